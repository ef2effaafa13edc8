"""The driver tables read as engine inputs; every definition grows linearly with its table.

nodes        part; a section of 250 consecutive parts is a group, the name's first word gives the role
edges        one record per line item: part -> part + quantity - 1, flipped for open lines, score from
             discount and tax in milli-units; ends past the last part stay, as dangling ends
channels     seven scores per line item for the same pair
catalog A/B  one text row per line item, rendered as the catalogs' tab-separated cells
locations    one row per part, text by noun and by part type
features     embeddings, assigned to parts in turn
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import constants as K
from edgeloom.functions.identifiers import normalize_score, pair_high, pair_low
from edgeloom.functions.vectors import dot, sigmoid
from edgeloom.operators.evidence import evidence_by_node, fold_flags, fold_hits, physical_edges
from edgeloom.operators.graph import induced_edges
from edgeloom.operators.pairs import candidate_pairs, dedupe_edges
from edgeloom.plans.atlas import build_atlas
from edgeloom.session import materialize, plan_by_memory
from edgeloom.sources.catalogs import parse_catalog_a, parse_catalog_b

SECTION = 250
HEADER_A = [
    "#Interaction ID", "Experimental System", "Experimental System Type", "Publication Source",
    "Organism ID Interactor A", "Organism ID Interactor B", "Throughput",
    "SWISS-PROT Accessions Interactor A", "TREMBL Accessions Interactor A",
    "SWISS-PROT Accessions Interactor B", "TREMBL Accessions Interactor B",
]
# --- fixed values: renderings per line number ---
ASSAYS = ["Two-hybrid", "Affinity Capture-MS", "PCA", "Co-fractionation", "Dosage Rescue", "Synthetic Lethality", "FRET"]
METHODS = ["MI:0018", "MI:0006", "MI:0397", "MI:0004", "MI:0676", "MI:0096", "MI:0030"]
# --- fixed values: location text per noun and per part type ---
NOUN_LOCATIONS = {
    "gear": "Nucleus.", "plate": "Cytoplasm, cytosol.", "bolt": "Cell cortex.",
    "ring": "Cytoplasm, cytoskeleton.", "anvil": "Secreted, extracellular space.", "rod": "Mitochondrion inner membrane.",
}
TYPE_COMPONENTS = {"PROMO": "C:plasma membrane", "SMALL": "C:nucleoplasm"}


def accession_of(key: Column) -> Column:
    """Ten-character accession of a part key, one to one up to 9.4e10 keys."""
    low, high = F.lpad((key % 10_000_000).cast("string"), 7, "0"), F.floor(key / 10_000_000)
    letter = lambda n: F.char(n + 65)                                      # noqa: E731
    return F.concat(letter(high % 14), F.substring(low, 1, 1), letter(F.floor(high / 14) % 26),
                    F.substring(low, 2, 3), letter(F.floor(high / 364) % 26), F.substring(low, 5, 3))


def _case(col: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)).otherwise(out)
    return out


class Inputs:
    """Lazy engine inputs over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        plan_by_memory(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- nodes ---
    @cached_property
    def nodes(self) -> DataFrame:
        first = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
        role = (F.when(first == "hot", K.ROLE_BOTH).when(first == "red", K.ROLE_A)
                .when(first == "blue", K.ROLE_B).otherwise(K.ROLE_PARTNER))
        group = F.floor(F.col("p_partkey") / SECTION)
        return self.table("part").select(
            F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), group.alias("group_id"),
            F.concat(F.lit("section "), group.cast("string")).alias("group_name"), role.alias("role"),
            accession_of(F.col("p_partkey")).alias("accession"))

    @cached_property
    def seeds(self) -> DataFrame:
        """Seed symbols per group, taken from the names that occur there."""
        first = F.split_part("symbol", F.lit(" "), F.lit(1))
        roles = (F.when(first == "hot", F.array(F.lit("a"), F.lit("b"))).when(first == "red", F.array(F.lit("a")))
                 .when(first == "blue", F.array(F.lit("b"))).otherwise(F.array().cast("array<string>")))
        names = self.nodes.select("group_id", F.col("name").alias("symbol")).distinct()
        return names.select("group_id", F.upper("symbol").alias("symbol"), F.explode(roles).alias("role"))

    # --- edges ---
    @cached_property
    def _lines(self) -> DataFrame:
        far = F.col("l_partkey") + F.col("l_quantity").cast("bigint") - 1
        raw = F.round(F.col("l_discount") * 6000 + F.col("l_tax") * 5000)
        return self.table("lineitem").withColumn("far", far).withColumn("raw_score", raw)

    @cached_property
    def raw_edges(self) -> DataFrame:
        near, far, flip = F.col("l_partkey"), F.col("far"), F.col("l_linestatus") == "O"
        src, dst = F.when(flip, far).otherwise(near), F.when(flip, near).otherwise(far)
        return self._lines.select(
            src.alias("src"), dst.alias("dst"), F.concat(F.lit("part "), src.cast("string")).alias("src_name"),
            F.concat(F.lit("part "), dst.cast("string")).alias("dst_name"),
            F.lit(None).cast("bigint").alias("group_id"), normalize_score("raw_score").alias("score"))

    @cached_property
    def scored_edges(self) -> DataFrame:
        """Same-group edges, best score per pair."""
        return induced_edges(dedupe_edges(self.raw_edges), self.nodes)

    @cached_property
    def slim_edges(self) -> DataFrame:
        """Scored same-group pairs without names: ``src < dst, score``."""
        best = (self.raw_edges.filter(F.col("src") != F.col("dst"))
                .groupBy(pair_low("src", "dst").alias("src"), pair_high("src", "dst").alias("dst"))
                .agg(F.max("score").alias("score")))
        return induced_edges(best, self.nodes)

    @cached_property
    def context(self) -> DataFrame:
        """Context graph: same-group pairs with a score of at least 0.7.  Written once, since most graph queries read it many times."""
        return materialize(self.slim_edges.filter(F.col("score") >= K.CONTEXT_SCORE).select("src", "dst", "score", "group_id"))

    @cached_property
    def channels(self) -> DataFrame:
        raw = {
            "nscore": F.when(F.col("l_tax") > 0, F.round(F.col("l_tax") * 10000)),
            "fscore": F.round(F.col("l_discount") * 9000),
            "pscore": F.col("l_quantity") * 18,
            "ascore": (F.col("l_linenumber") * 130).cast("double"),
            "escore": F.when(F.col("l_returnflag") == "R", 850.0).when(F.col("l_returnflag") == "N", 300.0).otherwise(0.0),
            "dscore": F.when(F.col("l_linestatus") == "F", 600.0).otherwise(0.0),
            "tscore": (F.dayofmonth("l_shipdate") * 30).cast("double"),
        }
        scores = [F.coalesce(normalize_score(v), F.lit(0.0)).alias(c) for c, v in raw.items()]
        return self._lines.select(F.col("l_partkey").alias("src"), F.col("far").alias("dst"),
                                  normalize_score("raw_score").alias("combined"), *scores)

    # --- catalogs ---
    @cached_property
    def _spread_lines(self) -> DataFrame:
        """The columns that the catalogs are rendered from, dealt evenly: rendering is heavy and a file may be one split."""
        slim = self._lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_tax", "l_returnflag", "l_linestatus", "far")
        return slim.repartition("l_orderkey", "l_linenumber")

    @cached_property
    def catalog_a_lines(self) -> DataFrame:
        n = F.col("l_linenumber")
        sort = (F.when((F.col("l_returnflag") == "R") & (F.round(F.col("l_tax") * 100) >= 7), F.lit("physical"))
                .when((F.col("l_returnflag") == "A") & (F.round(F.col("l_tax") * 100) >= 5), F.lit("Genetic "))
                .otherwise(F.lit("other")))
        near, far = accession_of(F.col("l_partkey")), accession_of(F.col("far"))
        cells = [
            F.col("l_orderkey").cast("string"), F.element_at(F.array(*map(F.lit, ASSAYS)), n), sort,
            F.concat(F.lit("PUBMED:"), (F.col("l_orderkey") + 1_000_000).cast("string")),
            F.lit("9606"), F.lit("9606"),
            F.when(F.col("l_linestatus") == "F", F.lit("Low Throughput")).otherwise(F.lit("High Throughput")),
            near, F.when(n == 7, accession_of(F.col("l_partkey") + 1)).otherwise(F.lit("-")),
            F.when(F.col("l_linestatus") == "O", F.concat(F.lit("uniprotkb:"), far, F.lit("-2"))).otherwise(far),
            F.lit("-"),
        ]
        return self._spread_lines.select(F.concat_ws("\t", *cells).alias("value"))

    @cached_property
    def catalog_b_lines(self) -> DataFrame:
        n, tax = F.col("l_linenumber"), F.round(F.col("l_tax") * 100).cast("int")
        near = F.concat(F.lit("uniprotkb:"), accession_of(F.col("l_partkey")))
        far = F.concat(F.lit("uniprotkb:"), accession_of(F.col("l_partkey") + n * 7))
        kind = (F.when(F.col("l_returnflag") == "R", F.lit('psi-mi:"MI:0407"(direct interaction)'))
                .when(F.col("l_returnflag") == "A", F.lit('psi-mi:"MI:0915"(physical association)'))
                .otherwise(F.lit('psi-mi:"MI:0914"(association)')))
        pub = F.concat(F.lit("pubmed:"), (F.col("l_orderkey") + 1_000_000).cast("string"),
                       F.when(n == 3, F.lit("|imex:IM-15364-1")).otherwise(F.lit("")))
        cells = [
            near, far, near, F.lit("-"), F.lit("-"), F.lit("-"),
            F.concat(F.lit('psi-mi:"'), F.element_at(F.array(*map(F.lit, METHODS)), n), F.lit('"(method)')),
            F.lit("-"), pub,
            F.when(tax == 0, F.lit("taxid:9606(human)")).otherwise(F.lit("taxid:10090(mouse)")), F.lit("-"), kind,
            F.lit("psi-mi:intact"), F.lit("-"), F.lit("-"),
        ]
        return self._spread_lines.select(F.concat_ws("\t", *cells).alias("value"))

    @cached_property
    def hits_a(self) -> DataFrame:
        return parse_catalog_a(self.catalog_a_lines, HEADER_A, self.nodes)

    @cached_property
    def hits_b(self) -> DataFrame:
        return parse_catalog_b(self.catalog_b_lines, self.nodes)

    @cached_property
    def hits(self) -> DataFrame:
        return self.hits_a.unionByName(self.hits_b)

    @cached_property
    def evidence(self) -> DataFrame:
        return fold_hits(self.hits)

    @cached_property
    def evidence_flags(self) -> DataFrame:
        return fold_flags(self.hits)

    @cached_property
    def physical(self) -> DataFrame:
        return physical_edges(self.evidence, self.nodes)

    @cached_property
    def physical_pairs(self) -> DataFrame:
        """Physical node pairs only: ``a, b, group_id`` straight from the flags, without text folding.

        Written once, because splits and negatives read it several times.
        """
        strong = (parse_catalog_a(self.catalog_a_lines, HEADER_A, self.nodes, kind="physical").unionByName(self.hits_b)
                  .select("acc_a", "acc_b").distinct())
        return materialize(evidence_by_node(strong, self.nodes.select("node_id", "accession", "group_id"))
                           .select("a", "b", "group_id").distinct())

    # --- locations, features, scores ---
    @cached_property
    def locations(self) -> DataFrame:
        noun = F.split_part("p_name", F.lit(" "), F.lit(2))
        return self.table("part").select(
            accession_of(F.col("p_partkey")).alias("accession"), _case(noun, NOUN_LOCATIONS).alias("location"),
            _case(F.col("p_type"), TYPE_COMPONENTS).alias("component"))

    @cached_property
    def features(self) -> DataFrame:
        emb = self.table("embeddings")
        n = emb.agg(F.count(F.lit(1)).alias("n")).scalar()
        return (self.nodes.select("node_id").withColumn("vec_id", F.col("node_id") % n)
                .join(emb.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("node_id", "vector"))

    @cached_property
    def candidate_scores(self) -> DataFrame:
        """Stand-in model score of every candidate pair: logistic of the feature product."""
        nodes = self.nodes.select("node_id", "group_id", "role").join(self.features, "node_id")
        p = F.round(sigmoid(dot("vector_a", "vector_b")), 9)
        return candidate_pairs(nodes).select("a", "b", p.alias("probability"))

    @cached_property
    def atlas(self) -> DataFrame:
        scores = self.candidate_scores.withColumn("rank", F.lit(None).cast("bigint"))
        return build_atlas(self.nodes, self.context, self.evidence, self.channels, self.locations, scores)
