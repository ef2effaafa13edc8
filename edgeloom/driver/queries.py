"""Registered queries: each runs one operator over the whole driver tables, next to its SQL oracle."""
from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import constants as K
from edgeloom import schema as S
from edgeloom.driver.inputs import HEADER_A, Inputs
from edgeloom.driver.oracle_parts import PK, acc, metric_ctes, overlap, sql
from edgeloom.functions.evidence import dominant_channel, is_tier1, location_overlap
from edgeloom.functions.identifiers import accessions, digits_sorted, method_ids, publication_ids, taxon
from edgeloom.functions.vectors import round_metric
from edgeloom.operators import blocks as BL
from edgeloom.operators import evidence as E
from edgeloom.operators import features as FE
from edgeloom.operators import graph as G
from edgeloom.operators import metrics as M
from edgeloom.operators import nodes as N
from edgeloom.operators import pairs as P
from edgeloom.operators import ranking as R
from edgeloom.operators import splits as SP
from edgeloom.plans import atlas as A
from edgeloom.plans import benchmark as B
from edgeloom.plans import hits as H
from edgeloom.plans import ingest as IN
from edgeloom.session import materialize, shared_folder
from edgeloom.sources import catalogs as CA
from edgeloom.sources import fasta as FA
from edgeloom.sources import tables as TB

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEEDS = K.BENCHMARK_SEEDS
DIM = 64


def query(name: str, oracle: str | None = None):
    """Register ``fn(inputs)`` under ``name``."""
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def n_rows(name="n"):
    return F.count(F.lit(1)).alias(name)


def _hist(col: str) -> list:
    return [n_rows(), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"),
            F.sum((F.col("a") * 31 + F.col("b")) % 1000003).alias(col)]


def checksum(df: DataFrame, *keys: str) -> DataFrame:
    """Row count and sums that change when any pair moves to another key."""
    return df.groupBy(*keys).agg(*_hist("mix"))


def checksum_sql(source: str, keys: str) -> str:
    return (f"SELECT {keys}, count(*) AS n, CAST(sum(a) AS BIGINT) AS sum_a, CAST(sum(b) AS BIGINT) AS sum_b, "
            f"CAST(sum((a * 31 + b) % 1000003) AS BIGINT) AS mix FROM {source} GROUP BY ALL")


# --- identifiers, scores, roles ---------------------------------------------------

@query("score_normalize", sql(["raw_edges"], "SELECT score, count(*) AS n FROM raw_edges GROUP BY 1"))
def _(x: Inputs):
    return x.raw_edges.groupBy("score").agg(n_rows())


@query("pair_canonical_edges", sql(["raw_edges"], """
SELECT least(src, dst) AS src, greatest(src, dst) AS dst, 'part ' || least(src, dst) AS src_name,
 'part ' || greatest(src, dst) AS dst_name, max(score) AS score FROM raw_edges WHERE src <> dst GROUP BY 1, 2"""))
def _(x):
    return P.dedupe_edges(x.raw_edges).drop("group_id")


@query("edge_set_both_ways", sql(["raw_edges"], """
SELECT u, count(*) AS n_neighbors, CAST(sum(v) AS BIGINT) AS sum_neighbors FROM (
 SELECT DISTINCT src AS u, dst AS v FROM raw_edges WHERE src <> dst UNION
 SELECT dst, src FROM raw_edges WHERE src <> dst) GROUP BY 1"""))
def _(x):
    return P.both_ways(P.canonical_pairs(x.raw_edges), "a", "b").groupBy(F.col("src").alias("u")).agg(
        n_rows("n_neighbors"), F.sum("dst").alias("sum_neighbors"))


@query("role_label", sql(["nodes"], "SELECT node_id, name, role FROM nodes"))
def _(x):
    return N.label_roles(x.nodes.drop("role"), x.seeds).select("node_id", "name", "role")


@query("seed_symbols", sql(["nodes"], """
SELECT DISTINCT group_id, CASE WHEN role = 'b' THEN lower(name) ELSE upper(name) END AS symbol FROM nodes
WHERE role <> 'partner'"""))
def _(x):
    spelled = x.seeds.withColumn("pos", F.when(F.col("role") == "a", 0).otherwise(1)).withColumn(
        "symbol", F.when(F.col("role") == "a", F.upper("symbol")).otherwise(F.lower("symbol")))
    return TB.unique_symbols(spelled).select("group_id", "symbol")


@query("accession_extract", sql(["lines"], f"""
SELECT accession, count(*) AS n FROM (
 SELECT {acc('l_partkey')} AS accession FROM lines UNION ALL SELECT {acc('far')} FROM lines WHERE far <> l_partkey)
GROUP BY 1"""))
def _(x):
    from edgeloom.driver.inputs import accession_of
    cell = F.concat(F.lit("uniprotkb:"), accession_of(F.col("l_partkey")), F.lit("-2|"),
                    accession_of(F.col("far")), F.lit("|Q9H0"))
    return x._lines.select(F.explode_outer(accessions(cell)).alias("accession")).groupBy("accession").agg(n_rows())


@query("pmid_extract", r"""
SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(ids, lambda s: CAST(s AS BIGINT))), lambda n: lpad(CAST(n AS VARCHAR), 9, '0')), ';') AS ids FROM (
 SELECT doc_id, list_distinct(regexp_extract_all(text, '(?i)(?:pubmed:|PMID:)?(\d{4,9})', 1)) AS ids FROM documents)
WHERE len(ids) > 0""")
def _(x):
    ids = publication_ids("text")
    padded = F.transform(digits_sorted("ids"), lambda s: F.lpad(s, 9, "0"))
    return (x.table("documents").select("doc_id", ids.alias("ids")).filter(F.size("ids") > 0)
            .select("doc_id", F.array_join(padded, ";").alias("ids")))


@query("mi_extract_tier1", sql(["hits_b"], """
SELECT method, itype, method IN ('MI:0018','MI:0397','MI:0096') OR itype = 'MI:0407' AS tier1, count(*) AS n
FROM hits_b GROUP BY ALL"""))
def _(x):
    flat = x.hits_b.select(
        F.array_join(method_ids("detection_method"), ";").alias("method"),
        F.array_join(method_ids("interaction_type"), ";").alias("itype"),
        is_tier1(F.array(F.lit("")), F.array("detection_method"), F.array("interaction_type")).alias("tier1"))
    return flat.groupBy("method", "itype", "tier1").agg(n_rows())


@query("taxon_parse", sql(["lines"], """
SELECT CAST(CASE WHEN tax = 0 THEN 9606 ELSE 10090 END AS INTEGER) AS taxon_a, CAST(NULL AS INTEGER) AS taxon_b, count(*) AS n
FROM lines GROUP BY 1"""))
def _(x):
    p = F.split("value", "\t", -1)
    return x.catalog_b_lines.select(taxon(F.get(p, F.lit(9))).alias("taxon_a"), taxon(F.get(p, F.lit(10))).alias("taxon_b")).groupBy(
        "taxon_a", "taxon_b").agg(n_rows())


# --- catalogs ------------------------------------------------------------------------

@query("catalog_a_parse", sql(["hits_a"], f"""
SELECT {acc('a')} AS acc_a, {acc('b')} AS acc_b, system, kind, pubs[1] AS publication, through AS throughput, count(*) AS n
FROM hits_a GROUP BY ALL"""))
def _(x):
    return x.hits_a.groupBy("acc_a", "acc_b", "system", F.lower(F.trim("system_type")).alias("kind"),
                            F.replace("publication", F.lit("PUBMED:"), F.lit("")).alias("publication"), "throughput").agg(n_rows())


@query("catalog_b_parse", sql(["hits_b"], f"""
SELECT {acc('a')} AS acc_a, {acc('b')} AS acc_b, method, itype, pubs[1] AS publication, CAST(9606 AS INTEGER) AS taxon_a, count(*) AS n
FROM hits_b GROUP BY ALL"""))
def _(x):
    return x.hits_b.groupBy(
        "acc_a", "acc_b", method_ids("detection_method")[0].alias("method"), method_ids("interaction_type")[0].alias("itype"),
        F.get(publication_ids("publication"), F.lit(0)).alias("publication"), "taxon_a").agg(n_rows())


@query("catalog_fold", sql(["evidence"], f"""
SELECT {acc('a')} AS acc_a, {acc('b')} AS acc_b, phys AS catalog_a_physical, gen AS catalog_a_genetic, cb AS catalog_b,
 assays, methods, n_pub AS n_publications, pubs AS publications, throughput FROM evidence"""))
def _(x):
    from edgeloom.functions.identifiers import joined_text
    mis = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("methods", method_ids)))), ";")
    return x.evidence.select(
        "acc_a", "acc_b", "catalog_a_physical", "catalog_a_genetic", "catalog_b", joined_text("assays").alias("assays"),
        mis.alias("methods"), F.size("publications").cast("bigint").alias("n_publications"),
        F.array_join(digits_sorted("publications"), ";").alias("publications"), joined_text("throughputs").alias("throughput"))


@query("physical_edges", sql(["physical"], f"""
SELECT a, b, {acc('a')} AS acc_a, {acc('b')} AS acc_b, group_id, tier1, phys AS catalog_a_physical, cb AS catalog_b, assays,
 n_pub AS n_publications FROM physical"""))
def _(x):
    return x.physical.withColumn("n_publications", F.col("n_publications").cast("bigint"))


@query("catalog_overlap", sql(["physical", "context"], """
SELECT count(*) FILTER (p.a IS NOT NULL AND c.a IS NOT NULL) AS n_both, count(*) FILTER (c.a IS NULL) AS n_only_physical,
 count(*) FILTER (p.a IS NULL) AS n_only_scored FROM physical p FULL JOIN context c ON c.a = p.a AND c.b = p.b"""))
def _(x):
    return E.catalog_overlap(x.physical_pairs, x.context.select(F.col("src").alias("a"), F.col("dst").alias("b")))


def _written(x: Inputs, name: str) -> str:
    """A new path in the shared folder for a table that is read back."""
    return f"{shared_folder(x.spark)}/{name}-{uuid.uuid4().hex}"


@query("catalog_files", sql(["hits_a", "hits_b"], f"""
SELECT {acc('a')} AS acc_a, {acc('b')} AS acc_b, source, system, CASE source WHEN 'a' THEN through ELSE '' END AS throughput, count(*) AS n
FROM (SELECT a, b, source, system, through FROM hits_a UNION ALL SELECT a, b, source, system, through FROM hits_b) GROUP BY ALL"""))
def _(x):
    """Both catalogs landed as files (A in two files whose columns differ in order) and read again."""
    cells = x.catalog_a_lines.select(F.split("value", "\t", -1).alias("p")).select(*[F.col("p")[i].alias(c) for i, c in enumerate(HEADER_A)])
    paths = []
    for odd, columns in ((0, HEADER_A), (1, HEADER_A[:1] + HEADER_A[:0:-1])):
        paths.append(_written(x, "catalog-a"))
        cells.filter(F.col(HEADER_A[0]).cast("bigint") % 2 == odd).select(*[F.col(f"`{c}`") for c in columns]).write.csv(paths[-1], sep="\t", header=True, compression="gzip")
    other = _written(x, "catalog-b")
    x.catalog_b_lines.write.text(other, compression="gzip")
    found = CA.read_catalog_a(x.spark, paths, x.nodes).unionByName(CA.read_catalog_b(x.spark, other, x.nodes))
    return found.groupBy("acc_a", "acc_b", "source", "system", "throughput").agg(n_rows())


@query("channel_file", sql(["channels"], "SELECT a, b, combined, " + ", ".join(K.CHANNELS) + " FROM channels"))
def _(x):
    path = _written(x, "channels")
    x.channels.withColumnsRenamed({"src": "stringId_A", "dst": "stringId_B", "combined": "combined_score"}).write.csv(path, header=True)
    rows = TB.read_channels(x.spark, path).withColumns({"src": F.col("src").cast("bigint"), "dst": F.col("dst").cast("bigint")})
    return P.best_channels(rows).select("a", "b", "combined", *K.CHANNELS)


@query("location_file", sql(["places"], f"""
SELECT {acc('node_id')} AS accession, array_to_string(bk, ';') AS buckets FROM places"""))
def _(x):
    path = _written(x, "locations")
    x.locations.select(F.col("accession").alias("Entry"), F.col("location").alias("Subcellular location [CC]"),
                       F.col("component").alias("Gene Ontology (cellular component)")).write.csv(path, sep="\t", header=True)
    return E.location_map(TB.read_locations(x.spark, path)).select("accession", F.array_join("buckets", ";").alias("buckets"))


@query("node_edge_files", sql(["nodes", "raw_edges"], f"""
SELECT 'node' AS kind, CAST(node_id AS VARCHAR) AS a, name AS b, group_id, role AS note, CAST(0 AS DOUBLE) AS score, CAST(1 AS BIGINT) AS n FROM nodes
UNION ALL SELECT 'edge', CAST(src AS VARCHAR), CAST(dst AS VARCHAR), CAST(-1 AS BIGINT), 'part ' || CAST(src AS VARCHAR), score, count(*) FROM raw_edges GROUP BY ALL"""))
def _(x):
    """Node and edge tables through the flat sink and the schema-bound readers."""
    at = _written(x, "nodes"), _written(x, "edges")
    TB.write_csv(x.nodes.withColumn("sequence_length", F.lit(0).cast("bigint")), at[0])
    TB.write_csv(x.raw_edges, at[1])
    nodes, edges = TB.read_nodes(x.spark, at[0]), TB.read_edges(x.spark, at[1])
    one = nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.col("name").alias("b"), "group_id", F.col("role").alias("note"),
                       F.lit(0.0).alias("score"), F.lit(1).cast("bigint").alias("n"))
    two = edges.groupBy(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.coalesce("group_id", F.lit(-1)).alias("group_id"),
                        F.col("src_name").alias("note"), "score").agg(n_rows())
    return one.unionByName(two)


@query("network_rows", sql(["raw_edges"], """
SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, CAST(7 AS BIGINT) AS group_id, score, count(*) AS n FROM raw_edges GROUP BY ALL"""))
def _(x):
    """Network records of the service (ids as text, scores in thousandths) into edge rows."""
    raw = x.raw_edges.select(F.col("src").cast("string").alias("stringId_A"), F.col("dst").cast("string").alias("stringId_B"),
                             F.col("src_name").alias("preferredName_A"), F.col("dst_name").alias("preferredName_B"), "score")
    return TB.edge_rows(raw, 7).groupBy("src", "dst", "group_id", "score").agg(n_rows())


@query("feature_file", sql(["vecs"], """
SELECT CAST(node_id AS VARCHAR) AS node_id, len(v) AS width, round(CAST(v[1] AS DOUBLE), 6) AS head, round(CAST(v[len(v)] AS DOUBLE), 6) AS tail FROM vecs"""))
def _(x):
    path = _written(x, "features")
    TB.write_features(x.features.withColumn("node_id", F.col("node_id").cast("string")), path)
    v = F.col("vector")
    return TB.read_features(x.spark, path).select("node_id", F.size(v).cast("bigint").alias("width"), round_metric(v[0].cast("double")).alias("head"),
                                                  round_metric(F.element_at(v, -1).cast("double")).alias("tail"))


@query("feature_alignment", sql(["nodes", "vecs"], """
SELECT kind, count(*) AS n, CAST(sum(node_id) AS BIGINT) AS sum_id FROM (
 SELECT node_id, 'no vector' AS kind FROM nodes WHERE node_id NOT IN (SELECT node_id FROM vecs WHERE node_id % 7 <> 0)
 UNION ALL SELECT node_id, 'no node' FROM vecs WHERE node_id % 7 <> 0 AND node_id NOT IN (SELECT node_id FROM nodes WHERE role <> 'a')) GROUP BY 1
"""))
def _(x):
    """Gaps in both directions, after every seventh vector was taken away; nodes of role a do not count as owners of vectors."""
    some = x.features.filter(F.col("node_id") % 7 != 0)
    lack = FE.feature_gaps(x.nodes, some).filter(F.col("kind") == "no vector")
    stray = FE.feature_gaps(x.nodes.filter(F.col("role") != "a"), some).filter(F.col("kind") == "no node")
    return lack.unionByName(stray).groupBy("kind").agg(n_rows(), F.sum("node_id").alias("sum_id"))


@query("sequence_json_file", f"""
SELECT CAST(doc_id AS VARCHAR) AS accession, source AS gene, md5(upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS digest FROM documents
WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 AND length(source) > 0""")
def _(x):
    path = _written(x, "entries")
    _sequences(x).select(F.col("node_id").cast("string").alias("primaryAccession"),
                         F.array(F.struct(F.struct(F.col("source").alias("value")).alias("geneName"))).alias("genes"),
                         F.struct(F.col("sequence").alias("value")).alias("sequence")).write.json(path)
    return TB.read_sequence_json(x.spark, path).select("accession", "gene", F.md5("sequence").alias("digest"))


@query("identifier_map_file", """
SELECT p_name AS query, min(p_partkey) AS best, count(*) AS n_hits FROM part GROUP BY 1""")
def _(x):
    path = _written(x, "map")
    x.table("part").select(
        F.col("p_name").alias("queryItem"), F.lit(0).alias("queryIndex"), F.lpad(F.col("p_partkey").cast("string"), 19, "0").alias("stringId"),
        F.lit(9606).alias("ncbiTaxonId"), F.lit("x").alias("taxonName"), F.col("p_name").alias("preferredName"), F.lit("y").alias("annotation"),
    ).write.csv(path, sep="\t", header=True)
    mapped = TB.read_identifier_map(x.spark, path)
    size = mapped.groupBy("queryItem").agg(n_rows("n_hits"))
    return TB.best_identifier(mapped, ["stringId"]).join(size, "queryItem").select(
        F.col("queryItem").alias("query"), F.col("stringId").cast("bigint").alias("best"), "n_hits")


@query("dominant_channel", sql(["channels"], "SELECT a, b, combined, dominant_channel FROM channels"))
def _(x):
    return P.best_channels(x.channels).select("a", "b", "combined", dominant_channel().alias("dominant_channel"))


# --- locations -------------------------------------------------------------------------

@query("location_buckets", sql(["places"], f"""
SELECT {acc('node_id')} AS accession, array_to_string(bk, ';') AS buckets FROM places"""))
def _(x):
    return E.location_map(x.locations).select("accession", F.array_join("buckets", ";").alias("buckets"))


@query("location_overlap", sql(["cand", "places"], f"""
SELECT group_id, {overlap('x.bk', 'y.bk')} AS overlap, count(*) AS n_pairs FROM cand
JOIN places x ON x.node_id = a JOIN places y ON y.node_id = b GROUP BY ALL"""))
def _(x):
    placed = A.atlas_nodes(x.nodes, x.context.select(F.col("src").alias("a"), F.col("dst").alias("b")), x.locations)
    met = A.profile_pairs(placed, "buckets")
    return met.groupBy("group_id", location_overlap("l_buckets", "r_buckets").alias("overlap")).agg(
        (F.sum("twice_pairs") / 2).cast("bigint").alias("n_pairs")).filter("n_pairs > 0")


# --- sequences ---------------------------------------------------------------------------

_LETTERS = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


def _sequences(x: Inputs) -> DataFrame:
    return x.table("documents").select(
        F.col("doc_id").alias("node_id"), "source", "lang", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"))


@query("fasta_roundtrip", f"""
SELECT CAST(doc_id AS VARCHAR) AS node_id, length({_LETTERS}) AS n_residues, md5({_LETTERS}) AS digest FROM documents""")
def _(x):
    path = f"{shared_folder(x.spark)}/fasta-{uuid.uuid4().hex}"
    nodes = _sequences(x).withColumns({"name": F.col("source"), "group_id": F.lit(0), "role": F.col("lang"), "accession": F.lit("-")})
    FA.write_fasta(nodes, path)
    return FA.read_fasta(x.spark, path).select(
        "node_id", F.length("sequence").cast("bigint").alias("n_residues"), F.md5("sequence").alias("digest"))


@query("sequence_truncate", f"""
SELECT doc_id AS node_id, n_chars > {K.MAX_RESIDUES} AS truncated, length(substr(text, 1, {K.MAX_RESIDUES})) AS n_residues,
 md5(substr(text, 1, {K.MAX_RESIDUES})) AS digest FROM documents""")
def _(x):
    seq = x.table("documents").select(F.col("doc_id").alias("node_id"), F.col("text").alias("sequence"))
    return N.truncate_sequences(seq).select(
        "node_id", "truncated", F.length("sequence").cast("bigint").alias("n_residues"), F.md5("sequence").alias("digest"))


@query("truncation_report", f"""
SELECT count(*) AS n_sequences, count(*) FILTER (length(text) > {K.MAX_RESIDUES}) AS n_truncated,
 CAST(sum(CASE WHEN length(text) > {K.MAX_RESIDUES} THEN doc_id ELSE 0 END) AS BIGINT) AS id_sum FROM documents""")
def _(x):
    seq = x.table("documents").select(F.col("doc_id").alias("node_id"), F.col("text").alias("sequence"))
    return N.truncate_sequences(seq).agg(
        n_rows("n_sequences"), F.count_if("truncated").alias("n_truncated"),
        F.sum(F.when(F.col("truncated"), F.col("node_id")).otherwise(0)).alias("id_sum"))


def _sequence_json(x: Inputs) -> DataFrame:
    """Documents rendered as nested sequence entries and read back through the schema."""
    entry = F.to_json(F.struct(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("primaryAccession"),
        F.array(F.struct(F.struct(F.concat_ws("-", "source", "lang").alias("value")).alias("geneName"))).alias("genes"),
        F.struct(F.col("text").alias("value")).alias("sequence")))
    parsed = x.table("documents").select("doc_id", F.from_json(entry, S.SEQUENCE_JSON).alias("e")).select("doc_id", "e.*")
    return TB.sequence_rows(parsed).withColumnRenamed("doc_id", "pos")


_BEST = """SELECT upper(source || '-' || lang) AS gene_key, 'D' || doc_id AS accession, length(text) AS n_residues, md5(text) AS digest
FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, doc_id) AS rn FROM documents {where}) WHERE rn = 1"""


@query("longest_per_key", _BEST.format(where=""))
def _(x):
    return N.longest_sequences(_sequence_json(x)).select(
        "gene_key", "accession", F.length("sequence").cast("bigint").alias("n_residues"), F.md5("sequence").alias("digest"))


@query("first_per_key", "SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1")
def _(x):
    return R.first_per_key(x.table("documents").select("source", "doc_id", "lang", "n_chars"), ["source"], ["doc_id"])


@query("fallback_lookup", """
WITH d AS (SELECT upper(source || '-' || lang) AS gene_key, doc_id, length(text) AS n,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS curated FROM documents),
 b AS (SELECT *, row_number() OVER (PARTITION BY gene_key ORDER BY curated DESC, n DESC, doc_id) AS rn FROM d)
SELECT gene_key, 'D' || doc_id AS accession, n AS n_residues FROM b WHERE rn = 1""")
def _(x):
    good = x.table("labels").filter("quality = 1").select(F.col("doc_id").alias("pos")).distinct()
    seq = _sequence_json(x)
    first = N.longest_sequences(seq.join(good, "pos", "left_semi"))
    second = N.longest_sequences(seq.join(good, "pos", "left_anti"))
    return N.with_fallback(first, second, "gene_key").select(
        "gene_key", "accession", F.length("sequence").cast("bigint").alias("n_residues"))


@query("attach_sequences", """
WITH best AS (SELECT source, doc_id, length(text) AS n FROM (
 SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rn FROM documents) WHERE rn = 1)
SELECT d.doc_id AS node_id, 'D' || b.doc_id AS accession, b.n AS sequence_length FROM documents d JOIN best b ON b.source = d.source""")
def _(x):
    docs = x.table("documents")
    seq = N.longest_sequences(docs.select(
        F.col("source").alias("gene"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("accession"),
        F.col("text").alias("sequence"), F.col("doc_id").alias("pos")))
    return N.attach_sequences(docs.select(F.col("doc_id").alias("node_id"), F.col("source").alias("name")), seq).select(
        "node_id", "accession", F.col("sequence_length").cast("bigint").alias("sequence_length"))


# --- graph ---------------------------------------------------------------------------------

@query("induced_subgraph", sql(["slim"], "SELECT a AS src, b AS dst, score, group_id FROM slim"))
def _(x):
    return x.slim_edges.select("src", "dst", "score", "group_id")


@query("missing_endpoints", sql(["raw_edges", "nodes"], """
SELECT node_id, count(*) AS n_ends FROM (SELECT src AS node_id FROM raw_edges UNION ALL SELECT dst FROM raw_edges) e
ANTI JOIN nodes USING (node_id) GROUP BY 1"""))
def _(x):
    return G.missing_endpoints(x.raw_edges, x.nodes)


@query("partner_expansion", sql(["nodes", "context"], """
SELECT node_id FROM nodes WHERE role <> 'partner' UNION
SELECT v FROM (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY score DESC, v) AS rn FROM (
 SELECT a AS u, b AS v, score FROM context UNION ALL SELECT b, a, score FROM context)
 WHERE u IN (SELECT node_id FROM nodes WHERE role <> 'partner')) WHERE rn <= 20"""))
def _(x):
    return G.expand_partners(N.role_nodes(x.nodes), x.slim_edges)


_INGEST = """net AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(score) AS score FROM raw_edges
 JOIN nodes x ON x.node_id = src JOIN nodes y ON y.node_id = dst AND y.group_id = x.group_id WHERE src <> dst
 GROUP BY 1, 2 HAVING max(score) >= 0.7),
picked AS (SELECT node_id FROM nodes WHERE role <> 'partner' UNION SELECT v FROM (
 SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY score DESC, v) AS rn FROM (
  SELECT a AS u, b AS v, score FROM net UNION ALL SELECT b, a, score FROM net)
 WHERE u IN (SELECT node_id FROM nodes WHERE role <> 'partner')) WHERE rn <= 20),
kept AS (SELECT node_id, group_id FROM nodes SEMI JOIN picked USING (node_id)),
links AS (SELECT a, b, x.group_id FROM net JOIN kept x ON x.node_id = a JOIN kept y ON y.node_id = b AND y.group_id = x.group_id),
ends AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node_id, node_id AS r FROM kept UNION SELECT reach.node_id, v FROM reach JOIN ends ON u = r),
comp AS (SELECT node_id, min(r) AS c FROM reach GROUP BY 1)"""


@query("ingest_summary", sql(["raw_edges", "nodes"], """
SELECT group_id, CAST(sum(n) AS BIGINT) AS n_nodes, CAST(sum(e) AS BIGINT) AS n_edges, CAST(sum(c) AS BIGINT) AS n_components,
 CAST(sum(i) AS BIGINT) AS n_isolates FROM (
 SELECT group_id, 1 AS n, 0 AS e, CASE WHEN node_id = c THEN 1 ELSE 0 END AS c,
  CASE WHEN node_id IN (SELECT u FROM ends) THEN 0 ELSE 1 END AS i FROM kept JOIN comp USING (node_id)
 UNION ALL SELECT group_id, 0, 1, 0, 0 FROM links) GROUP BY ROLLUP (group_id)""", _INGEST).replace("WITH ", "WITH RECURSIVE ", 1))
def _(x):
    names = x.nodes.select("node_id", "name", "group_id", "group_name")
    seq = x.nodes.select("group_id", F.upper("name").alias("gene_key"), F.col("name").alias("accession"), F.col("name").alias("sequence")).distinct()
    nodes, edges = IN.ingest_graph(names, x.raw_edges, x.seeds, seq)
    return IN.ingest_summary(nodes, edges)


@query("degrees", sql(["deg"], "SELECT node_id, degree FROM deg"))
def _(x):
    return G.degrees(x.nodes, x.context)


@query("holdout_degrees", sql(["run_deg"], "SELECT protocol, seed, node_id, degree FROM run_deg WHERE protocol = 'edge_random'"))
def _(x):
    pos = SP.split_edges_random(x.physical_pairs, SEEDS)
    return SP.holdout_degrees(x.nodes, _context_pairs(x), pos)


def _context_pairs(x: Inputs) -> DataFrame:
    return x.context.select(F.col("src").alias("a"), F.col("dst").alias("b"))


@query("shared_neighbors", sql(["shared"], "SELECT a, b, shared FROM shared"))
def _(x):
    return G.candidate_shared(x.nodes, P.both_ways(x.context))


_REACH = "reach AS (SELECT node_id, node_id AS r FROM nodes UNION SELECT reach.node_id, adj.v FROM reach JOIN adj ON adj.u = reach.r)"


@query("components", sql(["adj", "nodes"], "SELECT node_id, min(r) AS component FROM reach GROUP BY 1", _REACH).replace(
    "WITH ", "WITH RECURSIVE ", 1))
def _(x):
    return G.connected_components(x.nodes, x.context)


@query("graph_summary", sql(["deg"], """
SELECT group_id, count(*) AS n_nodes, CAST(sum(degree) / 2 AS BIGINT) AS n_edges, round(avg(degree), 6) AS mean_degree,
 round(median(degree), 6) AS median_degree, max(degree) AS max_degree, count(*) FILTER (degree = 0) AS n_isolates,
 round(sum(degree) / (count(*) * (count(*) - 1)), 6) AS density FROM deg GROUP BY 1"""))
def _(x):
    out = G.graph_summary(x.nodes, x.context)
    for c in ("mean_degree", "median_degree", "density"):
        out = out.withColumn(c, round_metric(c))
    return out.withColumn("n_isolates", F.col("n_isolates").cast("bigint"))


_LINK = ["cand", "deg", "adj"]
_LINK_SUMS = """s AS (SELECT c.a, c.b, count(*) AS sh, sum(CASE WHEN d.degree > 1 THEN 1.0 / ln(d.degree) ELSE 0 END) AS aa
 FROM cand c JOIN adj p ON p.u = c.a JOIN adj q ON q.u = c.b AND q.v = p.v JOIN deg d ON d.node_id = p.v GROUP BY 1, 2),
l AS (SELECT c.a, c.b, x.degree AS da, y.degree AS db, coalesce(s.sh, 0) AS sh, coalesce(s.aa, 0.0) AS aa FROM cand c
 JOIN deg x ON x.node_id = c.a JOIN deg y ON y.node_id = c.b LEFT JOIN s ON s.a = c.a AND s.b = c.b)"""


def _links(x: Inputs) -> DataFrame:
    return G.candidate_link_scores(x.nodes, x.context)


@query("jaccard", sql(_LINK, "SELECT a, b, round(CASE WHEN da + db - sh > 0 THEN sh / (da + db - sh) ELSE 0.0 END, 6) AS jaccard FROM l", _LINK_SUMS))
def _(x):
    return _links(x).select("a", "b", round_metric("jaccard").alias("jaccard"))


@query("adamic_adar", sql(_LINK, "SELECT a, b, round(aa, 6) AS adamic_adar FROM l", _LINK_SUMS))
def _(x):
    return _links(x).select("a", "b", round_metric("adamic_adar").alias("adamic_adar"))


@query("preferential_attachment", sql(_LINK, "SELECT a, b, CAST(da * db AS DOUBLE) AS preferential_attachment FROM l", _LINK_SUMS))
def _(x):
    return _links(x).select("a", "b", "preferential_attachment")


@query("l3_walks", sql(["cand", "adj"], """
SELECT a, b, count(*) AS l3 FROM cand JOIN adj p ON p.u = a JOIN adj m ON m.u = p.v JOIN adj q ON q.u = m.v AND q.v = b GROUP BY 1, 2"""))
def _(x):
    return G.candidate_three_walks(x.nodes.select("node_id", "group_id", "role"), P.both_ways(x.context))


# --- candidates and atlas --------------------------------------------------------------------

@query("candidate_pairs", sql(["cand"], "SELECT group_id, a, b, ra AS role_a, rb AS role_b FROM cand"))
def _(x):
    return P.candidate_pairs(x.nodes.select("node_id", "group_id", "role"))


@query("novel_candidates", sql(["cand", "context"], "SELECT group_id, a, b FROM cand ANTI JOIN context USING (a, b)"))
def _(x):
    return P.novel_candidates(x.nodes.select("node_id", "group_id", "role"), _context_pairs(x)).select("group_id", "a", "b")


def _atlas_nodes(x: Inputs) -> DataFrame:
    return A.atlas_nodes(x.nodes, _context_pairs(x), x.locations)


@query("degree_product_cutoff", sql(["cand", "deg"], """
SELECT quantile_cont(x.degree * y.degree, 0.9) AS cutoff FROM cand JOIN deg x ON x.node_id = a JOIN deg y ON y.node_id = b"""))
def _(x):
    return A.degree_product_cutoff(_atlas_nodes(x))


@query("atlas", sql(["graded"], """
SELECT group_id, group_name, na AS name_a, nb AS name_b, a, b, aa AS accession_a, ab AS accession_b, ra AS role_a, rb AS role_b,
 dega AS degree_a, degb AS degree_b, dp AS degree_product, shared AS shared_neighbors, comb AS string_combined,
 in_graph AS string_in_graph, dom AS dominant_channel, phys AS catalog_a_physical, gen AS catalog_a_genetic, cb AS catalog_b,
 gen_only AS genetic_only, n_pub AS n_publications, ov AS localization_overlap, p AS probability,
 cutoff AS degree_product_cutoff, cls AS evidence_class, absent AS string_absent, assays, pubs AS publications, throughput,
 array_to_string(bka, ';') AS location_a, array_to_string(bkb, ';') AS location_b FROM graded"""))
def _(x):
    return x.atlas.drop(*K.CHANNELS, "model_rank", "methods", "interaction_types").withColumn("n_publications", F.col("n_publications").cast("bigint"))


def _counts(x: Inputs) -> DataFrame:
    return A.class_counts(x.nodes, x.context, x.evidence_flags, x.channels, x.locations)


@query("atlas_stats", sql(["graded"], """
SELECT group_id, cls AS evidence_class, count(*) AS n_pairs, count(*) FILTER (absent) AS n_absent,
 count(*) FILTER (phys OR cb) AS n_physical, count(*) FILTER (gen_only) AS n_genetic_only
FROM graded GROUP BY ROLLUP (group_id, cls)"""))
def _(x):
    return A.group_stats(_counts(x))


_SUMMARY = """SELECT count(*) AS n_pairs, count(*) FILTER (absent) AS n_absent, count(*) FILTER (NOT absent) AS n_present,
 count(*) FILTER (cls = 'physical_curated') AS n_physical, count(*) FILTER (absent AND (phys OR cb)) AS n_physical_absent,
 count(*) FILTER (absent AND cls = 'unreported') AS n_unreported_absent, count(*) FILTER (gen_only) AS n_genetic_only FROM graded"""


@query("atlas_summary", sql(["graded"], f"""
SELECT *, round(n_physical_absent / greatest(n_absent, 1), 6) AS frac_physical_absent,
 round(n_unreported_absent / greatest(n_absent, 1), 6) AS frac_unreported_absent FROM ({_SUMMARY})"""))
def _(x):
    out = A.atlas_summary(_counts(x))
    return out.withColumn("frac_physical_absent", round_metric("frac_physical_absent")).withColumn(
        "frac_unreported_absent", round_metric("frac_unreported_absent"))


_RHO = """ranked AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r1,
 rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS r2 FROM graded WHERE absent AND p IS NOT NULL)"""


def _absent_scored(x: Inputs) -> DataFrame:
    """Absent candidate pairs with score, degree product and shared neighbours."""
    nodes = G.with_degree(N.role_nodes(x.nodes).select("node_id", "group_id", "role"), x.context)
    pairs = P.candidate_pairs(nodes).withColumn("degree_product", F.col("degree_a") * F.col("degree_b"))
    present = _context_pairs(x).unionByName(
        P.best_channels(x.channels).filter(F.col("combined") >= K.CONTEXT_SCORE).select("a", "b")).distinct()
    return pairs.join(present, ["a", "b"], "left_anti").join(x.candidate_scores, ["a", "b"])


@query("spearman", sql(["graded"], "SELECT count(*) AS n_rows, round(corr(r1, r2), 6) AS rho FROM ranked", _RHO.format(y="dp")))
def _(x):
    return A.spearman(_absent_scored(x), "probability", "degree_product").withColumn("rho", round_metric("rho"))


@query("spearman_shared", sql(["graded"], "SELECT count(*) AS n_rows, round(corr(r1, r2), 6) AS rho FROM ranked", _RHO.format(y="shared")))
def _(x):
    """Model score against shared neighbours, over the absent pairs."""
    shared = G.candidate_shared(x.nodes, P.both_ways(x.context))
    rows = _absent_scored(x).select("a", "b", "probability").join(shared, ["a", "b"], "left").fillna(0, ["shared"])
    return A.spearman(rows, "probability", "shared").withColumn("rho", round_metric("rho"))


@query("atlas_order", sql(["graded"], """
SELECT a, b, row_number() OVER (ORDER BY group_id, na, nb, a, b) AS position FROM graded"""))
def _(x):
    """The ordered sink: rows keep the place they are written in."""
    nodes = x.nodes.select("node_id", "name", "group_id", "role")
    rows = P.candidate_pairs(nodes).select("group_id", "name_a", "name_b", "a", "b")
    return R.global_rank(rows, A.SINK_ORDER, name="position").select("a", "b", "position")


@query("location_flags", sql(["cand", "places"], """
SELECT n.p_partkey AS node_id, CAST(CASE WHEN len(p.bk) > 0 AND p.node_id IN (SELECT a FROM cand UNION SELECT b FROM cand) THEN 1 ELSE 0 END AS BIGINT) AS flag
FROM part n JOIN places p ON p.node_id = n.p_partkey"""))
def _(x):
    """Flags from the atlas; a test holds ``bucket_flags`` equal to them."""
    placed = A.atlas_nodes(x.nodes, _context_pairs(x), x.locations).select("node_id", "group_id", "role", F.array_join("buckets", ";").alias("location"))
    return FE.location_flags(x.nodes, P.candidate_pairs(placed)).select("node_id", F.col("flag").cast("bigint").alias("flag"))


@query("atlas_gate", sql(["graded"], f"""
SELECT n_absent, round(fp, 6) AS frac_physical_absent, round(fu, 6) AS frac_unreported_absent, round(rho, 6) AS rho,
 NOT (n_absent = 0 OR fp >= 0.9) AS run_benchmark,
 CASE WHEN n_absent = 0 THEN 'no absent candidate pairs'
  WHEN fp >= 0.9 THEN 'absent pairs are already curated: publish a missingness resource'
  WHEN fu >= 0.15 THEN 'a large unreported set remains'
  WHEN abs(rho) >= 0.3 THEN 'model scores follow the degree product' ELSE 'sources disagree' END AS reason
FROM (SELECT *, n_physical_absent / greatest(n_absent, 1) AS fp, n_unreported_absent / greatest(n_absent, 1) AS fu,
 (SELECT corr(r1, r2) FROM ranked) AS rho FROM ({_SUMMARY}))""", _RHO.format(y="dp")))
def _(x):
    out = A.atlas_gate(A.atlas_summary(_counts(x)), A.spearman(_absent_scored(x), "probability", "degree_product"))
    for c in ("frac_physical_absent", "frac_unreported_absent", "rho"):
        out = out.withColumn(c, round_metric(c))
    return out


@query("atlas_qc", sql(["graded", "hits", "physical", "channels"], """
SELECT unnest(['n_nodes','n_role_nodes','n_pairs','n_scored','n_records','n_evidence_pairs','n_physical_edges','n_tier1_edges','n_channel_pairs']) AS metric,
 unnest([(SELECT count(*) FROM nodes), (SELECT count(*) FROM nodes WHERE role <> 'partner'), (SELECT count(*) FROM graded),
  (SELECT count(p) FROM graded), (SELECT count(*) FROM hits), (SELECT count(*) FROM evidence), (SELECT count(*) FROM physical),
  (SELECT count(*) FROM physical WHERE tier1), (SELECT count(*) FROM channels)]) AS value"""))
def _(x):
    pairs = P.candidate_pairs(x.nodes.select("node_id", "group_id", "role")).select("a", "b").join(
        x.candidate_scores.select("a", "b", "probability"), ["a", "b"], "left")
    graded = materialize(E.fold_grades(x.hits))                                 # the catalogs are parsed once
    return A.quality_counts(x.nodes, pairs, graded, E.physical_grades(graded, x.nodes), x.channels)


@query("rank_absent", sql(["graded"], """
SELECT a, b, p AS probability, row_number() OVER (ORDER BY p DESC NULLS LAST, a, b) AS rank_among_absent FROM graded WHERE absent"""))
def _(x):
    pairs = _absent_scored(x).select("a", "b", "probability").withColumn("string_absent", F.lit(True))
    return A.rank_absent(pairs).select("a", "b", "probability", "rank_among_absent")


@query("top_absent", sql(["graded"], """
SELECT a, b, cls AS evidence_class, p AS probability, comb AS string_combined, dom AS dominant_channel, n_pub AS n_publications,
 assays, ov AS localization_overlap, dp AS degree_product, shared AS shared_neighbors
FROM graded WHERE absent ORDER BY p DESC, a, b LIMIT 10"""))
def _(x):
    return A.top_absent(x.atlas).select(
        "a", "b", "evidence_class", "probability", "string_combined", "dominant_channel",
        F.col("n_publications").cast("bigint").alias("n_publications"), "assays", "localization_overlap", "degree_product", "shared_neighbors")


@query("top_per_group", sql(["scores"], """
SELECT group_id, a, b, p AS probability, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY p DESC, a, b) AS rank FROM scores) WHERE rank <= 15"""))
def _(x):
    scored = P.candidate_pairs(x.nodes.select("node_id", "group_id", "role")).select("group_id", "a", "b").join(
        x.candidate_scores, ["a", "b"])
    return H.top_per_group(scored).select(
        "group_id", "a", "b", "probability", F.col("rank").cast("bigint").alias("rank"))


_HITS = """top AS (SELECT *, row_number() OVER (ORDER BY p DESC, a, b) AS rank FROM scores ANTI JOIN context USING (a, b)
 ORDER BY p DESC, a, b LIMIT 50)"""


def _hits(x: Inputs) -> DataFrame:
    novel = P.novel_candidates(x.nodes.select("node_id", "group_id", "role"), _context_pairs(x))
    return H.top_hits(novel.join(x.candidate_scores, ["a", "b"]))


@query("hit_list", sql(["scores", "context"], "SELECT rank, a, b, group_id, p AS probability FROM top", _HITS))
def _(x):
    return _hits(x).select(F.col("rank").cast("bigint").alias("rank"), "a", "b", "group_id", "probability")


_WIDTH = 4
_OUT, _OUT_BIAS = (1.0, -1.0, 1.5, -0.5), -0.1


def _network() -> BL.PairNetwork:
    """Fixed weights by a stated rule, so that SQL computes the same scores; a fitted perceptron takes the same way."""
    i, j = np.arange(3 * DIM)[None, :], np.arange(_WIDTH)[:, None]
    return BL.PairNetwork(((7 * i + 13 * j) % 11 - 5) / 40.0, (np.arange(_WIDTH) - 1) / 4.0, np.array(_OUT), _OUT_BIAS)


def _dots(value: str, start: int, name: str) -> str:
    return ", ".join(f"sum({value} * (((7 * (i + {start}) + 13 * {j}) % 11 - 5) / 40.0::DOUBLE)) AS {name}{j}" for j in range(_WIDTH))


def _hidden(one: str, two: str) -> str:
    return " + ".join(f"{_OUT[j]}::DOUBLE / (1.0::DOUBLE + exp(-({one}.f{j} + {two}.s{j} + d.d{j} + {(j - 1) / 4.0}::DOUBLE)))" for j in range(_WIDTH))


_NETWORK = f"""slots AS MATERIALIZED (SELECT node_id, {_dots('v', 0, 'f')}, {_dots('v', DIM, 's')} FROM (
  SELECT node_id, CAST(unnest(v) AS DOUBLE) AS v, unnest(range({DIM})) AS i FROM vecs) GROUP BY 1),
 apart AS MATERIALIZED (SELECT a, b, group_id, {_dots('abs(x - y)', 2 * DIM, 'd')} FROM (
  SELECT c.a, c.b, c.group_id, CAST(unnest(x.v) AS DOUBLE) AS x, CAST(unnest(y.v) AS DOUBLE) AS y, unnest(range({DIM})) AS i
  FROM cand c JOIN vecs x ON x.node_id = c.a JOIN vecs y ON y.node_id = c.b) GROUP BY ALL),
 modelled AS MATERIALIZED (SELECT d.a, d.b, d.group_id, round(1.0 / (1.0 + exp(-(({_hidden('x', 'y')} + {_hidden('y', 'x')}) / 2.0 + {_OUT_BIAS}::DOUBLE))), 9) AS p
  FROM apart d JOIN slots x ON x.node_id = d.a JOIN slots y ON y.node_id = d.b)"""


@query("model_hit_list", sql(["cand", "vecs", "context"], """
SELECT row_number() OVER (ORDER BY p DESC, a, b) AS rank, a, b, group_id, p AS probability FROM modelled ANTI JOIN context USING (a, b)
ORDER BY p DESC, a, b LIMIT 50""", _NETWORK))
def _(x):
    """Best novel candidates of the fixed pair network, scored block against block."""
    found = H.hit_list(x.nodes, _context_pairs(x), _network(), x.features)
    return found.select(F.col("rank").cast("bigint").alias("rank"), "a", "b", "group_id", "probability")


@query("model_rank_candidates", sql(["cand", "vecs"], "SELECT row_number() OVER (ORDER BY p DESC, a, b) AS rank, a, b, p AS probability FROM modelled", _NETWORK))
def _(x):
    """Every candidate pair ranked by the fixed pair network."""
    return H.rank_candidates(x.nodes, _network(), x.features).select(F.col("rank").cast("bigint").alias("rank"), "a", "b", "probability")


@query("display_subgraph", sql(["scores", "context", "slim"], """
SELECT a, b, 'predicted' AS kind, p AS probability FROM top UNION ALL
SELECT a, b, 'known', score FROM slim ANTI JOIN top USING (a, b)
WHERE a IN (SELECT a FROM top UNION SELECT b FROM top) AND b IN (SELECT a FROM top UNION SELECT b FROM top)""", _HITS))
def _(x):
    _, edges = G.display_subgraph(_hits(x), x.slim_edges, x.nodes)
    return edges


@query("display_nodes", sql(["scores", "context", "nodes"], """
SELECT node_id, name, role, group_name FROM nodes WHERE node_id IN (SELECT a FROM top UNION SELECT b FROM top)""", _HITS))
def _(x):
    return G.display_subgraph(_hits(x), x.slim_edges, x.nodes)[0]


@query("label_disambiguate", sql(["nodes"], """
SELECT node_id, name || CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN ' (' || group_id || ')' ELSE '' END AS label
FROM nodes WHERE name IN ('red anvil','red bolt','red gear','red gizmo','red plate','red ring','red rod','red widget')"""))
def _(x):
    names = ["red " + n for n in ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")]
    return N.seed_labels(x.nodes, names, F.col("group_id").cast("string")).select("node_id", "label")


# --- metrics ------------------------------------------------------------------------------------

_LABELLED = """labelled AS (SELECT c.group_id, c.a, c.b, CASE WHEN f.a IS NULL THEN 0 ELSE 1 END AS label,
 CAST(coalesce(s.shared, 0) AS DOUBLE) AS score, sc.p FROM cand c LEFT JOIN physical f ON f.a = c.a AND f.b = c.b
 LEFT JOIN shared s ON s.a = c.a AND s.b = c.b JOIN scores sc ON sc.a = c.a AND sc.b = c.b)"""
_LABEL_NEEDS = ["cand", "physical", "shared", "scores"]


def _labelled(x: Inputs) -> DataFrame:
    """Candidates labelled by physical support and scored by shared neighbours (many ties)."""
    pairs = P.candidate_pairs(x.nodes.select("node_id", "group_id", "role"))
    shared = G.candidate_shared(x.nodes, P.both_ways(x.context))
    strong = x.physical_pairs.select("a", "b", F.lit(1).alias("label"))
    return pairs.select("group_id", "a", "b").join(strong, ["a", "b"], "left").join(shared, ["a", "b"], "left").select(
        "group_id", "a", "b", F.coalesce("label", F.lit(0)).alias("label"),
        F.coalesce("shared", F.lit(0)).cast("double").alias("score"))


@query("auroc_ap", sql(_LABEL_NEEDS, "SELECT group_id, round(auroc, 6) AS auroc, round(ap, 6) AS ap FROM metrics",
                       _LABELLED + ",\n" + metric_ctes("labelled", ["group_id"])))
def _(x):
    return M.auroc_ap(_labelled(x), ["group_id"]).select("group_id", round_metric("auroc").alias("auroc"), round_metric("ap").alias("ap"))


@query("precision_at_k", sql(_LABEL_NEEDS, "SELECT group_id, round(p_at_10, 6) AS p_at_10, round(p_at_20, 6) AS p_at_20, round(p_at_50, 6) AS p_at_50 FROM metrics",
                             _LABELLED + ",\n" + metric_ctes("labelled", ["group_id"])))
def _(x):
    out = M.ranking_metrics(_labelled(x), ["group_id"])
    return out.select("group_id", *[round_metric(f"p_at_{k}").alias(f"p_at_{k}") for k in K.PRECISION_KS])


@query("bce_loss", sql(_LABEL_NEEDS, """
SELECT group_id, round(avg(ln(1 + exp(-abs(z))) + greatest(z, 0) - z * label), 6) AS loss FROM (SELECT *, ln(p / (1 - p)) AS z FROM labelled) GROUP BY 1""", _LABELLED))
def _(x):
    strong = x.physical_pairs.select("a", "b", F.lit(1).alias("label"))
    nodes = x.nodes.select("node_id", "group_id", "role")
    rows = (P.candidate_pairs(nodes).select("group_id", "a", "b").join(x.candidate_scores, ["a", "b"]).join(strong, ["a", "b"], "left")
            .withColumn("label", F.coalesce("label", F.lit(0))).withColumn("logit", F.log(F.col("probability") / (1 - F.col("probability")))))
    return M.bce_loss(rows, ["group_id"]).withColumn("loss", round_metric("loss"))


# --- splits ------------------------------------------------------------------------------------------

@query("split_edge_group", sql(["link_pos"], checksum_sql("link_pos", "seed, group_id, split")))
def _(x):
    return checksum(SP.split_edges_by_group(_context_pairs(x).join(
        x.context.select(F.col("src").alias("a"), F.col("dst").alias("b"), "group_id"), ["a", "b"]), SEEDS), "seed", "group_id", "split")


@query("split_edge_random", sql(["random_pos"], checksum_sql("(SELECT * FROM random_pos WHERE protocol = 'edge_random')", "seed, split")))
def _(x):
    return checksum(SP.split_edges_random(x.physical_pairs, SEEDS), "seed", "split")


@query("split_node_disjoint", sql(["disjoint_pos"], checksum_sql("disjoint_pos", "seed, split, group_id")))
def _(x):
    return checksum(SP.split_node_disjoint(x.physical_pairs, x.nodes, SEEDS), "seed", "split", "group_id")


@query("negatives_uniform", sql(["neg_uniform"], checksum_sql("(SELECT * FROM neg_uniform WHERE protocol = 'edge_random')", "seed, split")))
def _(x):
    pos = SP.written_split(SP.split_edges_random(x.physical_pairs, SEEDS), SEEDS)
    return checksum(SP.uniform_negatives(pos, PK, x.nodes, x.physical_pairs), "seed", "split")


@query("negatives_degree_matched", sql(["neg_matched"], checksum_sql("neg_matched", "seed, split")))
def _(x):
    pos = SP.written_split(SP.split_edges_random(x.physical_pairs, SEEDS, protocol="degree_matched"), SEEDS)
    deg = SP.holdout_degrees(x.nodes, _context_pairs(x), pos)
    return checksum(SP.degree_matched_negatives(pos, PK, x.nodes, x.physical_pairs, deg), "seed", "split")


@query("negative_gaps", sql(["matched", "missing"], """
SELECT seed, split, step, count(*) AS n, round(max(gap), 6) AS widest, round(sum(gap), 4) AS total FROM matched GROUP BY ALL UNION ALL
SELECT seed, split, 'none fits', CAST(sum(n) AS BIGINT), NULL, NULL FROM missing GROUP BY ALL"""))
def _(x):
    """How near in log degree product each step of the matching comes; no gap passes 0.35, and no free drawn pair fits a positive of 'none fits'."""
    pos = SP.written_split(SP.split_edges_random(x.physical_pairs, SEEDS, protocol="degree_matched"), SEEDS)
    found, slots, _ = SP.degree_matches(pos, PK, x.nodes, x.physical_pairs, SP.holdout_degrees(x.nodes, _context_pairs(x), pos))
    steps = found.groupBy("seed", "split", "step").agg(n_rows(), F.round(F.max("gap"), 6).alias("widest"), F.round(F.sum("gap"), 4).alias("total"))
    none = F.lit(None).cast("double")
    return steps.unionByName(slots.groupBy("seed", "split").agg(n_rows()).select(
        "seed", "split", F.lit("none fits").alias("step"), "n", none.alias("widest"), none.alias("total")))


def _split(x: Inputs) -> DataFrame:
    return SP.protocol_split(x.physical_pairs, x.nodes, _context_pairs(x), SEEDS)


@query("protocol_split", sql(["split"], checksum_sql("split", "protocol, seed, split, label")))
def _(x):
    return checksum(_split(x), "protocol", "seed", "split", "label")


@query("split_inventory", sql(["split"], f"""
SELECT *, NOT (short OR few) AS usable, CASE WHEN short THEN 'too few possible negatives' WHEN few THEN 'too few test pairs' ELSE '' END AS reason
FROM (SELECT protocol, seed, CAST(coalesce(sum(p) FILTER (split = 'train'), 0) AS BIGINT) AS n_train_pos,
  CAST(coalesce(sum(p) FILTER (split = 'val'), 0) AS BIGINT) AS n_val_pos, CAST(coalesce(sum(p) FILTER (split = 'test'), 0) AS BIGINT) AS n_test_pos,
  CAST(coalesce(sum(n) FILTER (split = 'test'), 0) AS BIGINT) AS n_test_neg, bool_or(n < p) AS short,
  coalesce(sum(p) FILTER (split = 'test'), 0) < {K.MIN_TEST_POSITIVES} OR coalesce(sum(n) FILTER (split = 'test'), 0) = 0 AS few
 FROM (SELECT protocol, seed, split, group_id, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM split GROUP BY ALL) GROUP BY ALL)
""").replace("SELECT *, NOT", "SELECT protocol, seed, n_train_pos, n_val_pos, n_test_pos, n_test_neg, NOT"))
def _(x):
    return SP.usable_runs(_split(x))


@query("positive_edges", sql(["context"], checksum_sql("(SELECT seed, a, b, group_id FROM context, (SELECT CAST(unnest(range(20)) AS INTEGER) AS seed))", "seed, group_id")))
def _(x):
    """A link split put together again is the whole edge set of each seed."""
    edges = x.context.select(F.col("src").alias("a"), F.col("dst").alias("b"), "group_id")
    split = SP.split_edges_by_group(edges, SEEDS).withColumn("label", F.lit(1))
    return checksum(SP.positive_edges(split, ["seed"]), "seed", "group_id")


@query("split_roundtrip", sql(["random_pos"], checksum_sql("(SELECT * FROM random_pos WHERE protocol = 'edge_random')", "protocol, seed, split")))
def _(x):
    path = f"{shared_folder(x.spark)}/splits-{uuid.uuid4().hex}"
    TB.write_splits(SP.split_edges_random(x.physical_pairs, SEEDS), path)
    back = TB.read_splits(x.spark, path)
    return checksum(back, "protocol", "seed", "split")


_LINK_NEG = """pool2 AS MATERIALIZED ({}), wanted2 AS (SELECT seed, split, group_id, count(*) AS n FROM link_pos GROUP BY ALL),
link_neg AS ({}), link_split AS (SELECT seed, split, 1 AS label, a, b FROM link_pos UNION ALL SELECT seed, split, 0, a, b FROM link_neg)"""


def _link_sql() -> str:
    from edgeloom.driver.oracle_parts import draws_sql, take_sql
    pool = draws_sql("link_pos", ["seed", "split"], 4).replace("forbidden f", "context f")
    return sql(["link_pos", "node_index", "context"], checksum_sql("link_split", "seed, split, label"),
               _LINK_NEG.format(pool, take_sql("pool2", "wanted2", ["seed", "split"])))


@query("train_graph_split", _link_sql())
def _(x):
    edges = x.context.select(F.col("src").alias("a"), F.col("dst").alias("b"), "group_id")
    return checksum(SP.link_split(edges, x.nodes, SEEDS), "seed", "split", "label")


@query("message_edges", sql(["link_pos"], """
SELECT seed, src, count(*) AS n, CAST(sum(dst) AS BIGINT) AS sum_dst FROM (
 SELECT seed, a AS src, b AS dst FROM link_pos WHERE split = 'train' UNION ALL SELECT seed, b, a FROM link_pos WHERE split = 'train') GROUP BY ALL"""))
def _(x):
    edges = x.context.select(F.col("src").alias("a"), F.col("dst").alias("b"), "group_id")
    split = SP.split_edges_by_group(edges, SEEDS).withColumn("label", F.lit(1))
    return SP.message_edges(split).groupBy("seed", "src").agg(n_rows(), F.sum("dst").alias("sum_dst"))


# --- features ------------------------------------------------------------------------------------------

@query("feature_permute", sql(["vecs"], """
SELECT x.node_id, round(CAST(y.v[1] AS DOUBLE), 6) AS first, round(CAST(y.v[64] AS DOUBLE), 6) AS last FROM
 (SELECT node_id, row_number() OVER (ORDER BY md5(concat_ws('|','identity',node_id)), node_id) AS r FROM vecs) x JOIN
 (SELECT v, row_number() OVER (ORDER BY md5(concat_ws('|','permute-17',node_id)), node_id) AS r FROM vecs) y USING (r)"""))
def _(x):
    out = SP.permuted_features(x.features, 17)
    return out.select("node_id", round_metric(F.col("vector")[0].cast("double")).alias("first"),
                      round_metric(F.col("vector")[63].cast("double")).alias("last"))


_TOKEN = "CAST(floor(abs(CAST(embedding[1] AS DOUBLE)) * 10) AS BIGINT)"


@query("masked_mean_pool", f"""
SELECT label AS node_id, count(*) FILTER (t <> 0) AS n_tokens, i AS slot, round(coalesce(avg(CAST(x AS DOUBLE)) FILTER (t <> 0), 0), 5) AS value
FROM (SELECT label, {_TOKEN} AS t, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY label, i""")
def _(x):
    token = F.floor(F.abs(F.col("embedding")[0].cast("double")) * 10)
    tokens = x.table("embeddings").select(F.col("label").alias("node_id"), token.alias("token_id"), F.col("embedding").alias("vector"))
    return FE.masked_mean(tokens, [0], DIM).select("node_id", "n_tokens", F.posexplode("pooled").alias("slot", "v")).select(
        "node_id", "n_tokens", F.col("slot").cast("bigint").alias("slot"), F.round("v", 5).alias("value"))


@query("neighbor_mean", sql(["vecs", "adj", "nodes"], """
SELECT n.node_id, round(coalesce(avg(CAST(x.v[1] AS DOUBLE)), 0), 5) AS first, round(coalesce(avg(CAST(x.v[64] AS DOUBLE)), 0), 5) AS last
FROM nodes n LEFT JOIN adj ON adj.u = n.node_id LEFT JOIN vecs x ON x.node_id = adj.v GROUP BY 1"""))
def _(x):
    out = FE.neighbor_mean(x.features, P.both_ways(x.context), DIM)
    return out.select("node_id", F.round(F.col("vector")[0], 5).alias("first"), F.round(F.col("vector")[63], 5).alias("last"))


@query("pair_encoding", sql(["context", "vecs"], """
SELECT c.a, c.b, round(CAST(x.v[1] AS DOUBLE), 6) AS left_first, round(CAST(y.v[1] AS DOUBLE), 6) AS right_first,
 round(g.gap, 5) AS gap FROM context c JOIN vecs x ON x.node_id = c.a JOIN vecs y ON y.node_id = c.b JOIN gaps g ON g.a = c.a AND g.b = c.b""",
 """slots AS (SELECT node_id, unnest(v) AS s, generate_subscripts(v, 1) AS i FROM vecs),
gaps AS (SELECT c.a, c.b, sum(abs(CAST(x.s AS DOUBLE) - CAST(y.s AS DOUBLE))) AS gap FROM context c
 JOIN slots x ON x.node_id = c.a JOIN slots y ON y.node_id = c.b AND y.i = x.i GROUP BY 1, 2)"""))
def _(x):
    wide = x.features.select("node_id", F.col("vector").cast("array<double>").alias("vector"))
    enc = FE.encode_pairs(_context_pairs(x), wide)
    gap = F.aggregate(F.slice("encoded", 129, 64), F.lit(0.0), lambda s, v: s + v)
    return enc.select("a", "b", round_metric(F.col("encoded")[0]).alias("left_first"), round_metric(F.col("encoded")[64]).alias("right_first"),
                      F.round(gap, 5).alias("gap"))


@query("pair_features", sql(_LINK + ["places"], """
SELECT l.a, l.b, da AS degree_a, db AS degree_b, da * db AS degree_product, sh AS shared,
 CAST(CASE WHEN len(x.bk) > 0 AND len(y.bk) > 0 THEN 1 ELSE 0 END AS BIGINT) AS both_located
FROM l JOIN places x ON x.node_id = l.a JOIN places y ON y.node_id = l.b""", _LINK_SUMS))
def _(x):
    flags = FE.bucket_flags(x.nodes, x.locations)
    return FE.pair_features(_links(x), flags).select(
        "a", "b", "degree_a", "degree_b", "degree_product", F.col("shared").cast("bigint").alias("shared"),
        F.col("both_located").cast("bigint").alias("both_located"))


def _letter_encoder(sequences: list[str]):
    """One-hot letters A E I O U behind a start and an end mark; 0 pad, 1 start, 2 end."""
    import numpy as np
    width = max(len(s) for s in sequences) + 2
    ids = np.zeros((len(sequences), width), dtype="int64")
    for row, s in enumerate(sequences):
        codes = np.frombuffer(s.encode("ascii"), dtype="uint8")
        ids[row, 0], ids[row, len(codes) + 1] = 1, 2
        ids[row, 1:len(codes) + 1] = codes
    hidden = np.stack([(ids == ord(c)) for c in "AEIOU"], axis=-1).astype("float64")
    return ids, ids != 0, hidden


@query("batch_embed", f"""
SELECT doc_id AS node_id, {', '.join(f"length(s) - length(replace(s, '{c}', '')) AS n_{c.lower()}" for c in 'AEIOU')}
FROM (SELECT doc_id, substr({_LETTERS}, 1, {K.MAX_RESIDUES}) AS s FROM documents)""")
def _(x):
    seq = N.truncate_sequences(_sequences(x).select("node_id", "sequence"))
    out = FE.embed_sequences(seq, _letter_encoder, special_ids=[0, 1, 2], id_type="bigint").join(
        seq.select("node_id", F.length("sequence").alias("n")), "node_id")
    share = lambda i: F.col("vector")[i].cast("double")                     # noqa: E731
    return out.select("node_id", *[F.round(share(i) * F.col("n")).cast("bigint").alias(f"n_{c}") for i, c in enumerate("aeiou")])


# --- benchmark ------------------------------------------------------------------------------------------

_BENCH = metric_ctes("model_scores", ["protocol", "seed", "model"])
_METRICS = ("auroc", "ap", "p_at_10", "p_at_20", "p_at_50")


def _bench(x: Inputs) -> DataFrame:
    return B.benchmark_metrics(B.topology_scores(_split(x), _context_pairs(x)))


@query("benchmark_topology", sql(["model_scores"], "SELECT protocol, seed, model, " + ", ".join(
    f"round({m}, 5) AS {m}" for m in _METRICS) + " FROM metrics", _BENCH))
def _(x):
    return _bench(x).select("protocol", "seed", "model", *[F.round(m, 5).alias(m) for m in _METRICS])


@query("seed_ci", sql(["model_scores"], """
SELECT protocol, model, metric, round(avg(value), 5) AS mean, round(coalesce(stddev_samp(value), 0), 5) AS sd,
 round(avg(value) - 1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(value)), 5) AS ci95_lo,
 round(avg(value) + 1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(value)), 5) AS ci95_hi, count(value) AS n
FROM (UNPIVOT metrics ON auroc, ap, p_at_10, p_at_20, p_at_50 INTO NAME metric VALUE value) GROUP BY ALL""", _BENCH))
def _(x):
    out = B.benchmark_summary(_bench(x))
    return out.select("protocol", "model", "metric", *[F.round(c, 5).alias(c) for c in ("mean", "sd", "ci95_lo", "ci95_hi")], "n")


@query("paired_delta", sql(["model_scores"], """
SELECT protocol, round(avg(d), 5) AS mean, round(stddev_samp(d), 5) AS sd, round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(d)), 5) AS ci95_lo,
 round(avg(d) + 1.96 * stddev_samp(d) / sqrt(count(d)), 5) AS ci95_hi, count(d) AS n
FROM (SELECT x.protocol, x.auroc - y.auroc AS d FROM metrics x JOIN metrics y ON x.protocol = y.protocol AND x.seed = y.seed
 AND x.model = 'l3' AND y.model = 'adamic_adar') GROUP BY 1""", _BENCH))
def _(x):
    out = M.paired_delta(_bench(x), "l3", "adamic_adar")
    return out.select("protocol", *[F.round(c, 5).alias(c) for c in ("mean", "sd", "ci95_lo", "ci95_hi")], "n")


_STABLE = sql(["cand", "run_deg"], """
SELECT a, b, median(rk) AS median_rank, round(avg(rk), 4) AS mean_rank, round(avg(CASE WHEN rk <= 10 THEN 1.0 ELSE 0.0 END), 6) AS frac_top10,
 round(avg(CASE WHEN rk <= 20 THEN 1.0 ELSE 0.0 END), 6) AS frac_top20, count(*) AS n_seeds
FROM (SELECT c.a, c.b, row_number() OVER (PARTITION BY x.seed ORDER BY x.degree * y.degree DESC, c.a, c.b) AS rk FROM cand c
 JOIN run_deg x ON x.node_id = c.a AND x.protocol = 'edge_random' JOIN run_deg y ON y.node_id = c.b AND y.protocol = 'edge_random' AND y.seed = x.seed)
GROUP BY 1, 2""")


def _stability(x: Inputs) -> DataFrame:
    """A pair is one row for all seeds: its ends bring their degrees in every seed."""
    pos = SP.written_split(SP.split_edges_random(x.physical_pairs, SEEDS), SEEDS)
    deg = SP.holdout_degrees(x.nodes, _context_pairs(x), pos)
    per_seed = [F.max(F.when(F.col("seed") == s, F.col("degree"))).cast("bigint") for s in SP.seed_list(SEEDS)]
    nodes = x.nodes.select("node_id", "group_id", "role").join(deg.groupBy("node_id").agg(F.array_compact(F.array(*per_seed)).alias("d")), "node_id")
    product = F.transform(F.arrays_zip("d_a", "d_b"), lambda d: d["d_a"] * d["d_b"])
    scored = materialize(P.candidate_pairs(nodes).select("a", "b", product.alias("scores")))
    return M.rank_array_stability(B.candidate_rank_arrays(scored), ["a", "b"])


def _rounded_stability(out: DataFrame) -> DataFrame:
    return out.select("a", "b", "median_rank", F.round("mean_rank", 4).alias("mean_rank"), round_metric("frac_top10").alias("frac_top10"),
                      round_metric("frac_top20").alias("frac_top20"), "n_seeds")


@query("rank_stability", _STABLE)
def _(x):
    return _rounded_stability(_stability(x))


@query("most_stable", _STABLE + " ORDER BY median_rank, a, b LIMIT 10")
def _(x):
    return _rounded_stability(M.most_stable(_stability(x)))


@query("logreg_optimum", sql(["split"], """
SELECT protocol, seed, count(*) AS n_train, CAST(sum(label) AS BIGINT) AS n_pos, 0.0::DOUBLE AS gradient FROM split WHERE split = 'train'
GROUP BY ALL HAVING sum(label) BETWEEN 1 AND count(*) - 1"""))
def _(x):
    """All protocols and seeds fitted together; at each optimum the slope of the penalised loss is zero."""
    out = B.logistic_optimum(B.run_features(_split(x), _context_pairs(x), FE.bucket_flags(x.nodes, x.locations)))
    return out.withColumn("gradient", F.round("gradient", 4))


@query("logreg_scores")
def _(x):
    split = SP.protocol_split(x.physical_pairs, x.nodes, _context_pairs(x), [0], ("edge_random",))
    return B.logistic_run(split, _context_pairs(x), FE.bucket_flags(x.nodes, x.locations), "edge_random", 0)


def _neural(x: Inputs, name: str) -> DataFrame:
    split = SP.protocol_split(x.physical_pairs, x.nodes, _context_pairs(x), [0], ("edge_random",))
    return B.neural_run(name, split, _context_pairs(x), x.features, DIM, "edge_random", 0, max_iter=20)[0]


@query("pair_mlp")
def _(x):
    return _neural(x, "seq_mlp")


@query("propagated_mlp")
def _(x):
    return _neural(x, "graph_seq")
