"""Evidence atlas: one row per candidate pair, and its statistics with and without listing the pairs."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom import constants as K
from edgeloom.functions.evidence import dominant_channel, evidence_class, gate, location_overlap
from edgeloom.functions.identifiers import digits_sorted, joined_text, pair_high, pair_low
from edgeloom.operators.evidence import evidence_by_node, location_map
from edgeloom.operators.graph import candidate_shared, induced_edges, with_degree
from edgeloom.operators.nodes import role_nodes
from edgeloom.operators.pairs import (attach_ends, best_channels, both_ways, candidate_pairs, canonical_pairs,
                                      is_candidate, tiled_join)
from edgeloom.operators.ranking import average_ranks, global_rank, weighted_quantile
from edgeloom.session import materialize

PROFILE_TILE = 2048
_NODE_COLUMNS = ["node_id", "name", "group_id", "group_name", "role", "accession", "degree", "buckets"]


def context_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Canonical pairs of the context graph: both ends are nodes, loops dropped."""
    return canonical_pairs(induced_edges(edges.select("src", "dst"), nodes.select("node_id"), same_group=False))


def atlas_nodes(nodes: DataFrame, context: DataFrame, locations: DataFrame) -> DataFrame:
    """Role nodes with degree and location buckets, so that pairs need no further node joins."""
    graph = context.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    placed = with_degree(role_nodes(nodes), graph).join(location_map(locations), "accession", "left")
    return placed.withColumn("buckets", F.coalesce("buckets", F.array().cast("array<string>"))).select(*_NODE_COLUMNS)


def prepare(nodes: DataFrame, edges: DataFrame, locations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Context pairs and annotated role nodes, written once because every later step reads them."""
    context = materialize(context_pairs(edges, nodes))
    return context, materialize(atlas_nodes(nodes, context, locations))


# --- degree-product cut-off without listing pairs -------------------------------

def _profiles(annotated: DataFrame, *columns: str) -> DataFrame:
    return annotated.groupBy("group_id", *columns).agg(
        F.count_if(F.col("role").isin(*K.A_LIKE)).alias("n_a"),
        F.count_if(F.col("role").isin(*K.B_LIKE)).alias("n_b"),
        F.count_if(F.col("role") == K.ROLE_BOTH).alias("n_ab"))


def profile_pairs(annotated: DataFrame, *columns: str) -> DataFrame:
    """Number of candidate pairs per pair of node profiles, as ``twice_pairs`` = 2 x count.

    Nodes with equal (degree, buckets) behave alike, so only their counts are paired.  The number of
    distinct degrees in a group is at most 2 * sqrt(edges), hence the profile pairs stay linear in the
    edges, while the candidate pairs themselves are quadratic in the nodes.  The profile pairs of a
    large group are spread over tiles.
    """
    prof = _profiles(annotated, *columns)
    left = prof.select("group_id", *[F.col(c).alias("l_" + c) for c in [*columns, "n_a", "n_ab"]])
    right = prof.select("group_id", *[F.col(c).alias("r_" + c) for c in [*columns, "n_b", "n_ab"]])
    same = reduce(lambda x, y: x & y, [F.col("l_" + c) == F.col("r_" + c) for c in columns])
    tiles = F.ceil(F.count(F.lit(1)) / PROFILE_TILE)
    sizes = prof.groupBy("group_id").agg(tiles.alias("_ta"), tiles.alias("_tb"))
    met = tiled_join(left, right, sizes, "group_id", ["l_" + c for c in columns], ["r_" + c for c in columns])
    # ordered A x B meetings counted twice; a pair of two 'both' nodes meets twice, a node meets itself
    twice = (2 * F.col("l_n_a") * F.col("r_n_b") - F.col("l_n_ab") * F.col("r_n_ab")
             - F.when(same, F.col("l_n_ab")).otherwise(0))
    return met.withColumn("twice_pairs", twice).filter(F.col("twice_pairs") != 0)


def degree_product_cutoff(annotated: DataFrame, q: float = K.DEGREE_PRODUCT_QUANTILE) -> DataFrame:
    """One row: exact quantile of degree_a * degree_b over all candidate pairs."""
    met = profile_pairs(annotated, "degree")
    # profile pairs (p, q) and (q, p) together hold an even number, so halves add up exactly
    hist = (met.groupBy((F.col("l_degree") * F.col("r_degree")).alias("product"))
            .agg((F.sum("twice_pairs") / 2).cast("bigint").alias("n")).filter(F.col("n") > 0))
    return weighted_quantile(hist, "product", "n", q, name="cutoff")


# --- evidence attached to pairs ---------------------------------------------------

def _pair_sources(annotated: DataFrame, context: DataFrame, evidence: DataFrame, channels: DataFrame):
    found = evidence_by_node(evidence, annotated.select("node_id", "accession", "group_id")).drop(
        "acc_a", "acc_b", "group_id")
    best = best_channels(channels).withColumn("dominant_channel", dominant_channel())
    known = context.select("a", "b", F.lit(True).alias("known"))
    return found, best, known


def _grade(pairs: DataFrame, cutoff: Column) -> DataFrame:
    """Defaults, score floor, flags and class after the left joins."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))                      # noqa: E731
    score = F.coalesce("combined", F.lit(0.0))
    floor = F.when(yes("known") & (score < K.CONTEXT_SCORE), F.lit(K.CONTEXT_SCORE)).otherwise(score)
    out = (pairs.withColumn("string_combined", floor)
           .withColumn("string_in_graph", yes("known") | (F.col("string_combined") >= K.CONTEXT_SCORE))
           .withColumn("dominant_channel", F.coalesce("dominant_channel", F.lit("")))
           .withColumn("catalog_a_physical", yes("catalog_a_physical"))
           .withColumn("catalog_a_genetic", yes("catalog_a_genetic"))
           .withColumn("catalog_b", yes("catalog_b"))
           .withColumn("degree_product", F.col("degree_a") * F.col("degree_b"))
           .withColumn("localization_overlap", location_overlap("buckets_a", "buckets_b"))
           .withColumn("degree_product_cutoff", cutoff))
    physical = F.col("catalog_a_physical") | F.col("catalog_b")
    return (out.withColumn("genetic_only", F.col("catalog_a_genetic") & ~physical)
            .withColumn("evidence_class", evidence_class(
                physical, "string_combined", "dominant_channel", "localization_overlap", "degree_product",
                "degree_product_cutoff"))
            .withColumn("string_absent", ~F.col("string_in_graph")))


def build_atlas(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, channels: DataFrame,
                locations: DataFrame, model_scores: DataFrame | None = None, *,
                quantile: float = K.DEGREE_PRODUCT_QUANTILE, with_text: bool = True) -> DataFrame:
    """One row per candidate pair.

    Node attributes travel through the tile join; the pairs are shuffled once on (a, b) and every
    further source is joined on that same key.
    """
    context, annotated = prepare(nodes, edges, locations)
    found, best, known = _pair_sources(annotated, context, evidence, channels)
    cutoff = degree_product_cutoff(annotated, quantile).scalar()
    pairs = candidate_pairs(annotated)
    shared = candidate_shared(annotated.select("node_id", "group_id", "role"), both_ways(context, "a", "b"))
    joined = (pairs.join(found, ["a", "b"], "left").join(best, ["a", "b"], "left")
              .join(known, ["a", "b"], "left").join(shared, ["a", "b"], "left"))
    if model_scores is not None:
        scores = model_scores.select(pair_low("a", "b").alias("a"), pair_high("a", "b").alias("b"),
                                     "probability", F.col("rank").alias("model_rank"))
        joined = joined.join(scores, ["a", "b"], "left")
    else:
        joined = joined.withColumn("probability", F.lit(None).cast("double")).withColumn(
            "model_rank", F.lit(None).cast("bigint"))
    graded = _grade(joined, cutoff)
    empty = F.array().cast("array<string>")
    arrays = {c: F.coalesce(c, empty) for c in ("assays", "methods", "interaction_types", "publications", "throughputs")}
    columns = [
        "group_id", F.col("group_name").alias("group_name"), F.col("name_a"), F.col("name_b"), "a", "b",
        "accession_a", "accession_b", "role_a", "role_b", "degree_a", "degree_b", "degree_product",
        F.coalesce("shared", F.lit(0)).cast("bigint").alias("shared_neighbors"), "string_combined", "string_in_graph",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in K.CHANNELS], "dominant_channel",
        "catalog_a_physical", "catalog_a_genetic", "catalog_b", "genetic_only",
        F.size(arrays["publications"]).alias("n_publications"),
        "localization_overlap", "probability", "model_rank", "degree_product_cutoff", "evidence_class", "string_absent",
    ]
    if with_text:
        columns += [
            joined_text(arrays["assays"]).alias("assays"), joined_text(arrays["methods"]).alias("methods"),
            joined_text(arrays["interaction_types"]).alias("interaction_types"),
            F.array_join(digits_sorted(arrays["publications"]), ";").alias("publications"),
            joined_text(arrays["throughputs"]).alias("throughput"),
            F.array_join("buckets_a", ";").alias("location_a"), F.array_join("buckets_b", ";").alias("location_b"),
        ]
    return graded.select(*columns)


def rank_absent(atlas: DataFrame) -> DataFrame:
    """Rank among the absent pairs, unscored last; null for present pairs and when nothing is scored."""
    atlas = materialize(atlas)                      # read to rank and again to join the ranks
    absent = atlas.filter("string_absent").select("a", "b", "probability")
    ranked = global_rank(absent, [F.col("probability").desc_nulls_last(), F.col("a"), F.col("b")],
                         name="rank_among_absent")
    any_scored = ranked.agg(F.coalesce(F.bool_or(F.col("probability").isNotNull()), F.lit(False)).alias("x")).scalar()
    ranks = ranked.select("a", "b", F.when(any_scored, F.col("rank_among_absent")).alias("rank_among_absent"))
    return atlas.join(ranks, ["a", "b"], "left")


# --- statistics ---------------------------------------------------------------------

def sparse_grades(context: DataFrame, annotated: DataFrame, evidence: DataFrame, channels: DataFrame, cutoff: Column) -> DataFrame:
    """Grades of just the candidate pairs that any source mentions (linear in the sources)."""
    found, best, known = _pair_sources(annotated, context, evidence, channels)
    flags = found.select("a", "b", "catalog_a_physical", "catalog_a_genetic", "catalog_b")
    score = best.select("a", "b", "combined", "dominant_channel")
    met = flags.join(score, ["a", "b"], "full_outer").join(known, ["a", "b"], "full_outer")
    slim = annotated.select("node_id", "group_id", "role", "degree", "buckets")
    pairs = attach_ends(met, slim).filter((F.col("group_id_a") == F.col("group_id_b")) & is_candidate())
    return _grade(pairs.withColumnRenamed("group_id_a", "group_id").drop("group_id_b"), cutoff)


def class_counts(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, channels: DataFrame,
                 locations: DataFrame, *, quantile: float = K.DEGREE_PRODUCT_QUANTILE) -> DataFrame:
    """``(group_id, evidence_class, string_absent, n_pairs, n_physical, n_genetic_only)`` over all pairs.

    Exact, yet no list of all pairs is made: every pair gets the class of its node profiles, then the
    pairs that a source mentions are moved from that class to their own.  Of ``evidence`` only the flags are
    read (``fold_flags`` suffices).  The cutoff is computed once and written, as both parts need it.
    """
    context, annotated = prepare(nodes, edges, locations)
    cutoff = materialize(degree_product_cutoff(annotated, quantile)).scalar()

    def unmentioned(overlap, product):
        return evidence_class(F.lit(False), F.lit(0.0), F.lit(""), overlap, product, "_cut")

    plain = profile_pairs(annotated, "degree", "buckets").withColumn("_cut", cutoff).select(
        "group_id", unmentioned(location_overlap("l_buckets", "r_buckets"),
                                F.col("l_degree") * F.col("r_degree")).alias("evidence_class"),
        F.lit(True).alias("string_absent"), F.col("twice_pairs").alias("t"), F.lit(0).alias("p"), F.lit(0).alias("g"))
    sparse = sparse_grades(context, annotated, evidence, channels, cutoff)
    default = sparse.withColumn("_cut", F.col("degree_product_cutoff")).withColumn(
        "_default", unmentioned("localization_overlap", "degree_product"))
    moves = default.select("group_id", F.explode(F.array(
        F.struct(F.col("evidence_class").alias("c"), F.col("string_absent").alias("s"), F.lit(2).alias("t"),
                 (F.col("catalog_a_physical") | F.col("catalog_b")).cast("int").alias("p"),
                 F.col("genetic_only").cast("int").alias("g")),
        F.struct(F.col("_default").alias("c"), F.lit(True).alias("s"), F.lit(-2).alias("t"),
                 F.lit(0).alias("p"), F.lit(0).alias("g")),
    )).alias("m")).select("group_id", F.col("m.c").alias("evidence_class"), F.col("m.s").alias("string_absent"),
                          F.col("m.t").cast("bigint").alias("t"), F.col("m.p").alias("p"), F.col("m.g").alias("g"))
    return (plain.unionByName(moves).groupBy("group_id", "evidence_class", "string_absent")
            .agg((F.sum("t") / 2).cast("bigint").alias("n_pairs"), F.sum("p").cast("bigint").alias("n_physical"),
                 F.sum("g").cast("bigint").alias("n_genetic_only"))
            .filter(F.col("n_pairs") > 0))


def group_stats(counts: DataFrame) -> DataFrame:
    """Per group and class, with totals by rollup (group_id null = all groups, class null = all classes)."""
    absent = F.col("string_absent")
    return counts.rollup("group_id", "evidence_class").agg(
        F.sum("n_pairs").alias("n_pairs"),
        F.sum(F.when(absent, F.col("n_pairs")).otherwise(0)).alias("n_absent"),
        F.sum("n_physical").alias("n_physical"), F.sum("n_genetic_only").alias("n_genetic_only"))


def atlas_summary(counts: DataFrame) -> DataFrame:
    """One row of totals and fractions."""
    n, absent = F.col("n_pairs"), F.col("string_absent")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, n).otherwise(0)), F.lit(0))
    base = counts.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_pairs"), total(absent).alias("n_absent"), total(~absent).alias("n_present"),
        total(F.col("evidence_class") == K.CLASS_PHYSICAL).alias("n_physical"),
        F.coalesce(F.sum(F.when(absent, F.col("n_physical")).otherwise(0)), F.lit(0)).alias("n_physical_absent"),
        total(absent & (F.col("evidence_class") == K.CLASS_UNREPORTED)).alias("n_unreported_absent"),
        F.coalesce(F.sum("n_genetic_only"), F.lit(0)).alias("n_genetic_only"))
    safe = F.greatest(F.col("n_absent"), F.lit(1))
    return (base.withColumn("frac_physical_absent", F.col("n_physical_absent") / safe)
            .withColumn("frac_unreported_absent", F.col("n_unreported_absent") / safe))


def spearman(df: DataFrame, x: str, y: str, *, min_rows: int = 5, name: str = "rho") -> DataFrame:
    """One row: rank correlation with mean ranks; null when constant or fewer than ``min_rows`` rows.

    Equal (x, y) rows are merged first, ranks come from the value histograms, and the sums are
    centred on the mean rank (n + 1) / 2.
    """
    joint = materialize(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("w")))      # read four times below

    def ranks(col, out):
        return average_ranks(joint.groupBy(col).agg(F.sum("w").alias("w")), [], col, "w", name=out)
    ranked = joint.join(ranks("_x", "rx"), "_x").join(ranks("_y", "ry"), "_y")
    mid = (joint.agg(F.sum("w").alias("n")).select(((F.col("n") + 1) / 2.0).alias("m"))).scalar()
    dx, dy = F.col("rx") - F.col("_m"), F.col("ry") - F.col("_m")
    sums = ranked.withColumn("_m", mid).agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * dx * dy).alias("xy"),
        F.sum(F.col("w") * dx * dx).alias("xx"), F.sum(F.col("w") * dy * dy).alias("yy"))
    rho = F.when((F.col("n") >= min_rows) & (F.col("xx") > 0) & (F.col("yy") > 0),
                 F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    return sums.select(F.coalesce("n", F.lit(0)).alias("n_rows"), rho.alias(name))


def atlas_gate(summary: DataFrame, rho: DataFrame) -> DataFrame:
    """Decision row from the summary and the score / degree-product correlation."""
    run, reason = gate("n_absent", "frac_physical_absent", "frac_unreported_absent", "rho")
    value = rho.select("rho").scalar()
    return summary.withColumn("rho", value).select(
        "n_absent", "frac_physical_absent", "frac_unreported_absent", "rho",
        run.alias("run_benchmark"), reason.alias("reason"))


SINK_ORDER = ["group_id", "name_a", "name_b", "a", "b"]


def ordered(atlas: DataFrame) -> DataFrame:
    """The atlas in the order of its sink: group, then the names of both ends, then ids."""
    return atlas.orderBy(*SINK_ORDER)


def top_absent(atlas: DataFrame, n: int = 10) -> DataFrame:
    """Compact rows of the best-scored absent pairs."""
    return (atlas.filter(F.col("string_absent") & F.col("probability").isNotNull())
            .orderBy(F.desc("probability"), "a", "b").limit(n)
            .select("group_id", "a", "b", "name_a", "name_b", "evidence_class", "probability", "string_combined",
                    "dominant_channel", "catalog_a_physical", "catalog_b", "n_publications", "assays",
                    "localization_overlap", "degree_product", "shared_neighbors"))


def quality_counts(nodes: DataFrame, atlas: DataFrame, graded: DataFrame, physical: DataFrame, channels: DataFrame) -> DataFrame:
    """Quality counts as ``(metric, value)``, one aggregate per source; ``graded`` are the records folded by ``fold_grades``."""
    def counted(df, **measures):
        row = df.agg(*[c.cast("bigint").alias(k) for k, c in measures.items()])
        return row.unpivot([], list(measures), "metric", "value")
    n = F.count(F.lit(1))
    parts = [
        counted(nodes, n_nodes=n, n_role_nodes=F.count_if(F.col("role").isin("a", "b", "both"))),
        counted(atlas, n_pairs=n, n_scored=F.count("probability")),
        counted(graded, n_records=F.coalesce(F.sum("n_records"), F.lit(0)), n_evidence_pairs=n),
        counted(physical, n_physical_edges=n, n_tier1_edges=F.count_if("tier1")),
        counted(best_channels(channels), n_channel_pairs=n),
    ]
    return reduce(DataFrame.unionByName, parts)
