"""Catalog hits folded onto pairs, and the physical edges they support."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.evidence import is_tier1, location_buckets
from edgeloom.functions.identifiers import joined_text, pair_high, pair_low, publication_ids


def fold_hits(hits: DataFrame, *extra_keys: str) -> DataFrame:
    """One row per accession pair: flags, distinct texts, distinct publication ids.

    Rows are first reduced to distinct (pair, source, texts) with a map-side combine, so a pair
    that holds a large share of all records sends only its distinct values on.
    """
    keys = [*extra_keys, "acc_a", "acc_b"]
    kind = F.lower(F.trim("system_type"))
    slim = hits.select(
        *extra_keys, pair_low("acc_a", "acc_b").alias("acc_a"), pair_high("acc_a", "acc_b").alias("acc_b"),
        ((F.col("source") == "a") & (kind == "physical")).alias("physical"),
        ((F.col("source") == "a") & (kind == "genetic")).alias("genetic"),
        (F.col("source") == "b").alias("b"),
        F.when((F.col("source") == "a") & (F.col("system") != ""), F.col("system")).alias("assay"),
        F.when((F.col("source") == "a") & (F.col("throughput") != ""), F.col("throughput")).alias("through"),
        F.when((F.col("source") == "b") & (F.col("detection_method") != ""), F.col("detection_method")).alias("method"),
        F.when((F.col("source") == "b") & (F.col("interaction_type") != ""), F.col("interaction_type")).alias("itype"),
        "publication",
    ).distinct()
    return slim.groupBy(*keys).agg(
        F.bool_or("physical").alias("catalog_a_physical"),
        F.bool_or("genetic").alias("catalog_a_genetic"),
        F.bool_or("b").alias("catalog_b"),
        F.collect_set("assay").alias("assays"),
        F.collect_set("method").alias("methods"),
        F.collect_set("itype").alias("interaction_types"),
        F.array_distinct(F.flatten(F.collect_set(publication_ids("publication")))).alias("publications"),
        F.collect_set("through").alias("throughputs"),
    )


def fold_flags(hits: DataFrame) -> DataFrame:
    """The three flags of ``fold_hits`` alone, one row per accession pair: no texts are parsed, kept apart or shuffled."""
    kind = F.lower(F.trim("system_type"))
    slim = hits.select(
        pair_low("acc_a", "acc_b").alias("acc_a"), pair_high("acc_a", "acc_b").alias("acc_b"),
        ((F.col("source") == "a") & (kind == "physical")).alias("physical"),
        ((F.col("source") == "a") & (kind == "genetic")).alias("genetic"),
        (F.col("source") == "b").alias("b"))
    return slim.groupBy("acc_a", "acc_b").agg(F.bool_or("physical").alias("catalog_a_physical"),
                                              F.bool_or("genetic").alias("catalog_a_genetic"), F.bool_or("b").alias("catalog_b"))


def fold_grades(hits: DataFrame) -> DataFrame:
    """What ``fold_hits`` says of each accession pair but for its texts: its records, physical support of both catalogs, and ``tier1``.

    Each record is graded by itself and the grades are joined by or, so no text is kept apart or shuffled.
    """
    a, b = F.col("source") == "a", F.col("source") == "b"
    none = F.array().cast("array<string>")
    direct = is_tier1(F.when(a, F.array("system")).otherwise(none), F.when(b, F.array("detection_method")).otherwise(none),
                      F.when(b, F.array("interaction_type")).otherwise(none))
    slim = hits.select(pair_low("acc_a", "acc_b").alias("acc_a"), pair_high("acc_a", "acc_b").alias("acc_b"),
                       (a & (F.lower(F.trim("system_type")) == "physical")).alias("physical"), b.alias("b"), direct.alias("tier1"))
    return slim.groupBy("acc_a", "acc_b").agg(F.count(F.lit(1)).alias("n_records"), F.bool_or("physical").alias("catalog_a_physical"),
                                              F.bool_or("b").alias("catalog_b"), F.bool_or("tier1").alias("tier1"))


def physical_grades(graded: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b, tier1`` of ``physical_edges``, from graded accession pairs."""
    support = graded.filter(F.col("catalog_a_physical") | F.col("catalog_b")).select("acc_a", "acc_b", "tier1")
    met = evidence_by_node(support, nodes.select("node_id", "accession", "group_id"))
    return met.groupBy("a", "b").agg(F.min(F.struct("acc_a", "acc_b", "group_id", "tier1")).alias("r")).select("a", "b", "r.tier1")


def evidence_by_node(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """Accession pairs onto same-group node pairs ``(a, b)``; one accession may name several nodes."""
    left = nodes.select(F.col("accession").alias("acc_a"), F.col("node_id").alias("_l"), F.col("group_id"))
    right = nodes.select(F.col("accession").alias("acc_b"), F.col("node_id").alias("_r"), F.col("group_id").alias("_g"))
    met = evidence.join(left, "acc_a").join(right, "acc_b").filter(
        (F.col("group_id") == F.col("_g")) & (F.col("_l") != F.col("_r")))
    return met.withColumn("a", pair_low("_l", "_r")).withColumn("b", pair_high("_l", "_r")).drop("_l", "_r", "_g")


def physical_edges(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """Same-group node pairs with physical support.

    Node ids and accessions are ordered independently of each other.  A node pair reached by
    several accession pairs keeps the smallest accession pair.
    """
    support = evidence.filter(F.col("catalog_a_physical") | F.col("catalog_b")).select(
        "acc_a", "acc_b", "catalog_a_physical", "catalog_b",
        is_tier1("assays", "methods", "interaction_types").alias("tier1"),
        joined_text("assays").alias("assays"), F.size("publications").alias("n_publications"))
    rest = ["acc_a", "acc_b", "group_id", "tier1", "catalog_a_physical", "catalog_b", "assays", "n_publications"]
    met = evidence_by_node(support, nodes.select("node_id", "accession", "group_id"))
    return (met.groupBy("a", "b").agg(F.min(F.struct(*rest)).alias("r")).select("a", "b", "r.*"))


def catalog_overlap(physical: DataFrame, scored: DataFrame) -> DataFrame:
    """Pairs in both, only physical, only scored."""
    p = physical.select("a", "b", F.lit(True).alias("p"))
    s = scored.select("a", "b", F.lit(True).alias("s"))
    met = p.join(s, ["a", "b"], "full_outer")
    return met.agg(F.count_if(F.col("p") & F.col("s")).alias("n_both"),
                   F.count_if(F.col("s").isNull()).alias("n_only_physical"),
                   F.count_if(F.col("p").isNull()).alias("n_only_scored"))


def location_map(locations: DataFrame) -> DataFrame:
    """``(accession, buckets)``; repeated accessions pool their buckets."""
    rows = locations.select("accession", location_buckets("location", "component").alias("b"))
    return rows.groupBy("accession").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("b")))).alias("buckets"))
