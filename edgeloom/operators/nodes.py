"""Node tables: roles, sequences, checks."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom import constants as K
from edgeloom.operators.graph import require_empty
from edgeloom.operators.ranking import first_per_key


def label_roles(nodes: DataFrame, seeds: DataFrame, *, by_group: bool = True) -> DataFrame:
    """Role from the seed lists, case ignored: a, b, both, or partner."""
    keys = (["group_id"] if by_group else []) + ["_k"]
    flags = (seeds.withColumn("_k", F.upper("symbol")).groupBy(*keys)
             .agg(F.bool_or(F.col("role") == K.ROLE_A).alias("_a"), F.bool_or(F.col("role") == K.ROLE_B).alias("_b")))
    out = nodes.withColumn("_k", F.upper("name")).join(flags, keys, "left")
    role = (F.when(F.col("_a") & F.col("_b"), F.lit(K.ROLE_BOTH)).when(F.col("_a"), F.lit(K.ROLE_A))
            .when(F.col("_b"), F.lit(K.ROLE_B)).otherwise(F.lit(K.ROLE_PARTNER)))
    return out.withColumn("role", role).drop("_k", "_a", "_b")


def role_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("role").isin(K.ROLE_A, K.ROLE_B, K.ROLE_BOTH))


def longest_sequences(sequences: DataFrame, *, order: str = "pos", extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Longest sequence per upper-cased gene; the first one wins a tie."""
    keyed = sequences.withColumn("gene_key", F.upper("gene")).withColumn("_short", -F.length("sequence"))
    return first_per_key(keyed, [*extra_keys, "gene_key"], ["_short", order]).drop("_short")


def with_fallback(preferred: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Second source only for the keys that the preferred source lacks."""
    return preferred.unionByName(second.join(preferred.select(key), key, "left_anti"))


def attach_sequences(nodes: DataFrame, sequences: DataFrame) -> DataFrame:
    """Sequence and accession by group and upper-cased name; nodes without one drop out.

    ``sequences`` without ``group_id`` stand for a single group and match by name alone.
    """
    group = ["group_id"] if "group_id" in sequences.columns else []
    seq = sequences.select(*group, F.col("gene_key").alias("_k"), "accession", "sequence")
    return (nodes.drop("accession", "sequence").withColumn("_k", F.upper("name")).join(seq, [*group, "_k"]).drop("_k")
            .withColumn("sequence_length", F.length("sequence")))


def truncate_sequences(sequences: DataFrame, limit: int = K.MAX_RESIDUES) -> DataFrame:
    """Clip to ``limit`` residues and flag the clipped ones."""
    return sequences.withColumn("truncated", F.length("sequence") > limit).withColumn(
        "sequence", F.substring("sequence", 1, limit))


def prepare_sequences(nodes: DataFrame, fasta: DataFrame, limit: int = K.MAX_RESIDUES) -> DataFrame:
    """Clipped sequence per node; a node without record or with an empty sequence stops the job."""
    require_empty(nodes.select("node_id").join(fasta, "node_id", "left_anti"), "nodes without a sequence record")
    met = truncate_sequences(nodes.select("node_id").join(fasta, "node_id"), limit)
    require_empty(met.filter(F.col("sequence") == "").select("node_id"), "empty sequence")
    return met


def seed_labels(nodes: DataFrame, labelled: list[str], tag) -> DataFrame:
    """Display label of listed names; a name on several rows gets the group tag appended."""
    mine = nodes.filter(F.col("name").isin(labelled))
    counts = mine.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    text = F.when(F.col("_n") > 1, F.concat("name", F.lit(" ("), tag, F.lit(")"))).otherwise(F.col("name"))
    return mine.join(counts, "name").withColumn("label", text).drop("_n")
