"""FASTA text in and out, as splittable Spark text."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import constants as K
from edgeloom.operators.graph import require_empty


def parse_fasta_records(records: DataFrame) -> DataFrame:
    """Raw record text (header line first, with or without '>') into ``(node_id, sequence)``."""
    lines = F.transform(F.split(F.regexp_replace("value", r"\r", ""), "\n"), lambda x: F.trim(x))
    head = F.regexp_replace(F.get(lines, F.lit(0)), "^>", "")
    body = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    return records.select(
        F.get(F.split(F.trim(head), r"\s+"), F.lit(0)).alias("node_id"),
        F.upper(F.replace(F.array_join(body, ""), F.lit(" "), F.lit(""))).alias("sequence"),
        F.col("value").startswith(">").alias("_marked"))


def read_fasta(spark: SparkSession, path: str, *, check: bool = True) -> DataFrame:
    """Records are split on the record mark itself, so one file is read by many tasks.

    Raises on an empty file, a header without id, or a body before the first header.
    """
    raw = (spark.read.option("lineSep", "\n>").text(path)
           .filter(F.length(F.trim(F.regexp_replace("value", r"\s", ""))) > 0))
    parsed = parse_fasta_records(raw)
    if check:
        if not parsed.limit(1).collect():
            raise ValueError(f"no records in {path}")
        require_empty(parsed.filter(F.col("node_id") == ""), "header without an id")
        first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
        if not first[0][0].strip().startswith(">"):
            raise ValueError("sequence text before the first header")
    return parsed.drop("_marked")


def fasta_text(nodes: DataFrame, *, width: int = K.FASTA_WIDTH) -> DataFrame:
    """One text record per node: header, then the sequence wrapped at ``width``."""
    header = F.concat(
        F.lit(">"), F.col("node_id").cast("string"), F.lit(" "), F.col("name"),
        F.lit(" OX="), F.col("group_id").cast("string"), F.lit(" GN="), F.col("name"),
        F.lit(" compartment="), F.col("role"), F.lit(" AC="), F.col("accession"))
    body = F.array_join(F.regexp_extract_all("sequence", F.lit(f"(.{{1,{width}}})"), F.lit(1)), "\n")
    return nodes.select(F.concat(header, F.lit("\n"), body).alias("value"))


def write_fasta(nodes: DataFrame, path: str, *, width: int = K.FASTA_WIDTH) -> None:
    fasta_text(nodes, width=width).write.mode("overwrite").text(path)
