"""Written tables that prove themselves: an order-free digest of all rows is written last and checked on every read.

The digest (number of rows and sum of row hashes) is taken from the finished files in one scan; ``df`` itself is evaluated once, and a session that has
observed metrics could not train Spark ML models any more.  It lies in ``_digest`` below the table, where readers of the files do not look; a
table without it was not finished.  A file that is lost, cut or changed later makes the sum differ.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "_digest"
_MARK_SCHEMA = "n_rows bigint, hash_sum string, columns array<string>"


class BrokenTable(ValueError):
    """A table whose rows are not those that were written."""


def row_hash(columns: list[str]) -> Column:
    """Hash of a row by its columns in order of name; nulls differ from empty texts, and from each other by their place."""
    names = sorted(columns)
    return F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in names], *[F.col(f"`{c}`").isNull() for c in names])


def _measures(columns: list[str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(row_hash(columns).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("hash_sum")]


def write_proved(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet files, then the digest of what was written.  An existing table is replaced; until the end it has no mark."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    found = kept.agg(*_measures(kept.columns)).first()
    mark = df.sparkSession.createDataFrame([(found["n_rows"], found["hash_sum"], sorted(df.columns))], _MARK_SCHEMA)
    mark.coalesce(1).write.mode("overwrite").json(f"{path}/{MARK}")


def read_proved(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table at ``path`` after one scan that compares its digest; BrokenTable if it has none or another."""
    try:
        mark = spark.read.schema(_MARK_SCHEMA).json(f"{path}/{MARK}").first()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        mark = None
    if mark is None:
        raise BrokenTable(f"{path} was not written to its end")
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    if sorted(df.columns) != list(mark["columns"]):
        raise BrokenTable(f"{path} has other columns than were written")
    try:
        found = df.agg(*_measures(df.columns)).first()
    except Exception as broken:
        raise BrokenTable(f"{path} cannot be read: {str(broken)[:300]}") from broken
    if (found["n_rows"], found["hash_sum"]) != (mark["n_rows"], mark["hash_sum"]):
        raise BrokenTable(f"{path} holds {found['n_rows']} rows where {mark['n_rows']} were written, or other rows")
    return df
