"""Shared pieces: table access, bounded text chunks inside tasks, shard counts."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20       # text handled at once inside a task; a single longer text is its own chunk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession, times: int = 1) -> int:
    """Number of groups to deal rows into: a multiple of the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))) * times


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, extra: tuple[str, ...] = ()) -> DataFrame:
    """The two columns an operator needs, null texts read as empty; whatever else the table holds is left behind."""
    return df.select(df[id_col].cast("bigint").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
                     *[df[c] for c in extra])


def chunks(batches: Iterable[pa.RecordBatch], text_col: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each with at most ``limit`` bytes of text unless one row alone is longer."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text_col: str = "text") -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
