"""Runs as bits: up to 63 (protocol, seed) runs share one long, so rows of the graph are stored once whatever the number of runs.

A table of runs gives each its ``slab`` (which long) and ``bit``.  ``masks`` folds rows of runs into one row with a mask, ``each_run`` unfolds
a mask again.  Counts of many runs at once are bit-sliced: ``slices`` sums 32 longs, each of which counts two runs in its halves.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_KEYS = ["protocol", "seed"]
RUNS_PER_LONG = 63
_HALF = 32
_LANES = (1 << 32) | 1
_COUNT = (1 << 32) - 1


def number_runs(spark: SparkSession, runs: list[tuple[str, int]]) -> DataFrame:
    """``protocol, seed, slab, bit`` of a run list (small by nature: protocols times seeds)."""
    rows = [(p, int(s), i // RUNS_PER_LONG, i % RUNS_PER_LONG) for i, (p, s) in enumerate(sorted(set(runs)))]
    return spark.createDataFrame(rows, "protocol string, seed int, slab int, bit int")


def on_every_slab(df: DataFrame, runs: list[tuple[str, int]]) -> DataFrame:
    """Each row once for each 63 runs, with ``slab`` and ``all``, the mask of the slab's runs."""
    n = len(set(runs))
    full = [(1 << min(RUNS_PER_LONG, n - i)) - 1 for i in range(0, n, RUNS_PER_LONG)]
    slabs = F.array(*[F.struct(F.lit(i).alias("slab"), F.lit(m).cast("bigint").alias("all")) for i, m in enumerate(full)])
    return df.withColumn("_s", F.explode(slabs)).select("*", "_s.*").drop("_s")


def numbered(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of runs with ``slab`` and ``bit`` in place of protocol and seed.  One row a run is broadcast."""
    return df.join(F.broadcast(runs), RUN_KEYS).drop(*RUN_KEYS)


def masks(df: DataFrame, keys: list[str], *, name: str = "mask") -> DataFrame:
    """``slab, keys..., mask``: which runs hold a row of the key; ``df`` has ``slab`` and ``bit``."""
    return df.groupBy("slab", *keys).agg(F.expr("bit_or(shiftleft(1L, bit))").alias(name))


def bits_of(mask: str) -> Column:
    """The set bits of a mask, as an array."""
    return F.expr(f"filter(sequence(0, {RUNS_PER_LONG - 1}), r -> (shiftrightunsigned({mask}, r) & 1L) = 1L)")


def each_run(df: DataFrame, mask: str) -> DataFrame:
    """One row a set bit, in column ``bit``; the mask is dropped."""
    return df.withColumn("bit", F.explode(bits_of(mask))).drop(mask)


def named(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Protocol and seed in place of ``slab`` and ``bit``."""
    return df.join(F.broadcast(runs), ["slab", "bit"]).drop("slab", "bit")


def slices(mask: str) -> list[Column]:
    """Aggregates that count, for every run, the rows whose mask holds it; each sum counts two runs, to 2^31 rows each."""
    return [F.sum(F.expr(f"shiftrightunsigned({mask}, {j}) & {_LANES}L")).alias(f"_s{j}") for j in range(_HALF)]


def packed_slices() -> Column:
    return F.array(*[F.col(f"_s{j}") for j in range(_HALF)])


def count_masks(df: DataFrame, keys: list[str], mask: str, *extra: Column, name: str = "counts") -> DataFrame:
    """``keys..., counts`` (bit-sliced) and the ``extra`` aggregates."""
    rows = df.groupBy(*keys).agg(*slices(mask), *extra)
    return rows.withColumn(name, packed_slices()).drop(*[f"_s{j}" for j in range(_HALF)])


def count_of(counts: str, bit: str) -> Column:
    """The count of one run out of bit-sliced counts: runs j and j + 32 lie in the two halves of long j."""
    return F.expr(f"shiftrightunsigned({counts}[{bit} % {_HALF}], if({bit} < {_HALF}, 0, 32)) & {_COUNT}L")
