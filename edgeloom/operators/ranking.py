"""Ranks, running totals and quantiles that never sort one whole key inside one task.

* ``hash_rank``      rank by a uniform hash: one window a key, and hash cells plus cell offsets for large keys.
* ``running_totals`` cumulative sums over distinct values: range sort, per-partition sums, offsets.
* ``global_rank``    one total order over a whole table: range sort, checkpoint, per-partition offsets.
* ``top_n``          row_number()<=n, which Spark turns into a partial limit before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.session import materialize

CELL_ROWS = 65_536


def _partition(keys: list) -> list:
    return list(keys) if keys else [F.lit(0)]


def key_hash(*parts) -> Column:
    """md5 over '|'-joined parts: the one source of pseudo-randomness, equal in any SQL engine."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.col(p) for p in parts]))


def large_keys(df: DataFrame, keys: list[str], cell_rows: int = CELL_ROWS) -> DataFrame | None:
    """``keys, key_rows, _digits`` of the keys with more than ``cell_rows`` rows, or None where there are none.

    They number at most one in ``cell_rows`` rows.  ``_digits`` hex digits of a hash cut such a key into cells of at most ``cell_rows`` rows on average.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows")).filter(F.col("key_rows") > cell_rows)
    digits = F.least(F.greatest(F.ceil(F.log(F.col("key_rows") / cell_rows) / F.log(F.lit(16.0))), F.lit(1)), F.lit(8))
    found = materialize(sizes.withColumn("_digits", digits.cast("int")))
    return None if found.isEmpty() else found


def with_large(df: DataFrame, large: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Rows with the ``key_rows`` and ``_digits`` of their key; the large keys are few, so they are sent to all tasks."""
    return df.join(F.broadcast(large), keys, how) if keys else df.crossJoin(F.broadcast(large))


def hash_rank(df: DataFrame, keys: list[str], hash_col: str, ties: list[str], *, cell_rows: int = CELL_ROWS,
              sized: tuple[DataFrame | None, list[str]] | None = None) -> DataFrame:
    """Add ``rank`` (1-based, by hash then ties) and ``key_rows`` (rows of the key).

    A key of at most ``cell_rows`` rows is one window.  Larger ones are cut into hash cells, whose offsets alone are summed by key: a table of
    a few cells for each ``cell_rows`` rows, however many keys there are.  ``sized`` gives ``large_keys`` where it is known, and its key columns.
    """
    large, by = (large_keys(df, keys, cell_rows), keys) if sized is None else sized
    one = F.count(F.lit(1))
    if large is None:
        key = Window.partitionBy(*_partition(keys))
        return (df.withColumn("rank", F.row_number().over(key.orderBy(hash_col, *ties)).cast("bigint"))
                .withColumn("key_rows", one.over(key)))
    tagged = with_large(df, large, by).withColumn("_cell", F.coalesce(F.left(F.col(hash_col), F.col("_digits")), F.lit("")))
    sizes = tagged.filter(F.col("_digits").isNotNull()).groupBy(*keys, "_cell").agg(one.alias("_n"))
    before = Window.partitionBy(*_partition(keys)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    cell = Window.partitionBy(*keys, "_cell")
    return (tagged.join(offsets, [*keys, "_cell"], "left")
            .withColumn("rank", F.coalesce("_before", F.lit(0)) + F.row_number().over(cell.orderBy(hash_col, *ties)))
            .withColumn("key_rows", F.coalesce("key_rows", one.over(cell)))
            .drop("_cell", "_before", "_digits"))


def running_totals(hist: DataFrame, keys: list[str], value: str, measures: list[str], *,
                   descending: bool = False) -> DataFrame:
    """Add inclusive ``cum_<measure>`` and ``all_<measure>``; ``hist`` has one row per key and value.

    The rows are range-sorted by key and value and written; a key with many values covers many sort partitions, each of which is summed
    by itself and moved by the totals of those before it.  No window holds more than a sort partition, however the values
    crowd.  Rows without a value are left out.
    """
    way = F.desc if descending else F.asc
    placed = materialize(hist.filter(F.col(value).isNotNull()).orderBy(*keys, way(value)).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy(*keys, "_part").agg(*[F.sum(m).alias(m) for m in measures])
    before = Window.partitionBy(*_partition(keys)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*_partition(keys))
    offsets = sums.select(
        *keys, "_part",
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_before_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"all_{m}") for m in measures],
    )
    inside = (Window.partitionBy(*keys, "_part").orderBy(way(value))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = placed.join(offsets, [*keys, "_part"])
    for m in measures:
        out = out.withColumn(f"cum_{m}", F.col(f"_before_{m}") + F.sum(m).over(inside))
    return out.drop("_part", *[f"_before_{m}" for m in measures])


def running_lows(df: DataFrame, keys: list[str], value: str, measure: str, *, name: str) -> DataFrame:
    """Add ``name``: the least ``measure`` of the key's rows with a smaller ``value`` (null: none); one row per key and value.

    Range-sorted and written like ``running_totals``, so no window holds more than a sort partition.
    """
    placed = materialize(df.orderBy(*keys, value).withColumn("_part", F.spark_partition_id()))
    lows = placed.groupBy(*keys, "_part").agg(F.min(measure).alias("_low"))
    before = Window.partitionBy(*_partition(keys)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lows.select(*keys, "_part", F.min("_low").over(before).alias("_before"))
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (placed.join(offsets, [*keys, "_part"]).withColumn(name, F.least("_before", F.min(measure).over(inside)))
            .drop("_part", "_before"))


def average_ranks(hist: DataFrame, keys: list[str], value: str, weight: str, *, name: str) -> DataFrame:
    """Mean rank of every distinct value when ``weight`` rows share it (ascending)."""
    run = running_totals(hist, keys, value, [weight])
    return run.select(*keys, value, (F.col(f"cum_{weight}") - (F.col(weight) - 1) / 2.0).alias(name))


def weighted_quantile(hist: DataFrame, value: str, weight: str, q: float, *, name: str) -> DataFrame:
    """Exact quantile with linear interpolation over ``weight`` copies of each value; 0 on empty input."""
    run = running_totals(hist, [], value, [weight])
    position = F.lit(q) * (F.col(f"all_{weight}") - 1)
    low_hit = F.col(f"cum_{weight}") > F.floor(position)
    high_hit = F.col(f"cum_{weight}") > F.ceil(position)
    ends = run.agg(
        F.min(F.when(low_hit, F.col(value).cast("double"))).alias("lo"),
        F.min(F.when(high_hit, F.col(value).cast("double"))).alias("hi"),
        F.max(position - F.floor(position)).alias("frac"),
    )
    return ends.select(F.coalesce(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac"), F.lit(0.0)).alias(name))


def global_rank(df: DataFrame, order: list[Column], *, name: str = "rank") -> DataFrame:
    """Number all rows 1..n in one total order without a single-partition window."""
    placed = materialize(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part, local = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    before = (Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    # one row per sort partition, so the broadcast is bounded by the partition count
    return (placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + local + 1).drop("_place", "_part", "_before"))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, *, name: str = "rank") -> DataFrame:
    """Best n rows per key, numbered."""
    w = Window.partitionBy(*_partition(keys)).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row with the smallest ``order`` per key, by a partial aggregate rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")
