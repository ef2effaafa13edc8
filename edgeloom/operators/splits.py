"""Deterministic splits and negatives.

Every draw is an md5 of its key, so a split can be repeated anywhere, needs no driver-side generator
and is the same for any partitioning.  Counts and invariants follow the split rules exactly; which
pair lands where differs from a sequential generator.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom import constants as K
from edgeloom.functions.identifiers import pair_high, pair_low
from edgeloom.operators import drawing as D
from edgeloom.operators import runs as R
from edgeloom.operators.graph import require_empty
from edgeloom.operators.matching import band_of, match_products
from edgeloom.operators.ranking import CELL_ROWS, hash_rank, key_hash, large_keys, with_large
from edgeloom.session import materialize

SPLIT_KEYS = ["protocol", "seed"]
SORTED_ROWS = 1_000_000


def seed_list(seeds: int | list[int]) -> list[int]:
    return list(range(seeds)) if isinstance(seeds, int) else [int(s) for s in seeds]


def with_seeds(df: DataFrame, seeds: int | list[int]) -> DataFrame:
    """Copy every row once per seed, in its own partition.

    Joined rather than exploded: Spark takes an exploded table for as small as the table before, and would send it whole through the driver.
    """
    values = seed_list(seeds)
    listed = df.sparkSession.range(len(values)).select(
        F.element_at(F.array(*[F.lit(s) for s in values]), (F.col("id") + 1).cast("int")).alias("seed"))
    return df.crossJoin(F.broadcast(listed))


def spread_by(df: DataFrame, keys: list[str], copies: int) -> DataFrame:
    """Written rows dealt by key so that a task has about ``SORTED_ROWS`` after each is copied; windows by the key and more need no other shuffle."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() * copies // SORTED_ROWS))
    return df.repartition(n, *keys)


def split_sizes(n: Column, ratios, *, rule: str) -> tuple[Column, Column]:
    """(train, validation) sizes; ``rule`` is 'floor' or 'round' (half to even).

    From three rows on, every part gets at least one.
    """
    cut = (lambda x: F.floor(x)) if rule == "floor" else (lambda x: F.bround(x, 0).cast("bigint"))
    train, val = cut(n * F.lit(ratios[0])), cut(n * F.lit(ratios[1]))
    short = (n >= 3) & (F.least(train, val, n - train - val) < 1)
    val_up = F.greatest(val, F.lit(1))
    test_up = F.greatest(n - F.greatest(train, F.lit(1)) - val_up, F.lit(1))
    return F.when(short, n - val_up - test_up).otherwise(train), F.when(short, val_up).otherwise(val)


def _part(ratios, rule: str) -> Column:
    train, val = split_sizes(F.col("key_rows"), ratios, rule=rule)
    return (F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + val, "val").otherwise("test"))


def split_edges(pairs: DataFrame, keys: list[str], seeds, *, salt: str, rule: str, ratios=K.EDGE_RATIOS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Cut the hash-shuffled pairs of every seed and key into train / val / test: ``seed, split`` and the columns of ``pairs``.

    All seeds share one shuffle of the pairs by key.  Keys of more than ``cell_rows`` pairs are not shuffled: their hash cells are counted, and only
    the two cells a seed in which a part ends are ranked.
    """
    pairs = materialize(pairs)
    if not keys:
        return _split_all(pairs, seeds, salt=salt, rule=rule, ratios=ratios, cell_rows=cell_rows)
    own, cols = ["seed", *keys], ["seed", "split", *pairs.columns]

    def drawn(df):
        return with_seeds(df, seeds).withColumn("_h", key_hash(F.lit(salt), "seed", "a", "b"))

    def ranked(df):
        df = spread_by(df, keys, len(seed_list(seeds)))
        return hash_rank(drawn(df), own, "_h", ["a", "b"], sized=(None, keys)).withColumn("split", _part(ratios, rule)).select(*cols)

    large = large_keys(pairs, keys, cell_rows)
    if large is None:
        return ranked(pairs)
    tagged = with_large(drawn(pairs), large, keys, "inner").withColumn("_cell", F.left(F.col("_h"), F.col("_digits")))
    before = Window.partitionBy(*own).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = tagged.groupBy(*own, "key_rows", "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    train, val = split_sizes(F.col("key_rows"), ratios, rule=rule)
    first, second = [F.col("_before") + F.col("_n") >= end for end in (train, train + val)]
    cuts = materialize(cells.groupBy(*own).agg(*[F.min(F.when(hit, F.col(c))).alias(name) for hit, c, name in (
        (first, "_cell", "_c1"), (first, "_before", "_b1"), (second, "_cell", "_c2"), (second, "_before", "_b2"))]))
    placed = tagged.join(F.broadcast(cuts), own)                                # one row a seed and large key
    near = (F.col("_cell") == F.col("_c1")) | (F.col("_cell") == F.col("_c2"))
    clear = placed.filter(~near).withColumn("split", F.when(F.col("_cell") < F.col("_c1"), "train").when(F.col("_cell") < F.col("_c2"), "val").otherwise("test"))
    inside = Window.partitionBy(*own, "_cell").orderBy("_h", "a", "b")
    edge = (placed.filter(near).withColumn("rank", F.when(F.col("_cell") == F.col("_c1"), F.col("_b1")).otherwise(F.col("_b2")) + F.row_number().over(inside))
            .withColumn("split", _part(ratios, rule)))
    out = clear.select(*cols).unionByName(edge.select(*cols))
    return out.unionByName(ranked(materialize(pairs.join(F.broadcast(large), keys, "left_anti"))))


def _split_all(pairs: DataFrame, seeds, *, salt: str, rule: str, ratios, cell_rows: int) -> DataFrame:
    """``split_edges`` over all pairs at once: the last pair of train and of validation is found for each seed, and every pair is held against the two.

    Hash cells are counted and the two in which a part ends are ranked; the rows of the seeds are made where they are read and never shuffled.
    """
    n = pairs.count()
    digits = min(max(math.ceil(math.log(n / cell_rows, 16)), 1), 8) if n > cell_rows else 0
    dealt = spread_by(pairs, ["a", "b"], len(seed_list(seeds)))
    hashed = key_hash(F.lit(salt), "seed", "a", "b")
    tagged = with_seeds(dealt, seeds).withColumn("_h", hashed).withColumn("_cell", F.left(F.col("_h"), F.lit(digits))).select("seed", "_h", "a", "b", "_cell")
    train, val = split_sizes(F.lit(n), ratios, rule=rule)
    before = Window.partitionBy("seed").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = tagged.groupBy("seed", "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    near = materialize(cells.filter(F.greatest(*[((F.col("_before") < end) & (end <= F.col("_before") + F.col("_n"))).cast("int") for end in (train, train + val)]) == 1))
    inside = Window.partitionBy("seed", "_cell").orderBy("_h", "a", "b")
    ranked = tagged.join(F.broadcast(near), ["seed", "_cell"]).withColumn("rank", F.col("_before") + F.row_number().over(inside))       # at most two cells a seed
    here = F.struct("_h", "a", "b")
    ends = ranked.groupBy("seed").agg(*[F.max(F.when(F.col("rank") == end, here)).alias(name) for end, name in ((train, "_train"), (train + val, "_val"))])
    listed = materialize(with_seeds(pairs.sparkSession.range(1).select(), seeds).join(ends, "seed", "left"))       # a seed of which train and validation are empty has no ends
    split = F.when(here <= F.col("_train"), "train").when(here <= F.col("_val"), "val").otherwise("test")
    met = dealt.crossJoin(F.broadcast(listed)).withColumn("_h", hashed)                                 # one row a seed
    return met.withColumn("split", split).select("seed", "split", *pairs.columns)


def split_edges_by_group(pairs: DataFrame, seeds) -> DataFrame:
    """80/10/10 within every group (sizes rounded down)."""
    return split_edges(pairs.select("a", "b", "group_id"), ["group_id"], seeds, salt="group", rule="floor")


def split_edges_random(pairs: DataFrame, seeds, *, protocol: str = "edge_random") -> DataFrame:
    """80/10/10 over all pairs (sizes rounded half to even)."""
    out = split_edges(pairs.select("a", "b", "group_id"), [], seeds, salt=protocol, rule="round")
    return out.select(F.lit(protocol).alias("protocol"), "seed", "split", "a", "b", "group_id")


def node_parts(nodes: DataFrame, seeds) -> DataFrame:
    """70/15/15 of the nodes of every group: ``seed, node_id, part``."""
    nodes = materialize(nodes.select("node_id", "group_id"))
    large = large_keys(nodes, ["group_id"])
    dealt = spread_by(nodes, ["group_id"], len(seed_list(seeds))) if large is None else nodes
    tagged = with_seeds(dealt, seeds).withColumn("_h", key_hash(F.lit("node_disjoint"), "seed", "node_id"))
    return hash_rank(tagged, ["seed", "group_id"], "_h", ["node_id"], sized=(large, ["group_id"])).select(
        "seed", "node_id", _part(K.NODE_RATIOS, "round").alias("part"))


PARTS = ("train", "val", "test")
SEEDS_PER_LONG = 31


def packed_parts(nodes: DataFrame, seeds) -> DataFrame:
    """``node_id, parts``: the parts of a node under all seeds, two bits a seed, 31 seeds a long."""
    values = seed_list(seeds)
    at = F.element_at(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[F.lit(i) for i in range(len(values))])), F.col("seed"))
    code = F.array_position(F.array(*map(F.lit, PARTS)), F.col("part"))         # 1, 2, 3
    rows = node_parts(nodes, values).withColumn("_at", at).withColumn("_code", code)
    longs = [F.sum(F.when(F.floor(F.col("_at") / SEEDS_PER_LONG) == i, F.expr(f"shiftleft(_code, 2 * (_at % {SEEDS_PER_LONG}))")).otherwise(0)).alias(f"_p{i}")
             for i in range(-(-len(values) // SEEDS_PER_LONG))]
    rows = rows.groupBy("node_id").agg(*longs)
    return rows.select("node_id", F.array(*[f"_p{i}" for i in range(len(longs))]).alias("parts"))


def split_node_disjoint(pairs: DataFrame, nodes: DataFrame, seeds) -> DataFrame:
    """Pairs whose two ends fall into the same part; the others are left out.

    The parts of all seeds travel as a few longs per node, so the pairs are joined twice in all
    and not twice per seed.
    """
    values = seed_list(seeds)
    packed = materialize(packed_parts(nodes, values))
    met = (pairs.join(packed.select(F.col("node_id").alias("a"), F.col("parts").alias("pa")), "a")
           .join(packed.select(F.col("node_id").alias("b"), F.col("parts").alias("pb")), "b"))

    same = F.array_compact(F.array(*[
        F.when(_part_code("pa", i) == _part_code("pb", i), F.struct(F.lit(s).alias("seed"), F.element_at(F.array(*map(F.lit, PARTS)), _part_code("pa", i).cast("int")).alias("split")))
        for i, s in enumerate(values)]))
    return (met.select("a", "b", "group_id", F.explode(same).alias("_s"))
            .select(F.lit("node_disjoint").alias("protocol"), "_s.seed", "_s.split", "a", "b", "group_id"))


def _part_code(parts: str, i: int) -> Column:
    """The part of seed number ``i`` out of packed parts: 0 (none) or a place in ``PARTS``."""
    return F.shiftright(F.col(parts)[i // SEEDS_PER_LONG], 2 * (i % SEEDS_PER_LONG)).bitwiseAND(F.lit(3))


def written_split(split: DataFrame, seeds) -> DataFrame:
    """The same rows from a written table of one row a pair, in which the parts of all seeds are a few longs; reading it again costs little.

    A pair occurs at most once for a seed.
    """
    values = seed_list(seeds)
    rest = [c for c in split.columns if c not in ("seed", "split")]
    code = F.array_position(F.array(*map(F.lit, PARTS)), F.col("split"))
    longs = []
    for i, first in enumerate(range(0, len(values), SEEDS_PER_LONG)):
        some = F.array(*map(F.lit, values[first:first + SEEDS_PER_LONG]))
        place = F.array_position(some, F.col("seed"))                                # 0: a seed of another long
        bits = F.call_function("shiftleft", code, (2 * (place - 1)).cast("int"))
        longs.append(F.sum(F.when(place > 0, bits).otherwise(0)).alias(f"_p{i}"))
    packed = materialize(split.groupBy(*rest).agg(*longs).select(*rest, F.array(*[f"_p{i}" for i in range(len(longs))]).alias("_parts")))
    names = F.array(*map(F.lit, PARTS))
    each = F.array_compact(F.array(*[F.when(_part_code("_parts", i) > 0, F.struct(F.lit(s).alias("seed"), F.element_at(names, _part_code("_parts", i).cast("int")).alias("split")))
                                     for i, s in enumerate(values)]))
    rows = spread_by(packed, ["a", "b"], len(values)).select(*rest, F.explode(each).alias("_s"))
    return rows.select("_s.seed", "_s.split", *rest).select(*split.columns)


# --- negatives -------------------------------------------------------------------

def _hash_number(h: Column, start: int) -> Column:
    return F.conv(F.substring(h, start, 15), 16, 10).cast("bigint")


def index_nodes(nodes: DataFrame) -> DataFrame:
    """Number the nodes of every group 0..m-1 in hash order: ``group_id, idx, node_id, m``."""
    tagged = nodes.select("node_id", "group_id").withColumn("_h", key_hash(F.lit("node"), "node_id"))
    return hash_rank(tagged, ["group_id"], "_h", ["node_id"]).select(
        "group_id", (F.col("rank") - 1).alias("idx"), "node_id", F.col("key_rows").alias("m"))


def drawn_pairs(positives: DataFrame, keys: list[str], nodes: DataFrame, forbidden: DataFrame, *,
                draws: int, first: int = 0) -> DataFrame:
    """Distinct allowed same-group pairs drawn by hash: draws ``first`` to ``first + draws - 1`` of each positive, spread like the positives."""
    indexed = index_nodes(nodes)
    sizes = indexed.groupBy("group_id").agg(F.max("m").alias("m"))
    one = (positives.join(sizes, "group_id")
           .withColumn("_j", F.explode(F.sequence(F.lit(first), F.lit(first + draws - 1))))
           .withColumn("_h", key_hash(*keys, "a", "b", "_j"))
           .select(*keys, "group_id", F.pmod(_hash_number(F.col("_h"), 1), F.col("m")).alias("li"),
                   F.pmod(_hash_number(F.col("_h"), 17), F.col("m")).alias("ri"))
           .filter(F.col("li") != F.col("ri")))
    return _named_pairs(one, keys, indexed).distinct().join(forbidden.select("a", "b"), ["a", "b"], "left_anti")


def _named_pairs(numbered: DataFrame, keys: list[str], indexed: DataFrame) -> DataFrame:
    """Node ids of the pairs of node numbers ``li, ri``."""
    left = indexed.select("group_id", F.col("idx").alias("li"), F.col("node_id").alias("_l"))
    right = indexed.select("group_id", F.col("idx").alias("ri"), F.col("node_id").alias("_r"))
    met = numbered.join(left, ["group_id", "li"]).join(right, ["group_id", "ri"])
    return met.select(*keys, "group_id", pair_low("_l", "_r").alias("a"), pair_high("_l", "_r").alias("b"))


def _listed_pairs(short: DataFrame, keys: list[str], nodes: DataFrame, forbidden: DataFrame) -> DataFrame:
    """All allowed pairs of the groups of ``short`` (keys, group_id, m), spread by their first node."""
    rows = (short.select(*keys, "group_id", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 2)).alias("li"))
            .repartition(*keys, "group_id", "li")
            .select(*keys, "group_id", "li", F.explode(F.sequence(F.col("li") + 1, F.col("m") - 1)).alias("ri")))
    return _named_pairs(rows, keys, index_nodes(nodes)).join(forbidden.select("a", "b"), ["a", "b"], "left_anti")


def _short(pool: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Keys and groups of ``wanted`` for which the pool holds fewer pairs than asked."""
    held = pool.groupBy(*keys, "group_id").agg(F.count(F.lit(1)).alias("held"))
    return (wanted.join(held, [*keys, "group_id"], "left").filter(F.coalesce("held", F.lit(0)) < F.col("n")).drop("held"))


def negative_pool(positives: DataFrame, keys: list[str], nodes: DataFrame, forbidden: DataFrame, wanted: DataFrame, *,
                  draws: int = 4) -> DataFrame:
    """Distinct allowed pairs, for every key and group at least as many as ``wanted`` says, or all there are.

    ``draws`` hash draws of each positive serve most groups.  Where they fall short and little room is left, all
    pairs of the group are listed (never more than four times the wanted number, or twice it plus the forbidden pairs); other
    short groups draw again, twice as often each time.  At least twice the wanted number is possible there, so this ends.
    """
    pool = materialize(drawn_pairs(positives, keys, nodes, forbidden, draws=draws))
    short = materialize(_short(pool, keys, wanted))
    if short.isEmpty():
        return pool
    sizes = nodes.groupBy("group_id").agg(F.count(F.lit(1)).alias("m"))
    taken = (canonical_forbidden(forbidden).join(nodes.select(F.col("node_id").alias("a"), "group_id"), "a")
             .join(nodes.select(F.col("node_id").alias("b"), F.col("group_id").alias("_g")), "b").filter(F.col("group_id") == F.col("_g"))
             .groupBy("group_id").agg(F.count(F.lit(1)).alias("taken")))
    total = F.expr("m * (m - 1) div 2")
    sized = materialize(short.join(sizes, "group_id").join(taken, "group_id", "left").withColumn("total", total)
                        .withColumn("dense", (F.col("total") <= 4 * F.col("n"))
                                    | (F.col("total") - F.coalesce("taken", F.lit(0)) <= 2 * F.col("n"))))
    listed = _listed_pairs(sized.filter("dense AND m > 1"), keys, nodes, forbidden)
    pool = materialize(pool.unionByName(listed).distinct())
    open_ = sized.filter("NOT dense").select(*keys, "group_id", "n")
    while not open_.isEmpty():
        again = positives.join(open_.select(*keys, "group_id"), [*keys, "group_id"], "left_semi")
        pool = materialize(pool.unionByName(drawn_pairs(again, keys, nodes, forbidden, draws=draws, first=draws)).distinct())
        draws *= 2
        open_ = materialize(_short(pool, keys, open_))
    return pool


def canonical_forbidden(forbidden: DataFrame) -> DataFrame:
    return forbidden.select(pair_low("a", "b").alias("a"), pair_high("a", "b").alias("b")).distinct()


def _take(pairs: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """First ``n`` drawn pairs of every key and group in hash order."""
    own = [*keys, "group_id"]
    large = large_keys(pairs, own)
    dealt = spread_by(pairs, own, 1) if large is None else pairs                # the hash is taken after the shuffle and does not travel
    ranked = hash_rank(dealt.withColumn("_h", key_hash(*keys, "a", "b")), own, "_h", ["a", "b"], sized=(large, own)).drop("_h")
    return ranked.join(wanted, [*keys, "group_id"]).filter(F.col("rank") <= F.col("n")).select(
        *keys, "a", "b", "group_id")


def wanted_negatives(positives: DataFrame, keys: list[str], ratio: float = 1.0) -> DataFrame:
    return positives.groupBy(*keys, "group_id").agg(
        F.bround(F.count(F.lit(1)) * F.lit(ratio), 0).cast("bigint").alias("n"))


def _in_groups(positives: DataFrame, keys: list[str], nodes: DataFrame, forbidden: DataFrame, wanted: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Negatives drawn group by group, and what of ``wanted`` is left to joins over all groups: large groups, and runs whose draws fall short."""
    large = materialize(D.large_groups(wanted, nodes))
    some = not large.isEmpty()
    part, asked = [df.join(F.broadcast(large), "group_id", "left_anti") if some else df for df in (positives, wanted)]      # few groups
    drawn = D.group_negatives(part, keys, nodes, forbidden, asked, **how)
    lack = drawn.filter("a IS NULL" + (" AND step IS NULL" if "step" in drawn.columns else ""))
    rest = wanted.join(lack.select(*keys, "group_id"), [*keys, "group_id"], "left_semi")
    if some:
        rest = rest.unionByName(wanted.join(F.broadcast(large), "group_id", "left_semi"))
    return drawn, materialize(rest)


def uniform_negatives(positives: DataFrame, keys: list[str], nodes: DataFrame, forbidden: DataFrame, *,
                      ratio: float = 1.0, draws: int = 4) -> DataFrame:
    """As many distinct allowed pairs per key and group as there are positives (times ratio); fewer only where no more exist."""
    wanted = materialize(wanted_negatives(positives, keys, ratio))
    drawn, rest = _in_groups(positives, keys, nodes, forbidden, wanted, draws=draws)
    drawn = drawn.filter("a IS NOT NULL").select(*keys, "a", "b", "group_id")
    if rest.isEmpty():
        return drawn
    own = [*keys, "group_id"]
    mine = materialize(positives.join(rest.select(*own), own, "left_semi"))
    return drawn.unionByName(_take(negative_pool(mine, keys, nodes, forbidden, rest, draws=draws), keys, rest))


def _take_nearest(pairs: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """First ``n`` pairs of every key and group by ``far``, then in hash order."""
    own = [*keys, "group_id"]
    sizes = pairs.groupBy(*own, "far").agg(F.count(F.lit(1)).alias("_n"))          # one row a band distance
    w = Window.partitionBy(*own).orderBy("far").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*own, "far", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_nearer"))
    ranked = hash_rank(pairs, [*own, "far"], "_h", ["a", "b"]).join(before, [*own, "far"]).join(wanted, own)
    return ranked.filter(F.col("_nearer") + F.col("rank") <= F.col("n")).select(*keys, "a", "b", "group_id")


def _fill(slots: DataFrame, spare: DataFrame, keys: list[str]) -> DataFrame:
    """As many drawn pairs as slots are left over, those in the band nearest to such a slot first."""
    own = [*keys, "group_id"]
    missing = slots.groupBy(*own).agg(F.count(F.lit(1)).alias("n"))
    # bands per key and group: a few dozen, whatever the number of pairs
    dry = slots.select(*own, band_of(F.col("product")).alias("_dry")).distinct()
    spare = spare.withColumn("band", band_of(F.col("product")))
    near = (spare.select(*own, "band").distinct().join(dry, own).groupBy(*own, "band").agg(F.min(F.abs(F.col("band") - F.col("_dry"))).alias("far")))
    return _take_nearest(spare.join(near, [*own, "band"]).select(*own, "a", "b", "_h", "far"), keys, missing)


def degree_matches(positives: DataFrame, keys: list[str], nodes: DataFrame, forbidden: DataFrame, degree: DataFrame, *,
                   draws: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drawn pairs matched one to one to the positives by degree product (see ``match_products``), positives left over, and the drawn pairs that fill their places.

    ``degree`` holds ``protocol, seed, node_id, degree``; a node without a row counts as 0.
    """
    own = [*keys, "group_id"]
    wanted = materialize(wanted_negatives(positives, keys))
    drawn, rest = _in_groups(positives, keys, nodes, forbidden, wanted, draws=draws, degree=degree, degree_keys=SPLIT_KEYS)
    steps = drawn.filter(F.col("step").isNotNull())
    found = steps.filter(~F.col("step").isin(D.NONE_FITS, D.NEAREST)).select(*own, "slot_a", "slot_b", "a", "b", "gap", "step")
    left = steps.filter(F.col("step") == D.NONE_FITS).select(*own, F.col("slot_a").alias("a"), F.col("slot_b").alias("b"))
    filled = steps.filter(F.col("step") == D.NEAREST).select(*keys, "a", "b", "group_id")
    if rest.isEmpty():
        return found, left, filled
    mine = materialize(positives.join(rest.select(*own), own, "left_semi").select(*keys, "a", "b", "group_id"))
    pool = negative_pool(mine, keys, nodes, forbidden, rest, draws=draws)

    def measured(pairs):
        def of(end):
            return degree.select(*SPLIT_KEYS, F.col("node_id").alias(end), F.col("degree").alias("_d" + end))
        met = pairs.join(of("a"), [*SPLIT_KEYS, "a"], "left").join(of("b"), [*SPLIT_KEYS, "b"], "left")
        product = F.coalesce("_da", F.lit(0)) * F.coalesce("_db", F.lit(0))
        return materialize(met.withColumn("product", product.cast("bigint")).withColumn("_h", key_hash(*keys, "a", "b")).drop("_da", "_db"))

    more, slots, spare = match_products(measured(mine), measured(pool), own)
    return (found.unionByName(more), left.unionByName(slots.select(*own, "a", "b")), filled.unionByName(_fill(slots, spare, keys)))


def degree_matched_negatives(positives: DataFrame, keys: list[str], nodes: DataFrame, forbidden: DataFrame,
                             degree: DataFrame, *, draws: int = 4) -> DataFrame:
    """One negative per positive, its log degree product within 0.35 of the positive's wherever a free drawn pair is.

    Positives that no free drawn pair fits get the drawn pairs that are left, those in the band nearest to such a positive first.
    """
    found, _, filled = degree_matches(positives, keys, nodes, forbidden, degree, draws=draws)
    return found.select(*keys, "a", "b", "group_id").unionByName(filled)


def shortfalls(positives: DataFrame, negatives: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and groups for which too few negatives exist (such a split is skipped or raised by the caller)."""
    got = negatives.groupBy(*keys, "group_id").agg(F.count(F.lit(1)).alias("got"))
    return (wanted_negatives(positives, keys).join(got, [*keys, "group_id"], "left")
            .withColumn("got", F.coalesce("got", F.lit(0))).filter(F.col("got") < F.col("n")))


def labelled(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Positives then negatives, told apart by ``label``."""
    cols = [c for c in positives.columns if c in negatives.columns]
    return positives.select(*cols, F.lit(1).alias("label")).unionByName(
        negatives.select(*cols, F.lit(0).alias("label")))


# --- whole splits -----------------------------------------------------------------

def link_split(edges: DataFrame, nodes: DataFrame, seeds) -> DataFrame:
    """Per-group split of known edges with uniform negatives; message edges are the train positives.

    Returns ``seed, split, label, a, b, group_id``.  Fails when a group has too few pairs that are no edge.
    """
    keys = ["seed", "split"]
    pos = written_split(split_edges_by_group(edges, seeds), seeds)
    neg = uniform_negatives(pos, keys, nodes, edges)
    require_empty(shortfalls(pos, neg, keys).select(F.concat_ws("/", *keys, "group_id")), "too few possible negatives (seed/split/group)")
    return labelled(pos, neg)


def positive_edges(split: DataFrame, keys: list[str]) -> DataFrame:
    """The whole edge set of every run again: train, validation and test positives together."""
    return split.filter(F.col("label") == 1).select(*keys, "a", "b", "group_id")


def message_edges(split: DataFrame) -> DataFrame:
    """Train positives of a link split, in both directions."""
    from edgeloom.operators.pairs import both_ways
    return both_ways(split.filter((F.col("split") == "train") & (F.col("label") == 1)), "a", "b", "seed")


def holdout_degrees(nodes: DataFrame, context: DataFrame, positives: DataFrame) -> DataFrame:
    """Degree on the context graph without the held-out pairs: ``protocol, seed, node_id, degree``.

    The runs without an edge are bits of one long, and what they lack is counted bit-sliced, so each edge is one row for all runs; nodes are
    unfolded into runs last.
    """
    listed = [(r[0], r[1]) for r in positives.select(*SPLIT_KEYS).distinct().collect()]         # one entry per run, tens at most
    runs = R.number_runs(nodes.sparkSession, listed)
    base = context.select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("d"))
    held = positives.filter(F.col("split") != "train").select(*SPLIT_KEYS, "a", "b").join(context.select("a", "b"), ["a", "b"], "left_semi")
    gone = R.masks(R.numbered(held, runs), ["a", "b"], name="gone").select("slab", "gone", F.explode(F.array("a", "b")).alias("node_id"))
    taken = R.count_masks(gone, ["slab", "node_id"], "gone")
    full = R.on_every_slab(nodes.select("node_id").join(base, "node_id", "left"), listed).join(taken, ["slab", "node_id"], "left")
    out = R.each_run(full, "all").select("slab", "bit", "node_id", (F.coalesce("d", F.lit(0)) - F.coalesce(R.count_of("counts", "bit"), F.lit(0))).alias("degree"))
    return R.named(out, runs).select(*SPLIT_KEYS, "node_id", "degree")


def protocol_positives(pairs: DataFrame, nodes: DataFrame, seeds, protocol: str) -> DataFrame:
    split = split_node_disjoint(pairs, nodes, seeds) if protocol == "node_disjoint" else split_edges_random(pairs, seeds, protocol=protocol)
    return written_split(split, seeds)


def protocol_split(pairs: DataFrame, nodes: DataFrame, context: DataFrame, seeds,
                   protocols=("edge_random", "node_disjoint", "degree_matched"), *, draws: int = 4) -> DataFrame:
    """All protocols and seeds at once: ``protocol, seed, split, label, a, b, group_id``.

    Negatives avoid the positives only, so a context edge may serve as a negative.
    """
    keys, parts = [*SPLIT_KEYS, "split"], []
    for protocol in protocols:
        pos = protocol_positives(pairs, nodes, seeds, protocol)
        if protocol == "degree_matched":
            neg = degree_matched_negatives(pos, keys, nodes, pairs, holdout_degrees(nodes, context, pos), draws=draws)
        else:
            neg = uniform_negatives(pos, keys, nodes, pairs, draws=draws)
        parts.append(labelled(pos, neg))
    return reduce(DataFrame.unionByName, parts)


def usable_runs(split: DataFrame) -> DataFrame:
    """Counts per run, whether it can be evaluated, and the reason if not.

    A run needs its full number of negatives, two test positives and a test negative.
    """
    per = split.groupBy(*SPLIT_KEYS, "split", "group_id").agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))

    def total(what, part):
        return F.sum(F.when(F.col("split") == part, F.col(what)).otherwise(0))
    counts = per.groupBy(*SPLIT_KEYS).agg(
        *[total("p", part).alias(f"n_{part}_pos") for part in ("train", "val", "test")],
        total("n", "test").alias("n_test_neg"), F.bool_or(F.col("n") < F.col("p")).alias("_short"))
    few = (F.col("n_test_pos") < K.MIN_TEST_POSITIVES) | (F.col("n_test_neg") == 0)
    reason = (F.when(F.col("_short"), F.lit("too few possible negatives"))
              .when(few, F.lit("too few test pairs")).otherwise(F.lit("")))
    return counts.withColumn("usable", ~(F.col("_short") | few)).withColumn("reason", reason).drop("_short")


def permuted_features(features: DataFrame, seed: int) -> DataFrame:
    """Every vector handed to another node: rank by id hash meets rank by seeded hash."""
    def ranked(salt, keep):
        tagged = features.withColumn("_h", key_hash(F.lit(salt), "node_id"))
        return hash_rank(tagged, [], "_h", ["node_id"]).select("rank", keep)
    return ranked("identity", "node_id").join(ranked(f"permute-{seed}", "vector"), "rank").drop("rank")
