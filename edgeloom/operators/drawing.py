"""Negatives of whole groups: the pairs of a group, its nodes and what is forbidden there meet in one task, and all runs are drawn there.

A positive is one row for all runs (bits), so neither the rows of the runs nor their draws are ever shuffled or written; only what is taken is.  The draws, their
order and the matching are those of ``operators/splits.py`` and ``operators/matching.py``, which serve the groups that are too large for a task, or too full.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom import constants as K
from edgeloom.operators.runs import RUNS_PER_LONG
from edgeloom.session import materialize

try:
    from _md5 import md5                                 # the plain one of Python: short texts cost a third
except ImportError:
    from hashlib import md5

LOCAL_NODES = 1024                  # nodes of a group that is worked on in one task; its pairs fit a bitmap
LOCAL_POSITIVES = 2_000_000         # positives of all runs of such a group
PAIRS_PER_TASK = 500_000            # positives of all runs that a task draws for
UP, DOWN = math.exp(K.LOG_DEGREE_TOLERANCE), math.exp(-K.LOG_DEGREE_TOLERANCE)
NONE_FITS, NEAREST = "none fits", "nearest"
_STEPS = ("equal", "band", "border", "border")


def large_groups(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """``group_id`` of the groups that no task takes whole; few, since each holds many nodes or positives."""
    crowded = nodes.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LOCAL_NODES)
    busy = wanted.groupBy("group_id").agg(F.sum("n").alias("n")).filter(F.col("n") > LOCAL_POSITIVES)
    return crowded.select("group_id").union(busy.select("group_id")).distinct()


def numbered(wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``keys..., code`` of the runs that want negatives, and how many there are (one row a run, tens or hundreds)."""
    found = sorted((tuple(r) for r in wanted.select(*keys).distinct().collect()), key=lambda r: [str(v) for v in r])
    schema = ", ".join(f"{k} {wanted.schema[k].dataType.simpleString()}" for k in keys)
    return wanted.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(found)], f"{schema}, code int"), len(found)


def _digests(texts: list[bytes]) -> np.ndarray:
    """The md5 of each text as two unsigned numbers, whose order is that of the hex digits."""
    return np.frombuffer(b"".join([md5(t).digest() for t in texts]), ">u8").astype(np.uint64).reshape(-1, 2)


def _in_hash_order(digests: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    order = np.argsort(digests[:, 0], kind="stable")
    first = digests[order, 0]
    return np.lexsort((pairs, digests[:, 1], digests[:, 0])) if (first[1:] == first[:-1]).any() else order


class _Group:
    """Nodes of a group in the order of their ids, and the same in the order of their hashes, by which draws name them."""

    def __init__(self, ids: list, forbidden: list[tuple]):
        texts = [str(i).encode() for i in ids]
        drawn = sorted(range(len(ids)), key=lambda i: (md5(b"node|" + texts[i]).digest(), ids[i]))
        self.ids = sorted(set(ids))
        self.place = {v: i for i, v in enumerate(self.ids)}
        self.texts = [str(i).encode() for i in self.ids]
        self.drawn = np.array([self.place[ids[i]] for i in drawn], dtype=np.int64)
        n = len(self.ids)
        self.free = np.ones(n * n, dtype=bool)
        for a, b in forbidden:
            if a in self.place and b in self.place:
                self.free[self.place[a] * n + self.place[b]] = False

    def pool(self, prefix: bytes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct allowed pairs that the texts draw, in hash order, and their digests; a pair is its two places in one number."""
        if not len(self.drawn):
            return np.empty(0, np.int64), np.empty((0, 2), np.uint64)
        ends = ((_digests([prefix + t for t in texts]) >> np.uint64(4)) % np.uint64(len(self.drawn))).astype(np.int64)
        ends = self.drawn[ends[ends[:, 0] != ends[:, 1]]]
        pairs = np.unique(ends.min(axis=1) * len(self.ids) + ends.max(axis=1))
        pairs = pairs[self.free[pairs]]
        found = self.hashed(prefix, pairs)
        order = _in_hash_order(found, pairs)
        return pairs[order], found[order]

    def hashed(self, prefix: bytes, pairs: np.ndarray) -> np.ndarray:
        n, t = len(self.ids), self.texts
        return _digests([prefix + t[i] + b"|" + t[j] for i, j in zip((pairs // n).tolist(), (pairs % n).tolist())])

    def ends(self, pairs: np.ndarray) -> tuple[list, list]:
        n, ids = len(self.ids), self.ids
        return [ids[i] for i in (pairs // n).tolist()], [ids[i] for i in (pairs % n).tolist()]


# --- matching by degree product, see operators/matching.py ----------------------------

def bands(product: np.ndarray) -> np.ndarray:
    return np.floor(np.log(product + 1.0) / K.LOG_DEGREE_TOLERANCE).astype(np.int64)


def _in_cells(slots: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the slots and drawn pairs with the same number in a cell; both sides come in hash order."""
    one, other = np.argsort(slots, kind="stable"), np.argsort(drawn, kind="stable")
    a, b = slots[one], drawn[other]

    def held(mine, theirs):
        number = np.arange(len(mine)) - np.searchsorted(mine, mine, "left")
        return number < np.searchsorted(theirs, mine, "right") - np.searchsorted(theirs, mine, "left")
    return one[held(a, b)], other[held(b, a)]


def _over_borders(slots: np.ndarray, drawn: np.ndarray, odd: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the slots and drawn pairs that meet over every second border between bands."""
    at, to = bands(slots) + odd, bands(drawn) + odd
    up, up_to = at % 2 == 0, to % 2 == 1                 # the wanted pair has the smaller product
    reach = np.where(up, np.floor((slots + 1.0) * UP) - 1, 1 - np.ceil((slots + 1.0) * DOWN)).astype(np.int64)
    own = np.where(up_to, drawn, -drawn)
    side, side_to = at // 2 * 2 + up, to // 2 * 2 + up_to
    found = [], []
    for s in np.intersect1d(side, side_to):
        i, j = np.flatnonzero(side == s), np.flatnonzero(side_to == s)
        i, j = i[np.argsort(reach[i], kind="stable")], j[np.argsort(own[j], kind="stable")]
        number = np.arange(1, len(i) + 1)
        served = number + np.minimum(np.minimum.accumulate(np.searchsorted(own[j], reach[i], "right") - number), 0)
        i = i[np.diff(served, prepend=0) > 0]
        found[0].append(i)
        found[1].append(j[:len(i)])
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in found)


def match(slots: np.ndarray, drawn: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Steps of the matching with the places of their slots and drawn pairs, then the slots left over next to the drawn pairs that are.

    Both sides are degree products in hash order.
    """
    i, j = np.arange(len(slots)), np.arange(len(drawn))
    for at, step in enumerate(_STEPS):
        s, d = slots[i], drawn[j]
        one, other = (_in_cells(s, d) if at == 0 else _in_cells(bands(s), bands(d)) if at == 1 else _over_borders(s, d, at - 2))
        yield step, i[one], j[other]
        i, j = np.delete(i, one), np.delete(j, other)
    yield NONE_FITS, i, j


def _nearest(slots: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Places of as many spare pairs as slots: those in the band nearest to a slot's first, then in hash order."""
    dry = np.unique(bands(slots))
    far = np.abs(bands(spare)[:, None] - dry[None, :]).min(axis=1)
    return np.argsort(far, kind="stable")[:len(slots)]


# --- Spark side ------------------------------------------------------------------------

def group_negatives(positives: DataFrame, keys: list[str], nodes: DataFrame, forbidden: DataFrame, wanted: DataFrame, *, draws: int,
                    degree: DataFrame | None = None, degree_keys: list[str] = ()) -> DataFrame:
    """Negatives of every run and group, written: ``keys..., a, b, group_id``; a run whose draws fall short has one row without a pair in that group instead.

    With ``degree`` (``degree_keys, node_id, degree``) they are matched to the positives and ``slot_a, slot_b, gap, step`` tell how; a positive that nothing fits is a row
    of step 'none fits' without ``a, b``, and the pairs that take the place of such ones are of step 'nearest'.
    """
    runs, n_runs = numbered(wanted, keys)
    coded = F.broadcast(runs)                                                        # one row a run
    longs = max(1, -(-n_runs // RUNS_PER_LONG))
    bit = F.expr(f"shiftleft(1L, code % {RUNS_PER_LONG})")
    masks = [F.coalesce(F.bit_or(F.when(F.floor(F.col("code") / RUNS_PER_LONG) == i, bit)), F.lit(0)).alias(f"_m{i}") for i in range(longs)]
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                -(-(wanted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]) // PAIRS_PER_TASK))
    folded = positives.join(coded, keys).groupBy("group_id", "a", "b").agg(*masks).select(
        "group_id", "a", "b", F.array(*[f"_m{i}" for i in range(longs)]).alias("runs")).repartition(tasks, "group_id")
    types = {"a": positives.schema["a"].dataType.simpleString(), "group_id": positives.schema["group_id"].dataType.simpleString()}

    home = nodes.select(F.col("group_id").cast(types["group_id"]).alias("home"), F.col("node_id").cast(types["a"]).alias("a"))
    none, empty = F.lit(None).cast(types["a"]), F.array().cast("array<bigint>")
    lists = empty
    per_run: list[int] | None = None
    if degree is not None:
        listed = sorted({tuple(r) for r in runs.select(*degree_keys).collect()})
        at = {r: i for i, r in enumerate(listed)}
        per_run = [at[tuple(r[k] for k in degree_keys)] for r in runs.orderBy("code").collect()]
        places = nodes.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(listed)], ", ".join(
            f"{k} {runs.schema[k].dataType.simpleString()}" for k in degree_keys) + ", _at int")
        per = degree.join(F.broadcast(places), list(degree_keys)).groupBy("node_id").agg(F.array(*[
            F.coalesce(F.sum(F.when(F.col("_at") == i, F.col("degree"))), F.lit(0)).cast("bigint") for i in range(len(listed))]).cast("array<bigint>").alias("_d"))
        home = home.join(per.select(F.col("node_id").cast(types["a"]).alias("a"), "_d"), "a", "left")
        lists = F.coalesce("_d", empty)
    owned = home.select("home", F.lit(0).alias("kind"), "a", none.alias("b"), F.lit(0).alias("code"), F.lit(0).cast("bigint").alias("n"), lists.alias("degrees"))
    closed = forbidden.select("a", "b").distinct().join(nodes.select(F.col("group_id").cast(types["group_id"]).alias("home"), F.col("node_id").alias("a")), "a").select(
        "home", F.lit(1).alias("kind"), F.col("a").cast(types["a"]).alias("a"), F.col("b").cast(types["a"]).alias("b"), F.lit(0).alias("code"), F.lit(0).cast("bigint").alias("n"), empty.alias("degrees"))
    asked = wanted.join(coded, keys).select(F.col("group_id").alias("home"), F.lit(2).alias("kind"), none.alias("a"), none.alias("b"), "code", "n", empty.alias("degrees"))
    around = owned.unionByName(closed).unionByName(asked).repartition(tasks, "home")
    prefixes = [("|".join(str(r[k]) for k in keys if r[k] is not None) + "|").encode() for r in runs.orderBy("code").collect()]

    def work(rows: pa.Table, near: pa.Table) -> pa.Table:
        return _work(rows, near, prefixes, per_run, draws)

    schema = f"code int, a {types['a']}, b {types['a']}, group_id {types['group_id']}"
    if degree is not None:
        schema += f", slot_a {types['a']}, slot_b {types['a']}, gap double, step string"
    drawn = materialize(folded.groupBy("group_id").cogroup(around.groupBy("home")).applyInArrow(work, schema))
    return drawn.join(coded, "code").drop("code")


def _work(rows: pa.Table, near: pa.Table, prefixes: list[bytes], per_run: list[int] | None, draws: int) -> pa.Table:
    """All runs of one group."""
    if not rows.num_rows or not near.num_rows:
        types = {"code": pa.int32(), "gap": pa.float64(), "step": pa.string(), "group_id": rows.schema.field("group_id").type}
        names = ["code", "a", "b", "group_id"] + ["slot_a", "slot_b", "gap", "step"] * (per_run is not None)
        return pa.schema([(c, types.get(c, rows.schema.field("a").type)) for c in names]).empty_table()
    kind = near.column("kind").to_numpy()

    def of(which, *names):
        part = near.filter(pa.array(kind == which))
        return [part.column(name).to_pylist() for name in names]
    ids, degrees = of(0, "a", "degrees")
    group = _Group(ids, list(zip(*of(1, "a", "b"))))
    matched = per_run is not None
    cols: dict[str, list] = {c: [] for c in (["code", "a", "b"] + (["slot_a", "slot_b", "gap", "step"] if matched else []))}
    one, other = rows.column("a").to_pylist(), rows.column("b").to_pylist()
    texts = [b"%s|%s|" % (str(a).encode(), str(b).encode()) for a, b in zip(one, other)]
    numbers = [str(j).encode() for j in range(draws)]
    bits = np.array(rows.column("runs").to_pylist(), dtype=np.int64).reshape(len(one), -1)
    if matched:
        width = 1 + max(per_run, default=0)
        degree = np.zeros((len(group.ids), width), np.int64)
        for i, d in zip(ids, degrees):
            if d:
                degree[group.place[i]] = d
        n = len(group.ids)
        spots = np.array([(group.place.get(a, -1), group.place.get(b, -1)) for a, b in zip(one, other)], np.int64).reshape(-1, 2)
        degree = np.vstack((degree, np.zeros((1, width), np.int64)))                 # an end that is no node counts as 0

    def put(code, pairs, slots=None, gap=None, step=None):
        a, b = pairs if pairs is not None else ([None] * len(slots), [None] * len(slots))
        cols["code"] += [code] * len(a)
        cols["a"] += a
        cols["b"] += b
        if matched:
            at = [None] * len(a) if slots is None else slots.tolist()
            cols["slot_a"] += [None if i is None else one[i] for i in at]
            cols["slot_b"] += [None if i is None else other[i] for i in at]
            cols["gap"] += [None] * len(a) if gap is None else gap.tolist()
            cols["step"] += [step] * len(a)

    for code, want in sorted(zip(*of(2, "code", "n"))):
        mine = np.flatnonzero((bits[:, code // RUNS_PER_LONG] >> (code % RUNS_PER_LONG)) & 1)
        pairs, _ = group.pool(prefixes[code], [texts[i] + j for i in mine.tolist() for j in numbers])
        if len(pairs) < want:
            put(code, ([None], [None]))
        elif not matched:
            put(code, group.ends(pairs[:want]))
        else:
            found = _digests([prefixes[code] + texts[i][:-1] for i in mine.tolist()])
            mine = mine[np.lexsort((mine, found[:, 1], found[:, 0]))]
            d = degree[:, per_run[code]]
            slots, drawn = d[spots[mine, 0]] * d[spots[mine, 1]], d[pairs // n] * d[pairs % n]
            for step, i, j in match(slots, drawn):
                if step == NONE_FITS:
                    put(code, None, mine[i], None, step)
                    put(code, group.ends(pairs[j[_nearest(slots[i], drawn[j])]] if len(i) else pairs[:0]), None, None, NEAREST)
                else:
                    put(code, group.ends(pairs[j]), mine[i], np.abs(np.log(drawn[j] + 1.0) - np.log(slots[i] + 1.0)), step)
    kinds = {"code": pa.int32(), "gap": pa.float64(), "step": pa.string()}
    out = pa.table({c: pa.array(v, kinds.get(c, rows.schema.field("a").type)) for c, v in cols.items()})
    home = rows.column("group_id")
    return out.add_column(3, "group_id", pa.array([home[0].as_py()] * out.num_rows, home.type))
