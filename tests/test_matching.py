"""Matching by degree product: one to one, inside the tolerance, and maximal; held against plain loops."""
import math
import random

import pytest

from edgeloom.operators import matching as MA
from edgeloom.operators import ranking as R
from edgeloom.operators.ranking import key_hash

_SCHEMA = "k string, group_id bigint, a bigint, b bigint, product bigint"
OWN = ["k", "group_id"]


def _run(spark, slots, drawn):
    frames = [spark.createDataFrame(rows, _SCHEMA).withColumn("_h", key_hash("k", "a", "b")) for rows in (slots, drawn)]
    found, left, free = MA.match_products(*frames, OWN)
    return found.collect(), left.collect(), free.collect()


def _log(p):
    return math.log(p + 1)


def _check(slots, drawn, found, left, free):
    want = {(k, g, a, b): p for k, g, a, b, p in slots}
    have = {(k, g, a, b): p for k, g, a, b, p in drawn}
    served = [(r.k, r.group_id, r.slot_a, r.slot_b) for r in found]
    used = [(r.k, r.group_id, r.a, r.b) for r in found]
    over, spare = [(r.k, r.group_id, r.a, r.b) for r in left], [(r.k, r.group_id, r.a, r.b) for r in free]
    assert sorted(served + over) == sorted(want) and sorted(used + spare) == sorted(have)        # each row once, none lost
    for s, d, r in zip(served, used, found):
        assert abs(r.gap - abs(_log(want[s]) - _log(have[d]))) < 1e-9 and r.gap <= 0.35 + 1e-12
        assert (r.step == "equal") == (want[s] == have[d]) or r.step != "equal"
    for s in over:                                                                              # nothing that fits is free
        assert not [d for d in spare if d[:2] == s[:2] and abs(_log(want[s]) - _log(have[d])) <= 0.35]


def _cases():
    """Rows of several keys and groups, so that one run serves all tests: ``(slots, drawn)``."""
    draw = random.Random(3)
    slots, drawn = [], []
    for g, top in enumerate((40, 400, 6)):                       # random products, crowded to the lower end on the drawn side
        slots += [("random", g, i, 1000 + i, draw.randrange(top)) for i in range(100)]
        drawn += [("random", g, i, 2000 + i, int(draw.random() ** 2 * top * 1.3)) for i in range(110)]
    low = [r for r in range(1, 3000) if math.floor(_log(r) / 0.35) == 20]
    high = [r for r in range(1, 6000) if math.floor(_log(r) / 0.35) == 21]
    for g, (one, other) in enumerate(((low, high), (high, low))):
        slots += [("border", g, i, 10_000, draw.choice(one)) for i in range(80)]
        drawn += [("border", g, i, 20_000, draw.choice(other)) for i in range(60)]
    slots += [("hot", 1, i, 5000 + i, 12) for i in range(400)] + [("only slots", 1, i, 50, i) for i in range(9)]
    drawn += [("hot", 1, i, 9000 + i, 12) for i in range(300)] + [("only drawn", 1, i, 50, i) for i in range(9)]
    return slots, drawn


@pytest.fixture(scope="module")
def matched(spark):
    slots, drawn = _cases()
    return slots, drawn, _run(spark, slots, drawn)


def test_one_to_one_inside_the_tolerance_and_maximal(matched):
    slots, drawn, (found, left, free) = matched
    _check(slots, drawn, found, left, free)
    assert {r.step for r in found if r.k == "random"} == {"equal", "band", "border"}


def test_border_serves_as_many_as_fit(matched):
    """Products just under and over a band's border: the running minimum gives the greatest number of matches."""
    slots, drawn, (found, _, _) = matched
    for g in (0, 1):
        mine = [[p for k, gg, _, _, p in rows if (k, gg) == ("border", g)] for rows in (slots, drawn)]
        # sets of fitting drawn pairs are nested, so serving those with the fewest first is best
        fits = sorted(sum(abs(_log(s) - _log(d)) <= 0.35 for d in mine[1]) for s in mine[0])
        best = 0
        for n in fits:
            best += best < n
        steps = [r.step for r in found if (r.k, r.group_id) == ("border", g)]
        assert steps == ["border"] * best and best > 0


def test_hot_product_and_empty_sides(matched):
    _, _, (found, left, free) = matched
    hot = [r for r in found if r.k == "hot"]
    assert len(hot) == 300 and {r.gap for r in hot} == {0.0} and sum(r.k == "hot" for r in left) == 100
    assert not [r for r in found if r.k.startswith("only")]
    assert sum(r.k == "only slots" for r in left) == 9 and sum(r.k == "only drawn" for r in free) == 9


def test_running_lows(spark):
    rows = [("x", i, (7 * i) % 11 - i % 3) for i in range(40)] + [("y", 3, 5), ("y", 4, None), ("y", 9, 1)]
    df = spark.createDataFrame(rows, "k string, v int, m int").repartition(5)
    got = {(r.k, r.v): r.low for r in R.running_lows(df, ["k"], "v", "m", name="low").collect()}
    for k, v, _ in rows:
        before = [m for kk, vv, m in rows if kk == k and vv < v and m is not None]
        assert got[(k, v)] == (min(before) if before else None)
