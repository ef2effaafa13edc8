"""Runs as bits: masks, bit-sliced counts, walks by difference, all against plain loops."""
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import runs as R
from edgeloom.operators import splits as S
from edgeloom.operators.context import RunContext


def test_masks_and_bit_sliced_counts(spark):
    rng = random.Random(3)
    runs = [("p", s) for s in range(63)] + [("q", s) for s in range(40)]           # two slabs
    numbers = R.number_runs(spark, runs)
    rows = [(p, s, n) for p, s in runs for n in range(30) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, "protocol string, seed int, n int")
    folded = R.masks(R.numbered(df, numbers), ["n"])
    assert folded.count() <= 60
    back = R.named(R.each_run(folded, "mask"), numbers).select("protocol", "seed", "n").collect()
    assert sorted(map(tuple, back)) == sorted(rows)
    keyed = folded.withColumn("k", F.col("n") % 2)
    counts = R.on_every_slab(spark.range(2).select(F.col("id").cast("int").alias("k")), runs).join(R.count_masks(keyed, ["slab", "k"], "mask"), ["slab", "k"])
    got = R.named(R.each_run(counts, "all").withColumn("c", R.count_of("counts", "bit")), numbers).collect()
    assert len(got) == 2 * len(runs)
    for r in got:
        assert r.c == sum(1 for p, s, n in rows if (p, s, n % 2) == (r.protocol, r.seed, r.k))


def _positives(spark, removed):
    """One run a list of removed pairs; a train pair keeps each run alive."""
    rows = [("edge_random", s, "test", a, b) for s, pairs in enumerate(removed) for a, b in pairs]
    rows += [("edge_random", s, "train", 90, 91) for s in range(len(removed))]
    return spark.createDataFrame(rows, "protocol string, seed int, split string, a bigint, b bigint")


def _walks(edges, size):
    m = np.zeros((size, size), int)
    for a, b in edges:
        m[a, b] = m[b, a] = 1
    return m @ m @ m


def test_one_two_and_three_removed_steps_of_one_walk(spark):
    """Path 0-1-2-3 with a bypass: every set of removed steps, among them all three and the asked pair's own edge."""
    edges = [(0, 1), (1, 2), (2, 3), (0, 4), (3, 4), (1, 4), (0, 3)]
    removed = [list(c) for n in range(len(edges) + 1) for c in itertools.combinations(edges, n)]      # 128 runs, three slabs
    context = spark.createDataFrame(edges, "a bigint, b bigint")
    wanted = list(itertools.combinations(range(5), 2))
    pairs = spark.createDataFrame([("edge_random", s, a, b) for s in range(len(removed)) for a, b in wanted], "protocol string, seed int, a bigint, b bigint")
    got = {(r.seed, r.a, r.b): r.l3 for r in RunContext(context, _positives(spark, removed)).three_walks(pairs).collect()}
    for s, gone in enumerate(removed):
        three = _walks(set(edges) - set(gone), 5)
        for a, b in wanted:
            assert got.get((s, a, b), 0) == three[a, b], (gone, a, b)


def test_masked_walks_agree_with_walks_by_difference(spark):
    rng = random.Random(8)
    edges = [p for p in itertools.combinations(range(14), 2) if rng.random() < 0.4]
    removed = [rng.sample(edges, 6) for _ in range(9)]
    context = RunContext(spark.createDataFrame(edges, "a bigint, b bigint"), _positives(spark, removed))
    pairs = spark.createDataFrame([("edge_random", s, a, b) for s in range(9) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.3],
                                  "protocol string, seed int, a bigint, b bigint")
    wanted = context._wanted(pairs)
    one, two = context.masked_walks(wanted), context.walks_by_difference(wanted)
    cols = ["slab", "bit", "a", "b", "l3"]
    assert sorted(map(tuple, one.select(cols).collect())) == sorted(map(tuple, two.select(cols).collect()))


@pytest.mark.parametrize("n_runs", [3, 60])
def test_rows_of_the_graph_do_not_grow_with_the_runs(spark, n_runs):
    edges = [(i, i + 1) for i in range(20)]
    removed = [[edges[s % 20]] for s in range(n_runs)]
    context = RunContext(spark.createDataFrame(edges, "a bigint, b bigint"), _positives(spark, removed))
    assert context.adjacency.count() == 40 and context.degrees.count() == 21
    pairs = spark.createDataFrame([("edge_random", s, 4, 6) for s in range(n_runs)], "protocol string, seed int, a bigint, b bigint")
    assert context._shared(context._wanted(pairs)).count() == 1


def test_holdout_degrees_of_many_runs(spark):
    edges = [(0, 1), (0, 2), (0, 3), (1, 2)]
    removed = [[edges[s % 4]] for s in range(70)]
    nodes = spark.range(6).select(F.col("id").alias("node_id"))
    got = {(r.seed, r.node_id): r.degree for r in S.holdout_degrees(nodes, spark.createDataFrame(edges, "a bigint, b bigint"), _positives(spark, removed)).collect()}
    assert len(got) == 70 * 6
    for (s, n), d in got.items():
        assert d == sum(n in e for e in edges if e not in removed[s])
