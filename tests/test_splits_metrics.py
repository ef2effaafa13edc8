"""Splits, negatives, run contexts, ranks and metrics."""
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import metrics as M
from edgeloom.operators import ranking as R
from edgeloom.operators import splits as S
from edgeloom.operators.context import RunContext
from edgeloom.plans import benchmark as B


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(5)
    nodes = spark.createDataFrame([(i, i // 15) for i in range(30)], "node_id bigint, group_id bigint")
    within = [(a, b, a // 15) for a, b in itertools.combinations(range(30), 2) if a // 15 == b // 15]
    pos = spark.createDataFrame(rng.sample(within, 40), "a bigint, b bigint, group_id bigint")
    ctx = spark.createDataFrame([(a, b) for a, b, _ in rng.sample(within, 80)], "a bigint, b bigint")
    return nodes, pos, ctx


@pytest.mark.parametrize("n, rule, want", [
    (10, "floor", (8, 1, 1)), (10, "round", (8, 1, 1)), (25, "round", (20, 2, 3)), (35, "round", (28, 4, 3)), (25, "floor", (20, 2, 3)),
    (3, "floor", (1, 1, 1)), (5, "round", (3, 1, 1)), (5, "floor", (3, 1, 1)), (2, "round", (2, 0, 0)), (2, "floor", (1, 0, 1)), (4, "floor", (2, 1, 1)),
])
def test_sizes(spark, n, rule, want):
    train, val = S.split_sizes(F.lit(n), (0.8, 0.1, 0.1), rule=rule)
    r = spark.range(1).select(train.alias("t"), val.alias("v")).first()
    assert (r.t, r.v, n - r.t - r.v) == want


def test_edge_splits_cover_and_stay_apart(graph):
    _, pos, _ = graph
    want = sorted((r.a, r.b) for r in pos.collect())
    for split in (S.split_edges_random(pos, 2), S.split_edges_by_group(pos, 2)):
        rows = split.collect()
        for seed in (0, 1):
            assert sorted((r.a, r.b) for r in rows if r.seed == seed) == want
    one = {(r.seed, r.a, r.b): r.split for r in S.split_edges_random(pos, 2).collect()}
    again = {(r.seed, r.a, r.b): r.split for r in S.split_edges_random(pos.repartition(7), 2).collect()}
    assert one == again                                                     # no dependence on partitioning
    assert any(one[(0, a, b)] != one[(1, a, b)] for a, b in want)


def test_node_disjoint(graph):
    nodes, pos, _ = graph
    rows = S.split_node_disjoint(pos, nodes, [1]).collect()
    touched = {s: {n for r in rows if r.split == s for n in (r.a, r.b)} for s in ("train", "val", "test")}
    for s, t in itertools.combinations(touched, 2):
        assert touched[s].isdisjoint(touched[t])
    assert touched["train"]


def test_uniform_negatives(graph):
    nodes, pos, _ = graph
    split = S.split_edges_random(pos, 2)
    neg = S.uniform_negatives(split, S.SPLIT_KEYS + ["split"], nodes, pos, draws=12)
    rows = neg.collect()
    known = {(r.a, r.b) for r in pos.collect()}
    assert all(r.a < r.b and r.a // 15 == r.b // 15 == r.group_id and (r.a, r.b) not in known for r in rows)
    keys = [(r.protocol, r.seed, r.split, r.a, r.b) for r in rows]
    assert len(keys) == len(set(keys)) == split.count()
    assert S.shortfalls(split, neg, S.SPLIT_KEYS + ["split"]).count() == 0


def test_shortfall_is_reported(spark):
    nodes = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "node_id bigint, group_id bigint")
    pos = spark.createDataFrame([("p", 0, "train", 0, 1, 1), ("p", 0, "train", 0, 2, 1)],
                                "protocol string, seed int, split string, a bigint, b bigint, group_id bigint")
    neg = S.uniform_negatives(pos, S.SPLIT_KEYS + ["split"], nodes, pos.select("a", "b"), draws=20)
    assert [(r.a, r.b) for r in neg.collect()] == [(1, 2)]
    assert [(r.n, r.got) for r in S.shortfalls(pos, neg, S.SPLIT_KEYS + ["split"]).collect()] == [(2, 1)]


_POS = "protocol string, seed int, split string, a bigint, b bigint, group_id bigint"


def test_short_groups_are_listed_or_drawn_again(spark):
    keys = S.SPLIT_KEYS + ["split"]
    nodes = spark.createDataFrame([(i, 1) for i in range(6)] + [(100 + i, 2) for i in range(40)], "node_id bigint, group_id bigint")
    known = [(0, 1, 1), (2, 3, 1), (4, 5, 1), (0, 2, 1), (1, 3, 1)] + [(100, 101 + i, 2) for i in range(39)]
    pos = spark.createDataFrame([("p", 0, "train", a, b, g) for a, b, g in known], _POS)
    for draws in (1, 3):                                    # group 1 has 10 allowed pairs for 5, group 2 has 741 for 39
        rows = S.uniform_negatives(pos, keys, nodes, pos, draws=draws).collect()
        got = {(r.a, r.b) for r in rows}
        assert len(rows) == len(got) == len(known) and not got & {(a, b) for a, b, _ in known}
        assert [sum(r.group_id == g for r in rows) for g in (1, 2)] == [5, 39]
    many = pos.filter("group_id = 1").unionByName(spark.createDataFrame([("p", 0, "train", 1, 2, 1)] * 7, _POS))
    rows = S.uniform_negatives(many, keys, nodes, pos, draws=1).collect()          # 12 asked, 10 exist
    assert {(r.a, r.b) for r in rows} == {p for p in itertools.combinations(range(6), 2)} - {(a, b) for a, b, g in known if g == 1}
    assert len(rows) == 10 and S.shortfalls(many, S.uniform_negatives(many, keys, nodes, pos, draws=1), keys).count() == 1


def test_link_split_fails_when_a_group_is_full(spark):
    nodes = spark.createDataFrame([(i, 1) for i in range(4)], "node_id bigint, group_id bigint")
    full = spark.createDataFrame([(a, b, 1) for a, b in itertools.combinations(range(4), 2)], "a bigint, b bigint, group_id bigint")
    with pytest.raises(ValueError, match="too few possible negatives"):
        S.link_split(full, nodes, [0])


def test_dry_bands_are_filled_from_the_nearest(spark):
    # nodes 0, 1 have degree 9, nodes 10 to 13 degree 4, nodes 20 to 29 degree 0; the one positive joins the two of degree 9
    degree = {0: 9, 1: 9, **{10 + i: 4 for i in range(4)}, **{20 + i: 0 for i in range(10)}}
    nodes = spark.createDataFrame([(i, 1) for i in degree], "node_id bigint, group_id bigint")
    deg = spark.createDataFrame([("p", 0, n, d) for n, d in degree.items()], "protocol string, seed int, node_id bigint, degree bigint")
    pos = spark.createDataFrame([("p", 0, "train", 0, 1, 1)], _POS)
    pool = S.negative_pool(pos, S.SPLIT_KEYS + ["split"], nodes, pos, S.wanted_negatives(pos, S.SPLIT_KEYS + ["split"]), draws=60).collect()
    neg = S.degree_matched_negatives(pos, S.SPLIT_KEYS + ["split"], nodes, pos, deg, draws=60).collect()
    band = lambda r: math.floor(math.log(degree[r.a] * degree[r.b] + 1) / 0.35)        # noqa: E731
    goal = math.floor(math.log(82) / 0.35)
    assert len(neg) == 1 and abs(band(neg[0]) - goal) == min(abs(band(r) - goal) for r in pool)


def test_degree_matched(graph):
    nodes, pos, ctx = graph
    split = S.split_edges_random(pos, 1, protocol="degree_matched")
    deg = S.holdout_degrees(nodes, ctx, split)
    neg = S.degree_matched_negatives(split, S.SPLIT_KEYS + ["split"], nodes, pos, deg, draws=12).collect()
    d = {r.node_id: r.degree for r in deg.collect()}
    known = {(r.a, r.b) for r in pos.collect()}
    assert len(neg) == pos.count() and not known & {(r.a, r.b) for r in neg}
    band = lambda r: math.floor(math.log(d[r.a] * d[r.b] + 1) / 0.35)      # noqa: E731
    have, want = {}, {}
    for rows, into in ((neg, have), (split.collect(), want)):
        for r in rows:
            into[(r.split, r.group_id, band(r))] = into.get((r.split, r.group_id, band(r)), 0) + 1
    assert sum(min(have.get(k, 0), n) for k, n in want.items()) > len(neg) / 2


def test_link_split_does_not_leak(graph):
    nodes, pos, _ = graph
    split = S.link_split(pos, nodes, [0])
    msg = {tuple(sorted((r.src, r.dst))) for r in S.message_edges(split).collect()}
    rows = split.collect()
    part = {s: {(r.a, r.b) for r in rows if r.split == s and r.label == 1} for s in ("train", "val", "test")}
    assert msg == part["train"] and not part["val"] & part["train"] and not part["test"] & (part["train"] | part["val"])
    known = {(r.a, r.b) for r in pos.collect()}
    assert part["train"] | part["val"] | part["test"] == known
    assert not known & {(r.a, r.b) for r in rows if r.label == 0}


def test_run_context_against_brute_force(graph):
    nodes, pos, ctx = graph
    split = S.protocol_split(pos, nodes, ctx, [0, 1], draws=12)
    got = RunContext(ctx, split.filter("label = 1")).scores(split).collect()
    rows, context = split.collect(), {(r.a, r.b) for r in ctx.collect()}
    for protocol in B.PROTOCOLS:
        for seed in (0, 1):
            mine = [r for r in rows if r.protocol == protocol and r.seed == seed]
            held = {(r.a, r.b) for r in mine if r.label == 1 and r.split != "train"}
            edges = context - held
            if protocol == "node_disjoint":
                ok = {n for r in mine if r.label == 1 and r.split == "train" for n in (r.a, r.b)}
                edges = {e for e in edges if e[0] in ok and e[1] in ok}
            m = np.zeros((30, 30))
            for a, b in edges:
                m[a, b] = m[b, a] = 1
            deg, two, three = m.sum(0), m @ m, m @ m @ m
            for r in (g for g in got if g.protocol == protocol and g.seed == seed):
                assert (r.degree_a, r.degree_b, r.shared) == (deg[r.a], deg[r.b], two[r.a, r.b])
                assert r.l3 == three[r.a, r.b]
                aa = sum(1 / math.log(deg[w]) for w in range(30) if m[r.a, w] and m[r.b, w] and deg[w] > 1)
                assert r.adamic_adar == pytest.approx(aa)


def test_usable_runs(spark):
    rows = [("p", 0, "test", 1, 1, 2), ("p", 0, "test", 1, 1, 3), ("p", 0, "test", 0, 1, 4), ("p", 0, "test", 0, 2, 4),
            ("q", 0, "test", 1, 1, 2), ("q", 0, "test", 0, 1, 4), ("r", 0, "train", 1, 1, 2)]
    df = spark.createDataFrame(rows, "protocol string, seed int, split string, label int, a bigint, b bigint").withColumn("group_id", F.lit(1))
    got = {r.protocol: (r.usable, r.reason) for r in S.usable_runs(df).collect()}
    assert got == {"p": (True, ""), "q": (False, "too few test pairs"), "r": (False, "too few possible negatives")}


def test_whole_benchmark(spark, graph):
    nodes, pos, ctx = graph
    split = S.protocol_split(pos, nodes, ctx, [0], ("edge_random", "degree_matched"), draws=12)
    flags = nodes.select("node_id", F.lit(1).alias("flag"))
    vectors = nodes.select("node_id", F.array(F.col("node_id") / 30.0, F.lit(1.0)).alias("vector"))
    out = B.run_benchmark(pos, nodes, ctx, flags, split, features=vectors, dim=2, seeds=[0], protocols=("edge_random",),
                          neural=B.NEURAL, max_iter=3).collect()
    got = {(r.protocol, r.model) for r in out}
    assert got == ({(p, m) for p in ("edge_random", "degree_matched") for m in B.TOPOLOGY}
                   | {("edge_random", m) for m in ("logreg", *B.NEURAL)})
    assert all(r.auroc is None or 0 <= r.auroc <= 1 for r in out)
    with pytest.raises(ValueError, match="too few"):
        B.require_positives(pos.limit(3))


def test_hot_group_is_ranked_and_paired_like_any_other(spark):
    from edgeloom.operators.pairs import candidate_pairs
    role = F.when(F.col("id") % 3 == 0, "both").when(F.col("id") % 3 == 1, "a").otherwise("b")
    nodes = spark.range(400).select(F.col("id").alias("node_id"), F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("group_id"), role.alias("role"))
    want = sum(1 for i, j in itertools.combinations(range(300), 2)
               if (i % 3 in (0, 1) and j % 3 in (0, 2)) or (j % 3 in (0, 1) and i % 3 in (0, 2)))
    pairs = candidate_pairs(nodes, tile_rows=16)
    assert pairs.count() == pairs.select("a", "b").distinct().count() == want


# --- ranks ------------------------------------------------------------------

def test_hash_rank_is_a_plain_rank(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("k"), F.md5(F.col("id").cast("string")).alias("h"))
    rows = R.hash_rank(df, ["k"], "h", ["id"]).collect()
    for k in (0, 1):
        mine = sorted((r for r in rows if r.k == k), key=lambda r: r.h)
        assert [r["rank"] for r in mine] == list(range(1, 251)) and {r.key_rows for r in mine} == {250}


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    values = [0.0, 1e-9, 2e-9, 0.3, 0.30000000001, 0.5, 1.0, 7.0, 7.5, 1e6, 1e12, -3.0, -0.25]
    df = spark.createDataFrame([(v, i + 1) for i, v in enumerate(values)], "v double, w bigint")
    got = {r.v: r.cum_w for r in R.running_totals(df, [], "v", ["w"], descending=descending).collect()}
    total = 0
    for v, w in sorted(zip(values, range(1, 99)), reverse=descending):
        total += w
        assert got[v] == total


def test_running_totals_split_crowded_values(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("k"), (F.col("id") * 6e-9).alias("v"), F.lit(1).cast("bigint").alias("w"))
    df = df.unionByName(spark.createDataFrame([(0, None, 5)], "k bigint, v double, w bigint"))
    rows = R.running_totals(df, ["k"], "v", ["w"]).collect()
    for k in (0, 1):
        mine = sorted((r for r in rows if r.k == k), key=lambda r: r.v)
        assert [r.cum_w for r in mine] == list(range(1, 2001)) and {r.all_w for r in mine} == {2000}


def test_global_rank(spark):
    df = spark.range(300).select("id", ((F.col("id") * 37) % 11).cast("double").alias("s"))
    rows = R.global_rank(df, [F.desc("s"), F.col("id")]).collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: (-r.s, r.id))] == list(range(1, 301))


def test_average_ranks_and_first(spark):
    hist = spark.createDataFrame([(1.0, 2), (5.0, 3), (9.0, 1)], "v double, w bigint")
    got = {r.v: r.r for r in R.average_ranks(hist, [], "v", "w", name="r").collect()}
    assert got == {1.0: 1.5, 5.0: 4.0, 9.0: 6.0}
    df = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 3, "c")], "k string, o int, t string")
    assert {(r.k, r.t) for r in R.first_per_key(df, ["k"], ["o"]).collect()} == {("x", "a"), ("y", "c")}
    assert {(r.k, r.t) for r in R.top_n(df, ["k"], [F.desc("o")], 1).collect()} == {("x", "b"), ("y", "c")}


# --- metrics ------------------------------------------------------------------

def scored(spark, labels, scores):
    rows = [("m", i, i + 100, int(y), float(s)) for i, (y, s) in enumerate(zip(labels, scores))]
    return spark.createDataFrame(rows, "model string, a bigint, b bigint, label int, score double")


def test_perfect_ranking(spark):
    r = M.auroc_ap(scored(spark, [0, 0, 1, 1], [-4, -2, 2, 5]), ["model"]).first()
    assert (r.auroc, r.ap) == (1.0, 1.0)


def test_metrics_with_ties_match_brute_force(spark):
    rng = random.Random(1)
    y = [rng.random() < 0.4 for _ in range(200)]
    s = [rng.randrange(12) / 11 for _ in range(200)]
    r = M.ranking_metrics(scored(spark, y, s), ["model"]).first()
    pos, neg = [v for v, t in zip(s, y) if t], [v for v, t in zip(s, y) if not t]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for t in sorted(set(s), reverse=True):
        tp = sum(v >= t for v in pos)
        ap += (tp - seen) / len(pos) * tp / (tp + sum(v >= t for v in neg))
        seen = tp
    assert r.auroc == pytest.approx(auc) and r.ap == pytest.approx(ap)
    best = sorted(zip(s, y), key=lambda t: (-t[0], -t[1]))[:20]             # tied scores favour positives
    assert r.p_at_20 == pytest.approx(sum(t[1] for t in best) / 20)


def test_precision_small_and_one_class(spark):
    r = M.precision_at(scored(spark, [1, 0, 1, 0], [0.9, 0.8, 0.1, 0.0]), ["model"], ks=(2, 10)).first()
    assert (r.p_at_2, r.p_at_10) == (0.5, 0.5)
    r = M.ranking_metrics(scored(spark, [1, 1], [0.9, 0.8]), ["model"]).first()
    assert r.auroc is None and r.ap is None and r.p_at_10 is None


def test_mean_sd_ci(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("x", float("nan")), ("y", 2.0), ("z", float("nan"))], "k string, value double")
    got = {r.k: r for r in M.mean_sd_ci(df, ["k"]).collect()}
    assert got["x"].n == 2 and got["x"].sd == pytest.approx(math.sqrt(2)) and got["x"].ci95_hi == pytest.approx(2 + 1.96)
    assert (got["y"].sd, got["y"].ci95_lo) == (0.0, 2.0)
    assert got["z"].n == 0 and got["z"].mean is None


def test_paired_and_stability(spark):
    df = spark.createDataFrame([("p", 0, "x", 0.8), ("p", 0, "y", 0.5), ("p", 1, "x", 0.6), ("p", 1, "y", 0.5), ("p", 2, "x", 0.6)],
                               "protocol string, seed int, model string, auroc double")
    r = M.paired_delta(df, "x", "y").first()
    assert r.mean == pytest.approx(0.2) and r.n == 2
    ranks = spark.createDataFrame([(1, 2, 5), (1, 2, 15), (1, 2, 40)], "a int, b int, rank bigint")
    r = M.rank_stability(ranks, ["a", "b"]).first()
    assert (r.median_rank, r.mean_rank, r.n_seeds) == (15.0, 20.0, 3)
    assert (r.frac_top10, r.frac_top20) == (pytest.approx(1 / 3), pytest.approx(2 / 3))


def test_candidate_ranks(spark):
    df = spark.createDataFrame([(0, 1, 2, 0.5), (0, 1, 3, 0.9), (1, 1, 2, 0.7), (1, 1, 3, 0.7)], "seed int, a bigint, b bigint, score double")
    got = {(r.seed, r.b): r["rank"] for r in B.candidate_ranks(df).collect()}
    assert got == {(0, 3): 1, (0, 2): 2, (1, 2): 1, (1, 3): 2}
