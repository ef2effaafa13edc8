"""Negatives drawn group by group: the rows of the joins over all groups, and no table of the draws."""
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import drawing as D
from edgeloom.operators import splits as S

KEYS = [*S.SPLIT_KEYS, "split"]


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(8)
    nodes = spark.createDataFrame([(i, i // 30) for i in range(60)], "node_id bigint, group_id bigint")
    within = [(a, b, a // 30) for a, b in itertools.combinations(range(60), 2) if a // 30 == b // 30]
    pairs = spark.createDataFrame(rng.sample(within, 150), "a bigint, b bigint, group_id bigint")
    return nodes, pairs, spark.createDataFrame([p[:2] for p in rng.sample(within, 300)], "a bigint, b bigint")


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_groups_are_drawn_like_joins(graph, monkeypatch):
    nodes, pairs, context = graph
    pos = S.written_split(S.split_edges_random(pairs, 2, protocol="degree_matched"), 2)
    degree = S.holdout_degrees(nodes, context, pos)

    def all_rows():
        found, left, filled = S.degree_matches(pos, KEYS, nodes, pairs, degree)
        return [_rows(df) for df in (S.uniform_negatives(pos, KEYS, nodes, pairs),
                                     found.select(*KEYS, "group_id", "slot_a", "slot_b", "a", "b", F.round("gap", 9), "step"),
                                     left.select(*KEYS, "group_id", "a", "b"), filled.select(*KEYS, "group_id", "a", "b"))]
    own = all_rows()
    monkeypatch.setattr(D, "LOCAL_NODES", 0)                # every group is too large for a task
    assert own == all_rows()
    assert {r[-1] for r in own[1]} == {"equal", "band", "border"} and len(own[2]) == len(own[3])


def test_matches_in_a_group_are_one_to_one_and_maximal():
    rng = np.random.default_rng(2)
    for top, n, m in ((40, 90, 100), (4000, 200, 150), (6, 30, 60), (9, 5, 0), (9, 0, 5)):
        slots, drawn = rng.integers(0, top, n), (rng.random(m) ** 2 * top * 1.3).astype(np.int64)
        gap = np.abs(np.log(slots[:, None] + 1.0) - np.log(drawn[None, :] + 1.0))
        *steps, (last, left, spare) = D.match(slots, drawn)
        assert sorted(np.concatenate([i for _, i, _ in steps] + [left])) == list(range(n)) and sorted(np.concatenate([j for _, _, j in steps] + [spare])) == list(range(m))
        assert all((gap[i, j] <= 0.35 + 1e-12).all() for _, i, j in steps) and not (gap[np.ix_(left, spare)] <= 0.35).any() and last == D.NONE_FITS
        if len(left) and len(spare) >= len(left):
            assert len(D._nearest(slots[left], drawn[spare])) == len(left)


def test_a_split_is_written_with_one_row_a_pair(graph, monkeypatch):
    """Before, the positives of all runs and a pool of four times as many drawn pairs were written."""
    nodes, pairs, _ = graph
    split = S.split_edges_random(pairs, 20)
    sizes, write = [], S.materialize

    def counted(df):
        out = write(df)
        sizes.append(out.count())
        return out
    for module in (S, D):
        monkeypatch.setattr(module, "materialize", counted)
    pos = S.written_split(split, 20)
    assert _rows(pos) == _rows(split) and sizes == [150]
    neg = S.uniform_negatives(pos, KEYS, nodes, pairs)
    assert neg.count() == pos.count() == 3000 and max(sizes) <= 3000 + 120


def test_written_parts_of_more_seeds_than_a_long_holds(graph):
    _, pairs, _ = graph
    seeds = list(range(5, 76, 2))
    split = S.split_edges_by_group(pairs, seeds)
    assert _rows(S.written_split(split, seeds).select("seed", "split", "a", "b")) == _rows(split.select("seed", "split", "a", "b"))
