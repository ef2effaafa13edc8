"""Undirected pairs: canonical form, de-duplication, candidate enumeration."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom import constants as K
from edgeloom.functions.identifiers import pair_high, pair_low

TILE_ROWS = 4096


def canonical_pairs(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct ``(a, b)`` with a < b; loops dropped."""
    return (edges.filter(F.col(src) != F.col(dst))
            .select(pair_low(src, dst).alias("a"), pair_high(src, dst).alias("b")).distinct())


def both_ways(edges: DataFrame, src: str = "src", dst: str = "dst", *extra: str) -> DataFrame:
    """Each edge in both directions, from one scan."""
    ends = F.explode(F.array(
        F.struct(F.col(src).alias("src"), F.col(dst).alias("dst")),
        F.struct(F.col(dst).alias("src"), F.col(src).alias("dst")),
    )).alias("_e")
    return edges.select(ends, *extra).select("_e.src", "_e.dst", *extra)


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """Best-scored record per undirected pair, endpoints and names re-ordered.

    Equal scores are settled by the smallest names instead of by input order.
    """
    forward = F.col("src") <= F.col("dst")
    ordered = edges.filter(F.col("src") != F.col("dst")).select(
        pair_low("src", "dst").alias("src"), pair_high("src", "dst").alias("dst"), "score",
        F.struct(
            F.when(forward, F.col("src_name")).otherwise(F.col("dst_name")).alias("src_name"),
            F.when(forward, F.col("dst_name")).otherwise(F.col("src_name")).alias("dst_name"),
            F.col("group_id"),
        ).alias("meta"),
    )
    best = F.min_by(F.struct("score", "meta"), F.struct((-F.col("score")).alias("s"), F.col("meta")))
    return (ordered.groupBy("src", "dst").agg(best.alias("r"))
            .select("src", "dst", "r.meta.src_name", "r.meta.dst_name", "r.meta.group_id", "r.score"))


def best_channels(channels: DataFrame) -> DataFrame:
    """Channel row of the highest combined score per pair (missing channels are 0)."""
    values = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in K.CHANNELS]
    ordered = channels.filter(F.col("src") != F.col("dst")).select(
        pair_low("src", "dst").alias("a"), pair_high("src", "dst").alias("b"),
        F.struct("combined", *values).alias("r"))
    return ordered.groupBy("a", "b").agg(F.max("r").alias("r")).select("a", "b", "r.*")


def tiled_join(left: DataFrame, right: DataFrame, sizes: DataFrame, key: str, left_id: list[str],
               right_id: list[str]) -> DataFrame:
    """Equi-join on ``key`` cut into tiles, so that no single task pairs up a whole key.

    ``sizes`` holds ``key, _ta, _tb``: the number of tiles of each side.  A row falls into one tile of its
    own side by hash and is copied to every tile of the other side; each pair of rows meets exactly once.
    """
    def placed(df, ids, own, other):
        at = F.pmod(F.xxhash64(*ids), F.col("_" + own))
        return (df.join(sizes, key).withColumn(own, at)
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_" + other) - 1)))
                .drop("_ta", "_tb"))
    met = placed(left, left_id, "ta", "tb").join(placed(right, right_id, "tb", "ta"), [key, "ta", "tb"])
    return met.drop("ta", "tb")


def candidate_pairs(nodes: DataFrame, *, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Every same-group A x B pair once, ``a`` < ``b``, with the attributes of both nodes.

    Node columns other than the group come back as ``<column>_a`` and ``<column>_b`` (ids as a, b).
    Two ``both`` nodes meet twice in the join; only the ordered meeting is kept, so the result is
    unique without a distinct over the pairs.
    """
    is_a, is_b = F.col("role").isin(*K.A_LIKE), F.col("role").isin(*K.B_LIKE)
    sizes = nodes.groupBy("group_id").agg(
        F.ceil(F.count_if(is_a) / tile_rows).alias("_ta"), F.ceil(F.count_if(is_b) / tile_rows).alias("_tb"),
    ).filter((F.col("_ta") > 0) & (F.col("_tb") > 0))

    def side(flag, prefix, *shared):
        names = [F.col(c) if c in shared else F.col(c).alias(prefix + c) for c in nodes.columns
                 if c in shared or c != "group_name"]
        return nodes.filter(flag).select(*names)
    met = tiled_join(side(is_a, "l_", "group_id", "group_name"), side(is_b, "r_", "group_id"), sizes, "group_id",
                     ["l_node_id"], ["r_node_id"])
    twice = (F.col("l_role") == K.ROLE_BOTH) & (F.col("r_role") == K.ROLE_BOTH)
    met = met.filter((F.col("l_node_id") != F.col("r_node_id"))
                     & (~twice | (F.col("l_node_id") < F.col("r_node_id"))))
    forward = F.col("l_node_id") < F.col("r_node_id")
    cols = []
    for c in nodes.columns:
        if c in ("group_id", "group_name"):
            continue
        left_c, right_c = F.col("l_" + c), F.col("r_" + c)
        names = ("a", "b") if c == "node_id" else (c + "_a", c + "_b")
        cols.append(F.when(forward, left_c).otherwise(right_c).alias(names[0]))
        cols.append(F.when(forward, right_c).otherwise(left_c).alias(names[1]))
    head = ["group_id"] + (["group_name"] if "group_name" in nodes.columns else [])
    return met.select(*head, *cols)


def novel_candidates(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Candidate pairs that are not a known edge; ``known`` holds canonical (a, b)."""
    return candidate_pairs(nodes).join(known.select("a", "b"), ["a", "b"], "left_anti")


def is_candidate(role_a: str = "role_a", role_b: str = "role_b"):
    """Role test for a same-group pair."""
    a, b = F.col(role_a), F.col(role_b)
    return (a.isin(*K.A_LIKE) & b.isin(*K.B_LIKE)) | (b.isin(*K.A_LIKE) & a.isin(*K.B_LIKE))


def attach_ends(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attributes of both end nodes as ``<column>_a`` / ``<column>_b``; pairs with an unknown end drop out."""
    def renamed(end):
        return nodes.select(*[F.col(c).alias(end if c == "node_id" else f"{c}_{end}") for c in nodes.columns])
    return pairs.join(renamed("a"), "a").join(renamed("b"), "b")
