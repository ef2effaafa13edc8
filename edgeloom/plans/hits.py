"""Scoring and ranking of candidate pairs."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom import constants as K
from edgeloom.operators.blocks import PairNetwork, block_scores
from edgeloom.operators.features import require_vectors
from edgeloom.operators.ranking import global_rank, top_n

SCORE_DIGITS = 9            # probabilities that agree this far tie, whatever the order of summation


def top_hits(scored: DataFrame, k: int = K.HIT_LIST_ROWS, *, score: str = "probability") -> DataFrame:
    """Best k rows, numbered.  The limit runs first, so only k rows reach the numbering."""
    best = scored.orderBy(F.desc(score), "a", "b").limit(k)
    return top_n(best, [], [F.desc(score), F.col("a"), F.col("b")], k)


def _scores(nodes: DataFrame, model, vectors: DataFrame) -> DataFrame:
    """All candidate pairs scored by blocks; a role node without a vector is an error, not a pair less."""
    ends = nodes.select("node_id", "group_id", "role").filter(F.col("role").isin(*K.A_LIKE, *K.B_LIKE))
    require_vectors(ends, vectors)
    return block_scores(ends, model if isinstance(model, PairNetwork) else PairNetwork.of_perceptron(model), vectors)


def hit_list(nodes: DataFrame, known: DataFrame, model, vectors: DataFrame, k: int = K.HIT_LIST_ROWS) -> DataFrame:
    """Novel candidates (no known edge) scored by a pair model, fitted or a ``PairNetwork``, best k."""
    scored = _scores(nodes, model, vectors).withColumn("probability", F.round("probability", SCORE_DIGITS))
    return top_hits(scored.join(known.select("a", "b"), ["a", "b"], "left_anti"), k)


def rank_candidates(nodes: DataFrame, model, vectors: DataFrame) -> DataFrame:
    """Every candidate pair scored and ranked."""
    scored = _scores(nodes, model, vectors).select("a", "b", F.round("probability", SCORE_DIGITS).alias("probability"))
    return global_rank(scored, [F.desc("probability"), F.col("a"), F.col("b")])


def top_per_group(scored: DataFrame, n: int = K.TOP_PER_GROUP) -> DataFrame:
    return top_n(scored, ["group_id"], [F.desc("probability"), F.col("a"), F.col("b")], n)
