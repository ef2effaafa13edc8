"""Exact top-k inner products by vector-approximation files.

Components become the integers floor(scale * x).  Vectors lie in blocks; a block's file has, for each vector, the number of a cell in each
dimension, for each cell its smallest and largest value, and apart from these the exact vectors.  A search scans the cells, which
bound every score from above and below, then reads exact vectors from the highest upper bound downwards (for distances: lower
bounds upwards) until no bound left can reach the k-th score.  Queries are a stated set; they go in blocks against blocks.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.session import materialize

SCALE, CELLS = 256.0, 16
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024
READ_STEP = 64              # exact vectors read at once
_EXACT = 2.0 ** 53


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v`` (array of double) of rows with an id and a vector without null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def _matrix(group: pa.Table, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floor(scale * x) of a group of vectors of one length, by ascending id."""
    ids = group.column("id").combine_chunks().to_numpy()
    values = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], np.floor(values[order] * scale)


def approximate(exact: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers (n, d), and each cell's smallest and largest value (d, cells); cells hold about equally many values."""
    n, d = exact.shape
    codes, low, high = np.empty((n, d), np.uint8), np.zeros((d, cells)), np.zeros((d, cells))
    for j in range(d):
        column = exact[:, j]
        edges = np.quantile(column, np.arange(1, cells) / cells, method="lower")
        codes[:, j] = np.searchsorted(edges, column, "right")
        low[j], high[j] = np.inf, -np.inf
        np.minimum.at(low[j], codes[:, j], column)
        np.maximum.at(high[j], codes[:, j], column)
    empty = low > high
    low[empty] = high[empty] = 0
    return codes, low, high


def build_file(vectors: DataFrame, blocks: int, *, scale: float = SCALE, cells: int = CELLS) -> DataFrame:
    """One row a block and vector length: ids, cell numbers, cell bounds, exact vectors."""
    def build(group: pa.Table) -> pa.Table:
        ids, exact = _matrix(group, scale)
        codes, low, high = approximate(exact, cells)
        one = {"ids": ids.astype("<i8"), "codes": codes, "low": low, "high": high, "exact": exact}
        return pa.table({"block": group.column("block")[:1], "dim": group.column("dim")[:1], **{k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in one.items()}})

    dealt = vectors.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("dim"), "id", "v")
    return dealt.groupBy("block", "dim").applyInArrow(build, "block int, dim int, ids binary, codes binary, low binary, high binary, exact binary")


def _integer_scores(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond what doubles count exactly, in whole numbers held inside the range of a long."""
    if np.abs(q).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, len(q)) < _EXACT:
        return (vectors @ q).astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(a * int(b) for a, b in zip(whole, row)))) for row in vectors], np.int64)


def search_block(file: dict, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list, list, list, int]:
    """The block's k best for each query, and how many exact vectors were read."""
    dim = queries.shape[1]
    ids = np.frombuffer(file["ids"], "<i8")
    codes = np.frombuffer(file["codes"], np.uint8).reshape(len(ids), dim)
    low, high = np.frombuffer(file["low"]).reshape(dim, -1), np.frombuffer(file["high"]).reshape(dim, -1)
    exact = np.frombuffer(file["exact"]).reshape(len(ids), dim)
    at = (np.arange(dim)[None, :], codes)
    middle, reach = ((low + high) / 2)[at], ((high - low) / 2)[at]
    out_q, out_v, out_s, read = [], [], [], 0
    safe = np.abs(queries).max(initial=0) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * max(1, dim) < _EXACT / 4
    for i in range(0, len(queries), 128):
        q = queries[i:i + 128]
        centre, spread = q @ middle.T, np.abs(q) @ reach.T
        upper, lower = centre + spread, centre - spread
        own = ids[None, :] == query_ids[i:i + 128, None]
        upper[own] = lower[own] = -np.inf
        if not safe:                                   # bounds in doubles are not exact there: read everything
            upper[~own], lower[~own] = np.inf, -np.inf
        least = np.partition(lower, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(q), -np.inf)
        for n in range(len(q)):
            open_ = np.flatnonzero((upper[n] >= least[n]) & ~own[n])
            open_ = open_[np.argsort(-upper[n, open_], kind="stable")]
            best_s, best_v = np.empty(0, np.int64), np.empty(0, np.int64)
            for j in range(0, len(open_), READ_STEP):
                if len(best_s) == k and upper[n, open_[j]] < best_s[-1]:
                    break
                step = open_[j:j + READ_STEP]
                read += len(step)
                best_s, best_v = np.concatenate((best_s, _integer_scores(q[n], exact[step]))), np.concatenate((best_v, ids[step]))
                first = np.lexsort((best_v, -best_s.astype(float) if not safe else -best_s))[:k]
                best_s, best_v = best_s[first], best_v[first]
            out_q.append(np.full(len(best_s), query_ids[i + n]))
            out_s.append(best_s)
            out_v.append(best_v)
    return out_q, out_v, out_s, read


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE,
          block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products, ties to the smaller id.

    Candidates are all rows but those with the query's id; rows that repeat an id are candidates each.  A query id with several vectors asks with
    the smallest of them.  Rows with a null id, a null vector, or null or non-finite components take no part; vectors meet only
    those of their own length.  With fewer than k candidates all are returned.
    """
    all_rows = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-all_rows.count() // block_vectors))
    q_blocks = max(1, -(-asked.count() // block_queries))
    file = materialize(build_file(all_rows, n_blocks, scale=scale))

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = file.withColumn("q_block", every(q_blocks))
    right = asked.select(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(q_blocks)).cast("int").alias("q_block"), F.size("v").alias("dim"), "id", "v").withColumn("block", every(n_blocks))
    schema = "query_id bigint, vec_id bigint, score bigint"

    def meet(block: pa.Table, wanted: pa.Table) -> pa.Table:
        q, v, s = [], [], []
        if block.num_rows and wanted.num_rows:
            ids, matrix = _matrix(wanted, scale)
            q, v, s, _ = search_block(block.to_pylist()[0], ids, matrix, k)
        cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
        return pa.table({"query_id": cat(q), "vec_id": cat(v), "score": cat(s)})

    keys = ["block", "q_block", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
