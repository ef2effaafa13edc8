"""Feature vectors: pooling, neighbour means, pair features, batch embedding."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom import constants as K
from edgeloom.functions.vectors import pair_encoding
from edgeloom.operators.dealing import deal, in_blocks, matrix, places
from edgeloom.operators.graph import require_empty

EDGES_PER_BLOCK = 1 << 16


def _zeros(dim: int):
    return F.array_repeat(F.lit(0.0), dim)


def masked_mean(tokens: DataFrame, special_ids: list[int], dim: int, *, key: str = "node_id",
                token: str = "token_id", vector: str = "vector") -> DataFrame:
    """Mean vector per key over ordinary tokens; a key with special tokens only gets zeros."""
    vec = array_to_vector(F.col(vector).cast("array<double>"))
    kept = tokens.filter(~F.col(token).isin(special_ids)).groupBy(key).agg(
        vector_to_array(Summarizer.mean(vec)).alias("pooled"), F.count(F.lit(1)).alias("n_tokens"))
    return tokens.select(key).distinct().join(kept, key, "left").select(
        key, F.coalesce("pooled", _zeros(dim)).alias("pooled"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def neighbor_mean(features: DataFrame, adjacency: DataFrame, dim: int) -> DataFrame:
    """Mean vector of a node's neighbours; zeros without neighbours.

    Edges are dealt to blocks with the vectors they name, so a vector travels once a block and not once an edge; a hub sends one running sum a block.
    """
    dealt, held = deal(adjacency.select("src", "dst"), "src", ["dst"], features, block_rows=EDGES_PER_BLOCK)

    def sums(edges: pa.Table, nodes: pa.Table) -> pa.Table:
        at = places(edges, "dst", nodes)
        src = edges.column("src").combine_chunks().dictionary_encode()
        code = src.indices.to_numpy()[at >= 0]
        order = np.argsort(code, kind="stable")
        code, at = code[order], at[at >= 0][order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        total = np.add.reduceat(matrix(nodes)[at], first, axis=0) if len(at) else np.empty((0, dim))
        n = np.diff(first, append=len(at))
        return pa.table({"src": src.dictionary.take(pa.array(code[first])), "n": pa.array(n, pa.int64()), "total": pa.array(list(total), pa.list_(pa.float64()))})

    parts = in_blocks(dealt, held, sums, f"src {adjacency.schema['src'].dataType.simpleString()}, n bigint, total array<double>")
    means = parts.groupBy("src").agg(F.sum("n").alias("_n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("_t"))
    means = means.select(F.col("src").alias("node_id"), F.transform("_t", lambda t: t / F.col("_n")).alias("m"))
    return features.select("node_id").join(means, "node_id", "left").select("node_id", F.coalesce("m", _zeros(dim)).alias("vector"))


def propagate(features: DataFrame, adjacency: DataFrame, dim: int) -> DataFrame:
    """``[x, mean of x, mean of the means]``: two mean-aggregation layers without trained weights."""
    one = neighbor_mean(features, adjacency, dim)
    two = neighbor_mean(one, adjacency, dim)
    return (features.select("node_id", F.col("vector").cast("array<double>").alias("x"))
            .join(one.withColumnRenamed("vector", "m1"), "node_id")
            .join(two.withColumnRenamed("vector", "m2"), "node_id")
            .select("node_id", F.concat("x", "m1", "m2").alias("vector")))


def constant_features(nodes: DataFrame, dim: int = 16) -> DataFrame:
    return nodes.select("node_id", F.array_repeat(F.lit(1.0), dim).alias("vector"))


def encode_pairs(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs with ``encoded`` = [za, zb, |za - zb|]; see ``require_vectors`` for nodes without a vector."""
    def of(end):
        return features.select(F.col("node_id").alias(end), F.col("vector").alias("v_" + end))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    return met.withColumn("encoded", pair_encoding("v_a", "v_b")).drop("v_a", "v_b")


def location_flags(nodes: DataFrame, atlas: DataFrame) -> DataFrame:
    """1 for a node that shows any location bucket in the atlas, else 0."""
    seen = atlas.select(F.explode(F.array(
        F.struct(F.col("a").alias("node_id"), F.col("location_a").alias("t")),
        F.struct(F.col("b").alias("node_id"), F.col("location_b").alias("t")))).alias("r")).select("r.*")
    flags = seen.groupBy("node_id").agg(F.max((F.coalesce("t", F.lit("")) != "").cast("int")).alias("flag"))
    return nodes.select("node_id").join(flags, "node_id", "left").select(
        "node_id", F.coalesce("flag", F.lit(0)).alias("flag"))


def bucket_flags(nodes: DataFrame, locations: DataFrame) -> DataFrame:
    """The same flag straight from the location map, for the nodes that an atlas names: role nodes with a counterpart in their group."""
    from edgeloom.operators.evidence import location_map
    per = nodes.groupBy("group_id").agg(F.count_if(F.col("role").isin(*K.A_LIKE)).alias("_a"), F.count_if(F.col("role").isin(*K.B_LIKE)).alias("_b"),
                                        F.count_if(F.col("role").isin(K.ROLE_A, K.ROLE_B, K.ROLE_BOTH)).alias("_any"))
    partners = (F.when(F.col("role") == K.ROLE_A, F.col("_b")).when(F.col("role") == K.ROLE_B, F.col("_a"))
                .when(F.col("role") == K.ROLE_BOTH, F.col("_any") - 1).otherwise(0))
    flag = F.when((partners > 0) & (F.size("buckets") > 0), 1).otherwise(0)
    return nodes.join(per, "group_id").join(location_map(locations), "accession", "left").select("node_id", flag.alias("flag"))


def feature_gaps(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """``node_id, kind``: nodes without a vector (no row or null) and vectors that belong to no node."""
    have = features.filter(F.col("vector").isNotNull())
    lack = nodes.select("node_id").join(have, "node_id", "left_anti").select("node_id", F.lit("no vector").alias("kind"))
    return lack.unionByName(features.select("node_id").join(nodes, "node_id", "left_anti").select("node_id", F.lit("no node").alias("kind")))


def require_vectors(nodes: DataFrame, features: DataFrame) -> None:
    """Fail before any work when a node has no vector, so that no pair drops out of a join later."""
    require_empty(feature_gaps(nodes, features).filter(F.col("kind") == "no vector"), "nodes without a vector")


def pair_features(scores: DataFrame, flags: DataFrame) -> DataFrame:
    """Five features: both degrees, their product, shared neighbours, both located."""
    def of(end):
        return flags.select(F.col("node_id").alias(end), F.col("flag").alias("_f" + end))
    met = scores.join(of("a"), "a").join(of("b"), "b")
    return met.withColumn("degree_product", F.col("degree_a") * F.col("degree_b")).withColumn(
        "both_located", F.col("_fa") * F.col("_fb")).drop("_fa", "_fb")


def embed_sequences(sequences: DataFrame, encoder: Callable, *, special_ids: list[int], id_type: str = "string",
                    batch_size: int = 64) -> DataFrame:
    """Mean-pooled vector per sequence from a caller-supplied encoder, in Arrow batches.

    ``encoder(list[str])`` returns ``(token_ids [B, L], mask [B, L], hidden [B, L, H])`` as numpy arrays.
    """
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        for frame in batches:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start:start + batch_size]
                ids, mask, hidden = encoder(part["sequence"].tolist())
                keep = mask.astype(bool) & ~np.isin(ids, special_ids)
                total = (hidden * keep[..., None]).sum(axis=1)
                pooled = total / np.maximum(keep.sum(axis=1), 1)[:, None]
                if not np.isfinite(pooled).all():
                    raise ValueError("encoder produced non-finite values")
                yield pd.DataFrame({"node_id": part["node_id"].to_numpy(), "vector": list(pooled.astype("float32"))})
    return sequences.select("node_id", "sequence").mapInPandas(run, f"node_id {id_type}, vector array<float>")
