"""Graph ingest from landed files: seeds, partners, induced edges, sequences, summary."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom import constants as K
from edgeloom.operators.graph import connected_components, expand_partners, induced_edges
from edgeloom.operators.nodes import attach_sequences, label_roles
from edgeloom.operators.pairs import dedupe_edges
from edgeloom.session import materialize


def ingest_graph(names: DataFrame, network: DataFrame, seeds: DataFrame, sequences: DataFrame, *,
                 min_score: float = K.CONTEXT_SCORE, partners: int = K.PARTNERS_PER_SEED) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the neighbourhood of the seeds.

    ``names``: node_id, name, group_id, group_name; ``network``: edge records; ``seeds``: group_id, symbol,
    role; ``sequences``: group_id, gene_key, accession, sequence.  Groups never mix: only edges inside a group count as partners.
    """
    same = materialize(induced_edges(dedupe_edges(network.filter(F.col("score") >= min_score)), names))
    seed_ids = (names.withColumn("_k", F.upper("name"))
                .join(seeds.select("group_id", F.upper("symbol").alias("_k")).distinct(), ["group_id", "_k"], "left_semi")
                .select("node_id"))
    wanted = expand_partners(seed_ids, same, min_score=min_score, limit=partners)
    nodes = label_roles(attach_sequences(names.join(wanted, "node_id", "left_semi"), sequences), seeds)
    return nodes, induced_edges(same, nodes)


def ingest_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, connected components and isolates per group; totals under group_id null."""
    comp = connected_components(nodes, edges.select("src", "dst"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("_linked", F.lit(1))
    per_node = (nodes.select("node_id", "group_id").join(comp, "node_id").join(ends, "node_id", "left")
                .select("group_id", F.lit(1).alias("n"), F.lit(0).alias("e"),
                        (F.col("node_id") == F.col("component")).cast("int").alias("c"),
                        F.col("_linked").isNull().cast("int").alias("i")))
    per_edge = edges.select("group_id", F.lit(0).alias("n"), F.lit(1).alias("e"), F.lit(0).alias("c"), F.lit(0).alias("i"))
    return per_node.unionByName(per_edge).rollup("group_id").agg(
        F.sum("n").alias("n_nodes"), F.sum("e").alias("n_edges"), F.sum("c").alias("n_components"),
        F.sum("i").alias("n_isolates"))
