"""Graph operators against small brute force."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from edgeloom.operators import graph as G
from edgeloom.operators import pairs as P


def edge_frame(spark, edges):
    return spark.createDataFrame([(int(a), int(b)) for a, b in edges], "src bigint, dst bigint")


@pytest.fixture(scope="module")
def toy(spark):
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(14), 2))) for _ in range(30)} | {(0, i) for i in range(1, 12)}   # node 0 is a hub
    nodes = spark.createDataFrame([(i, 1) for i in range(16)], "node_id bigint, group_id bigint")
    adj = {i: set() for i in range(16)}
    for a, b in edges:
        adj[a].add(b), adj[b].add(a)
    return nodes, edge_frame(spark, sorted(edges)), adj


def test_canonical_and_both_ways(spark):
    e = edge_frame(spark, [(0, 1), (1, 0), (2, 2), (0, 1)])
    assert [(r.a, r.b) for r in P.canonical_pairs(e).collect()] == [(0, 1)]
    got = {(r.src, r.dst) for r in P.both_ways(edge_frame(spark, [(0, 1), (1, 2)])).collect()}
    assert got == {(0, 1), (1, 0), (1, 2), (2, 1)}


def test_dedupe(spark):
    rows = [("B", "A", "b", "a", 1, 0.4), ("A", "B", "a", "b", 1, 0.8), ("A", "A", "a", "a", 1, 1.0), ("B", "A", "z", "y", 1, 0.8)]
    df = spark.createDataFrame(rows, "src string, dst string, src_name string, dst_name string, group_id bigint, score double")
    got = [tuple(r) for r in P.dedupe_edges(df).collect()]
    assert got == [("A", "B", "a", "b", 1, 0.8)]


def test_best_channels_and_rescale(spark):
    from edgeloom.sources.tables import channel_rows
    raw = spark.createDataFrame([("A", "B", 400.0, 900.0, None), ("B", "A", 800.0, 300.0, "x"), ("A", "A", 900.0, 1.0, "1")],
                                "stringId_A string, stringId_B string, score double, nscore double, tscore string")
    got = [r.asDict() for r in P.best_channels(channel_rows(raw)).collect()]
    assert len(got) == 1 and got[0]["combined"] == 0.8 and got[0]["nscore"] == 0.3 and got[0]["tscore"] == 0.0 and got[0]["escore"] == 0.0


def test_induced_and_missing(spark, nodes):
    e = spark.createDataFrame([("9606.YAP1", "9606.ACTB"), ("9606.YAP1", "9606.Z"), ("9606.YAP1", "4932.ACT1")], "src string, dst string")
    assert [(r.src, r.dst) for r in G.induced_edges(e, nodes).collect()] == [("9606.YAP1", "9606.ACTB")]
    assert G.induced_edges(e, nodes, same_group=False).count() == 2
    lost = G.missing_endpoints(e, nodes)
    assert [tuple(r) for r in lost.collect()] == [("9606.Z", 1)]
    with pytest.raises(ValueError, match="unknown"):
        G.require_empty(lost, "unknown ends")


def test_link_scores(spark, toy):
    import math
    nodes, edges, adj = toy
    pairs = spark.createDataFrame(list(itertools.combinations(range(16), 2)), "a bigint, b bigint")
    got = {(r.a, r.b): r for r in G.link_scores(pairs, nodes, edges).collect()}
    for (a, b), r in got.items():
        shared, union = adj[a] & adj[b], adj[a] | adj[b]
        assert r.shared == len(shared)
        assert r.jaccard == pytest.approx(len(shared) / len(union) if union else 0.0)
        assert r.adamic_adar == pytest.approx(sum(1 / math.log(len(adj[w])) for w in shared if len(adj[w]) > 1))
        assert r.preferential_attachment == len(adj[a]) * len(adj[b])


def test_three_walks(spark, toy):
    import numpy as np
    nodes, edges, adj = toy
    m = np.zeros((16, 16))
    for a, others in adj.items():
        for b in others:
            m[a, b] = 1
    cube = m @ m @ m
    pairs = spark.createDataFrame(list(itertools.combinations(range(16), 2)), "a bigint, b bigint")
    got = {(r.a, r.b): r.l3 for r in G.three_walks(pairs, P.both_ways(edges)).collect()}
    for a, b in itertools.combinations(range(16), 2):
        assert got.get((a, b), 0) == cube[a, b]


@pytest.mark.parametrize("tile_rows", [4096, 2])
def test_walks_of_all_candidates_equal_walks_pair_by_pair(spark, toy, monkeypatch, tile_rows):
    monkeypatch.setattr(G, "TILE_ROWS", tile_rows)              # a node in the middle cut into several tiles
    _, edges, _ = toy
    roles = ["a", "both", "b", "both", "partner"]
    nodes = spark.createDataFrame([(i, i // 12, roles[i % 5]) for i in range(16)], "node_id bigint, group_id bigint, role string")
    adjacency = P.both_ways(edges)
    want = {(r.a, r.b, r.l3) for r in G.three_walks(P.candidate_pairs(nodes), adjacency).collect()}
    rows = G.candidate_three_walks(nodes, adjacency).collect()
    assert want and {(r.a, r.b, r.l3) for r in rows} == want and len(rows) == len(want)


def test_path_graph(spark):
    nodes = spark.createDataFrame([(i, 1) for i in range(4)], "node_id bigint, group_id bigint")
    e = edge_frame(spark, [(0, 1), (1, 2), (2, 3)])
    pairs = spark.createDataFrame([(0, 2), (0, 3)], "a bigint, b bigint")
    jac = {(r.a, r.b): r.jaccard for r in G.link_scores(pairs, nodes, e).collect()}
    assert jac[(0, 2)] > jac[(0, 3)]
    assert [(r.a, r.b) for r in G.three_walks(pairs, P.both_ways(e)).collect()] == [(0, 3)]


def test_components(spark):
    nodes = spark.createDataFrame([(i, 1) for i in range(40)], "node_id bigint, group_id bigint")
    path = [(i, i + 1) for i in range(20)]                                  # a long path, a star, isolates
    star = [(30, i) for i in range(31, 37)]
    got = {r.node_id: r.component for r in G.connected_components(nodes, edge_frame(spark, path + star)).collect()}
    assert all(got[i] == 0 for i in range(21)) and all(got[i] == 30 for i in range(30, 37))
    assert got[25] == 25 and len(got) == 40


def test_partner_expansion(spark):
    rows = [(0, i, 0.7 + i / 100) for i in range(1, 6)] + [(9, 1, 0.1), (1, 7, 0.9)]
    e = spark.createDataFrame(rows, "src bigint, dst bigint, score double")
    seeds = spark.createDataFrame([(0,)], "node_id bigint")
    assert {r.node_id for r in G.expand_partners(seeds, e, limit=2).collect()} == {0, 5, 4}


def test_graph_summary(toy):
    nodes, edges, adj = toy
    r = G.graph_summary(nodes, edges).first()
    degs = sorted(len(v) for v in adj.values())
    assert (r.n_nodes, r.n_edges, r.max_degree) == (16, sum(degs) // 2, degs[-1])
    assert r.median_degree == (degs[7] + degs[8]) / 2 and r.n_isolates == degs.count(0)
    assert r.density == pytest.approx(sum(degs) / (16 * 15))


def test_display_subgraph(spark):
    nodes = spark.createDataFrame([("A", "YAP1", "a", "x"), ("C", "VCL", "b", "x")], "node_id string, name string, role string, group_name string")
    hits = spark.createDataFrame([("A", "B", 0.8), ("A", "C", 0.7)], "a string, b string, probability double")
    e = spark.createDataFrame([("B", "C", 0.85), ("A", "B", 0.99), ("A", "Z", 0.9), ("C", "C", 1.0)], "src string, dst string, score double")
    shown, edges = G.display_subgraph(hits, e, nodes)
    meta = {r.node_id: (r.name, r.role) for r in shown.collect()}
    assert meta == {"A": ("YAP1", "a"), "B": ("B", "partner"), "C": ("VCL", "b")}
    assert {(r.a, r.b): (r.kind, r.probability) for r in edges.collect()} == {
        ("A", "B"): ("predicted", 0.8), ("A", "C"): ("predicted", 0.7), ("B", "C"): ("known", 0.85)}


def test_catalog_overlap(spark):
    from edgeloom.operators.evidence import catalog_overlap
    p = spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "a bigint, b bigint")
    s = spark.createDataFrame([(1, 2), (6, 7)], "a bigint, b bigint")
    assert tuple(catalog_overlap(p, s).first()) == (1, 2, 1)


def test_context_pairs_ignore_unknown_ends(spark, nodes):
    from edgeloom.plans.atlas import context_pairs
    e = spark.createDataFrame([("9606.YAP1", "9606.NF2"), ("9606.NF2", "9606.YAP1"), ("9606.NF2", "Z")], "src string, dst string")
    assert context_pairs(e, nodes).agg(F.count("*")).first()[0] == 1


def test_partners_count_once_and_stay_in_the_group(spark):
    from edgeloom.plans.ingest import ingest_graph
    names = spark.createDataFrame([("S", "SEED", 1, "g"), ("A", "A", 1, "g"), ("B", "B", 1, "g"), ("Z", "Z", 2, "h")],
                                  "node_id string, name string, group_id bigint, group_name string")
    rows = [("S", "Z", 0.99), ("S", "A", 0.95), ("A", "S", 0.94), ("S", "B", 0.8)]
    network = spark.createDataFrame([(a, b, a, b, None, s) for a, b, s in rows],
                                    "src string, dst string, src_name string, dst_name string, group_id bigint, score double")
    seeds = spark.createDataFrame([(1, "seed", "a")], "group_id bigint, symbol string, role string")
    seq = spark.createDataFrame([(g, n, "P" + n, "MK") for g, n in ((1, "SEED"), (1, "A"), (1, "B"), (2, "Z"))],
                                "group_id bigint, gene_key string, accession string, sequence string")
    nodes, edges = ingest_graph(names, network, seeds, seq, partners=2)
    assert {r.node_id for r in nodes.collect()} == {"S", "A", "B"} and edges.count() == 2


def test_sequences_are_attached_inside_the_group(spark):
    from edgeloom.operators import nodes as N
    both = spark.createDataFrame([("h", "CDC42", 9606), ("y", "CDC42", 4932)], "node_id string, name string, group_id bigint")
    raw = spark.createDataFrame([(9606, "CDC42", "P60953", "MQTIK", 0), (4932, "CDC42", "P19073", "MQT", 0)],
                                "group_id bigint, gene string, accession string, sequence string, pos int")
    got = N.attach_sequences(both, N.longest_sequences(raw, extra_keys=("group_id",))).collect()
    assert sorted((r.node_id, r.accession) for r in got) == [("h", "P60953"), ("y", "P19073")]


def test_a_named_folder_is_set_once(spark, tmp_path, monkeypatch):
    from edgeloom.session import _qualified, shared_folder
    before, kind = spark.sparkContext.getCheckpointDir(), type(spark.conf)
    get = kind.get
    monkeypatch.setattr(kind, "get", lambda self, key, *rest: str(tmp_path) if key == "spark.checkpoint.dir" else get(self, key, *rest))
    first = shared_folder(spark)
    assert first.startswith(_qualified(spark, str(tmp_path))) and {shared_folder(spark) for _ in range(3)} == {first}
    monkeypatch.undo()
    if before:
        spark.sparkContext.setCheckpointDir(before.rsplit("/", 1)[0])


def test_wedges_equal_walks_from_the_pairs(spark):
    import random
    from edgeloom.operators import graph as G
    from edgeloom.operators.pairs import both_ways, candidate_pairs
    rng = random.Random(3)
    nodes = spark.createDataFrame([(i, i // 20, ("a", "b", "both", "partner")[rng.randrange(4)]) for i in range(40)],
                                  "node_id bigint, group_id bigint, role string")
    edges = spark.createDataFrame(sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(250)}), "src bigint, dst bigint")
    pairs = candidate_pairs(nodes)
    want = {(r.a, r.b): r.shared for r in G.shared_counts(pairs, both_ways(edges)).collect()}
    assert want == {(r.a, r.b): r.shared for r in G.candidate_shared(nodes, both_ways(edges)).collect()}
    cols = ["a", "b", "shared", "jaccard", "adamic_adar", "preferential_attachment"]
    one, two = (sorted(df.select(*cols).collect()) for df in (G.link_scores(pairs, nodes, edges), G.candidate_link_scores(nodes, edges)))
    assert one == two


def test_flags_from_the_map_equal_those_of_the_atlas(spark):
    from edgeloom.operators import features as FE
    from edgeloom.operators.pairs import candidate_pairs
    # group 2 has one both node and no counterpart, group 3 two a nodes
    rows = [("x", 1, "a", "P00001"), ("y", 1, "b", "P00002"), ("z", 1, "partner", "P00003"), ("v", 2, "both", "P00004"), ("u", 3, "a", "P00005"), ("t", 3, "a", "P00006")]
    nodes = spark.createDataFrame(rows, "node_id string, group_id bigint, role string, accession string")
    places = spark.createDataFrame([(r[3], "Nucleus." if r[0] != "y" else "", None) for r in rows], "accession string, location string, component string")
    from edgeloom.operators.evidence import location_map
    placed = nodes.join(location_map(places), "accession").select("node_id", "group_id", "role", F.array_join("buckets", ";").alias("location"))
    want = {r.node_id: r.flag for r in FE.location_flags(nodes, candidate_pairs(placed)).collect()}
    assert want == {r.node_id: r.flag for r in FE.bucket_flags(nodes, places).collect()} == {"x": 1, "y": 0, "z": 0, "v": 0, "u": 0, "t": 0}


def test_nodes_without_a_vector_stop_the_job(spark):
    from edgeloom.operators import features as FE
    nodes = spark.createDataFrame([("x",), ("y",), ("w",)], "node_id string")
    vectors = spark.createDataFrame([("x", [1.0]), ("w", None), ("z", [2.0])], "node_id string, vector array<double>")
    assert sorted(map(tuple, FE.feature_gaps(nodes, vectors).collect())) == [("w", "no vector"), ("y", "no vector"), ("z", "no node")]
    with pytest.raises(ValueError, match="nodes without a vector"):
        FE.require_vectors(nodes, vectors)
    FE.require_vectors(nodes.filter("node_id = 'x'"), vectors)
