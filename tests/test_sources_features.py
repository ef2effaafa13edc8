"""Sources, sinks, node tables, features and learners."""
import json

import pytest
from pyspark.sql import functions as F

from edgeloom.operators import features as FE
from edgeloom.operators import learners as L
from edgeloom.operators import nodes as N
from edgeloom.operators.pairs import both_ways
from edgeloom.operators.splits import permuted_features
from edgeloom.plans import hits as H
from edgeloom.plans import ingest as IN
from edgeloom.sources import fasta as FA
from edgeloom.sources import tables as T


def test_fasta(spark, tmp_path):
    (tmp_path / "t.fasta").write_text(">idA nameA\nMKT\nAA a\n\n>idB\nC\n")
    assert {r.node_id: r.sequence for r in FA.read_fasta(spark, str(tmp_path / "t.fasta")).collect()} == {"idA": "MKTAAA", "idB": "C"}
    nodes = spark.createDataFrame([("9606.X", "YAP1", 9606, "a", "P46937", "A" * 70)],
                                  "node_id string, name string, group_id bigint, role string, accession string, sequence string")
    lines = FA.fasta_text(nodes).first().value.split("\n")
    assert lines == [">9606.X YAP1 OX=9606 GN=YAP1 compartment=a AC=P46937", "A" * 60, "A" * 10]
    FA.write_fasta(nodes, str(tmp_path / "out"))
    assert FA.read_fasta(spark, str(tmp_path / "out")).first().sequence == "A" * 70


@pytest.mark.parametrize("text, word", [("", "no records"), ("MKT\n>a\nC\n", "before"), (">\nMKT\n>b\nC\n", "without an id")])
def test_fasta_errors(spark, tmp_path, text, word):
    (tmp_path / "bad.fasta").write_text(text)
    with pytest.raises(ValueError, match=word):
        FA.read_fasta(spark, str(tmp_path / "bad.fasta"))


MAP = ("queryItem\tqueryIndex\tstringId\tncbiTaxonId\ttaxonName\tpreferredName\tannotation\n"
       "YAP1\t0\t9606.E1\t9606\tHomo sapiens\tYAP1\tx\nYAP1\t0\t9606.DUP\t9606\tHomo sapiens\tYAP1\ty\nACTB\t1\t9606.E2\t9606\tHomo sapiens\tACTB\tz\n")


def test_identifier_map(spark, tmp_path):
    for name, text in (("ok", MAP), ("empty", "\n"), ("err", "Error: invalid species\n"), ("other", "a\tb\n1\t2\n")):
        (tmp_path / name).write_text(text)
    df = T.read_identifier_map(spark, str(tmp_path / "ok")).withColumn("pos", F.monotonically_increasing_id())
    best = {r.queryItem: r.stringId for r in T.best_identifier(df, ["queryIndex", "pos"]).collect()}
    assert best == {"YAP1": "9606.E1", "ACTB": "9606.E2"}
    symbols = spark.createDataFrame([("yap1",), ("ZZZ",)], "symbol string")
    assert [r.symbol for r in T.unresolved(symbols, df).collect()] == ["ZZZ"]
    assert T.read_identifier_map(spark, str(tmp_path / "empty")).count() == 0
    for name in ("err", "other"):
        with pytest.raises(ValueError):
            T.read_identifier_map(spark, str(tmp_path / name))


def test_seeds_and_roles(spark):
    seeds = T.seed_table(spark)
    assert T.unique_symbols(seeds).groupBy("group_id").count().collect().__len__() == 2
    assert {r.group_id: r["count"] for r in T.unique_symbols(seeds).groupBy("group_id").count().collect()} == {9606: 20, 4932: 16}
    names = spark.createDataFrame([("YAP1", 9606), ("actb", 9606), ("AMOT", 9606), ("CDC42", 4932), ("YAP1", 4932)], "name string, group_id bigint")
    got = {(r.name, r.group_id): r.role for r in N.label_roles(names, seeds).collect()}
    assert got == {("YAP1", 9606): "a", ("actb", 9606): "b", ("AMOT", 9606): "partner", ("CDC42", 4932): "b", ("YAP1", 4932): "partner"}
    twice = seeds.unionByName(spark.createDataFrame([(9606, "Yap1", "b", 99)], seeds.schema))
    assert N.label_roles(names, twice).filter("name = 'YAP1' AND group_id = 9606").first().role == "both"


def test_sequences(spark, tmp_path):
    def entry(acc, gene, seq):
        return {"primaryAccession": acc, "genes": [{"geneName": {"value": gene}}] if gene else [], "sequence": {"value": seq}}
    rows = [entry("SHORT", "YAP1", "AAA"), entry("LONG", "YAP1", "AAAAAA"), entry("TIE", "yap1", "CCCCCC"), entry("NONE", None, "A"), entry("X", "TP53", "MEEPQ")]
    (tmp_path / "s.json").write_text("\n".join(json.dumps(r) for r in rows))
    seq = T.read_sequence_json(spark, str(tmp_path / "s.json")).withColumn("pos", F.monotonically_increasing_id())
    best = N.longest_sequences(seq)
    assert {r.gene_key: r.accession for r in best.collect()} == {"YAP1": "LONG", "TP53": "X"}
    second = best.withColumn("accession", F.lit("B")).unionByName(best.withColumn("gene_key", F.lit("NEW")).filter("gene = 'TP53'"))
    assert {r.gene_key: r.accession for r in N.with_fallback(best, second, "gene_key").collect()} == {"YAP1": "LONG", "TP53": "X", "NEW": "X"}
    nodes = spark.createDataFrame([(1, "yap1"), (2, "nope")], "node_id bigint, name string")
    assert [(r.node_id, r.sequence_length) for r in N.attach_sequences(nodes, best).collect()] == [(1, 6)]


def test_prepare_sequences(spark):
    fasta = spark.createDataFrame([("b", "CC"), ("a", "AA"), ("c", "DDDD"), ("e", "")], "node_id string, sequence string")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "node_id string")
    got = {r.node_id: (r.sequence, r.truncated) for r in N.prepare_sequences(ids("a", "b", "c"), fasta, 3).collect()}
    assert got == {"a": ("AA", False), "b": ("CC", False), "c": ("DDD", True)}
    with pytest.raises(ValueError, match="without"):
        N.prepare_sequences(ids("zz"), fasta)
    with pytest.raises(ValueError, match="empty"):
        N.prepare_sequences(ids("e"), fasta)


def test_locations_and_csv(spark, nodes, edges, tmp_path):
    (tmp_path / "l.tsv").write_text("Entry\tSubcellular location [CC]\tGene Ontology (cellular component)\nP1\tNucleus\tcytosol\n")
    assert T.read_locations(spark, str(tmp_path / "l.tsv")).columns == ["accession", "location", "component"]
    odd = spark.createDataFrame([("P1", "x")], "k string, v string")
    assert T.location_rows(odd).first().location == "x"
    T.write_csv(nodes.withColumn("sequence_length", F.lit(3)), str(tmp_path / "n"))
    assert T.read_nodes(spark, str(tmp_path / "n")).count() == 7
    net = spark.createDataFrame([("x", "y", "X", "Y", 900.0)], "stringId_A string, stringId_B string, preferredName_A string, preferredName_B string, score double")
    assert T.edge_rows(net, 9606).first().score == 0.9
    T.write_csv(T.edge_rows(net, 9606), str(tmp_path / "e"))
    assert T.read_edges(spark, str(tmp_path / "e")).first().score == 0.9


def test_feature_files_and_splits(spark, tmp_path):
    f = spark.createDataFrame([("a", [1.0, 2.0])], "node_id string, vector array<double>")
    T.write_features(f, str(tmp_path / "f"))
    assert T.read_features(spark, str(tmp_path / "f")).first().vector == [1.0, 2.0]
    s = spark.createDataFrame([("p", 0, "train", 1, 2), ("p", 1, "test", 1, 2)], "protocol string, seed int, split string, a bigint, b bigint")
    T.write_splits(s, str(tmp_path / "s"))
    assert T.read_splits(spark, str(tmp_path / "s")).filter("seed = 1").first().split == "test"
    T.write_summary(s, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_masked_mean(spark):
    rows = [(1, t, v) for t, v in zip([1, 3, 3, 2, 0], [[9.0, 9.0], [1.0, 0.0], [3.0, 2.0], [8.0, 8.0], [0.0, 0.0]])] + [(2, 1, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "node_id int, token_id int, vector array<double>")
    got = {r.node_id: r.pooled for r in FE.masked_mean(df, [0, 1, 2], 2).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 0.0]}


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [float(i), float((i * i) % 7), 1.0]) for i in range(20)]
    return spark.createDataFrame(rows, "node_id bigint, vector array<double>")


def test_neighbor_mean_and_propagation(spark, vectors):
    adj = both_ways(spark.createDataFrame([(0, 1), (0, 2)], "src bigint, dst bigint"))
    got = {r.node_id: r.vector for r in FE.neighbor_mean(vectors, adj, 3).collect()}
    assert got[0] == [1.5, 2.5, 1.0] and got[1] == [0.0, 0.0, 1.0] and got[5] == [0.0, 0.0, 0.0]
    wide = {r.node_id: r.vector for r in FE.propagate(vectors, adj, 3).collect()}
    assert wide[1] == [1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.5, 2.5, 1.0]


def test_permuted_features_keep_the_multiset(vectors):
    got = permuted_features(vectors, 3).collect()
    assert sorted(r.vector for r in got) == sorted(r.vector for r in vectors.collect())
    assert {r.node_id for r in got} == set(range(20)) and any(r.vector[0] != r.node_id for r in got)


def test_embedding(spark):
    def encoder(seqs):
        import numpy as np
        width = max(map(len, seqs)) + 2
        ids = np.zeros((len(seqs), width), dtype=int)
        for i, s in enumerate(seqs):
            ids[i, 0], ids[i, len(s) + 1] = 1, 2
            ids[i, 1:len(s) + 1] = 3
        table = np.zeros((8, 4))
        table[3] = [1, 2, 3, 4]
        return ids, ids != 0, table[ids]
    df = spark.createDataFrame([("x", "A"), ("y", "AAA")], "node_id string, sequence string")
    got = FE.embed_sequences(df, encoder, special_ids=[0, 1, 2], batch_size=1).collect()
    assert all(r.vector == [1.0, 2.0, 3.0, 4.0] for r in got) and len(got) == 2


def test_neighbor_mean_in_many_blocks_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(FE, "EDGES_PER_BLOCK", 4)               # node 0 alone fills several blocks
    pairs = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 28)]
    adj = both_ways(spark.createDataFrame(pairs, "src bigint, dst bigint"))
    vectors = spark.createDataFrame([(i, [float(i), 1.0 / (i + 1)]) for i in range(32) if i != 7], "node_id bigint, vector array<float>")
    value = {r.node_id: r.vector for r in vectors.collect()}
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    got = {r.node_id: r.vector for r in FE.neighbor_mean(vectors, adj, 2).collect()}
    assert got.keys() == value.keys()
    for node in value:
        held = [value[n] for n in near.get(node, []) if n in value]
        assert got[node] == pytest.approx([sum(v[j] for v in held) / len(held) if held else 0.0 for j in (0, 1)])


def test_location_flags(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node_id bigint")
    atlas = spark.createDataFrame([(1, 2, "nucleus", "")], "a bigint, b bigint, location_a string, location_b string")
    assert {r.node_id: r.flag for r in FE.location_flags(nodes, atlas).collect()} == {1: 1, 2: 0, 3: 0}


def test_logistic(spark):
    rows = [(i, i + 50, i % 2, i % 2 * 5 + i % 3, 1, i % 3, i % 2 * 3, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, label int, degree_a int, degree_b int, degree_product int, shared int, both_located int")
    model = L.fit_logistic(df)
    got = L.logistic_scores(model, df).collect()
    assert min(r.score for r in got if r.label == 1) > max(r.score for r in got if r.label == 0)
    assert L.fit_logistic(df.filter("label = 1")) is None


def test_pair_model_is_symmetric_and_ranks(spark, vectors):
    rows = [(i, i + 10, int(i < 5)) for i in range(10)]
    train = spark.createDataFrame(rows, "a bigint, b bigint, label int")
    model = L.fit_pair_mlp(train, vectors, 3, hidden=4, max_iter=10)
    fwd = {(r.a, r.b): r.score for r in L.symmetric_scores(model, train, vectors).collect()}
    assert len(fwd) == 10 and all(0 <= v <= 1 for v in fwd.values())
    nodes = spark.createDataFrame([(i, 1, "a" if i < 4 else "b") for i in range(8)], "node_id bigint, group_id bigint, role string")
    known = spark.createDataFrame([(0, 4)], "a bigint, b bigint")
    hits = H.hit_list(nodes, known, model, vectors, k=5).collect()
    assert len(hits) == 5 and (0, 4) not in {(r.a, r.b) for r in hits}
    ranked = H.rank_candidates(nodes, model, vectors).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 17))


def test_top_per_group(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.2), (1, 0, 2, 0.9), (1, 0, 3, 0.5), (2, 0, 4, 0.8)], "group_id int, a int, b int, probability double")
    got = sorted((r.group_id, r["rank"], r.probability) for r in H.top_per_group(df, 2).collect())
    assert got == [(1, 1, 0.9), (1, 2, 0.5), (2, 1, 0.8)]


def test_seed_labels(spark):
    df = spark.createDataFrame([(0, "CDC42", "H"), (1, "YAP1", "H"), (2, "CDC42", "Y"), (3, "VCL", "H")], "node_id int, name string, t string")
    got = {r.node_id: r.label for r in N.seed_labels(df, ["CDC42", "YAP1"], F.col("t")).collect()}
    assert got == {0: "CDC42 (H)", 1: "YAP1", 2: "CDC42 (Y)"}


def test_ingest(spark):
    names = spark.createDataFrame([(i, f"N{i}", 1, "one") for i in range(6)], "node_id bigint, name string, group_id bigint, group_name string")
    net = spark.createDataFrame([(0, 1, "N0", "N1", 1, 0.9), (1, 0, "N1", "N0", 1, 0.8), (1, 2, "N1", "N2", 1, 0.9), (0, 3, "N0", "N3", 1, 0.5), (0, 4, "N0", "N4", 1, 0.9)],
                                "src bigint, dst bigint, src_name string, dst_name string, group_id bigint, score double")
    seeds = spark.createDataFrame([(1, "n0", "a"), (1, "n5", "b")], "group_id bigint, symbol string, role string")
    seq = spark.createDataFrame([(f"N{i}", f"P{i}", "MKT") for i in (0, 1, 2, 3, 5)], "gene_key string, accession string, sequence string")
    nodes, edges = IN.ingest_graph(names, net, seeds, seq)
    assert {(r.node_id, r.role) for r in nodes.collect()} == {(0, "a"), (1, "partner"), (5, "b")}     # 4 lacks a sequence
    assert [(r.src, r.dst, r.score) for r in edges.collect()] == [(0, 1, 0.9)]
    total = IN.ingest_summary(nodes, edges).filter("group_id IS NULL").first()
    assert (total.n_nodes, total.n_edges, total.n_components, total.n_isolates) == (3, 1, 2, 1)
