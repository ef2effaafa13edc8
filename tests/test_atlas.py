"""Catalogs, folding, candidates and the atlas on the small fixture."""
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import evidence as E
from edgeloom.operators import pairs as P
from edgeloom.plans import atlas as A
from edgeloom.sources.catalogs import read_catalog_a, read_catalog_b
from tests.catalog_rows import HEADER_A, ROWS_A, ROWS_B


def test_hits_inside_universe(hits):
    rows = {(r.acc_a, r.acc_b, r.source, r.system_type) for r in hits.collect()}
    assert rows == {("P46937", "P60709", "a", "physical"), ("P53894", "P60010", "a", "genetic"),
                    ("P18206", "P46937", "b", ""), ("P53894", "P60010", "b", "")}


def test_catalog_files(spark, nodes, tmp_path):
    for name, rows in (("one.txt", ROWS_A[:1]), ("two.txt", ROWS_A[1:])):
        (tmp_path / name).write_text("\n".join(["\t".join(HEADER_A), *rows]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(ROWS_B) + "\n")
    a = read_catalog_a(spark, [str(tmp_path / "one.txt"), str(tmp_path / "two.txt")], nodes)
    assert a.count() == 2
    assert {r.taxon_a for r in a.collect()} == {9606, 559292}
    assert read_catalog_b(spark, str(tmp_path / "b.txt"), nodes).count() == 2


def test_multi_valued_cells_give_several_pairs(spark, nodes):
    from edgeloom.sources.catalogs import parse_catalog_a
    row = ROWS_A[0].replace("P46937\t-", "P46937\tP35240|P60709")
    got = parse_catalog_a(spark.createDataFrame([(row,)], "value string"), HEADER_A, nodes)
    assert {(r.acc_a, r.acc_b) for r in got.collect()} == {("P46937", "P60709"), ("P35240", "P60709")}


def test_optional_columns(spark, nodes):
    from edgeloom.sources.catalogs import parse_catalog_a
    keep = [0, 1, 2, 3, 7, 9]
    cut = lambda cells: [cells[i] for i in keep]                           # noqa: E731
    line = "\t".join(cut(ROWS_A[0].split("\t")))
    got = parse_catalog_a(spark.createDataFrame([(line,)], "value string"), cut(HEADER_A), nodes).first()
    assert (got.throughput, got.taxon_a) == ("", None)


def test_fold(hits):
    by = {(r.acc_a, r.acc_b): r for r in E.fold_hits(hits).collect()}
    both = by[("P53894", "P60010")]
    assert (both.catalog_a_physical, both.catalog_a_genetic, both.catalog_b) == (False, True, True)
    assert both.assays == ["Dosage Rescue"] and set(both.publications) == {"2222", "5555", "15364"}


def test_flags_alone_are_those_of_the_fold(spark, hits):
    names = ["acc_a", "acc_b", "catalog_a_physical", "catalog_a_genetic", "catalog_b"]
    flags = E.fold_flags(hits)
    assert flags.columns == names and sorted(map(tuple, flags.collect())) == sorted(map(tuple, E.fold_hits(hits).select(*names).collect()))
    assert E.fold_flags(hits.limit(0)).count() == 0


def test_physical_edges(hits, nodes):
    rows = {(r.a, r.b): r for r in E.physical_edges(E.fold_hits(hits), nodes).collect()}
    assert set(rows) == {("9606.ACTB", "9606.YAP1"), ("9606.VCL", "9606.YAP1"), ("4932.ACT1", "4932.CBK1")}
    assert rows[("9606.ACTB", "9606.YAP1")].acc_a == "P46937"              # accessions ordered on their own
    assert rows[("9606.VCL", "9606.YAP1")].tier1 and not rows[("4932.ACT1", "4932.CBK1")].tier1


def test_location_rows_pool(spark):
    loc = spark.createDataFrame([("P1", "Nucleus.", None), ("P1", None, "cytosol"), ("P2", None, None)],
                                "accession string, location string, component string")
    got = {r.accession: r.buckets for r in E.location_map(loc).collect()}
    assert got == {"P1": ["cytoplasm", "nucleus"], "P2": []}


def small(spark, roles, groups):
    rows = [(i, g, r) for i, (r, g) in enumerate(zip(roles, groups))]
    return spark.createDataFrame(rows, "node_id bigint, group_id bigint, role string")


@pytest.mark.parametrize("tile", [1, 2, 4096])
def test_candidates(spark, tile):
    got = P.candidate_pairs(small(spark, ["both", "a", "b"], [1, 1, 1]), tile_rows=tile).select("a", "b").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (0, 2), (1, 2)]
    cross = P.candidate_pairs(small(spark, ["a", "b", "partner", "a", "b", "both", "both"], [1, 1, 1, 2, 2, 2, 2]), tile_rows=tile)
    assert sorted((r.a, r.b) for r in cross.collect()) == [(0, 1), (3, 4), (3, 5), (3, 6), (4, 5), (4, 6), (5, 6)]


def test_novel(spark):
    known = spark.createDataFrame([(0, 1)], "a bigint, b bigint")
    got = P.novel_candidates(small(spark, ["a", "b", "partner", "a", "b"], [1, 1, 1, 2, 2]), known)
    assert [(r.a, r.b) for r in got.collect()] == [(3, 4)]


@pytest.fixture(scope="module")
def sources(spark, nodes, edges, hits):
    channels = spark.createDataFrame(
        [("9606.YAP1", "9606.NF2", 0.9, 0.0, 0.0, 0.0, 0.0, 0.4, 0.2, 0.1), ("4932.KIC1", "4932.ACT1", 0.3, 0.0, 0.0, 0.0, 0.0, 0.0, 0.2, 0.9)],
        "src string, dst string, combined double, nscore double, fscore double, pscore double, ascore double, escore double, dscore double, tscore double")
    text = ["Nucleus. Cytoplasm.", "Cytoplasm, cytoskeleton.", "Cell membrane. Cytoplasm.", "Nucleus. Plasma membrane.",
            "Cytoplasm.", "Cytoplasm, cytoskeleton.", "Bud neck."]
    acc = ["P46937", "P60709", "P18206", "P35240", "P53894", "P60010", "P38692"]
    loc = spark.createDataFrame([(a, t, "") for a, t in zip(acc, text)], "accession string, location string, component string")
    scores = spark.createDataFrame([("9606.YAP1", "9606.ACTB", 0.92, 2), ("4932.ACT1", "4932.KIC1", 0.95, 1)],
                                   "a string, b string, probability double, rank bigint")
    return E.fold_hits(hits), channels, loc, scores


def test_atlas(nodes, edges, sources):
    evidence, channels, loc, scores = sources
    table = A.rank_absent(A.build_atlas(nodes, edges, evidence, channels, loc, scores, quantile=0.99))
    rows = {(r.name_a, r.name_b): r for r in table.collect()}
    assert len(rows) == 6
    actb = rows[("ACTB", "YAP1")]
    assert actb.evidence_class == "physical_curated" and actb.probability == 0.92 and actb.localization_overlap == "compatible"
    cbk = rows[("ACT1", "CBK1")]
    assert cbk.catalog_b and cbk.catalog_a_genetic and not cbk.genetic_only and cbk.publications == "2222;5555;15364"
    kic = rows[("ACT1", "KIC1")]
    assert kic.string_combined == 0.7 and kic.string_in_graph and kic.dominant_channel == "textmining"
    assert kic.rank_among_absent is None and kic.evidence_class == "artifact_risk"
    ranks = sorted(r.rank_among_absent for r in rows.values() if r.string_absent)
    assert ranks == [1, 2, 3, 4, 5] and actb.rank_among_absent == 1        # unscored rows are numbered too


def test_unscored_atlas_has_no_ranks(nodes, edges, sources):
    evidence, channels, loc, _ = sources
    table = A.rank_absent(A.build_atlas(nodes, edges, evidence, channels, loc))
    assert table.filter("rank_among_absent IS NOT NULL").count() == 0


@pytest.mark.parametrize("q", [0.5, 0.9])
def test_counts_without_pairs_equal_counted_pairs(nodes, edges, sources, q):
    evidence, channels, loc, _ = sources
    dense = (A.build_atlas(nodes, edges, evidence, channels, loc, quantile=q)
             .groupBy("group_id", "evidence_class", "string_absent")
             .agg(F.count("*"), F.count_if(F.expr("catalog_a_physical OR catalog_b")), F.count_if("genetic_only")))
    sparse = A.class_counts(nodes, edges, evidence, channels, loc, quantile=q)
    assert sorted(map(tuple, dense.collect())) == sorted(map(tuple, sparse.collect()))
    flags = evidence.select("acc_a", "acc_b", "catalog_a_physical", "catalog_a_genetic", "catalog_b")
    slim = A.class_counts(nodes, edges, flags, channels, loc, quantile=q)
    assert sorted(map(tuple, slim.collect())) == sorted(map(tuple, sparse.collect()))


def test_profile_pairs_count_both_roles_once(spark):
    nodes = small(spark, ["both"] * 5 + ["a"] * 3 + ["b"] * 2, [7] * 10).withColumn("degree", F.col("node_id") % 3)
    got = A.profile_pairs(nodes, "degree").agg(F.sum("twice_pairs") / 2).first()[0]
    assert got == P.candidate_pairs(nodes).count()


def test_cutoff_is_the_interpolated_quantile(spark):
    import numpy as np
    nodes = small(spark, ["both", "a", "b", "a", "b"] * 8, [1, 2] * 20).withColumn("degree", F.col("node_id") % 7)
    pairs = P.candidate_pairs(nodes).select((F.col("degree_a") * F.col("degree_b")).alias("d")).toPandas()
    assert A.degree_product_cutoff(nodes).first()[0] == pytest.approx(np.quantile(pairs.d, 0.9))
    assert A.degree_product_cutoff(nodes.filter("node_id < 0")).first()[0] == 0.0


def test_spearman(spark):
    df = spark.createDataFrame([(float(i), float((i * 7) % 5), 1.0) for i in range(10)], "x double, y double, z double")
    pdf = df.toPandas()
    assert A.spearman(df, "x", "y").first().rho == pytest.approx(pdf.x.rank().corr(pdf.y.rank()))
    assert A.spearman(df, "x", "z").first().rho is None
    assert A.spearman(df.limit(4), "x", "y").first().rho is None


def test_graded_records_equal_the_whole_fold(spark, hits, nodes):
    from edgeloom.operators import evidence as E
    graded, whole = E.fold_grades(hits), E.fold_hits(hits)
    keys = ["acc_a", "acc_b", "catalog_a_physical", "catalog_b"]
    assert sorted(map(tuple, graded.select(*keys).collect())) == sorted(map(tuple, whole.select(*keys).collect()))
    assert sum(r.n_records for r in graded.collect()) == hits.count() > 0
    want = {(r.a, r.b, r.tier1) for r in E.physical_edges(whole, nodes).collect()}
    assert want and {(r.a, r.b, r.tier1) for r in E.physical_grades(graded, nodes).collect()} == want
