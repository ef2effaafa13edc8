"""Many catalog files, each with its own header row, are one scan."""
import random

import pytest
from catalog_rows import HEADER_A, ROWS_A

from edgeloom.sources import catalogs as CA


def _files(folder, n):
    """``n`` files of the same records under differing headers, besides an empty file and one of a header alone."""
    draw = random.Random(1)
    paths, texts = [], []
    for i in range(n):
        columns = list(HEADER_A)
        if i % 4 == 1:
            draw.shuffle(columns)
        if i % 4 == 2:
            columns = columns[:6] + columns[7:]                            # no throughput
        if i % 4 == 3:
            columns = [c for c in columns if c != "Organism ID Interactor B"]   # half a pair of columns counts as none
        rows = []
        for j, line in enumerate(ROWS_A):
            cells = dict(zip(HEADER_A, line.split("\t")))
            whole = len(cells) == len(HEADER_A)
            rows.append("\t".join(cells[c] if c != HEADER_A[0] else f"{i}{j}" for c in columns) if whole else line)
        if i % 5 == 0:
            rows.insert(2, "\t".join(columns))                              # the header again, further down
        texts.append((columns, rows))
        paths.append(folder / f"part-{i:03}.txt")
        paths[-1].write_text("\n".join(["\t".join(columns), *rows]) + "\n")
    for name, text in (("empty.txt", ""), ("bare.txt", "\t".join(HEADER_A))):
        paths.append(folder / name)
        paths[-1].write_text(text)
    return [str(p) for p in paths], texts


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(i, a) for i, a in enumerate(["P46937", "P60709", "P53894", "P60010"])], "node_id bigint, accession string")


def test_own_headers_in_one_scan(spark, nodes, tmp_path):
    paths, texts = _files(tmp_path, 24)
    frame = CA.read_catalog_a(spark, paths, nodes)
    want = []
    for columns, rows in texts[:8]:
        lines = spark.createDataFrame([(r,) for r in rows if r != "\t".join(columns)], "value string")
        want += [tuple(r) for r in CA.parse_catalog_a(lines, columns, nodes).collect()]
    few = CA.read_catalog_a(spark, paths[:8], nodes)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in few.collect()) and want
    assert frame.count() == 3 * len(want)                                   # 2 records a file, headers are none
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (few, frame)]
    assert [p.count("text") for p in plans] == [plans[0].count("text")] * 2      # as large for 26 files as for 8
    assert [sum("Union" in line for line in p.splitlines()) for p in plans] == [0, 0]


def test_first_line_of_a_cut_file(spark, tmp_path):
    """A file of many blocks has one header: the first line of its first block."""
    path = tmp_path / "long.txt"
    path.write_text("\n".join(["id\tname"] + [f"{i}\trow {i}" for i in range(20_000)]) + "\n")
    other = tmp_path / "other.txt"
    other.write_text("name\tid\nx\t1\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        got = {r.file.rsplit("/", 1)[1]: r.header for r in CA.file_headers(spark, [str(path), str(other)]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {"long.txt": "id\tname", "other.txt": "name\tid"}


def test_missing_column_and_no_content(spark, nodes, tmp_path):
    paths, _ = _files(tmp_path, 2)
    bad = tmp_path / "bad.txt"
    bad.write_text("\t".join(c for c in HEADER_A if c != "Publication Source") + "\n")
    with pytest.raises(KeyError, match="no column for pub"):
        CA.read_catalog_a(spark, [*paths, str(bad)], nodes)
    with pytest.raises(ValueError, match="no catalog content"):
        CA.read_catalog_a(spark, [paths[-2]], nodes)


def test_landed_catalogs_are_compressed(spark, monkeypatch):
    """Two catalogs as plain text take several times the disk of the tables they are rendered from."""
    import glob

    from edgeloom.driver import queries as Q
    paths, named = [], Q._written

    def kept(x, name):
        paths.append(named(x, name))
        return paths[-1]
    monkeypatch.setattr(Q, "_written", kept)
    assert Q.QUERIES["catalog_files"](spark, "/root/testdata/sf0.001").count() > 0
    files = [f for p in paths for f in glob.glob(p.removeprefix("file:") + "/part-*")]
    assert len(paths) == 3 and files and all(f.endswith(".gz") for f in files)


def test_records_of_one_type_are_told_inside_the_parse(spark):
    """A filter was moved below the dealing of the lines, each of which was made anew for every test in it."""
    from pyspark.sql import functions as F

    from edgeloom.driver import inputs as I
    x = I.Inputs(spark, "/root/testdata/sf0.001")
    want = x.hits_a.filter(F.lower(F.trim("system_type")) == "physical")
    got = CA.parse_catalog_a(x.catalog_a_lines, I.HEADER_A, x.nodes, kind="physical")
    assert got.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Filter" in line and "concat_ws" in line]
