import os

import pytest

import __spark_entry__
import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_name_themselves():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "pii", "packing"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver tables")
def test_stages_keep_clean_rows_and_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == docs.columns
            assert after.join(docs, "doc_id", "left_anti").count() == 0
        if name == "quality":
            lost = docs.join(after, "doc_id", "left_anti").join(labels, "doc_id")
            assert lost.filter("quality = 1").count() == 0 and lost.filter("quality = 0").count() > 0
        elif name in ("line_dedup", "pii"):
            assert after.count() == docs.count()
        elif name == "packing":
            assert after.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        docs = after
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[3] < sizes[2]
