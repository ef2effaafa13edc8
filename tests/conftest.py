import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from edgeloom.session import local_session                                # noqa: E402

from tests.catalog_rows import HEADER_A, ROWS_A, ROWS_B                   # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, memory="4g")
    s.conf.set("spark.sql.shuffle.partitions", "3")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def nodes(spark):
    rows = [
        ("9606.YAP1", "YAP1", 9606, "Homo sapiens", "a", "P46937"),
        ("9606.ACTB", "ACTB", 9606, "Homo sapiens", "b", "P60709"),
        ("9606.VCL", "VCL", 9606, "Homo sapiens", "b", "P18206"),
        ("9606.NF2", "NF2", 9606, "Homo sapiens", "a", "P35240"),
        ("4932.CBK1", "CBK1", 4932, "Saccharomyces cerevisiae", "a", "P53894"),
        ("4932.ACT1", "ACT1", 4932, "Saccharomyces cerevisiae", "b", "P60010"),
        ("4932.KIC1", "KIC1", 4932, "Saccharomyces cerevisiae", "a", "P38692"),
    ]
    return spark.createDataFrame(rows, "node_id string, name string, group_id bigint, group_name string, role string, accession string")


@pytest.fixture(scope="session")
def edges(spark):
    rows = [("9606.YAP1", "9606.NF2", 0.9), ("9606.ACTB", "9606.VCL", 0.8), ("4932.ACT1", "4932.KIC1", 0.75)]
    return spark.createDataFrame(rows, "src string, dst string, score double")


@pytest.fixture(scope="session")
def hits(spark, nodes):
    from edgeloom.sources.catalogs import parse_catalog_a, parse_catalog_b
    a = spark.createDataFrame([(r,) for r in ROWS_A], "value string")
    b = spark.createDataFrame([(r,) for r in ROWS_B], "value string")
    return parse_catalog_a(a, HEADER_A, nodes).unionByName(parse_catalog_b(b, nodes))
