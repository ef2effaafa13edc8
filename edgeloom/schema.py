"""Explicit schemas; no scan relies on inference."""
from pyspark.sql import types as T

NODE = T.StructType([
    T.StructField("node_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("group_id", T.LongType()),
    T.StructField("group_name", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("accession", T.StringType()),
    T.StructField("sequence_length", T.LongType()),
])
EDGE = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("src_name", T.StringType()),
    T.StructField("dst_name", T.StringType()),
    T.StructField("group_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
])
FEATURE = T.StructType([
    T.StructField("node_id", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
])
SEED = T.StructType([
    T.StructField("group_id", T.LongType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("pos", T.IntegerType()),
])
ID_MAP = T.StructType([
    T.StructField("queryItem", T.StringType()),
    T.StructField("queryIndex", T.IntegerType()),
    T.StructField("stringId", T.StringType()),
    T.StructField("ncbiTaxonId", T.IntegerType()),
    T.StructField("taxonName", T.StringType()),
    T.StructField("preferredName", T.StringType()),
    T.StructField("annotation", T.StringType()),
])
SEQUENCE_JSON = T.StructType([
    T.StructField("primaryAccession", T.StringType()),
    T.StructField("genes", T.ArrayType(T.StructType([
        T.StructField("geneName", T.StructType([T.StructField("value", T.StringType())])),
    ]))),
    T.StructField("sequence", T.StructType([T.StructField("value", T.StringType())])),
])
HIT_COLUMNS = [
    "acc_a", "acc_b", "source", "system", "system_type", "interaction_type", "detection_method",
    "publication", "throughput", "taxon_a", "taxon_b",
]
