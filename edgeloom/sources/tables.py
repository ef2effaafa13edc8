"""Table scans and sinks with explicit schemas."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import constants as K
from edgeloom import schema as S
from edgeloom.functions.identifiers import normalize_score, resolve_headers
from edgeloom.operators.ranking import first_per_key
from edgeloom.sources.proof import read_proved, write_proved


# --- scored edges and channels ------------------------------------------------

def channel_rows(frame: DataFrame) -> DataFrame:
    """Raw channel table with aliased headers into ``src, dst, combined`` and seven channels.

    A channel that is absent or not a number counts 0.
    """
    at = resolve_headers(frame.columns, K.CHANNEL_HEADERS)
    a, b, score = (frame.columns[at[field]] for field in ("src", "dst", "combined"))

    def channel(c):
        if c not in frame.columns:
            return F.lit(0.0)
        value = F.col(c).try_cast("double")
        return F.coalesce(normalize_score(F.nanvl(value, F.lit(None).cast("double"))), F.lit(0.0))
    return frame.select(F.col(a).alias("src"), F.col(b).alias("dst"), normalize_score(score).alias("combined"),
                        *[channel(c).alias(c) for c in K.CHANNELS])


def read_channels(spark: SparkSession, path: str, *, sep: str = ",") -> DataFrame:
    return channel_rows(spark.read.csv(path, header=True, sep=sep))


def edge_rows(frame: DataFrame, group_id) -> DataFrame:
    """Network rows into edge records with a 0-1 score."""
    group = group_id if not isinstance(group_id, int) else F.lit(group_id)
    return frame.select(
        F.col("stringId_A").alias("src"), F.col("stringId_B").alias("dst"),
        F.col("preferredName_A").alias("src_name"), F.col("preferredName_B").alias("dst_name"),
        group.cast("bigint").alias("group_id"), normalize_score("score").alias("score"))


# --- identifier map ------------------------------------------------------------

def read_identifier_map(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated map; an error body raises, an empty body gives an empty frame."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    if not first:
        return spark.createDataFrame([], S.ID_MAP)
    if first[0][0].strip().lower().startswith("error"):
        raise ValueError(f"service error: {first[0][0][:300]}")
    if "queryItem" not in first[0][0].split("\t"):
        raise ValueError("queryItem column missing")
    return spark.read.csv(path, sep="\t", header=True, schema=S.ID_MAP, mode="FAILFAST", enforceSchema=False)


def best_identifier(mapped: DataFrame, order: list[str]) -> DataFrame:
    """First hit per query."""
    return first_per_key(mapped, ["queryItem"], order)


def unresolved(symbols: DataFrame, mapped: DataFrame) -> DataFrame:
    keys = mapped.select(F.upper("queryItem").alias("_k")).distinct()
    return symbols.join(keys, F.upper("symbol") == F.col("_k"), "left_anti")


# --- seeds ------------------------------------------------------------------------

def seed_table(spark: SparkSession) -> DataFrame:
    """The stated seed symbols as rows."""
    rows = [(g, s, role, i) for g, roles in K.SEED_SYMBOLS.items()
            for i, (role, s) in enumerate((r, s) for r in ("a", "b") for s in roles[r])]
    return spark.createDataFrame(rows, S.SEED)


def unique_symbols(seeds: DataFrame) -> DataFrame:
    """Symbols per group, first spelling wins, case ignored."""
    return (seeds.withColumn("_k", F.upper("symbol")).groupBy("group_id", "_k")
            .agg(F.min_by("symbol", "pos").alias("symbol"), F.min("pos").alias("pos")).drop("_k"))


# --- nested sequence json ------------------------------------------------------------

def sequence_rows(entries: DataFrame) -> DataFrame:
    """Nested entries into ``gene, accession, sequence``; incomplete entries are dropped."""
    gene = F.get(F.col("genes"), F.lit(0))["geneName"]["value"]
    flat = entries.select(gene.alias("gene"), F.col("primaryAccession").alias("accession"),
                          F.col("sequence.value").alias("sequence"),
                          *[c for c in entries.columns if c not in ("genes", "primaryAccession", "sequence")])
    return flat.filter((F.length("gene") > 0) & F.col("accession").isNotNull() & (F.length("sequence") > 0))


def read_sequence_json(spark: SparkSession, path: str) -> DataFrame:
    return sequence_rows(spark.read.schema(S.SEQUENCE_JSON).json(path))


# --- locations -------------------------------------------------------------------------

_LOCATION_HEADERS = {
    "Entry": "accession",
    "Subcellular location [CC]": "location",
    "Gene Ontology (cellular component)": "component",
    "uniprot_accession": "accession",
    "subcellular_location": "location",
    "go_cc": "component",
}


def location_rows(frame: DataFrame) -> DataFrame:
    """Rename vendor headers; headers that are unknown are taken by position."""
    known = {c: _LOCATION_HEADERS[c] for c in frame.columns if c in _LOCATION_HEADERS}
    if "accession" not in known.values():
        known = dict(zip(frame.columns, ("accession", "location", "component")))
    out = frame.withColumnsRenamed(known)
    for c in ("location", "component"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select("accession", "location", "component")


def read_locations(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return location_rows(spark.read.csv(paths, sep="\t", header=True))


# --- nodes, edges, features, sinks ------------------------------------------------------

def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=S.NODE, header=True)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=S.EDGE, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    """Flat sink; array columns become ';'-joined text."""
    flat = [F.array_join(f.name, ";").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
            for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def write_features(features: DataFrame, path: str) -> None:
    write_proved(features.select("node_id", F.col("vector").cast("array<float>").alias("vector")), path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Vectors as they were written; ``BrokenTable`` where files are lost or changed."""
    return read_proved(spark, path, S.FEATURE)


def write_splits(split: DataFrame, path: str) -> None:
    """Frozen splits, replayable by protocol and seed through partition pruning."""
    write_proved(split, path, partition_by=("protocol", "seed"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Splits are replayed only if their digest agrees with what was frozen."""
    return read_proved(spark, path)


def write_summary(df: DataFrame, path: str) -> None:
    """Summary rows as JSON lines."""
    df.write.mode("overwrite").json(path)
