"""Scans of the two curated catalogs into flat hit records."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import constants as K
from edgeloom.functions.identifiers import accessions, pair_high, pair_low, resolve_headers, taxon, whole_number
from edgeloom.schema import HIT_COLUMNS
from edgeloom.session import materialize


def _cell(parts: Column, index: int | Column) -> Column:
    """Cell text, or null when the row is too short or the column is absent (null index)."""
    return F.get(parts, index if isinstance(index, Column) else F.lit(index))


def _inside_pairs(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Explode both id lists, keep ids of the node universe, drop self pairs, order each pair.

    The left id is filtered before the right list is opened, so a record never widens to
    pairs with an id that is not wanted on the left.  explode_outer rather than explode: the plain
    form makes Catalyst copy the whole cell parse into a size filter at the scan.
    """
    universe = wanted.select("accession").distinct()
    left = (records.withColumn("_a", F.explode_outer("ids_a")).drop("ids_a")
            .join(universe.withColumnRenamed("accession", "_a"), "_a", "left_semi"))
    both = (left.withColumn("_b", F.explode_outer("ids_b")).drop("ids_b").filter(F.col("_a") != F.col("_b"))
            .join(universe.withColumnRenamed("accession", "_b"), "_b", "left_semi"))
    return (both.withColumn("acc_a", pair_low("_a", "_b")).withColumn("acc_b", pair_high("_a", "_b"))
            .select(*HIT_COLUMNS))


def _cells(lines: DataFrame) -> DataFrame:
    return lines.select(F.split("value", "\t", -1).alias("p"))


def _usable(p: Column, needed: int | Column) -> Column:
    """A comment line or a short row gives no ids and hence no pairs (blank lines are short rows).

    The test sits in the projection, not in a filter, so that the split is evaluated once per line.
    """
    return (F.size(p) >= needed) & ~F.get(p, F.lit(0)).startswith("#")


FIELDS_A = ("sa", "sb", "ta", "tb", "system", "type", "pub", "through", "oa", "ob")


def _places(header: list[str]) -> tuple[dict[str, int | None], int]:
    """Position of every field of catalog A (None: absent), and how many cells a usable row has."""
    at = resolve_headers(header, K.CATALOG_A_HEADERS, optional=("ta", "tb", "through", "oa", "ob"))
    for one, other in (("ta", "tb"), ("oa", "ob")):     # a pair of columns counts only when complete
        if at[one] is None or at[other] is None:
            at[one] = at[other] = None
    return at, max(at[k] for k in ("sa", "sb", "system", "type", "pub")) + 1


def parse_catalog_a(lines: DataFrame, header: list[str], wanted: DataFrame, *, kind: str | None = None) -> DataFrame:
    """Catalog A: tab-separated with a header; short rows are dropped, some columns are optional.

    With ``kind`` only records of that type (case and outer blanks do not count) come back.  A filter on the records would be moved down to the lines and make
    them anew for every test in it; this one is part of the parse.
    """
    at, needed = _places(header)
    return _records_a(_cells(lines), {k: F.lit(at[k]).cast("int") for k in FIELDS_A}, F.lit(needed), wanted, kind=kind)


def _records_a(rows: DataFrame, at: dict[str, Column], needed: Column, wanted: DataFrame, *, kind: str | None = None) -> DataFrame:
    """Hit records of rows of cells ``p``; ``at`` gives the place of each field, which may differ from row to row."""
    p = F.col("p")

    def ids(main, second):
        found = F.array_union(accessions(_cell(p, at[main])), accessions(_cell(p, at[second])))
        usable = _usable(p, needed)
        return F.when(usable if kind is None else usable & (F.lower(F.trim(_cell(p, at["type"]))) == kind), found)

    records = rows.select(
        ids("sa", "ta").alias("ids_a"), ids("sb", "tb").alias("ids_b"),
        F.lit("a").alias("source"),
        _cell(p, at["system"]).alias("system"), _cell(p, at["type"]).alias("system_type"),
        F.lit("").alias("interaction_type"), F.lit("").alias("detection_method"),
        _cell(p, at["pub"]).alias("publication"),
        F.coalesce(_cell(p, at["through"]), F.lit("")).alias("throughput"),
        whole_number(F.trim(_cell(p, at["oa"]))).alias("taxon_a"),
        whole_number(F.trim(_cell(p, at["ob"]))).alias("taxon_b"),
    )
    return _inside_pairs(records, wanted)


def parse_catalog_b(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Catalog B: headerless, at least 12 cells; ids in cells 0, 2 and 1, 3.

    A row with a known taxon outside the allowed set gives nothing; an unknown taxon passes.
    """
    rows, p = _cells(lines), F.col("p")
    cell = lambda i: _cell(p, i)                             # noqa: E731
    rows = rows.select("p", taxon(cell(9)).alias("taxon_a"), taxon(cell(10)).alias("taxon_b"))
    full = _usable(p, 12)
    for t in ("taxon_a", "taxon_b"):
        full = full & F.coalesce(F.col(t).isin(*K.ALLOWED_TAXA), F.lit(True))
    records = rows.select(
        F.when(full, F.array_union(accessions(cell(0)), accessions(cell(2)))).alias("ids_a"),
        F.when(full, F.array_union(accessions(cell(1)), accessions(cell(3)))).alias("ids_b"),
        F.lit("b").alias("source"), F.lit("").alias("system"), F.lit("").alias("system_type"),
        cell(11).alias("interaction_type"), cell(6).alias("detection_method"), cell(8).alias("publication"),
        F.lit("").alias("throughput"), "taxon_a", "taxon_b",
    )
    return _inside_pairs(records, wanted)


def file_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, header``: the first line of every file that has one, from one scan of them all.

    Only a file's first block holds its first line, and rows of a block are numbered in file order.
    """
    first = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                          F.monotonically_increasing_id().alias("place"))
    return first.filter(F.col("start") == 0).groupBy("file").agg(F.min_by("value", "place").alias("header"))


def read_catalog_a(spark: SparkSession, paths: list[str], wanted: DataFrame) -> DataFrame:
    """Scan files that each have their own header row, whatever the number of files and headers, as one plan.

    The driver sees the different headers only, one row each; every row finds the places of its fields by its file.  A header without a
    needed column is an error before any row is read; a line equal to its file's header is no record.
    """
    headers = materialize(file_headers(spark, paths))
    kinds = [r["header"] for r in headers.select("header").distinct().orderBy("header").collect()]      # spellings of a header: a few
    if not kinds:
        raise ValueError("no catalog content")
    if len(kinds) == 1:
        return parse_catalog_a(spark.read.text(paths).filter(F.col("value") != kinds[0]), kinds[0].split("\t"), wanted)
    known = []
    for header in kinds:
        at, needed = _places(header.split("\t"))
        known.append((header, *(at[k] for k in FIELDS_A), needed))
    places = spark.createDataFrame(known, "header string, " + ", ".join(f"{k} int" for k in FIELDS_A) + ", needed int")
    placed = headers.join(places, "header")
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    rows = lines.join(placed, "file").filter(F.col("value") != F.col("header")).withColumn("p", F.split("value", "\t", -1))
    return _records_a(rows, {k: F.col(k) for k in FIELDS_A}, F.col("needed"), wanted)


def read_catalog_b(spark: SparkSession, paths: list[str] | str, wanted: DataFrame) -> DataFrame:
    return parse_catalog_b(spark.read.text(paths), wanted)
