"""Document fingerprints, in DataFrame functions only.

SimHash: the terms of a text are its words, each together with the word after it.  Each occurrence adds one vote for every bit of the
term's 64-bit hash, so a term weighs as often as it stands; a bit of the fingerprint is one when more than half of the
votes are.  Two 32-bit counters share one long, so 32 sums count all 64 bits.  Permuted block tables find all fingerprints within a Hamming
radius: of ``radius + 1`` blocks of bits, two fingerprints within the radius agree in at least one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import id_text, shuffle_width

_LANES = 0x0000000100000001


def fingerprint_texts(rows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row for each value of ``keys`` (which tell the rows apart) with ``fingerprint``, a bigint; no terms: the term of the empty text.

    Rows already partitioned by a key are not shuffled again.
    """
    words = F.split(text_col, " ")
    after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    terms = rows.select(*keys, F.inline(F.arrays_zip(words.alias("w"), after.alias("a"))).alias("w", "a"))
    h = F.xxhash64("w", "a")
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_LANES))).alias(f"v{i}") for i in range(32)]
    votes = terms.select(*keys, h.alias("h")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    bits = F.lit(0).cast("bigint")
    for i in range(32):
        low = F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"v{i}", 32)
        for place, votes_for in ((i, low), (32 + i, high)):
            bits = bits.bitwiseOR(F.when(votes_for * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("bigint"), place)).otherwise(F.lit(0).cast("bigint")))
    return votes.select(*keys, bits.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def as_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows dealt to consecutive id ranges, each range with a copy of the row that follows it; one shuffle, no global sort.

    Adds ``bucket``, ``ghost`` (the copy) and ``last`` (a copy of the first row, after the last range).  Range bounds are ids that occur.
    """
    found = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 10000).alias("b"),
                     F.min("doc_id").alias("low")).first()
    bounds = sorted({int(b) for b in (found["b"] or [])} - {found["low"]})
    n = len(bounds) + 1
    starts = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    own = F.when(F.col("doc_id").isNull(), F.lit(n - 1)).otherwise(F.size(F.filter(starts, lambda b: b <= F.col("doc_id"))))
    begins = F.array_contains(starts, F.col("doc_id")) & F.col("doc_id").isNotNull()
    first = F.col("doc_id").eqNullSafe(F.lit(found["low"])) if found["low"] is not None else F.lit(True)

    def place(bucket, ghost, last):
        return F.struct(bucket.cast("int").alias("bucket"), F.lit(ghost).alias("ghost"), F.lit(last).alias("last"))

    places = F.array_compact(F.array(place(own, False, False), F.when(begins, place(own - 1, True, False)), F.when(first, place(F.lit(n - 1), True, True))))
    return docs.select("*", F.inline(places))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and both likenesses.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next document: ascending id, rows
    with equal ids by text, rows without id last; after the last comes the first.  A null text is empty; a table of one row is its own
    next.  Every row is returned.  Equal texts have equal fingerprints.
    """
    placed = in_order(id_text(docs), shuffle_width(docs.sparkSession, 3))
    w = Window.partitionBy("bucket").orderBy("last", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text", "ghost")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = placed.select("bucket", "ghost", "last", "doc_id", "text", F.row_number().over(w).alias("place"), F.lead("text").over(w).alias("next"))
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next", F.lit(1), half))
    rows = rows.select("bucket", "ghost", "place", "doc_id", n.cast("bigint").alias("n_chars"), "text", F.when(~F.col("ghost"), edited).alias("edited"))
    texts = F.filter(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"))),
                     lambda x: x["text"].isNotNull())
    keys = ["bucket", "place", "ghost", "doc_id", "n_chars", "sha", "kind"]
    both = rows.select("bucket", "place", "ghost", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.inline(texts))
    prints = fingerprint_texts(both, keys)
    one = prints.groupBy(*keys[:-1]).agg(F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("own"),
                                         F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("changed"))
    following = F.lead("own").over(Window.partitionBy("bucket").orderBy("place"))
    return one.withColumn("following", following).filter(~F.col("ghost")).select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), as_hex(F.col("own")).alias("fingerprint"), as_hex(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))


def block_keys(bits: Column, radius: int) -> Column:
    """Array of ``(table, key)``: the fingerprint's bits in each of ``radius + 1`` blocks."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    keys = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        mask = (1 << (b - a)) - 1
        part = F.shiftrightunsigned(bits, a)
        keys.append(F.struct(F.lit(i).alias("table"), (part if mask >> 63 else part.bitwiseAND(F.lit(mask))).alias("key")))
    return F.array(*keys)


def within_radius(wanted: DataFrame, prints: DataFrame, radius: int = 3) -> DataFrame:
    """``fingerprint, found, distance``: for each distinct wanted fingerprint all distinct other ones within ``radius``.

    Both inputs have a bigint column ``fingerprint``; nulls take no part, equal rows count once.  Each table is a join on one block; a pair
    that agrees in several blocks is reported by the first of them.
    """
    left = wanted.select("fingerprint").dropna().distinct()
    right = prints.select(F.col("fingerprint").alias("found")).dropna().distinct()
    l = left.select("fingerprint", F.inline(block_keys(F.col("fingerprint"), radius)))
    r = right.select("found", F.inline(block_keys(F.col("found"), radius)))
    pair = l.join(r, ["table", "key"]).filter(F.col("fingerprint") != F.col("found"))
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("found")))
    pair = pair.withColumn("distance", distance).filter(F.col("distance") <= radius)
    both = F.zip_with(block_keys(F.col("fingerprint"), radius), block_keys(F.col("found"), radius), lambda x, y: x["key"] == y["key"])
    return pair.filter(F.array_position(both, True) == F.col("table") + 1).select("fingerprint", "found", "distance")
