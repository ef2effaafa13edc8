"""Substring de-duplication by content-defined anchors and exact windows.

A passage is a stretch of ``MIN_RUN`` whole words or more, byte for byte, that a document of smaller id holds too.  Its windows of ``MIN_RUN`` words are compared by a
128-bit digest, so borders are those of the passage.  Not every window of the corpus is shipped: a gear rolling hash over the bytes (it sees the last 32 bytes
only) picks one anchor in each window, the run of half as many words with the least hash at its end.  Neighbouring windows of one anchor are a block, about 13 windows.
Equal windows pick equal anchors, so a window that repeats has an anchor that repeats.  Where all blocks of an anchor are equal, the block stands for its windows;
where they differ, each different block is digested window by window, once.  No repeated window is lost, whatever its neighbourhood.

An anchor, block or window that a third of all documents hold costs the joins many rows of one key: the other side has one row a key, so Spark's skew join
can split it.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import chunks, column_of, id_text, texts_of
from edgeloom.session import materialize

LEAST, MOST, CUT_BITS = 16, 128, 5          # bytes of a chunk; one position in 2^CUT_BITS is a cut
MIN_RUN = 50                # whole words from which a repeated stretch is a passage
_NO_ID = (1 << 63) - 1      # a null id comes after all others
_GEAR = np.random.default_rng(41).integers(0, 1 << 32, 256, dtype=np.uint32)
_VALUE = np.random.default_rng(43).integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte: the sum of the last 32 bytes' gear values, each shifted by its distance."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        moved = np.zeros_like(h)
        moved[k:] = h[:-k] << np.uint32(k)
        h = h + moved
    return h


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks: at a cut of the hash, no chunk under LEAST (but the last) or over MOST bytes; never inside a character."""
    if not data:
        return []
    raw = np.frombuffer(data, np.uint8)
    # bits 16 to 20 depend on the last 17 to 21 bytes
    marks = np.flatnonzero((gear(raw) >> np.uint32(16)) & np.uint32((1 << CUT_BITS) - 1) == 0) + 1
    ends, start, n = [], 0, len(data)
    for m in [*marks.tolist(), n]:
        while m - start > MOST:
            end = start + MOST
            while end < n and data[end] & 0xC0 == 0x80:
                end += 1
            ends.append(end)
            start = end
        if m - start >= LEAST or m == n and m > start:
            while m < n and data[m] & 0xC0 == 0x80:
                m += 1
            ends.append(m)
            start = m
    return ends


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; words end at space, tab, line feed, vertical tab, form feed, return and zero."""
    space = np.concatenate(([True], (raw == 32) | ((raw >= 9) & (raw <= 13)) | (raw == 0), [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def _powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n of ``base``, modulo 2^64."""
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)


def anchors_of(data: list[bytes], n: int) -> tuple[list[np.ndarray], ...]:
    """Of each text: starts and ends of its words in bytes; first window, number of windows and anchor key of each block of windows of ``n`` words."""
    part = max(1, n // 2)                       # words of an anchor
    # a zero byte between texts; zeros inside one end words here as well, as in every other text
    raw = np.frombuffer(b"\0".join(data) + b"\0", np.uint8)
    first, last = _words(raw)
    sizes = np.array([len(d) + 1 for d in data], np.int64)
    begin = np.cumsum(sizes) - sizes
    cut = np.searchsorted(first, np.concatenate((begin, [len(raw)])))
    empty = np.empty(0, np.int64)
    starts = [first[a:b] - o for a, b, o in zip(cut, cut[1:], begin)]
    ends = [last[a:b] - o for a, b, o in zip(cut, cut[1:], begin)]
    if len(first) < n:
        return starts, ends, [empty] * len(data), [empty] * len(data), [empty] * len(data)
    up, down = _powers(_BASE, len(raw)), _powers(pow(_BASE, -1, 1 << 64), len(raw))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[raw] * up[:-1], dtype=np.uint64)))
    a, b = first[:len(first) - part + 1], last[part - 1:]
    key = (total[b] - total[a]) * down[a]
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(32)
    mark = gear(raw)[b - 1]
    short = b - a < 32                          # the rolling hash would look at what stands before the anchor
    mark[short] = (key[short] >> np.uint64(32)).astype(np.uint32)
    at = np.lib.stride_tricks.sliding_window_view(mark, n - part + 1).argmin(axis=1)
    at += np.arange(len(at))
    seqs, counts, keys = [], [], []
    for i, j in zip(cut, cut[1:]):
        own = at[i:max(i, j - n + 1)]
        seqs.append(np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))[:len(own)]))
        counts.append(np.diff(seqs[-1], append=len(own)))
        keys.append(key[own[seqs[-1]]].view(np.int64))
    return starts, ends, seqs, counts, keys


def _word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    return _words(np.frombuffer(raw, np.uint8))


def _positions(raw: bytes) -> np.ndarray:
    """Code points before each byte."""
    return np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))


def _digests(raw: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """128 bits of each stretch, as two signed numbers."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(a.tolist(), b.tolist())), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)


def _identified(docs: DataFrame) -> DataFrame:
    return id_text(docs).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("row"))


def block_rows(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, row, seq, size, start, end, key, hi, lo``: the blocks of every row (first window, windows, code points, anchor, digest); ``row`` tells
    rows with one id apart."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            data = [t.encode("utf-8", "surrogatepass") for t in texts_of(part)]
            take, cols = [], [[] for _ in range(7)]
            for i, (raw, begin, stop, seq, size, key) in enumerate(zip(data, *anchors_of(data, n))):
                if len(seq):
                    chars, a, b = _positions(raw), begin[seq], stop[seq + size + n - 2]
                    take.append(np.full(len(seq), i))
                    for col, own in zip(cols, (seq, size, chars[a], chars[b], key, *_digests(raw, a, b).T)):
                        col.append(own)
            if take:
                at = pa.array(np.concatenate(take), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [column_of(part, "doc_id").take(at), column_of(part, "row").take(at), *[pa.array(np.concatenate(c), pa.int32()) for c in cols[:4]],
                     *[pa.array(np.concatenate(c)) for c in cols[4:]]], ["doc_id", "row", "seq", "size", "start", "end", "key", "hi", "lo"])

    return _identified(docs).mapInArrow(run, "doc_id bigint, row bigint, seq int, size int, start int, end int, key bigint, hi bigint, lo bigint")


def window_rows(marked: DataFrame, n: int) -> DataFrame:
    """``block_hi, block_lo, off, start, end, hi, lo, holder``: every window of the ``blocks`` (seq, size, hi, lo) of a row, positions counted from the block's."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            blocks = column_of(part, "blocks").to_pylist()
            for doc, t, own in zip(column_of(part, "doc_id").to_pylist(), texts_of(part), blocks):
                raw = t.encode("utf-8", "surrogatepass")
                begin, stop = _word_spans(raw)
                chars = _positions(raw)
                seq, size = (np.array([x[c] for x in own]) for c in ("seq", "size"))
                owner = np.repeat(np.arange(len(own)), size)
                off = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
                a, b = begin[seq[owner] + off], stop[seq[owner] + off + n - 1]
                zero, h = chars[begin[seq]][owner], _digests(raw, a, b)
                hi, lo = (np.array([x[c] for x in own], np.int64)[owner] for c in ("hi", "lo"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hi), pa.array(lo), pa.array(off, pa.int32()), pa.array(chars[a] - zero, pa.int32()), pa.array(chars[b] - zero, pa.int32()),
                     pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(np.full(len(off), doc))],
                    ["block_hi", "block_lo", "off", "start", "end", "hi", "lo", "holder"])

    return (marked.select("doc_id", "text", "blocks")
            .mapInArrow(run, "block_hi bigint, block_lo bigint, off int, start int, end int, hi bigint, lo bigint, holder bigint"))


def repeated_runs(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``doc_id, start, end, n_words, first_doc_ids``: passages of ``min_run`` whole words or more that documents of smaller ids hold already.

    A passage is the union of overlapping windows of ``min_run`` words; ``first_doc_ids`` are the different smallest holders of its windows.  Texts of
    fewer words have none.  Rows with one id are one document: a text does not repeat itself.  Rows without an id come after all others, and are
    one document.  Equal rows give equal passages, once.
    """
    found = materialize(block_rows(docs, min_run))
    digest = F.struct("hi", "lo")
    shared = (found.groupBy("key").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last"), (F.min(digest) == F.max(digest)).alias("alike"))
              .filter(F.col("holder") < F.col("last")).drop("last"))
    blocks = materialize(found.join(shared, "key").drop("key"))
    alike = (blocks.filter("alike").select("doc_id", "row", "seq", (F.col("seq") + F.col("size") - 1).alias("to"), "start", "end", F.col("holder").alias("first")))
    mixed = blocks.filter(~F.col("alike"))
    # each different block is taken apart once, in its smallest holder
    once = mixed.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "row", "seq", "size")).alias("at")).select("at.*", "hi", "lo")
    once = once.groupBy("doc_id", "row").agg(F.collect_list(F.struct("seq", "size", "hi", "lo")).alias("blocks"))
    windows = materialize(window_rows(_identified(docs).join(once, ["doc_id", "row"]), min_run))
    first = windows.groupBy("hi", "lo").agg(F.min("holder").alias("first"))
    b = Window.partitionBy("block_hi", "block_lo").orderBy("off")
    parts = (windows.join(first, ["hi", "lo"]).withColumn("turn", F.coalesce(F.lag("first").over(b) != F.col("first"), F.lit(True)).cast("int"))
             .withColumn("turn", F.sum("turn").over(b)).groupBy("block_hi", "block_lo", "turn")
             .agg(F.min("off").alias("off"), F.max("off").alias("off_to"), F.min("start").alias("from_start"), F.max("end").alias("from_end"), F.min("first").alias("first"))
             .drop("turn"))
    cut = (mixed.withColumnsRenamed({"hi": "block_hi", "lo": "block_lo"}).join(parts, ["block_hi", "block_lo"])
           .select("doc_id", "row", (F.col("seq") + F.col("off")).alias("seq"), (F.col("seq") + F.col("off_to")).alias("to"),
                   (F.col("start") + F.col("from_start")).alias("start"), (F.col("start") + F.col("from_end")).alias("end"), "first"))
    again = alike.union(cut).filter(F.col("first") < F.col("doc_id")).distinct()
    w = Window.partitionBy("doc_id", "row").orderBy("seq")
    fresh = F.coalesce(F.col("seq") - F.lag("to").over(w) >= min_run, F.lit(True)).cast("int")
    runs = (again.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w)).groupBy("doc_id", "row", "run")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("to") - F.min("seq") + min_run).cast("bigint").alias("n_words"),
                 F.array_sort(F.collect_set("first")).alias("first_doc_ids")))
    return runs.select(F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), F.col("start").cast("bigint").alias("start"),
                       F.col("end").cast("bigint").alias("end"), "n_words", "first_doc_ids", "row")


def drop_repeated(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """All rows and columns of ``docs`` (``doc_id``, ``text`` and any others), the text without its repeated passages."""
    runs = repeated_runs(docs, min_run).groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__gone"))
    spans = docs.join(runs, docs["doc_id"].cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__row")), "left")
    begins = F.concat(F.array(F.lit(1).cast("bigint")), F.transform("__gone", lambda s: s["end"] + 1))
    stops = F.concat(F.transform("__gone", lambda s: s["start"]), F.array(F.length("text").cast("bigint")))
    kept = F.array_join(F.zip_with(begins, stops, lambda a, b: F.substring("text", a.cast("int"), (b - a + 1).cast("int"))), "")
    return spans.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
