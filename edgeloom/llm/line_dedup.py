"""Line de-duplication by a sharded minimal perfect hash.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.  All distinct key hashes (128 bits: one
word picks shard and slot, the other is the stored fingerprint) are indexed: a shard holds a minimal perfect hash and, slot by
slot, arrays of fingerprints, document counts and the smallest holding id.  Documents do not join lines: blocks of documents send each
different hash they hold once to its shard, the shard probes its arrays, and only hashes of repeated lines come back.

A line that everybody repeats costs a shard one row per block, not one per document: counts are pre-aggregated, probes are distinct.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import column_of, chunks, id_text, shuffle_width, texts_of
from edgeloom.session import materialize

MIN_CHARS = 10
SHARD_KEYS = 30_000         # wanted distinct lines of an index shard
BLOCK_BYTES = 4 << 20       # wanted text of a block of documents
_SPACE = b" \t\n\x0b\x0c\r"
_NO_ID = (1 << 63) - 1      # a null id counts as one document after all others
_U = np.uint64


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least)


def key_hashes(text: str, least: int = MIN_CHARS) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and for each its 16 hash bytes, or None where the key is too short to count."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    keys = map(line_key, lines)
    return lines, [xxhash.xxh3_128_digest(k) if _long_enough(k, least) else None for k in keys]


def _scramble(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h + _U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(31))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(29))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bit arrays; a key's slot is the rank of its bit.

    At each level keys that meet no other get their bit, the rest go on with the next level; a handful left after
    the last level are kept in a sorted list.
    """

    LEVELS, GAMMA = 24, 2.0

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, base = [], 0
        for bits in levels:
            ones = np.unpackbits(bits)
            self.ranks.append((ones, base + np.cumsum(ones) - ones))
            base += int(ones.sum())
        self.base = base

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        levels, left = [], keys
        while len(left) and len(levels) < cls.LEVELS:
            size = int(max(64, cls.GAMMA * len(left)) + 7) // 8 * 8
            at = (_scramble(left, len(levels)) % _U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone))
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1, or any slot, for a key that is not in the set."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (ones, rank) in enumerate(self.ranks):
            if not len(open_):
                return out
            at = (_scramble(keys[open_], level) % _U(len(ones))).astype(np.int64)
            hit = ones[at] == 1
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            i = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[i] == keys[open_]
            out[open_[same]] = self.base + i[same]
        return out

    def dump(self) -> list[bytes]:
        return [b.tobytes() for b in self.levels] + [self.rest.tobytes()]

    @classmethod
    def load(cls, parts: list[bytes]) -> "PerfectHash":
        return cls([np.frombuffer(p, np.uint8) for p in parts[:-1]], np.frombuffer(parts[-1], _U))


def _u64(column) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False).view(_U)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def line_rows(blocks: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """``block, hi, lo, doc_id``: the different counted lines of each document of ``(block, doc_id, text)``."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            digests, counts = [], []
            for t in texts_of(part):
                own = {h for h in key_hashes(t, least)[1] if h}
                digests.append(b"".join(own))
                counts.append(len(own))
            h = np.frombuffer(b"".join(digests), ">u8").astype(_U).reshape(-1, 2)
            take = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([column_of(part, "block").take(take), _long(h[:, 0].copy()), _long(h[:, 1].copy()),
                                              column_of(part, "doc_id").take(take)], ["block", "hi", "lo", "doc_id"])

    return blocks.mapInArrow(run, "block int, hi bigint, lo bigint, doc_id bigint")


def build_index(held: DataFrame, shards: int) -> DataFrame:
    """One row a shard: minimal perfect hash, and arrays of fingerprints, document counts and smallest ids by slot.

    ``held`` is ``(shard, hi, lo, docs, first)``, one row for each distinct hash.
    """
    def build(group: pa.Table) -> pa.Table:
        hi, lo = _u64(group.column("hi")), _u64(group.column("lo"))
        key = np.unique(hi)
        mph = PerfectHash.build(key)
        # distinct lines that agree in the first word share a slot; the rows of a slot are a short run
        slot = mph.slots(hi)
        order = np.lexsort((lo, slot))
        run = np.concatenate(([0], np.cumsum(np.bincount(slot, minlength=len(key))))).astype("<i4")
        docs = group.column("docs").combine_chunks().to_numpy()[order]
        return pa.table({"shard": group.column("shard")[:1], "hash": pa.array([mph.dump()], pa.list_(pa.binary())), "run": pa.array([run.tobytes()], pa.binary()),
                         "print": pa.array([lo[order].tobytes()], pa.binary()), "docs": pa.array([np.minimum(docs, 2 ** 31 - 1).astype("<i4").tobytes()], pa.binary()),
                         "first": pa.array([group.column("first").combine_chunks().to_numpy()[order].astype("<i8").tobytes()], pa.binary())})

    return held.groupBy("shard").applyInArrow(build, "shard int, hash array<binary>, run binary, print binary, docs binary, first binary")


def probe(index_row: dict, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(documents, smallest id)`` of each hash; 0 documents for a hash that is not indexed."""
    mph = PerfectHash.load(index_row["hash"])
    run, prints = np.frombuffer(index_row["run"], "<i4"), np.frombuffer(index_row["print"], "<u8")
    docs, first = np.frombuffer(index_row["docs"], "<i4"), np.frombuffer(index_row["first"], "<i8")
    slot = mph.slots(hi)
    n, low = np.zeros(len(hi), np.int64), np.zeros(len(hi), np.int64)
    known = np.flatnonzero(slot >= 0)
    at, end = run[slot[known]].astype(np.int64), run[slot[known] + 1]
    while len(known):
        same = (at < end) & (prints[np.minimum(at, len(prints) - 1)] == lo[known])
        n[known[same]], low[known[same]] = docs[at[same]], first[at[same]]
        more = ~same & (at + 1 < end)
        known, at, end = known[more], at[more] + 1, end[more]
    return n, low


def _in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """Documents dealt by id; rows without one by their text."""
    return docs.withColumn("block", F.pmod(F.coalesce(F.xxhash64("doc_id", F.lit(1)), F.xxhash64("text")), F.lit(blocks)).cast("int"))


def repeated(docs: DataFrame, blocks: int, least: int = MIN_CHARS) -> DataFrame:
    """``block, hi, lo, first``: hashes of lines held by two documents or more, for each block that holds them."""
    spark = docs.sparkSession
    rows = materialize(line_rows(_in_blocks(docs, blocks), least).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))
                       .groupBy("block", "hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                                                         F.count_distinct("doc_id").alias("docs")))
    shards = max(shuffle_width(spark), -(-rows.count() // SHARD_KEYS))
    shard = F.pmod(F.xxhash64("hi"), F.lit(shards)).cast("int").alias("shard")
    # an id lies in one block only, so the counts of blocks add up
    held = rows.groupBy("hi", "lo").agg(F.sum("docs").alias("docs"), F.min("first").alias("first")).select(shard, "hi", "lo", "docs", "first")
    index = materialize(build_index(held, shards))

    def ask(asked: pa.Table, shard_rows: pa.Table) -> pa.Table:
        n, first = np.zeros(asked.num_rows, np.int64), np.zeros(asked.num_rows, np.int64)
        for row in shard_rows.to_pylist():
            n, first = probe(row, _u64(asked.column("hi")), _u64(asked.column("lo")))
        hit = pa.array(n >= 2)
        return asked.select(["block", "hi", "lo"]).append_column("first", pa.array(first)).filter(hit)

    asked = rows.select(shard, "block", "hi", "lo")
    return asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(ask, "block int, hi bigint, lo bigint, first bigint")


def _answers(group: pa.Table) -> dict[bytes, int]:
    pairs = np.column_stack((_u64(group.column("hi")), _u64(group.column("lo")))).astype(">u8")
    return {p.tobytes(): f for p, f in zip(pairs, group.column("first").to_pylist())}


def _kept(text: str, doc_id: int | None, first: dict[bytes, int], least: int) -> tuple[int, int, bytes]:
    lines, hashes = key_hashes(text, least)
    own = _NO_ID if doc_id is None else doc_id
    kept = [line for line, h in zip(lines, hashes) if h is None or first.get(h, own) == own]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _block_count(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_width(docs.sparkSession), -(-total // BLOCK_BYTES))


def line_report(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row.

    A null or empty text has one empty line, which stays.  Rows with one id are one document: their lines stay or go together.  Rows without an id
    are one document after all others.  Keys shorter than ``least`` code points always stay.
    """
    own = id_text(docs)
    blocks = _block_count(own)

    def judge(group: pa.Table, answers: pa.Table) -> pa.Table:
        first, out = _answers(answers), []
        for doc, t in zip(group.column("doc_id").to_pylist(), group.column("text").to_pylist()):
            n, dropped, kept = _kept(t, doc, first, least)
            out.append((doc, n, dropped, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out)) or [[], [], [], []]
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "n_lines": pa.array(cols[1], pa.int64()), "n_dropped": pa.array(cols[2], pa.int64()),
                         "kept_sha256": pa.array(cols[3], pa.string())})

    answers = repeated(own, blocks, least)
    return (_in_blocks(own, blocks).groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(judge, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string"))


def drop_repeated_lines(docs: DataFrame, least: int = MIN_CHARS, length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` (``doc_id``, ``text`` and any others); the text has its kept lines, a null text stays null."""
    own = id_text(docs)
    blocks = _block_count(own)
    answers = repeated(own, blocks, least)
    extra = {"__block": F.pmod(F.coalesce(F.xxhash64(docs["doc_id"].cast("bigint"), F.lit(1)), F.xxhash64(F.coalesce(docs["text"], F.lit("")))), F.lit(blocks)).cast("int")}
    at = docs.columns.index("text")

    def judge(group: pa.Table, own_answers: pa.Table) -> pa.Table:
        first = _answers(own_answers)
        new = [None if t is None else _kept(t, d, first, least)[2].decode("utf-8", "surrogatepass")
               for d, t in zip(group.column("doc_id").to_pylist(), group.column("text").to_pylist())]
        return group.set_column(at, "text", pa.array(new, pa.string())).drop_columns(["__block"])

    out = (docs.withColumns(extra).groupBy("__block").cogroup(answers.groupBy("block")).applyInArrow(judge, docs.schema))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema[length_col].dataType))
    return out
