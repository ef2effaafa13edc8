"""Phrase collocations counted in quotient filters.

1. Tasks turn texts into chunks: the distinct words of a language with their counts, and the text as numbers into that list.  Chunks are written once.
2. Words found often enough get numbers, dense over all languages, so a phrase of numbers belongs to one language.
3. Each chunk gets the numbers of its words (one row a word and chunk, however often it occurs).  Its phrases of 2 to 4 words, packed into two
   integers, go through an invertible permutation; the first integer's high bits are the quotient, all other bits the remainder.  A filter keeps, sorted,
   how many entries each quotient has, whole remainders, and counters: no key is lost or confused, and no quotient is stored.
4. Filters are cut at quotients into shards, and the sorted parts of a shard are merged.  Permuted keys spread evenly, and a phrase costs a filter one
   entry however often it occurs, so shards are of bounded size.  Phrases counted often enough leave the merge, permuted back.
5. What is left, at most a thirtieth of the text, is joined: cuts, scores, longer phrases, best rows per language.

A phrase with a rarer word cannot be frequent itself, so rarer words break phrases and get no number.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import chunks, column_of, texts_of
from edgeloom.operators.ranking import global_rank, top_n
from edgeloom.session import materialize

LONGEST = 4                             # words of a phrase
CHUNK_WORDS = 400_000                   # words of a chunk; a single longer text is its own chunk
FILTER_ENTRIES = 1_500_000              # entries a task holds before it writes its filters
SHARD_ENTRIES = 3_000_000               # phrase occurrences a shard is laid out for
_U = np.uint64
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
_TO_PLAIN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


# ---------------------------------------------------------------- chunks
class _Chunk:
    """Texts of one language: distinct words, their counts, and the words in order (0: end of a piece)."""

    def __init__(self):
        self.number: dict[bytes, int] = {b"": 0, b"\n": 1}
        self.parts: list[np.ndarray] = []
        self.words = 0

    def add(self, text: str) -> None:
        number = self.number
        found = (text.encode().translate(_TO_PLAIN).replace(b"\n", b" \n ") + b" \n").split(b" ")
        codes = np.fromiter([number.setdefault(w, len(number)) for w in found], np.int32, len(found))
        codes = codes[codes > 0] - 1
        self.parts.append(codes)
        self.words += len(codes)

    def row(self) -> tuple[list[bytes], list[int], bytes]:
        codes = np.concatenate(self.parts)
        counts = np.bincount(codes, minlength=len(self.number) - 1)[1:]
        return list(self.number)[2:], counts.tolist(), zlib.compress(codes.astype("<i4").tobytes(), 1)


def read_chunks(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``chunk, lang, words, counts, codes`` of all texts, written once; null texts are empty, a null language is ``und``."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        task, serial, waiting = TaskContext.get().partitionId(), 0, 0
        held: dict[str, _Chunk] = {}

        def flush():
            nonlocal serial, waiting
            for lang, chunk in held.items():
                if chunk.words:
                    words, counts, codes = chunk.row()
                    columns = [pa.array([task << 32 | serial], pa.int64()), pa.array([lang], pa.string()), pa.array([[w.decode() for w in words]], pa.list_(pa.string())),
                               pa.array([counts], pa.list_(pa.int64())), pa.array([codes], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["chunk", "lang", "words", "counts", "codes"])
                    serial += 1
            held.clear()
            waiting = 0

        for part in chunks(batches):
            for lang, text in zip(column_of(part, "lang").to_pylist(), texts_of(part)):
                chunk = held.get(lang)
                if chunk is None:
                    chunk = held[lang] = _Chunk()
                before = chunk.words
                chunk.add(text)
                waiting += chunk.words - before
                if waiting >= chunk_words:
                    yield from flush()
        yield from flush()

    own = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return materialize(own.mapInArrow(run, "chunk bigint, lang string, words array<string>, counts array<bigint>, codes binary"))


# ---------------------------------------------------------------- keys and filters
def _mask(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


def _stir(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(_MIX[salt])
    return x ^ (x >> _U(32))


def permute(left: np.ndarray, right: np.ndarray, left_bits: int, right_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Invertible mixing of keys of two parts: each part in turn is changed by a hash of the other."""
    for salt in (0, 2):
        right = right ^ (_stir(left, salt) >> _U(64 - right_bits))
        left = left ^ (_stir(right, salt + 1) >> _U(64 - left_bits))
    return left, right


def unpermute(left: np.ndarray, right: np.ndarray, left_bits: int, right_bits: int) -> tuple[np.ndarray, np.ndarray]:
    for salt in (2, 0):
        left = left ^ (_stir(right, salt + 1) >> _U(64 - left_bits))
        right = right ^ (_stir(left, salt) >> _U(64 - right_bits))
    return left, right


def parts_of(n: int, word_bits: int) -> tuple[int, int]:
    """Bits of the two parts of a phrase of n words."""
    return (1 if n == 2 else 2) * word_bits, (2 if n == 4 else 1) * word_bits


def pack(numbers: np.ndarray, n: int, word_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Every phrase of n neighbouring word numbers as two integers; negative numbers break phrases."""
    size = max(0, len(numbers) - n + 1)
    fine = np.ones(size, bool)
    for i in range(n):
        fine &= numbers[i:i + size] >= 0
    words = [numbers[i:i + size][fine].astype(_U) for i in range(n)]
    b = _U(word_bits)
    return (words[0] if n == 2 else words[0] << b | words[1]), (words[2] << b | words[3] if n == 4 else words[-1])


def unpack(left: np.ndarray, right: np.ndarray, n: int, word_bits: int) -> np.ndarray:
    """Word numbers, one row a phrase."""
    b, m = _U(word_bits), _mask(word_bits)
    head = [left] if n == 2 else [left >> b, left & m]
    tail = [right >> b, right & m] if n == 4 else [right]
    return np.stack(head + tail, 1).astype(np.int64)


def _gather(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None, right_bits: int, left_bits: int):
    """Sorted distinct keys and their summed counts."""
    if not len(left):
        return left, right, np.zeros(0, np.int64)
    if left_bits + right_bits <= 64:
        key = left << _U(right_bits) | right
        if counts is None:
            key = np.sort(key)
        else:
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        left, right, ends = key[starts] >> _U(right_bits), key[starts] & _mask(right_bits), len(key)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        counts = None if counts is None else counts[order]
        starts = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]))))
        ends = len(left)
        left, right = left[starts], right[starts]
    summed = np.diff(np.append(starts, ends)) if counts is None else np.add.reduceat(counts, starts)
    return left, right, summed.astype(np.int64)


class QuotientFilter:
    """Sorted distinct keys with counts, and their packed form for a range of quotients.

    ``left`` and ``right`` are permuted keys; the quotient is the highest ``q`` bits of ``left``.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray, bits: tuple[int, int]):
        self.left, self.right, self.counts, self.bits = left, right, counts, bits

    def __len__(self) -> int:
        return len(self.left)

    @classmethod
    def count(cls, left: np.ndarray, right: np.ndarray, bits: tuple[int, int]) -> "QuotientFilter":
        """Of permuted keys, repeats included."""
        return cls(*_gather(left, right, None, bits[1], bits[0]), bits)

    @classmethod
    def merge(cls, filters: list["QuotientFilter"]) -> "QuotientFilter":
        bits = filters[0].bits
        joined = [np.concatenate([getattr(f, a) for f in filters]) for a in ("left", "right", "counts")]
        return cls(*_gather(*joined, bits[1], bits[0]), bits)

    def shards(self, shard_bits: int) -> Iterator[tuple[int, bytes]]:
        """Packed parts by the highest bits of the quotient."""
        shard_bits = min(shard_bits, self.bits[0])
        shift = _U(self.bits[0] - shard_bits)
        borders = np.searchsorted(self.left, np.arange(1 << shard_bits, dtype=_U) << shift).tolist() + [len(self)]
        for s in range(1 << shard_bits):
            if borders[s] < borders[s + 1]:
                yield s, self._packed(borders[s], borders[s + 1], s, shard_bits)

    def _packed(self, start: int, end: int, shard: int, shard_bits: int) -> bytes:
        left_bits, right_bits = self.bits
        left, right, counts = self.left[start:end], self.right[start:end], self.counts[start:end]
        q = min(left_bits, shard_bits + max(0, (end - start).bit_length() - 1))
        rest = left_bits - q
        quotients = (left >> _U(rest)).astype(np.int64) - (shard << (q - shard_bits))
        per_quotient = np.bincount(quotients, minlength=1 << (q - shard_bits))
        head = np.array([end - start, q, shard, shard_bits], "<i8").tobytes()
        big = np.flatnonzero(counts >= 255)
        spill = np.stack((big, counts[big])).astype("<i8").tobytes()
        wide = np.flatnonzero(per_quotient >= 255)
        wide_spill = np.stack((wide, per_quotient[wide])).astype("<i8").tobytes()
        return b"".join((head, np.array([len(big), len(wide)], "<i8").tobytes(), spill, wide_spill, np.minimum(per_quotient, 255).astype(np.uint8).tobytes(),
                         np.minimum(counts, 255).astype(np.uint8).tobytes(), _narrow(left & _mask(rest), rest), _narrow(right, right_bits)))

    @classmethod
    def unpacked(cls, data: bytes, bits: tuple[int, int]) -> "QuotientFilter":
        left_bits, right_bits = bits
        n, q, shard, shard_bits, big, wide = np.frombuffer(data, "<i8", 6).tolist()
        at = 48
        spill = np.frombuffer(data, "<i8", 2 * big, at).reshape(2, big)
        at += 16 * big
        wide_spill = np.frombuffer(data, "<i8", 2 * wide, at).reshape(2, wide)
        at += 16 * wide
        slots = 1 << (q - shard_bits)
        per_quotient = np.frombuffer(data, np.uint8, slots, at).astype(np.int64)
        per_quotient[wide_spill[0]] = wide_spill[1]
        at += slots
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        counts[spill[0]] = spill[1]
        at += n
        rest = left_bits - q
        low, at = _widened(data, at, n, rest)
        right, at = _widened(data, at, n, right_bits)
        quotients = np.repeat(np.arange(slots), per_quotient) + (shard << (q - shard_bits))
        return cls(quotients.astype(_U) << _U(rest) | low, right, counts, bits)


def _narrow(values: np.ndarray, bits: int) -> bytes:
    """The bytes of whole remainders that can differ from zero, byte by byte of all, which packs better."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :(bits + 7) // 8].T).tobytes()


def _widened(data: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    width = (bits + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(_U), at + n * width


# ---------------------------------------------------------------- counting
def frequent_words(chunks_: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``lang, word, f, id`` of frequent words, ids dense from 0; and ``lang, n``, all word occurrences."""
    each = chunks_.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    totals = chunks_.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c).alias("c")).groupBy("lang").agg(F.sum("c").alias("n"))
    often = each.groupBy("lang", "word").agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
    return materialize(global_rank(often, [F.col("lang"), F.col("word")], name="place").select("lang", "word", "f", (F.col("place") - 1).alias("id"))), materialize(totals)


def frequent_phrases(chunks_: DataFrame, words: DataFrame, occurrences: int, least: int, *, filter_entries: int = FILTER_ENTRIES,
                     shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``phrase`` (array of word numbers), ``f`` of phrases of 2 to 4 words found ``least`` times or more."""
    vocabulary = words.count()
    word_bits = max(1, (vocabulary - 1).bit_length()) if vocabulary else 1
    if word_bits > 32:
        raise ValueError("more than 2^32 frequent words")
    shard_bits = max(0, (-(-occurrences // shard_entries) - 1).bit_length())
    named = (chunks_.select("chunk", "lang", F.posexplode("words").alias("at", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
             .groupBy("chunk").agg(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), "id")).alias("named")))
    numbered = chunks_.select("chunk", F.size("words").alias("size"), "codes").join(named, "chunk")

    def count(batches) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[QuotientFilter]] = {n: [] for n in range(2, LONGEST + 1)}

        def flush():
            for n, filters in held.items():
                rows = list(QuotientFilter.merge(filters).shards(shard_bits)) if filters else []
                filters.clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(rows), pa.int32()), pa.array([s for s, _ in rows], pa.int64()), pa.array([zlib.compress(p, 1) for _, p in rows], pa.binary())],
                                                     ["n", "shard", "part"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column_of(batch, name)[i] for name in ("size", "codes", "named")}
                pairs = row["named"].values
                numbers = np.full(row["size"].as_py() + 1, -1, np.int64)
                numbers[pairs.field("at").to_numpy() + 1] = pairs.field("id").to_numpy()
                text = numbers[np.frombuffer(zlib.decompress(row["codes"].as_py()), "<i4")]
                for n in held:
                    bits = parts_of(n, word_bits)
                    one = QuotientFilter.count(*permute(*pack(text, n, word_bits), *bits), bits)
                    if len(one):
                        held[n].append(one)
                if sum(len(f) for fs in held.values() for f in fs) >= filter_entries:
                    yield from flush()
        yield from flush()

    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        n = key[0].as_py()
        bits = parts_of(n, word_bits)
        whole = QuotientFilter.merge([QuotientFilter.unpacked(zlib.decompress(p.as_py()), bits) for p in parts.column("part")])
        often = whole.counts >= least
        phrases = unpack(*unpermute(whole.left[often], whole.right[often], *bits), n, word_bits)
        return pa.table({"phrase": pa.array(list(phrases), pa.list_(pa.int64())), "f": pa.array(whole.counts[often], pa.int64())})

    filters = numbered.mapInArrow(count, "n int, shard bigint, part binary")
    return materialize(filters.groupBy("n", "shard").applyInArrow(merge, "phrase array<bigint>, f bigint"))


# ---------------------------------------------------------------- scores
def _cuts(phrases: DataFrame) -> DataFrame:
    """``phrase, a, k, first, rest``: every way to cut a phrase in two."""
    cut = phrases.select("phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    return cut.select("phrase", "a", "k", F.slice("phrase", 1, F.col("k")).alias("first"), F.expr("slice(phrase, k + 1, size(phrase) - k)").alias("rest"))


def collocations(docs: DataFrame, *, least: int = 30, best: int = 2000, chunk_words: int = CHUNK_WORDS, filter_entries: int = FILTER_ENTRIES,
                 shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 to 4 words.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and those into words at spaces and tabs.  A phrase found
    ``a >= least`` times is scored by its worst cut into two parts found l and r times, ``floor(2000000 a / (l + r))``, ties to the shortest first part.
    Phrases that stand inside a longer one found at least four fifths as often are left out.  Null texts are empty, a null language is
    ``und``; repeated rows count each; an empty table gives no rows; other columns are left behind.
    """
    read = read_chunks(docs, chunk_words)
    words, totals = frequent_words(read, least)
    occurrences = (totals.agg(F.sum("n")).first()[0] or 0) * (LONGEST - 1)
    phrases = frequent_phrases(read, words, occurrences, least, filter_entries=filter_entries, shard_entries=shard_entries)
    counted = phrases.unionByName(words.select(F.array("id").alias("phrase"), "f"))
    scored = (_cuts(phrases).join(counted.select(F.col("phrase").alias("first"), F.col("f").alias("l")), "first")
              .join(counted.select(F.col("phrase").alias("rest"), F.col("f").alias("r")), "rest")
              .withColumn("score", F.expr("cast(cast(a as decimal(38,0)) * 2000000 div (cast(l as decimal(38,0)) + r) as bigint)")))
    worst = scored.groupBy("phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("w")).select("phrase", "w.*")
    inner = (phrases.filter(F.size("phrase") > 2).select(F.col("phrase").alias("long"), "f", F.explode(F.expr("sequence(2, size(phrase) - 1)")).alias("m"))
             .select("long", "f", "m", F.explode(F.expr("sequence(1, size(long) - m + 1)")).alias("i")).select(F.expr("slice(long, i, m)").alias("phrase"), "f")
             .groupBy("phrase").agg(F.max("f").alias("longer")))
    dec = lambda c, by: F.col(c).cast("decimal(38,0)") * by
    kept = worst.join(inner, "phrase", "left").filter(F.col("longer").isNull() | (dec("longer", 100) < dec("a", 80))).drop("longer")
    spelled = (kept.select("*", F.posexplode("phrase").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
               .groupBy("phrase").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelled"),
                                      F.first("a").alias("a"), F.first("l").alias("l"), F.first("r").alias("r"), F.first("score").alias("score")))
    named = spelled.select("lang", F.expr("array_join(transform(spelled, s -> s.word), ' ')").alias("phrase"), "a", "l", "r", "score")
    ranked = top_n(named, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
