"""Packing token sequences into windows by minimum bin slack.

A document is its token ids and an end mark.  Documents of a window or more first fill windows of their own; the rest
lengths of a shard form a multiset.  Window by window, the longest rest is taken and a subset-sum dynamic programme over bitsets
finds the counts of other lengths that come closest to the capacity, traced back through the stored bitsets; only when no subset
fits exactly is a rest cut.  The last, partial window of a shard is cut into powers of two, which need no padding.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import chunks, column_of, id_text, shuffle_width, texts_of

WINDOW, END_ID = 4096, 2
SHARD_DOCS = 1500           # wanted documents of a shard
CACHED_WORDS = 200_000      # words of a worker's young cache, about 200 bytes each; results do not depend on it


class WordTokens:
    """Ids of whole texts by a tokenizer that drops white space and case, word by word with a cache.

    No piece of such a tokenizer spans white space, and ASCII white space composes with nothing, so the ids of a text are
    those of its words in turn.  A piece also ends between an ASCII letter or digit and a mark such as a comma, so a new word may be
    a known one with other case or marks.
    """

    MARKS = b".,!?;:"

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.cached_words = cached_words
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}               # forgotten with the next change, but for what was asked for again

    def _parts(self, word: bytes) -> tuple[bytes, bytes]:
        low = word.lower() if word.isascii() and b"<|" not in word else word
        core = low.rstrip(self.MARKS)
        return (core, low[len(core):]) if core[-1:].isalnum() else (low, b"")

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words: many in one line, told apart by where their tokens stand."""
        for i in range(0, len(words), 500):
            part = words[i:i + 500]
            texts = [w.decode("utf-8", "replace") for w in part]
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])
            e = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            data = np.array(e.ids, "<u4").tobytes()
            cuts = (np.searchsorted(np.array([a for a, _ in e.offsets], np.int64), starts) * 4).tolist()
            for k, word in enumerate(part):
                self.young[word] = data[cuts[k]:cuts[k + 1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.young) > self.cached_words:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        new = set().union(*split).difference(young) if split else set()
        made = {}
        for word in new:
            if word in old:
                young[word] = old[word]
            else:
                made[word] = self._parts(word)
        needed = {p for parts in made.values() for p in parts}.difference(young)
        for part in needed & old.keys():
            young[part] = old[part]
        young[b""] = b""
        self._learn([p for p in needed if p not in young])
        for word, (core, marks) in made.items():
            young[word] = young[core] + young[marks]
        get = young.__getitem__
        return [b"".join(map(get, words)) for words in split]


_TOKENS: dict[str, WordTokens] = {}


def _tokens(path: str, cached_words: int = CACHED_WORDS) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    _TOKENS[path].cached_words = cached_words
    return _TOKENS[path]


def closest_subset(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of lengths whose sum is the largest that does not pass ``capacity``, none used more often than it occurs."""
    reach, steps, full = 1, [], (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > capacity:
            continue
        left, k = min(counts[length], capacity // length), 1
        while left:                                    # 1, 2, 4, ... copies and the rest give every count
            k = min(k, left)
            steps.append((reach, length, k))
            reach |= reach << (length * k) & full
            left -= k
            k *= 2
        if reach >> capacity & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, k in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def pack_lengths(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """``(item, start, length, sequence, offset)`` pieces that hold every position of every item exactly once."""
    pieces, sequence = [], 0
    rests: dict[int, list[tuple[int, int]]] = {}
    total = 0
    for item, n in enumerate(lengths):
        for k in range(n // window):
            pieces.append((item, k * window, window, sequence, 0))
            sequence += 1
        if n % window:
            rests.setdefault(n % window, []).append((item, n - n % window))
            total += n % window

    def take(length):
        own = rests[length]
        got = own.pop()
        if not own:
            del rests[length]
        return got

    while total >= window:
        longest = max(rests)
        chosen = [(longest, *take(longest))]
        for length, n in closest_subset({k: len(v) for k, v in rests.items()}, window - longest).items():
            chosen += [(length, *take(length)) for _ in range(n)]
        slack = window - sum(c[0] for c in chosen)
        if slack:                                      # every rest left is longer than the slack: cut the longest
            length = max(rests)
            item, start = take(length)
            chosen.append((slack, item, start))
            rests.setdefault(length - slack, []).append((item, start + slack))
        offset = 0
        for length, item, start in chosen:
            pieces.append((item, start, length, sequence, offset))
            offset += length
        sequence += 1
        total -= window
    left = [(length, item, start) for length in sorted(rests, reverse=True) for item, start in rests[length]]
    room = 0
    for length, item, start in left:
        while length:
            if not room:
                room, offset = 1 << (total.bit_length() - 1), 0
            n = min(length, room)
            pieces.append((item, start, n, sequence, offset))
            length, start, offset, room, total = length - n, start + n, offset + n, room - n, total - n
            sequence += not room
    return pieces


def tokenized(docs: DataFrame, path: str, *, end_id: int = END_ID, cached_words: int = CACHED_WORDS) -> DataFrame:
    """``doc_id, n, ids`` of every row: ids with the end mark, as little-endian 16- or 32-bit numbers."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        own = _tokens(path, cached_words)
        wide = own.tokenizer.get_vocab_size(True) > 1 << 16 or end_id >= 1 << 16
        for part in chunks(batches, limit=6 << 20):      # larger chunks ask the cache for fewer words
            ids = [np.frombuffer(b, "<u4") for b in own.encode(texts_of(part))]
            blobs = [np.append(i, np.uint32(end_id)).astype("<u4" if wide else "<u2").tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), pa.array([len(i) + 1 for i in ids], pa.int64()), pa.array([wide] * len(ids)),
                                              pa.array(blobs, pa.binary())], ["doc_id", "n", "wide", "ids"])
        own.old = {}                                    # an idle worker keeps half

    return id_text(docs).mapInArrow(run, "doc_id bigint, n bigint, wide boolean, ids binary")


def pack(docs: DataFrame, path: str, *, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False,
         cached_words: int = CACHED_WORDS) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if wanted, ``ids``.

    A null or empty text is its end mark alone.  Rows with one id are documents each, as are rows without an id.  Each id of each document lies in one
    piece; a sequence is full, or its length is a power of two.  An empty table gives no pieces.
    """
    shards = max(shuffle_width(docs.sparkSession), -(-docs.count() // SHARD_DOCS))
    rows = tokenized(docs, path, end_id=end_id, cached_words=cached_words).withColumn("shard", F.pmod(F.xxhash64("doc_id", "n"), F.lit(shards)).cast("bigint"))

    def fill(group: pa.Table) -> pa.Table:
        lengths = group.column("n").to_pylist()
        order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], group.column("doc_id")[i].as_py() or 0))
        pieces = pack_lengths([lengths[i] for i in order], window)
        item, start, length, sequence, offset = (np.array(c, np.int64) for c in (zip(*pieces) if pieces else [[]] * 5))
        item = np.array(order, np.int64)[item] if len(item) else item
        blobs = [np.frombuffer(b, "<u4" if w else "<u2").astype("<u4") for b, w in zip(group.column("ids").to_pylist(), group.column("wide").to_pylist())]
        parts = [blobs[i][a:a + n] for i, a, n in zip(item, start, length)]
        out = {"doc_id": group.column("doc_id").take(pa.array(item)), "start": start, "length": length,
               "ids_crc32": np.array([zlib.crc32(p.tobytes()) for p in parts], np.int64), "doc_tokens": group.column("n").take(pa.array(item)),
               "sequence_id": (group.column("shard")[0].as_py() << 32) + sequence, "offset": offset}
        if with_ids:
            out["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
        return pa.table(out)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return rows.groupBy("shard").applyInArrow(fill, schema + (", ids array<int>" if with_ids else ""))
