"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot scores.

A text is cut into tokens: runs of word bytes and runs of ASCII punctuation.  Features are the token, the pair
of neighbouring tokens, the shape (kind, case, length class) of one, two and three neighbours, and whether a token repeats the
one or the two before it; each is hashed to a slot.  A slot's value is sqrt(share of the document's features), so
every document has length one whatever its size.  Only the text is read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import chunks, column_of, id_text, texts_of

SLOTS_LOG2 = 20
TRAIN_ROWS = 6000           # bound on the labelled rows a model is fitted on (smallest hashes of doc_id)
THRESHOLD = 0.7
HELD_OUT_REMAINDER = 2      # rows whose crc32(doc_id as text) mod 4 is this are never learned from

_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2 ** 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_PLACE = _RNG.integers(1, 2 ** 63, 64, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.full(256, 2, np.uint8)                       # 0 white space, 1 punctuation, 2 word
_KIND[:33] = 0
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:128] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    return (h ^ (h >> np.uint64(29))) * _MIX


def features(texts: list[str], bits: int = SLOTS_LOG2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, slot, value)`` of all non-zero features, sorted by row; a text without tokens has the one feature "empty"."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    n_docs = len(raw)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    kind = _KIND[data]
    change = np.flatnonzero(np.diff(kind)) + 1
    starts = np.concatenate(([0], change))
    starts, stops = starts, np.concatenate((change, [len(data)]))
    keep = kind[starts] > 0
    starts, stops = starts[keep], stops[keep]
    rows, slots = [np.arange(n_docs)], [np.zeros(n_docs, np.int64)]        # the bias, also the feature of an empty text
    if len(starts):
        length = stops - starts
        bounds = np.ravel(np.column_stack((starts, stops)))
        bounds = bounds[:-1] if bounds[-1] == len(data) else bounds
        inside = np.arange(len(data)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(data)]))))
        token = _mix(np.add.reduceat(_BYTE[data] * _PLACE[inside & 63], bounds)[::2] + length.astype(np.uint64))
        upper = np.add.reduceat(_UPPER[data], bounds)[::2]
        digit = np.add.reduceat(_DIGIT[data], bounds)[::2]
        case = np.where(upper == 0, 0, np.where(upper == length, 2, 1)) + 3 * (digit > 0)
        shape = (np.minimum(length, 12) // 2 * 8 + case) * 2 + (kind[starts] == 1)
        shape = np.where(kind[starts] == 1, token & np.uint64(0xFFFFF), shape.astype(np.uint64))
        doc = np.searchsorted(ends, starts, "right")

        def back(x, k, fill):
            out = np.empty_like(x)
            out[:k], out[k:] = fill, x[:-k]
            if k < len(x):
                out[k:][doc[k:] != doc[:-k]] = fill
            return out[: len(x)]

        one, two = back(token, 1, np.uint64(0)), back(token, 2, np.uint64(0))
        s1, s2 = back(shape, 1, np.uint64(999)), back(shape, 2, np.uint64(999))
        repeat = (token == one).astype(np.uint64) + np.uint64(2) * (token == two).astype(np.uint64)
        u = np.uint64
        for h in (token, _mix(token + u(7)) ^ one, shape + u(11 << 40), (shape * u(1 << 20) + s1) + u(13 << 44),
                  _mix(shape * u(1 << 20) + s1) + s2, repeat + u(17 << 50)):
            slot = (_mix(h + u(3)) >> u(64 - bits)).astype(np.int64)
            rows.append(doc)
            slots.append(np.maximum(slot, 1))
    key, count = np.unique((np.concatenate(rows) << bits) | np.concatenate(slots), return_counts=True)
    row, slot = key >> bits, key & ((1 << bits) - 1)
    total = np.bincount(row, count, n_docs)
    return row, slot, np.sqrt(count / total[row])


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = SLOTS_LOG2, *, alpha: float = 1.0,
         beta: float = 0.1, l1: float = 0.02, l2: float = 0.02, epochs: int = 5) -> np.ndarray:
    """Weights after ``epochs`` passes of FTRL-proximal over (slots, values) examples, one update an example."""
    z, n, w = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(1 << bits)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            slot, value = examples[i][0], examples[i][1].astype(float)
            zi, ni = z[slot], n[slot]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1.0 / (1.0 + np.exp(-np.clip(wi @ value, -35, 35)))
            g = (p - labels[i]) * value
            grown = ni + g * g
            z[slot] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * wi
            n[slot] = grown
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w.astype(np.float32)


def held_out(id_col="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == HELD_OUT_REMAINDER, F.lit(False))


def _held(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    """Each row's numbers where Arrow holds them, without a copy."""
    return [np.frombuffer(row.as_buffer(), kind) for chunk in column.chunks for row in chunk]


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", train_rows: int = TRAIN_ROWS,
          bits: int = SLOTS_LOG2) -> np.ndarray:
    """Weights learned from at most ``train_rows`` labelled, not held-out documents.

    Rows without id or label are no examples; an id labelled twice counts with its smaller label.  With no example, or
    with one class only, the weights still exist (zeros, or a model that leans to that class).
    """
    known = (labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels[label_col].cast("int").alias("label"))
             .dropna().groupBy("doc_id").agg(F.min("label").alias("label")).filter(~held_out())
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))

    def examples(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=1 << 20):
            row, slot, value = features(texts_of(part), bits)
            cut = np.searchsorted(row, np.arange(1, part.num_rows))
            yield pa.RecordBatch.from_arrays([
                column_of(part, "doc_id"), column_of(part, "label"),
                pa.array([s.astype("<i4").tobytes() for s in np.split(slot, cut)], pa.binary()),
                pa.array([v.astype("<f4").tobytes() for v in np.split(value, cut)], pa.binary())], ["doc_id", "label", "slot", "value"])

    # the small side has at most train_rows rows of two numbers
    rows = id_text(docs).join(F.broadcast(known), "doc_id").mapInArrow(examples, "doc_id bigint, label int, slot binary, value binary").toArrow()
    order = pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("slot", "ascending")]).to_numpy()
    slots, values = _held(rows.column("slot"), "<i4"), _held(rows.column("value"), "<f4")
    return ftrl([(slots[i], values[i]) for i in order], rows.column("label").to_numpy().astype(float)[order], bits)


def score(docs: DataFrame, weights: np.ndarray, *, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; a sparse dot product for each text, no shuffle.

    Null and empty texts get the score of their one feature; repeated rows give repeated results; a null id is not held out.
    """
    bits = int(len(weights)).bit_length() - 1

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=1 << 20):
            row, slot, value = features(texts_of(part), bits)
            dot = np.bincount(row, weights[slot] * value, part.num_rows)
            yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), pa.array(1.0 / (1.0 + np.exp(-np.clip(dot, -35, 35))))],
                                             ["doc_id", "score"])

    scored = id_text(docs).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, weights: np.ndarray, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores ``threshold`` or more."""
    bits = int(len(weights)).bit_length() - 1

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=1 << 20):
            row, slot, value = features(texts_of(part), bits)
            dot = np.bincount(row, weights[slot] * value, part.num_rows)
            yield part.filter(pa.array(1.0 / (1.0 + np.exp(-np.clip(dot, -35, 35))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
