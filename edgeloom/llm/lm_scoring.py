"""Document scores by cross-entropy difference of two n-gram language models.

Tokens are the bytes of the text after a start mark, so both models share one closed vocabulary and no token is unknown.  The background model counts all
documents, the target model the documents of the target set.  Probabilities are interpolated from order 1 to ``ORDER``; a score is the mean over a
document's tokens of (loss under the target - loss under the background): below zero, the text looks more like the target.

Counts are exact: an n-gram is its own key, never a hash slot, and the table of n-grams grows with the corpus.  Texts lie in blocks of bounded size.  Each
block counts its n-grams before anything is shuffled, asks once for the losses of those it holds, and sums them over its documents.  The losses of all
n-grams of the corpus come from joins of the order above with the order below; an n-gram has at most 256 continuations, so no key of these is hot.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import chunks, column_of, id_text, texts_of
from edgeloom.session import discard, materialize

ORDER = 6                                        # at most 7: the bytes of an n-gram are one positive bigint
WEIGHTS = (0.02, 0.04, 0.09, 0.17, 0.28, 0.4)    # interpolation weights by order; a context never seen leaves its weight to the lower orders
FLOOR = 1.0                 # added count of each byte at order 1
DAMP = 2.0                  # a context seen s times takes s / (s + DAMP) of its weight
BLOCK_BYTES = 32 << 20      # text of a block, unless one text alone is longer
WINDOW = 4 << 20            # bytes whose n-grams are held at once inside a task
SIDES = ("background", "target")


def in_blocks(docs: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """``block, rows``: consecutive rows of a partition, about ``limit`` bytes of text a block, in compressed pieces (``_unpacked`` reads one).

    Write the result before use: blocks follow the order of rows.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for part in _gathered(batches, min(limit, WINDOW)):
            size = part.column("text").nbytes
            if held and held + size > limit:
                block, held = block + 1, 0
            held += size
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(part)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    return docs.mapInArrow(run, "block bigint, rows binary")


def _gathered(batches, limit: int) -> Iterator[pa.Table]:
    """The rows of the batches in pieces of at most ``limit`` bytes of text, unless one text alone is longer."""
    held, size = [], 0
    for part in chunks(batches, limit=limit):
        own = column_of(part, "text").nbytes
        if held and size + own > limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _unpacked(piece: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(piece).read_next_batch()


def grams(texts: list[str], window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every token the n-gram of ``ORDER`` bytes that ends there, first byte highest, and the number of its text; ``window`` bytes at once."""
    raw = [b"\0" * ORDER + t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum([len(r) for r in raw], dtype=np.int64)
    start = end - [len(r) for r in raw] if raw else end
    for low in range(0, len(data), window):
        high = min(low + window, len(data))
        own = data[max(0, low - ORDER + 1):high].astype(np.int64)
        key = own.copy()
        for k in range(1, ORDER):
            key[k:] |= own[:-k] << (8 * k)
        owner = np.repeat(np.arange(len(raw)), np.clip(end, low, high) - np.clip(start, low, high))
        token = np.arange(low, high) >= start[owner] + ORDER
        yield key[len(key) - (high - low):][token], owner[token]


def _summed(key: np.ndarray, n: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of both counts."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(n[order], first) if len(first) else n, np.add.reduceat(chosen[order], first) if len(first) else chosen


def block_counts(blocks: DataFrame) -> DataFrame:
    """``block, key, background, target``: how often the n-grams of the highest order stand in a block; a block met by two tasks has two rows a key."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def merged():
            return _summed(*(np.concatenate(x) for x in zip(*held)))

        def rows():
            if held:
                key, n, chosen = merged()
                for i in range(0, len(key), 1 << 17):
                    own = slice(i, i + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[own]), block)), pa.array(key[own]), pa.array(n[own]), pa.array(chosen[own])],
                                                     ["block", "key", *SIDES])

        for batch in batches:
            for number, piece in zip(column_of(batch, "block").to_pylist(), column_of(batch, "rows")):
                if number != block:
                    yield from rows()
                    block, held = number, []
                own = _unpacked(piece.as_py())
                wanted = column_of(own, "is_target").to_numpy(zero_copy_only=False).astype(bool)
                for key, owner in grams(texts_of(own)):
                    seen, n = np.unique(key, return_counts=True)
                    some, m = np.unique(key[wanted[owner]], return_counts=True)
                    chosen = np.zeros(len(seen), np.int64)
                    chosen[np.searchsorted(seen, some)] = m
                    held.append((seen, n.astype(np.int64), chosen))
                    if len(held) > 3:
                        held = [merged()]
        yield from rows()

    return blocks.mapInArrow(run, "block bigint, key bigint, background bigint, target bigint")


def _low(key: Column, order: int) -> Column:
    """The last ``order`` bytes of an n-gram."""
    return key.bitwiseAND(F.lit((1 << (8 * order)) - 1))


def _sums(counts: DataFrame, key: Column) -> DataFrame:
    return counts.groupBy(key.alias("key")).agg(*[F.sum(s).alias(s) for s in SIDES])


def losses(counts: DataFrame) -> DataFrame:
    """``key, background_loss, target_loss``: -log2 probability of the last byte of every n-gram after the bytes before it, by both models.

    ``counts`` has ``key, background, target`` of the distinct n-grams of the highest order.  The counts of an order are sums of the order above; a context
    counts the tokens that follow it.
    """
    by_order = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        by_order[n] = materialize(_sums(by_order[n + 1], _low(F.col("key"), n)))
    total = by_order[1].agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in SIDES]).first()
    p = by_order[1].select("key", *[((F.col(s) + FLOOR) / (total[s] + 256 * FLOOR)).alias(f"{s}_p") for s in SIDES])
    weight = WEIGHTS[0]
    for n in range(2, ORDER + 1):
        context = F.shiftright("key", 8)
        seen = _sums(by_order[n], context).select(F.col("key").alias("context"), *[F.col(s).alias(f"{s}_seen") for s in SIDES])
        lower = p.select(F.col("key").alias("lower"), *[f"{s}_p" for s in SIDES])
        both = by_order[n].withColumns({"context": context, "lower": _low(F.col("key"), n - 1)}).join(seen, "context").join(lower, "lower")

        def mixed(s: str, part: float = WEIGHTS[n - 1] / (weight + WEIGHTS[n - 1])) -> Column:
            share = F.lit(part) * F.col(f"{s}_seen") / (F.col(f"{s}_seen") + DAMP)
            own = F.when(F.col(f"{s}_seen") > 0, F.col(s) / F.col(f"{s}_seen")).otherwise(0.0)
            return (1 - share) * F.col(f"{s}_p") + share * own

        before, p = p, materialize(both.select("key", *[mixed(s).alias(f"{s}_p") for s in SIDES]))
        discard(before, by_order[n - 1])
        weight += WEIGHTS[n - 1]
    return p.select("key", *[(-F.log2(f"{s}_p")).cast("float").alias(f"{s}_loss") for s in SIDES])


def score(docs: DataFrame, target_ids: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` of every row of ``docs``, in bits a token.

    The background model is trained on all rows, the target model on the rows whose id is in ``target_ids`` (column ``doc_id``); these are scored by a model
    that has seen them.  A null or empty text has no tokens and score zero.  Repeated rows count and return each time; a null id is no target.
    """
    wanted = target_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).dropna().distinct().withColumn("is_target", F.lit(True))
    marked = id_text(docs).join(wanted, "doc_id", "left").select("doc_id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    blocks = materialize(in_blocks(marked, block_bytes))
    own = materialize(block_counts(blocks))
    counts = materialize(_sums(own, F.col("key")))
    asked = own.join(losses(counts), "key").select("block", "key", "target_loss", "background_loss")

    def inside(block: pa.Table, known: pa.Table) -> pa.Table:
        key = known.column("key").to_numpy()
        order = np.argsort(key)
        key = key[order]
        loss = [known.column(c).to_numpy()[order].astype(np.float64) for c in ("target_loss", "background_loss")]
        ids, tokens, sums = [], [], ([], [])
        for piece in block.column("rows"):
            part = _unpacked(piece.as_py())
            n, total = np.zeros(part.num_rows, np.int64), np.zeros((2, part.num_rows))
            for own, owner in grams(texts_of(part)):
                seen, at = np.unique(own, return_inverse=True)
                place = np.searchsorted(key, seen)
                n += np.bincount(owner, minlength=part.num_rows)
                for side in (0, 1):
                    total[side] += np.bincount(owner, loss[side][place][at], part.num_rows)
            ids.append(column_of(part, "doc_id"))
            tokens.append(n)
            for side in (0, 1):
                sums[side].append(total[side] / np.maximum(n, 1))
        target, background = (np.concatenate(s) if s else np.empty(0) for s in sums)
        return pa.table({"doc_id": pa.chunked_array(ids, pa.int64()), "n_tokens": pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64)),
                         "target_loss": pa.array(target), "background_loss": pa.array(background), "score": pa.array(target - background)})

    return blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(
        inside, "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double")
