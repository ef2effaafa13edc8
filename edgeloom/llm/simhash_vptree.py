"""SimHash near-duplicates by vantage-point trees.

Fingerprints: 64 majority bits over the XXH64 hashes of word shingles.  Equal fingerprints are one node.  The upper
levels of one tree, built from a bounded sample, are a routing table: a node goes left of a vantage point when its Hamming distance is at most
``mu + radius`` and right when it is more than ``mu``; so by the triangle inequality two nodes within ``radius`` always share a shard, and only
nodes near a boundary go to both.  A shard goes on splitting the same way inside its task, compares leaves exactly, and returns a
spanning forest of its links, never all pairs.  Components of the forests are the classes.

That holds for small radii.  ``keep_first`` wants word shingles of Jaccard similarity 0.8 or more, which no radius bounds.  It takes the fingerprints of the sets of
shingles through the same trees, checks each class against its first member on all shingles (``fingerprint_links``), and then finds the links that lie beyond
the radius by prefix filter: in one order of all shingles, two sets of that similarity share a shingle among the first fifth of each.  Shingles whose holders
the fingerprints have joined are done; what is left is checked in stars round one member of a shingle, then all that no link has joined (``similar_classes``).

A shard's work is bounded by distinct fingerprints: however many copies a document has, at most 679,121 (1 + C(64,1) + ... + C(64,4))
fingerprints lie within distance 4 of any one.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import chunks, column_of, id_text, shuffle_width, texts_of
from edgeloom.operators.graph import connected_components
from edgeloom.session import discard, materialize

RADIUS, SHINGLE = 2, 3
SAMPLE = 1 << 16            # fingerprints the routing levels are built from
SHARD_NODES = 1500          # wanted nodes of a shard; the depth follows the number of nodes
MAX_DEPTH = 12
LEAF = 400                  # compared exactly without further splits

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingles(text: str, n: int) -> list[bytes]:
    """Word shingles of the text with A-Z lower-cased; words end at space, tab, line feed, vertical tab, form feed, return."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return [b" ".join(s) for s in zip(*(words[i:] for i in range(n)))]


def fingerprints_of(texts: list[str], n: int = SHINGLE) -> np.ndarray:
    """Unsigned fingerprints; a text without words has zero."""
    total = np.empty(len(texts), np.int64)
    digests = []
    for i, t in enumerate(texts):
        s = shingles(t, n)
        total[i] = len(s)
        digests.append(b"".join(map(xxhash.xxh64_digest, s, repeat(42))))
    h = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    owner = np.repeat(np.arange(len(texts)), total) * 256
    bits = np.empty((len(texts), 64), bool)
    for k in range(8):
        seen = np.bincount(owner + h[:, k], minlength=len(texts) * 256).reshape(-1, 256) @ _BITS
        bits[:, 8 * k:8 * k + 8] = 2 * seen > total[:, None]
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a bigint) of every row; null texts have no words, repeated rows repeat."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), pa.array(fingerprints_of(texts_of(part), n).view(np.int64))], ["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id bigint, fp bigint")


def _distance(a, b):
    return np.bitwise_count(a ^ b)


def build_routes(sample: np.ndarray, depth: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and median distances of a full binary tree of ``depth`` levels, in heap order."""
    rng = np.random.default_rng(seed)
    point, mu = np.zeros((1 << depth) - 1, np.uint64), np.full((1 << depth) - 1, 64, np.int64)
    held = {0: sample}
    for node in range(len(point)):
        own = held.pop(node, sample)
        own = own if len(own) else sample
        point[node] = own[rng.integers(len(own))]
        d = _distance(own, point[node])
        mu[node] = int(np.median(d))
        held[2 * node + 1], held[2 * node + 2] = own[d <= mu[node]], own[d > mu[node]]
        if 2 * node + 1 >= len(point):
            held.pop(2 * node + 1), held.pop(2 * node + 2)
    return point, mu


def route(fp: np.ndarray, point: np.ndarray, mu: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, shard)``: every shard that a fingerprint has to be in."""
    row, node = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    depth = int(len(point) + 1).bit_length() - 1
    for _ in range(depth):
        d = _distance(fp[row], point[node]).astype(np.int64)
        left, right = d <= mu[node] + radius, d > mu[node]
        row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
    return row, node - len(point)


class _Forest:
    """Disjoint sets over 0..n-1, joined many pairs at a time."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x):
        r = self.up[x]
        while True:
            s = self.up[r]
            if (s == r).all():
                return r
            r = s

    def join(self, a, b):
        while len(a):
            a, b = self.roots(a), self.roots(b)
            open_ = a != b
            a, b = np.maximum(a, b)[open_], np.minimum(a, b)[open_]
            np.minimum.at(self.up, a, b)


def link(fp: np.ndarray, radius: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the graph of fingerprints within ``radius``: (node, root) pairs."""
    fp = np.unique(fp)
    forest, rng = _Forest(len(fp)), np.random.default_rng(seed)
    stack = [np.arange(len(fp))]
    while stack:
        own = stack.pop()
        if len(own) > LEAF:
            for _ in range(4):
                d = _distance(fp[own], fp[own[rng.integers(len(own))]])
                mu = int(np.median(d))
                left, right = own[d <= mu + radius], own[d > mu]
                if max(len(left), len(right)) < 0.8 * len(own):
                    stack += [left, right]
                    break
            else:
                left = None
            if left is not None:
                continue
        for i in range(0, len(own), 512):              # too close together to split: exact, in blocks
            for j in range(i, len(own), 4096):
                a, b = np.nonzero(_distance(fp[own[i:i + 512]][:, None], fp[own[j:j + 4096]][None, :]) <= radius)
                a, b = own[i + a], own[j + b]
                forest.join(a[a != b], b[a != b])
    root = forest.roots(np.arange(len(fp)))
    leaf = np.flatnonzero(root != np.arange(len(fp)))
    return fp[leaf], fp[root[leaf]]


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def classes(nodes: DataFrame, radius: int = RADIUS, *, sample: int = SAMPLE, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """``fp, component`` of distinct fingerprints that have a link; those without one are left out."""
    count = nodes.count()
    depth = min(MAX_DEPTH, max(1, int(np.ceil(np.log2(max(2, count / shard_nodes))))))
    part = nodes if count <= sample else nodes.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int((1 << 30) * sample / count))
    seen = np.array([r[0] for r in part.select("fp").orderBy("fp").limit(2 * sample).collect()], np.int64).view(np.uint64)
    point, mu = build_routes(seen if len(seen) else np.zeros(1, np.uint64), depth)

    def deal(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _unsigned(column_of(batch, "fp"))
            row, shard = route(fp, point, mu, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[row].view(np.int64))], ["shard", "fp"])

    def inside(group: pa.Table) -> pa.Table:
        a, b = link(_unsigned(group.column("fp").combine_chunks()), radius)
        return pa.table({"src": pa.array(a.view(np.int64)), "dst": pa.array(b.view(np.int64))})

    links = nodes.select("fp").mapInArrow(deal, "shard bigint, fp bigint").groupBy("shard").applyInArrow(inside, "src bigint, dst bigint")
    links = materialize(links.distinct())
    ends = links.select(F.col("src").alias("node_id")).union(links.select(F.col("dst").alias("node_id"))).distinct()
    return connected_components(ends, links).select(F.col("node_id").alias("fp"), "component")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, n: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest id among all rows reachable over links within ``radius``.

    Null and empty texts share fingerprint zero and link like others.  A null id takes part, but names no component (null if no other
    id is reachable).  Repeated rows repeat.  No link between different fingerprints is lost, whatever the sizes.
    """
    prints = materialize(fingerprints(docs, n))
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    linked = materialize(classes(nodes, radius).join(nodes, "fp"))
    named = linked.groupBy("component").agg(F.min("low").alias("component_low"))
    named = linked.join(named, "component").select("fp", "component_low")
    whole = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_low", "low").alias("component_id"))
    return prints.join(whole, "fp").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- similarity 0.8 and more
TILE = 4096                 # members of a tile; a larger key is worked on tile against tile
STARS = 3                   # rounds in which one member of a key is compared with the others, before all that is left is paired
BITMAP = 2048               # bits of the narrow bitmap of a set; the wide one has at least two bits a shingle
PER_PART = 512              # members that one copy of a centre's text serves
HOT_DOCS, HOT = 1 << 13, 1 << 15    # documents the frequent shingles come from, and how many of them; they go last in the order, which changes the work only


def sketch_of(h: np.ndarray) -> np.ndarray:
    """All distinct shingle hashes, ascending."""
    return np.unique(h).astype("<u8")


def set_digest(h: np.ndarray) -> bytes:
    """128 bits of the distinct shingle hashes: equal for texts of the same shingles, however often each stands in them."""
    return xxhash.xxh3_128_digest(np.unique(h).tobytes())


def _hashes(text: str, n: int) -> np.ndarray:
    return sketch_of(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles(text, n), repeat(42))), ">u8").astype(np.uint64))


def set_fingerprint(h: np.ndarray) -> int:
    """64 majority bits over the distinct shingle hashes, as a signed long: repeats do not count, so it follows the similarity of sets."""
    seen = np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * seen > len(h)).view(">i8")[0])


def digested(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, row, node, worded, fp`` of every row: 128-bit digest of the set of its shingles, if there are any, and the set's fingerprint."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            sets = [_hashes(t, n) for t in texts_of(part)]
            yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), column_of(part, "row"), pa.array([set_digest(h) for h in sets], pa.binary()),
                                              pa.array([len(h) > 0 for h in sets]), pa.array([set_fingerprint(h) for h in sets], pa.int64())],
                                             ["doc_id", "row", "node", "worded", "fp"])

    return id_text(docs).withColumn("row", F.xxhash64("text")).mapInArrow(run, "doc_id bigint, row bigint, node binary, worded boolean, fp bigint")


def frequent(texts: DataFrame, n: int) -> np.ndarray:
    """Shingle hashes that several of a bounded number of documents hold, ascending by count."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_hashes(t, n) for t in texts_of(part)]).view(np.int64))], ["key"])

    count = texts.count()
    few = texts if count <= HOT_DOCS else texts.filter(F.pmod(F.xxhash64("nid"), F.lit(1 << 30)) < int((1 << 30) * HOT_DOCS / count))
    held = few.mapInArrow(run, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2)
    rows = held.orderBy(F.desc("n"), "key").limit(HOT).collect()
    return np.array([r["key"] for r in reversed(rows)], np.int64).view(np.uint64)


def wide_bitmap(h: np.ndarray) -> np.ndarray:
    """Unsigned longs whose bits tell whether an odd number of the hashes fall there: a power of two of bits, at least two a hash and ``BITMAP``.

    The exclusive or of two such rows has a bit set only where hashes of one set alone fall, so at most as many as stand in one set only.
    """
    width = max(BITMAP, 1 << (2 * len(h) - 1).bit_length())
    odd = np.bincount((h >> np.uint64(7)).astype(np.int64) % width, minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """For each set of hashes its wide bitmap folded to ``BITMAP`` bits, as rows of unsigned longs."""
    out = np.zeros((len(sets), BITMAP // 64), "<u8")
    for row, h in zip(out, sets):
        row[:] = np.bitwise_xor.reduce(wide_bitmap(h).reshape(-1, BITMAP // 64))
    return out


def prefixes(texts: DataFrame, n: int, similarity: float, hot: np.ndarray) -> DataFrame:
    """``nid, size, key, pos, bits``: the first shingles of every set in one order of all shingles, as many as two similar sets cannot both do without;
    the row of the first one holds the wide bitmap of the set."""
    order = np.argsort(hot)
    held = hot[order]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            keys, sets = [], [_hashes(t, n) for t in texts_of(part)]
            for h in sets:
                size = len(h)
                if len(held):
                    at = np.minimum(np.searchsorted(held, h), len(held) - 1)
                    rank = np.where(held[at] == h, order[at] + 1, 0)
                    h = h[np.argsort(rank, kind="stable")]
                keys.append(h[:size - int(np.ceil(similarity * size - 1e-9)) + 1])
            length = np.array([len(k) for k in keys])
            take = np.repeat(np.arange(len(keys)), length)
            pos = np.arange(len(take)) - np.repeat(np.cumsum(length) - length, length)
            bits = pa.array([wide_bitmap(h).view(np.int64) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([column_of(part, "nid").take(pa.array(take)), pa.array(np.array([len(h) for h in sets])[take], pa.int32()),
                                              pa.array(np.concatenate(keys).view(np.int64)), pa.array(pos, pa.int32()),
                                              bits.take(pa.array(np.where(pos == 0, take, 0), mask=pos != 0))], ["nid", "size", "key", "pos", "bits"])

    return texts.mapInArrow(run, "nid bigint, size int, key bigint, pos int, bits array<bigint>")


def _deal_tiles(members: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """``bin, shard, nid`` and ``carry``: the members of each key in tiles of about ``TILE``, each tile with every other; keys of one member go."""
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > 1)
    own = F.pmod(F.xxhash64("nid"), F.col("tiles")).cast("int")
    dealt = (members.join(sizes.withColumn("tiles", F.ceil(F.col("held") / TILE).cast("int")), keys).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumn("shard", F.xxhash64(*keys, F.least("own", "other"), F.greatest("own", "other"))))
    bins = shuffle_width(members.sparkSession, 4)
    return dealt.select(F.pmod("shard", F.lit(bins)).cast("int").alias("bin"), "shard", "nid", *carry)


def _per_shard(group: pa.Table, work) -> pa.Table:
    """Links ``src, dst`` of nodes that ``work`` finds among the rows (their positions) of each shard."""
    shard = group.column("shard").combine_chunks().to_numpy()
    nid = group.column("nid").combine_chunks().to_numpy()
    order = np.argsort(shard, kind="stable")
    found = []
    for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(shard) else []:
        a, b = work(own)
        found.append((nid[own[a]], nid[own[b]]))
    a, b = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
    return pa.table({"src": pa.array(a), "dst": pa.array(b)})


def may_be_similar(size, pos, size2, pos2, similarity: float, least=np.minimum):
    """False only if sets of these sizes with one shingle in common at these positions cannot have the similarity."""
    both = least(pos, pos2) + 1 + least(size - pos - 1, size2 - pos2 - 1)
    return both >= similarity / (1 + similarity) * (size + size2) - 1e-6


def most_apart(size, size2, similarity: float):
    """The most shingles that can stand in only one of two sets of these sizes and of the similarity."""
    return (1 - similarity) / (1 + similarity) * (size + size2) + 1e-6


def star_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """``a, center``: each member of a key with the key's ``center``, if both may be similar and are not in one component."""
    fits = may_be_similar(F.col("size"), F.col("pos"), F.col("c_size"), F.col("c_pos"), similarity, F.least)
    return members.filter((F.col("component") != F.col("c_component")) & fits).select(F.col("nid").alias("a"), "center").distinct()


def narrowed(signs: DataFrame) -> DataFrame:
    """``nid, bits``: the wide bitmaps folded to ``BITMAP`` bits."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = [np.bitwise_xor.reduce(b.values.to_numpy().reshape(-1, BITMAP // 64)) for b in column_of(part, "bits")]
            yield pa.RecordBatch.from_arrays([column_of(part, "nid"), pa.array(rows, pa.list_(pa.int64()))], ["nid", "bits"])

    return signs.select("nid", "bits").mapInArrow(run, "nid bigint, bits array<bigint>")


def bits_apart(one: pa.Array, two: pa.Array) -> np.ndarray:
    """Bits in which the wide bitmaps of each row differ, the wider one folded to the other."""
    def held(column):
        values, ends = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        return values, ends

    (x, xe), (y, ye), out = held(one), held(two), np.zeros(len(one), np.int64)
    xs, ys = np.diff(xe, prepend=0), np.diff(ye, prepend=0)
    for wide, wide2 in set(zip(xs.tolist(), ys.tolist())):
        rows = np.flatnonzero((xs == wide) & (ys == wide2))
        least = min(wide, wide2)
        for i in range(0, len(rows), max(1, (1 << 17) // (wide + wide2))):
            own = rows[i:i + max(1, (1 << 17) // (wide + wide2))]
            a, b = (v[(e[own] - w)[:, None] + np.arange(w)].reshape(len(own), -1, least) for v, e, w in ((x, xe, wide), (y, ye, wide2)))
            out[own] = np.bitwise_count(np.bitwise_xor.reduce(a, axis=1) ^ np.bitwise_xor.reduce(b, axis=1)).sum(axis=1)
    return out


def near_bitmaps(pairs: DataFrame, signs: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, center) without those whose wide bitmaps (``nid, size, bits``) already differ in more bits than similar sets can."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in batches:
            size, size2 = (column_of(part, c).to_numpy() for c in ("_size", "_size2"))
            near = pa.array(bits_apart(column_of(part, "_bits"), column_of(part, "_bits2")) <= most_apart(size, size2, similarity))
            yield pa.RecordBatch.from_arrays([column_of(part, c).filter(near) for c in ("a", "center")], ["a", "center"])

    left = signs.select(F.col("nid").alias("a"), F.col("size").alias("_size"), F.col("bits").alias("_bits"))
    right = signs.select(F.col("nid").alias("center"), F.col("size").alias("_size2"), F.col("bits").alias("_bits2"))
    met = pairs.select("a", "center").join(left, "a").join(right, "center")
    return met.mapInArrow(run, "a bigint, center bigint")


def other_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """``a, center``: all pairs of members of a key (``nid, size, key, pos, component, bits``) that may be similar and are in different components."""
    def inside(group: pa.Table) -> pa.Table:
        size, pos, part = (group.column(c).combine_chunks().to_numpy() for c in ("size", "pos", "component"))
        bits = group.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITMAP // 64)     # signed: bits of the absolute value

        def work(own):
            found = []
            for i in range(0, len(own), 256):
                x, y = own[i:i + 256, None], own[None, :]
                a, b = np.nonzero((part[x] != part[y]) & may_be_similar(size[x], pos[x], size[y], pos[y], similarity))
                a, b = i + a[i + a < b], b[i + a < b]
                for j in range(0, len(a), 1 << 14):
                    p, q = own[a[j:j + (1 << 14)]], own[b[j:j + (1 << 14)]]
                    near = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1) <= most_apart(size[p], size[q], similarity)
                    found.append((a[j:j + (1 << 14)][near], b[j:j + (1 << 14)][near]))
            return tuple(np.concatenate(f) for f in zip(*found)) if found else (np.empty(0, np.int64),) * 2
        return _per_shard(group, work)

    pairs = _deal_tiles(members, ["key"], ["size", "pos", "component", "bits"]).groupBy("bin").applyInArrow(inside, "src bigint, dst bigint")
    return pairs.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("center")).distinct()


def jaccard(one: np.ndarray, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Similarity of a set of shingle hashes, ascending, to those held end to end in ``values``."""
    size = ends - starts
    owner = np.repeat(np.arange(len(starts)), size)
    own = values[np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())]
    at = np.minimum(np.searchsorted(one, own), len(one) - 1)
    both = np.bincount(owner, weights=one[at] == own, minlength=len(starts))
    return both / (size + len(one) - both)


def similar_links(pairs: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """``src, dst``: the pairs whose sets of shingles are similar, counted over all shingles.

    Each member's text meets its centre's once; a centre's text travels once for every ``PER_PART`` members, ahead of them in sort order.
    The texts that a pair needs are picked by their numbers, which Spark sends to the texts while they are few, so that the other texts stay where they are.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        one = None
        for part in chunks(batches):
            src, dst = [], []
            for center, a, text in zip(column_of(part, "center").to_pylist(), column_of(part, "a").to_pylist(), texts_of(part)):
                h = _hashes(text, n)
                if a is None:
                    one = h
                elif jaccard(one, h, np.array([0]), np.array([len(h)]))[0] >= similarity:
                    src.append(a)
                    dst.append(center)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    wanted = materialize(pairs.select(F.explode(F.array("a", "center")).alias("nid")).distinct())
    texts = texts.join(wanted, "nid", "left_semi")
    centers = pairs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / PER_PART).cast("int").alias("parts"))
    members = pairs.join(centers, "center").select("center", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), "a")
    heads = centers.select("center", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("a"))
    rows = members.union(heads).withColumn("nid", F.coalesce("a", "center")).join(texts, "nid").select("center", "part", "a", "text")
    ahead = rows.repartition("center", "part").sortWithinPartitions("center", "part", F.asc_nulls_first("a"))
    return ahead.mapInArrow(run, "src bigint, dst bigint").distinct()


def fingerprint_links(nodes: DataFrame, texts: DataFrame, n: int, similarity: float, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Links ``src, dst`` inside the classes that vantage-point trees find for the fingerprints of the ``nodes`` (``nid, fp``), and the judged pairs ``x, y``.

    Every member of a class is judged against its first one on all shingles, so no link rests on fingerprints alone.
    """
    nodes = materialize(nodes)
    linked = materialize(classes(nodes.select("fp").distinct(), radius))
    family = nodes.join(linked, "fp", "left").select("nid", F.coalesce("component", "fp").alias("family"))
    center = family.groupBy("family").agg(F.min("nid").alias("center"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("family", "center")
    pairs = materialize(family.join(center, "family").filter(F.col("nid") != F.col("center")).select(F.col("nid").alias("a"), "center"))
    discard(nodes, linked)
    return materialize(similar_links(pairs, texts, n, similarity)), pairs.select(F.col("center").alias("x"), F.col("a").alias("y"))


def similar_classes(nodes: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """``nid, component`` of the nodes (``nid, fp`` and ``nid, text``) that have a link; no pair of the similarity is lost."""
    links, judged = fingerprint_links(nodes, texts, n, similarity)
    joined = materialize(_named(links))
    first = materialize(prefixes(texts, n, similarity, frequent(texts, n)))
    signs = materialize(first.filter("pos = 0").select("nid", "size", "bits"))
    narrow = materialize(narrowed(signs))
    shared = first.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("key")
    members = materialize(first.select("nid", "size", "key", "pos").join(shared, "key"))
    discard(first)
    shared_by, members = members, _open(members, joined)
    discard(shared_by, joined)
    for turn in range(STARS):
        draw = F.struct(F.xxhash64("nid", F.lit(turn)).alias("draw"), "nid", "size", "pos", "component")
        center = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("c")).filter(F.col("n") > 1).select(
            "key", F.col("c.nid").alias("center"), F.col("c.size").alias("c_size"), F.col("c.pos").alias("c_pos"), F.col("c.component").alias("c_component"))
        dealt = materialize(members.join(center, "key"))
        discard(members)
        proposed = star_pairs(dealt, similarity).withColumns({"x": F.least("a", "center"), "y": F.greatest("a", "center")})
        proposed = materialize(proposed.join(judged, ["x", "y"], "left_anti"))
        pairs = materialize(near_bitmaps(proposed.select("a", "center"), signs, similarity))
        found = materialize(similar_links(pairs, texts, n, similarity))
        discard(pairs)
        judged, links = judged.union(proposed.select("x", "y")), links.union(found)
        named = materialize(_named(links))
        members = _open(dealt.filter(F.col("nid") != F.col("center")).select("nid", "size", "key", "pos"), named)      # a key is done with its center
        discard(dealt, named)
    pairs = materialize(other_pairs(members.join(narrow, "nid"), similarity))
    discard(members, narrow)
    pairs = pairs.withColumns({"x": F.least("a", "center"), "y": F.greatest("a", "center")}).join(judged, ["x", "y"], "left_anti").select("a", "center")
    pairs = materialize(near_bitmaps(pairs, signs, similarity))
    discard(signs)
    found = materialize(similar_links(pairs, texts, n, similarity))
    return _named(links.union(found))


def _open(members: DataFrame, named: DataFrame) -> DataFrame:
    """The members with their component, of the keys whose members are not yet all in one."""
    rest = members.join(named, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    open_ = rest.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter(F.col("x") < F.col("y")).select("key")
    return materialize(rest.join(open_, "key"))


def _named(links: DataFrame) -> DataFrame:
    """``nid, component`` of the ends of links."""
    ends = links.select(F.col("src").alias("node_id")).union(links.select(F.col("dst").alias("node_id"))).distinct()
    return connected_components(ends, links).select(F.col("node_id").alias("nid"), "component")


def keep_first(docs: DataFrame, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that a near-duplicate of smaller id makes superfluous.

    Near-duplicates have ``similarity`` (Jaccard, of their distinct shingles) or more, directly or over others; none is missed.  Of each group the row with
    the smallest id stays (no id: last; one id: by text hash; equal rows: one).  Texts of the same set of shingles are one node;
    texts without words are one group.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    prints = materialize(digested(docs, n))
    nodes = prints.groupBy("node").agg(F.min(order).alias("low"), F.max("worded").alias("worded"), F.min("fp").alias("fp"))
    nodes = materialize(nodes.withColumn("nid", F.monotonically_increasing_id()).drop("node"))
    own = id_text(docs).withColumn("row", F.xxhash64("text"))
    texts = materialize(own.join(nodes.filter("worded").select("nid", F.col("low.doc_id").alias("id"), "low.row"), "row")
                        .filter(F.col("doc_id").eqNullSafe(F.col("id"))).select("nid", "text"))
    discard(prints)
    named = similar_classes(nodes.filter("worded").select("nid", "fp"), texts, n, similarity)
    stay = (nodes.select("nid", "low").join(named, "nid", "left").groupBy(F.coalesce("component", "nid").alias("component"))
            .agg(F.min("low").alias("low")).select(F.col("low.none").alias("__none"), F.coalesce("low.doc_id", F.lit(0)).alias("__id"), F.col("low.row").alias("__row")))
    stay = materialize(stay)
    discard(nodes, texts)
    key = ["__none", "__id", "__row"]
    keyed = docs.withColumns({"__none": docs["doc_id"].cast("bigint").isNull(), "__id": F.coalesce(docs["doc_id"].cast("bigint"), F.lit(0)),
                              "__row": F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))})
    # the window takes the join's own three columns, so that the texts are shuffled once
    once = Window.partitionBy(*key).orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))))
    return keyed.join(stay, key, "left_semi").withColumn("__n", F.row_number().over(once)).filter(F.col("__n") == 1).select(*docs.columns)
