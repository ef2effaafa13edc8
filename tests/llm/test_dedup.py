import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from edgeloom.llm import fingerprints, line_dedup, simhash_vptree, substring
from edgeloom.llm.line_dedup import PerfectHash


# ------------------------------------------------------------------ SimHash and vantage-point trees
def _fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    own = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def _components(rows, linked):
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[i], rows[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    low = defaultdict(lambda: None)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = doc if low[find(i)] is None else min(low[find(i)], doc)
    return [low[find(i)] for i in range(len(rows))]


def test_fingerprint_is_the_stated_one(odd):
    texts = [t for _, t in odd] + ["A B\tC\nd e F\x0bg", "aA bB", "İX ſ Kelvin K", "\x1c\x85\xa0 x y z"]
    got = simhash_vptree.fingerprints_of([t or "" for t in texts])
    assert [int(g) for g in got] == [_fingerprint(t) for t in texts]


def test_shingle_hash_is_spark_xxhash64(spark):
    s = "the three words"
    assert spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] == np.uint64(xxhash.xxh64_intdigest(s.encode(), 42)).astype(np.int64)


@pytest.mark.parametrize("radius", [0, 2, 3])
def test_routes_bring_every_close_pair_together(radius):
    rng = np.random.default_rng(radius)
    fp = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = fp[:1500].copy()
    for _ in range(radius):
        near ^= np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)
    both = np.concatenate((fp, near))
    point, mu = simhash_vptree.build_routes(both[:500], 5)
    row, shard = simhash_vptree.route(both, point, mu, radius)
    where = defaultdict(set)
    for r, s in zip(row, shard):
        where[r].add(s)
    assert all(where[i] & where[3000 + i] for i in range(1500)) and set(where) == set(range(4500))


@pytest.mark.parametrize("kind", ["spread", "dense"])
def test_forest_joins_what_brute_force_joins(kind):
    rng = np.random.default_rng(5)
    if kind == "spread":
        fp = rng.integers(0, 1 << 63, 2500, dtype=np.uint64)
        fp = np.concatenate((fp, fp[:400] ^ np.uint64(5), fp[:200] ^ np.uint64(1 << 40)))
    else:                                                  # a ball: every split leaves most of it on both sides
        fp = np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, (3000, 3)).astype(np.uint64)).sum(1).astype(np.uint64)
    fp = np.unique(fp)
    a, b = simhash_vptree.link(fp, 2)
    want = simhash_vptree._Forest(len(fp))
    want.join(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2))
    got = simhash_vptree._Forest(len(fp))
    got.join(np.searchsorted(fp, a), np.searchsorted(fp, b))
    every = np.arange(len(fp))
    assert np.array_equal(want.roots(every), got.roots(every))


def test_near_duplicates_against_brute_force(spark, docs, odd):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    rows = list(odd)
    for i in range(60):
        base = list(rng.choice(words, 400))
        rows.append((100 + 3 * i, " ".join(base)))
        base[int(rng.integers(400))] = "other"
        rows.append((99 + 3 * i, " ".join(base)))
    got = simhash_vptree.near_duplicates(docs(rows)).collect()
    fps = [(d, _fingerprint(t)) for d, t in rows]
    want = _components(fps, lambda a, b: (a[1] ^ b[1]).bit_count() <= 2)
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in got) == sorted(
        (str(d), f, str(c)) for (d, f), c in zip(fps, want))
    assert len({r["component_id"] for r in got}) < len(rows) - 20
    assert simhash_vptree.near_duplicates(docs([])).count() == 0


def test_keep_first_keeps_one_of_each_group(spark, docs, odd):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(4000)]
    rows, stay = [], set()
    for g in range(25):
        base = list(rng.choice(words, 300))
        stay.add(1000 + 10 * g)
        for k in range(6):
            own = list(base)
            if k:                                          # one word in 300 replaced: similarity above 0.8
                own[int(rng.integers(300))] = f"new{g}{k}"
            rows.append((1000 + 10 * g + k, " ".join(own)))
    out = simhash_vptree.keep_first(docs(rows))
    assert out.columns == docs(rows).columns and {r["doc_id"] for r in out.collect()} == stay
    left = [(r["doc_id"], r["text"]) for r in simhash_vptree.keep_first(docs(odd)).collect()]
    assert len(left) == len(set(left)) and sum(not (t or "").strip() for _, t in left) == 1
    assert [d for d, t in left if t == "the same text of a few words"] == [4] and (None, "a text without id") in left


def test_keep_first_tiles_a_hot_shard(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash_vptree, "TILE", 16)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(120):
        own = list(base)
        own[k] = f"n{k}"
        rows.append((k, " ".join(own)))
    assert [r["doc_id"] for r in simhash_vptree.keep_first(docs(rows)).collect()] == [0]


def _jaccard(a, b):
    a, b = (set(simhash_vptree.shingles(t, 5)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_keep_first_equals_brute_force_similarity(spark, docs):
    """Pairs on both sides of 0.8: one document of a pair goes exactly if its similarity is at least 0.8."""
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(6000)]
    rows, gone = [], set()
    for g in range(150):
        base = list(rng.choice(words, 200))
        own = list(base)
        for i in rng.choice(200, int(rng.integers(1, 14)), replace=False):
            own[int(i)] = f"x{g}y{i}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(own))]
        if _jaccard(rows[-1][1], rows[-2][1]) >= 0.8:
            gone.add(2 * g + 1)
    assert 20 < len(gone) < 130
    kept = {r["doc_id"] for r in simhash_vptree.keep_first(docs(rows)).collect()}
    assert {d for d, _ in rows} - kept == gone


def test_keep_first_keeps_different_texts_of_one_fingerprint(spark, docs):
    """A row repeated 100 times decides all fingerprint bits; the texts share nothing else."""
    rng = np.random.default_rng(23)
    row = " ".join(["total of the sum in this table"] * 100)
    rows = [(d, row + " " + " ".join(f"w{i}" for i in rng.integers(0, 10_000, 200))) for d in range(12)]
    assert len(set(simhash_vptree.fingerprints_of([t for _, t in rows], 5))) < 6
    assert max(_jaccard(a, b) for d, a in rows for e, b in rows if d < e) < 0.2
    assert {r["doc_id"] for r in simhash_vptree.keep_first(docs(rows)).collect()} == set(range(12))


@pytest.mark.parametrize("size", [600, 3000])
def test_keep_first_judges_long_texts_exactly(spark, docs, size):
    rng = np.random.default_rng(size)
    rows, gone, near = [], set(), 0
    for g in range(60):
        base = [f"w{i}" for i in rng.integers(0, 1_000_000, size)]
        own, edits = list(base), rng.choice(size // 5, int(size * rng.uniform(0.020, 0.026)), replace=False) * 5
        for i in edits:
            own[int(i)] = f"x{g}y{i}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(own))]
        near += abs(_jaccard(rows[-1][1], rows[-2][1]) - 0.8) < 0.02
        if _jaccard(rows[-1][1], rows[-2][1]) >= 0.8:
            gone.add(2 * g + 1)
    assert 10 < len(gone) < 50 and near > 20
    kept = {r["doc_id"] for r in simhash_vptree.keep_first(docs(rows)).collect()}
    assert {d for d, _ in rows} - kept == gone


def test_keep_first_links_equal_sets_nearly_and_texts_of_other_repeats(spark, docs):
    """One row stands 2 times in one text and 60 times in the other, one word differs: far fingerprints, similarity above 0.8."""
    rng = np.random.default_rng(24)
    rows = []
    for g in range(20):
        base, row = [f"w{i}" for i in rng.integers(0, 100_000, 200)], [f"r{g}x{i}" for i in range(7)]
        rows += [(2 * g, " ".join(row * 2 + base)), (2 * g + 1, " ".join(row * 60 + base[:-1] + ["other"]))]
    assert all(_jaccard(rows[2 * g][1], rows[2 * g + 1][1]) >= 0.9 for g in range(20))
    assert {r["doc_id"] for r in simhash_vptree.keep_first(docs(rows)).collect()} == set(range(0, 40, 2))


def test_other_pairs_keep_every_similar_pair(spark):
    """Bitmaps are signed longs in the tables: their bits are counted as they are, not those of the absolute values."""
    rng = np.random.default_rng(25)
    rows, want = [], set()
    for g in range(40):
        base = rng.integers(0, 1 << 63, 396).astype(np.uint64)
        other = np.concatenate((base[40:], rng.integers(0, 1 << 63, 40).astype(np.uint64)))            # similarity 0.816
        signs = simhash_vptree.bitmaps([np.unique(base), np.unique(other)]).view(np.int64).tolist()
        rows += [(2 * g + i, 396, g, 40, 2 * g + i, signs[i]) for i in (0, 1)]
        want.add((2 * g + 1, 2 * g))
    members = spark.createDataFrame(rows, "nid bigint, size int, key bigint, pos int, component bigint, bits array<bigint>")
    assert {(r["a"], r["center"]) for r in simhash_vptree.other_pairs(members, 0.8).collect()} == want


def test_keep_first_takes_its_nodes_through_the_trees(spark, docs, monkeypatch):
    """Links within the radius come from fingerprints of the sets of shingles, whatever the texts repeat, and hold at similarity 0.8."""
    rng = np.random.default_rng(26)
    rows = []
    for g in range(30):
        base, row = [f"w{i}" for i in rng.integers(0, 1_000_000, 300)], [f"r{g}x{i}" for i in range(7)]
        rows += [(2 * g, " ".join(row * 2 + base)), (2 * g + 1, " ".join(row * 60 + base[:-1] + ["other"]))]
    prints = [simhash_vptree.set_fingerprint(simhash_vptree._hashes(t, 5)) for _, t in rows]
    near = {g for g in range(30) if (prints[2 * g] ^ prints[2 * g + 1]).bit_count() <= simhash_vptree.RADIUS and prints[2 * g] * prints[2 * g + 1] >= 0}
    nodes = spark.createDataFrame([(d, f) for (d, _), f in zip(rows, prints)], "nid bigint, fp bigint")
    texts = spark.createDataFrame(rows, "nid bigint, text string")
    links, judged = simhash_vptree.fingerprint_links(nodes, texts, 5, 0.8)
    assert len(near) > 10 and near <= {r["dst"] // 2 for r in links.collect()}
    assert all(r["src"] == r["dst"] + 1 and r["dst"] % 2 == 0 for r in links.collect()) and judged.count() >= links.count()
    seen, classes = [], simhash_vptree.classes
    monkeypatch.setattr(simhash_vptree, "classes", lambda nodes, *a, **k: seen.append(nodes.count()) or classes(nodes, *a, **k))
    assert {r["doc_id"] for r in simhash_vptree.keep_first(docs(rows)).collect()} == set(range(0, 60, 2)) and seen == [len(set(prints))]


def test_similarity_is_exact_for_texts_of_any_length():
    rng = np.random.default_rng(22)
    for size in (300, 20_000):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        b = np.concatenate((a[:int(size * 0.8)], rng.integers(0, 1 << 63, size // 5, dtype=np.uint64)))
        sa, sb = simhash_vptree.sketch_of(a), simhash_vptree.sketch_of(b)
        got = simhash_vptree.jaccard(sa, np.concatenate((sb, sa)), np.array([0, len(sb)]), np.array([len(sb), len(sb) + len(sa)]))
        assert got[1] == 1 and abs(got[0] - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 1e-12


def test_bitmaps_never_tell_similar_sets_apart():
    rng = np.random.default_rng(25)
    for size in (5, 60, 900, 6000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for share in (0.8, 0.85, 0.95, 1.0):
            b = np.unique(np.concatenate((a[:int(np.ceil(size * share))], rng.integers(0, 1 << 63, int(size * (1 - share)), dtype=np.uint64))))
            one, two = simhash_vptree.bitmaps([a, b])
            apart = int(np.bitwise_count(one ^ two).sum())
            assert apart <= len(np.setxor1d(a, b))
            if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                assert apart <= simhash_vptree.most_apart(len(a), len(b), 0.8)


def test_wide_bitmaps_tell_long_texts_apart(spark):
    """Long texts fill a bitmap of 2,048 bits, so that it says nothing; theirs grow with them, and differing widths meet."""
    rng = np.random.default_rng(27)
    rows, want = [], set()
    for g in range(6):
        base = [f"w{i}" for i in rng.integers(0, 1_000_000, 4000 + 90 * g)]                 # widths of 8,192 and 16,384 bits
        near = base[:-300] + [f"n{i}" for i in rng.integers(0, 1_000_000, 300)]
        half = base[:2000] + [f"h{i}" for i in rng.integers(0, 1_000_000, len(base) - 2000)]
        rows += [(3 * g, " ".join(base)), (3 * g + 1, " ".join(near)), (3 * g + 2, " ".join(half))]
    texts = spark.createDataFrame(rows, "nid bigint, text string")
    signs = simhash_vptree.prefixes(texts, 5, 0.8, np.empty(0, np.uint64)).filter("pos = 0").select("nid", "size", "bits")
    sets = [set(simhash_vptree._hashes(t, 5).tolist()) for _, t in rows]
    want = {(a, c) for a in range(18) for c in range(a) if len(sets[a] & sets[c]) >= 0.8 * len(sets[a] | sets[c])}
    pairs = spark.createDataFrame([(a, c) for a in range(18) for c in range(a)], "a bigint, center bigint")
    assert {(r["a"], r["center"]) for r in simhash_vptree.near_bitmaps(pairs, signs, 0.8).collect()} == want and len(want) == 6


def test_only_the_texts_of_judged_pairs_are_shuffled(spark):
    """Few pairs send their numbers to the texts; before, each round dealt all texts anew."""
    texts = spark.range(3000).selectExpr("id AS nid", "concat(id, ' a b c d e f g h') AS text")
    pairs = spark.createDataFrame([(i + 1, i) for i in range(0, 40, 2)], "a bigint, center bigint")
    links = simhash_vptree.similar_links(pairs, texts, 5, 0.8)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "BroadcastHashJoin" in links._jdf.queryExecution().executedPlan().toString()
    assert simhash_vptree.similar_links(pairs, texts, 1, 0.8).count() == 20


# ------------------------------------------------------------------ lines
@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    keys = np.unique(keys)
    mph = PerfectHash.load(PerfectHash.build(keys).dump())
    assert np.array_equal(np.sort(mph.slots(keys)), np.arange(len(keys)))
    other = np.random.default_rng(n + 1).integers(0, 1 << 63, 100, dtype=np.uint64)
    assert (mph.slots(other) < max(1, len(keys))).all()


def test_perfect_hash_keeps_what_levels_cannot_place(monkeypatch):
    monkeypatch.setattr(PerfectHash, "LEVELS", 1)
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64))
    mph = PerfectHash.load(PerfectHash.build(keys).dump())
    assert len(mph.rest) and np.array_equal(np.sort(mph.slots(keys)), np.arange(len(keys)))


def _lines(rows):
    own = [(i, (1 << 63) - 1 if d is None else d, (t or "").split("\n")) for i, (d, t) in enumerate(rows)]

    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for _, d, lines in own:
        for line in lines:
            held[key(line)].add(d)
    out = []
    for i, d, lines in own:
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == d]
        out.append((str(rows[i][0]), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


def test_lines_against_brute_force(spark, docs, odd):
    rng = np.random.default_rng(4)
    shared = [f"A shared line number {i}" for i in range(8)] + ["éééééééééé", "short", "ééééééééé", "ten chars!"]
    rows = list(odd)
    for d in range(80):
        lines = [str(rng.choice(shared)) if rng.random() < 0.6 else f"own line {d} {k} of it" for k in range(int(rng.integers(0, 9)))]
        rows.append((200 + int(d), "\n".join(x.upper() if rng.random() < 0.3 else " " + x + "\r" if rng.random() < 0.3 else x for x in lines)))
    want = _lines(rows)
    got = line_dedup.line_report(docs(rows)).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == sorted(w[:4] for w in want)
    out = line_dedup.drop_repeated_lines(docs(rows))
    assert out.columns == docs(rows).columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect()) == sorted((w[0], w[4]) for w in want)
    assert line_dedup.line_report(docs([])).count() == 0


# ------------------------------------------------------------------ fingerprints
def test_edited_texts_and_order(spark, docs):
    rows = [(5, "five five five words"), (1, "one text é 😀 odd"), (9, None), (3, ""), (7, "seven and seven more words"), (None, "no id at all"), (3, "again three")]
    got = fingerprints.edited_fingerprints(docs(rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    texts = {d: t or "" for d, t in rows if d != 3}
    for d, after in ((5, 7), (7, 9)):
        t, n = texts[d], texts[after]
        half = len(t) // 2
        assert by[d, len(t)]["edited_sha256"] == hashlib.sha256((t[:len(t) - half] + n[:half]).encode()).hexdigest()
    last, first = order[-1][1], "one text é 😀 odd"
    assert by[None, len(last)]["edited_sha256"] == hashlib.sha256((last[:6] + first[:6]).encode()).hexdigest()
    assert all(0 <= r["near_edited"] <= 1 and len(r["fingerprint"]) == 16 for r in got)
    alone = fingerprints.edited_fingerprints(docs([(1, "just one text here")])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(docs([])).count() == 0


def test_equal_texts_have_equal_fingerprints_and_all_rows_return(spark, docs):
    rows = [(i, "the same words here and there" if i % 3 else f"text {i} of its own kind") for i in range(500)]
    got = fingerprints.edited_fingerprints(docs(rows)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(500))
    assert len({r["fingerprint"] for r in got if r["doc_id"] % 3}) == 1
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    for r in got:
        after = prints[(r["doc_id"] + 1) % 500]
        assert r["near_next"] == 1 - (prints[r["doc_id"]] ^ after).bit_count() / 64


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_block_tables_find_all_within_radius(spark, radius):
    rng = np.random.default_rng(radius)
    fp = rng.integers(-(1 << 63), (1 << 63) - 1, 200)
    flips = [int(f) ^ int(sum({1 << int(b) for b in rng.integers(0, 63, int(rng.integers(1, 5)))})) for f in fp]
    every = sorted({int(f) for f in fp} | set(flips))
    df = spark.createDataFrame([(f,) for f in every] + [(None,), (every[0],)], "fingerprint bigint")
    got = {(r[0], r[1], r[2]) for r in fingerprints.within_radius(df, df, radius).collect()}
    want = {(a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for a in every for b in every if a != b}
    assert got == {w for w in want if w[2] <= radius}


def test_fingerprints_stay_in_the_jvm(spark, docs):
    plan = fingerprints.edited_fingerprints(docs([(1, "a b"), (2, "c d")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ------------------------------------------------------------------ substrings
def test_cuts_cover_and_resist_insertions():
    text = " ".join(f"wörd{(i * i) % 997}" for i in range(4000)).encode()
    ends = substring.cut_points(text)
    assert ends[-1] == len(text) and all(b > a for a, b in zip(ends, ends[1:]))
    pieces = {text[a:b] for a, b in zip([0, *ends], ends)}
    assert b"".join(text[a:b] for a, b in zip([0, *ends], ends)) == text and all(len(p) <= substring.MOST + 3 for p in pieces)
    [p.decode() for p in pieces]
    moved = text[:9000] + b"inserted" + text[9000:]
    again = substring.cut_points(moved)
    other = {moved[a:b] for a, b in zip([0, *again], again)}
    assert len(pieces - other) <= 6
    assert substring.cut_points(b"") == [] and substring.cut_points(b"abc") == [3]


def test_passages_that_repeat_are_found_and_clean_texts_left(spark, docs, odd):
    rng = np.random.default_rng(8)

    def prose(n):
        return " ".join("".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9)))) for _ in range(n))
    passage, rows = prose(60), list(odd)
    for d in range(100, 140):
        own = prose(150)
        rows.append((d, own + (" " + passage + " " + prose(40) if d % 4 == 0 else "")))
    runs = substring.repeated_runs(docs(rows)).collect()
    assert {r["doc_id"] for r in runs if r["doc_id"] and r["doc_id"] >= 100} == {d for d in range(104, 140, 4)}
    texts = dict(r for r in rows if r[0] and r[0] >= 100)
    for r in runs:
        if r["doc_id"] and r["doc_id"] >= 100:
            assert texts[r["doc_id"]][r["start"]:r["end"]] in passage + " " or passage in texts[r["doc_id"]][r["start"] - 80:r["end"] + 80]
            assert r["first_doc_ids"] == [100]
    out = {r["doc_id"]: r["text"] for r in substring.drop_repeated(docs(rows)).collect() if r["doc_id"] and r["doc_id"] >= 100}
    assert out[101] == texts[101] and len(out[104]) < len(texts[104]) - 200
    assert substring.drop_repeated(docs(rows)).count() == len(rows) and substring.repeated_runs(docs([])).count() == 0


def test_every_passage_of_fifty_words_is_found_with_its_borders(spark, docs):
    """Passages of short words at 50 to 61 words in two contexts, and of 49; brute force over all windows of 50 words."""
    rng = np.random.default_rng(31)

    def prose(n):
        return ["".join(rng.choice(list("abcdefghijé"), int(rng.integers(1, 5)))) for _ in range(n)]
    rows = []
    for g in range(120):
        passage = prose(49 + g % 13)
        for k in range(2):
            rows.append((2 * g + k, "  ".join([" ".join(prose(30)), "\n".join([" ".join(passage), " ".join(prose(30))])])))
    holder, want = {}, set()
    for d, t in rows:
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", t)]
        hit = [i for i in range(len(words) - 49) if holder.setdefault(t[words[i][0]:words[i + 49][1]], d) < d]
        if hit:
            assert hit == list(range(hit[0], hit[-1] + 1))
            want.add((d, words[hit[0]][0], words[hit[-1] + 49][1], hit[-1] - hit[0] + 50))
    got = {(r["doc_id"], r["start"], r["end"], r["n_words"]) for r in substring.repeated_runs(docs(rows)).collect()}
    assert len(want) >= 110 and got == want


def test_anchor_keys_tell_anchors_apart():
    """Powers are whole numbers, and different anchors have different keys."""
    powers = substring._powers(substring._BASE, 40)
    assert powers.dtype == np.uint64 and [int(p) for p in powers] == [pow(substring._BASE, k, 1 << 64) for k in range(41)]
    rng = np.random.default_rng(44)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 50_000, 400)) for _ in range(60)]
    _, _, seqs, _, keys = substring.anchors_of([t.encode() for t in texts + texts[:5]], 50)
    distinct = {k for own in keys[:60] for k in own.tolist()}
    assert len(distinct) == sum(map(len, keys[:60]))
    assert all(np.array_equal(a, b) for a, b in zip(keys[60:], keys[:5]))
