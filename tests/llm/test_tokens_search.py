import codecs
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from edgeloom.llm import bpe_fst, lm_scoring, packing, vafile
from edgeloom.session import materialize

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------------ BPE
@pytest.fixture(scope="module")
def codec():
    return bpe_fst.Codec(bpe_fst.read_ranks(RANKS))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_fst.read_ranks(RANKS), special_tokens={})


def test_pattern_is_the_public_one():
    assert bpe_fst.PATTERN == public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text) and codec.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aehinorst ñé", max_size=60))
def test_words(codec, library, text):
    assert codec.encode(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "ab" * 3000, " " * 3000, "<|endoftext|>", "thethethethe" * 300, "ééñ" * 900])
def test_long_and_odd_texts(codec, library, text):
    assert codec.encode(text) == library.encode_ordinary(text)


def test_full_tables_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe_fst, "MAX_STATES", 5)
    monkeypatch.setattr(bpe_fst, "MAX_PIECES", 3)
    monkeypatch.setattr(bpe_fst, "MAX_PAIRS", 10)
    small = bpe_fst.Codec(bpe_fst.read_ranks(RANKS))
    text = "reinterpretations of unbelievable straightforwardness, überraschenderweise größtenteils missverständlich " * 3
    assert small.encode(text) == library.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.binary(max_size=40))
def test_utf8_machine(data):
    stream = bpe_fst.Utf8Stream()
    got = "".join(stream.feed(data[i:i + 1]) for i in range(len(data))) + stream.close()
    assert got == data.decode("utf-8", "replace")
    whole = codecs.getincrementaldecoder("utf-8")("replace")
    assert got == whole.decode(data, True)


def test_bpe_over_tables(spark, docs, odd, library):
    rows = bpe_fst.round_trip(docs(odd), RANKS).collect()
    assert sorted(str((r["doc_id"], r["n_tokens"])) for r in rows) == sorted(str((d, len(library.encode_ordinary(t or "")))) for d, t in odd)
    ids = [(d, ",".join(map(str, library.encode_ordinary(t or ""))), t or "") for d, t in odd]
    want = [(d, hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, i, t in ids]
    assert sorted(str((r["doc_id"], r["ids_sha256"], r["decoded_sha256"])) for r in rows) == sorted(map(str, want))
    coded = bpe_fst.encode(docs(odd), RANKS)
    back = bpe_fst.decode(coded, RANKS).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in back) == sorted(str((d, t or "")) for d, t in odd)
    assert bpe_fst.round_trip(docs([]), RANKS).count() == 0


# ------------------------------------------------------------------ packing
@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(1, 60))
def test_closest_subset_is_the_best(counts, capacity):
    used = packing.closest_subset(dict(counts), capacity)
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    assert all(0 < n <= counts[k] for k, n in used.items())
    assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= capacity)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=40))
def test_pieces_cover_and_fill(lengths):
    pieces = packing.pack_lengths(lengths, 64)
    held, filled = {}, {}
    for item, start, n, sequence, offset in pieces:
        held.setdefault(item, []).append((start, n))
        filled.setdefault(sequence, []).append((offset, n))
    assert len(held) == len(lengths)
    for parts, want in [(held[i], n) for i, n in enumerate(lengths)] + [(p, None) for p in filled.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert want is None and (at == 64 or at & (at - 1) == 0) or at == want


def test_packing_over_tables(spark, docs, odd):
    tokenizer = Tokenizer.from_file(WORDS)
    want = sorted(str((d, ids)) for d, ids in ((d, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in odd))
    rows = packing.pack(docs(odd), WORDS, with_ids=True).collect()
    seen, rebuilt = {}, []
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seen.values():
        total = sum(n for _, n in parts)
        assert total <= 4096 and (total == 4096 or total & (total - 1) == 0)
        assert sorted(parts)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
    unique = [r for r in rows if r["doc_id"] not in (4, 6, None)]            # rows with an id of their own
    by = {}
    for r in unique:
        by.setdefault(r["doc_id"], []).append(r)
    for d, parts in by.items():
        rebuilt.append(str((d, [i for r in sorted(parts, key=lambda r: r["start"]) for i in r["ids"]])))
    assert sorted(rebuilt) == [w for w in want if not w.startswith(("(4,", "(6,", "(None,"))]
    assert sum(r["length"] for r in rows) == sum(w.count(",") for w in want)
    assert packing.pack(docs([]), WORDS).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_word_cache_equals_the_tokenizer(text):
    own = packing._tokens(WORDS)
    assert np.frombuffer(own.encode([text, text.upper() + "., x."])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


# ------------------------------------------------------------------ search
def _brute(rows, wanted, k, scale=256.0):
    fine = [(i, np.floor(np.array(v, float) * scale)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q in wanted:
        mine = min((tuple(v) for i, v in fine if i == q), default=None)
        if mine is not None:
            best = sorted((-int(np.dot(v, mine)), i) for i, v in fine if i != q and len(v) == len(mine))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_search_is_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 12)]) for i in range(900)]
    rows += [(i, rows[i - 1000][1]) for i in range(1000, 1040)]               # ties
    rows += [(2000, None), (2001, [0.1] * 11 + [None]), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (None, [0.1] * 12), (2004, []),
             (2050, [0.5] * 7), (2100, [0.25] * 7), (2150, [1.0])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id bigint, embedding array<float>, score int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    wanted = df.filter("vec_id % 50 = 0")
    got = {tuple(r) for r in vafile.top_k(df, wanted, 5, block_vectors=100, block_queries=7).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == _brute(rows, [i for i, _ in rows if i is not None and i % 50 == 0], 5)
    assert vafile.top_k(df.limit(0), wanted.limit(0)).count() == 0


def test_search_reads_few_exact_vectors():
    rng = np.random.default_rng(1)
    exact = np.floor(rng.normal(0, 40, (4000, 16)))
    codes, low, high = vafile.approximate(exact)
    at = (np.arange(16)[None, :], codes)
    assert (low[at] <= exact).all() and (exact <= high[at]).all()
    file = {"ids": np.arange(4000, dtype="<i8").tobytes(), "codes": codes.tobytes(), "low": low.tobytes(), "high": high.tobytes(), "exact": exact.tobytes()}
    _, _, _, read = vafile.search_block(file, np.arange(20), exact[:20], 5)
    assert read < 20 * 4000 * 0.5


def test_search_beyond_doubles(spark):
    rows = [(0, [3e15, 1.0]), (1, [3e15, 2.0]), (2, [3e15, 3.0]), (3, [-3e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = vafile.top_k(df, df.filter("vec_id = 0"), 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got][2] == 3 and len(got) == 3


# ------------------------------------------------------------------ language models
def _slow_losses(texts, chosen):
    """Both mean losses of each text, by a dictionary of n-grams and one of contexts for each model."""
    order, marked = lm_scoring.ORDER, [b"\0" * lm_scoring.ORDER + t.encode() for t in texts]
    models = []
    for which in ([d for d, c in zip(marked, chosen) if c], marked):
        grams, contexts = Counter(), Counter()
        for d in which:
            for i in range(order, len(d)):
                for n in range(1, order + 1):
                    grams[d[i - n + 1:i + 1]] += 1
                    contexts[d[i - n + 1:i]] += 1
        models.append((grams, contexts))
    result = []
    for d in marked:
        means = []
        for grams, contexts in models:
            loss = 0.0
            for i in range(order, len(d)):
                p, weight = (grams[d[i:i + 1]] + 1) / (contexts[b""] + 256), lm_scoring.WEIGHTS[0]
                for n in range(2, order + 1):
                    seen = contexts[d[i - n + 1:i]]
                    share = lm_scoring.WEIGHTS[n - 1] / (weight + lm_scoring.WEIGHTS[n - 1]) * seen / (seen + 2.0)
                    p = (1 - share) * p + share * grams[d[i - n + 1:i + 1]] / max(seen, 1)
                    weight += lm_scoring.WEIGHTS[n - 1]
                loss -= np.log2(p)
            means.append(loss / max(1, len(d) - order))
        result.append(means)
    return result


def test_scores_equal_a_plain_count(spark, docs):
    rows = [(1, "the cat sat on the mat"), (2, "the cat and the hat"), (3, "zzz qqq zzz qqq"), (4, "ein großer Hund"), (5, None), (6, "")]
    target = spark.createDataFrame([(1,), (2,), (2,), (None,), (77,)], "doc_id bigint")
    got = {r["doc_id"]: r for r in lm_scoring.score(docs(rows), target).collect()}
    for (d, _), want in zip(rows, _slow_losses([t or "" for _, t in rows], [d in (1, 2) for d, _ in rows])):
        assert np.isclose(got[d]["target_loss"], want[0], atol=1e-5) and np.isclose(got[d]["background_loss"], want[1], atol=1e-5), d
    assert got[1]["score"] < 0 < got[3]["score"] and got[5]["score"] == got[6]["score"] == 0 and got[5]["n_tokens"] == 0


def test_scores_are_exact_however_many_ngrams(spark, docs):
    # 60,000 random bytes of 62 signs: nearly as many different n-grams, more than any text of words that long; in many blocks
    draw = np.random.default_rng(5)
    signs = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    rows = [(i, "".join(draw.choice(signs, 2_000))) for i in range(30)]
    target = spark.createDataFrame([(i,) for i in range(0, 30, 3)], "doc_id bigint")
    got = {r["doc_id"]: r for r in lm_scoring.score(docs(rows), target, block_bytes=5_000).collect()}
    for (d, _), want in zip(rows, _slow_losses([t for _, t in rows], [d % 3 == 0 for d, _ in rows])):
        assert got[d]["n_tokens"] == 2_000
        assert np.isclose(got[d]["target_loss"], want[0], atol=1e-5) and np.isclose(got[d]["background_loss"], want[1], atol=1e-5), d


def test_ngrams_of_windows_are_those_of_the_text():
    texts = ["the cat sat on the mat", "", "ein großer Hund", "x" * 50]
    whole = list(lm_scoring.grams(texts))
    assert len(whole) == 1
    for window in (1, 2, 7, 64):
        parts = list(lm_scoring.grams(texts, window))
        assert all((np.concatenate([p[i] for p in parts]) == whole[0][i]).all() for i in (0, 1))
    data = [b"\0" * lm_scoring.ORDER + t.encode() for t in texts]
    want = [int.from_bytes(d[i - lm_scoring.ORDER + 1:i + 1], "big") for d in data for i in range(lm_scoring.ORDER, len(d))]
    assert whole[0][0].tolist() == want and list(lm_scoring.grams([])) == []


def test_block_counts_are_one_row_a_block_and_ngram(spark, docs):
    """A hot id or text does not widen a block: blocks follow bytes; and the table of n-grams grows with what the texts hold."""
    rows = [(1, "a third of all rows has this text and id")] * 300 + [(i, f"other text {i * i}") for i in range(600)]
    marked = docs(rows).select("doc_id", "text").withColumn("is_target", F.col("doc_id") % 2 == 0)
    blocks = materialize(lm_scoring.in_blocks(marked, 2_000))
    sizes, held = Counter(), Counter()
    for r in blocks.collect():
        piece = lm_scoring._unpacked(bytes(r["rows"]))
        sizes[r["block"]] += sum(map(len, piece.column("text").to_pylist()))
        held.update(zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()))
    assert held == Counter(rows) and len(sizes) > 10 and max(sizes.values()) < 4_000
    found = lm_scoring.block_counts(blocks).groupBy("key").agg(F.sum("background").alias("n"), F.sum("target").alias("m")).collect()
    want, chosen = Counter(), Counter()
    for d, t in rows:
        raw = b"\0" * lm_scoring.ORDER + t.encode()
        own = [int.from_bytes(raw[i - lm_scoring.ORDER + 1:i + 1], "big") for i in range(lm_scoring.ORDER, len(raw))]
        want.update(own)
        chosen.update(own if d % 2 == 0 else [])
    assert {r["key"]: (r["n"], r["m"]) for r in found} == {k: (n, chosen[k]) for k, n in want.items()}


def test_scoring_odd_rows(spark, docs, odd):
    none = spark.createDataFrame([], "doc_id bigint")
    rows = lm_scoring.score(docs(odd), none).collect()
    assert len(rows) == len(odd) and all(np.isfinite(r["score"]) for r in rows)
    assert lm_scoring.score(docs([]), none).count() == 0
