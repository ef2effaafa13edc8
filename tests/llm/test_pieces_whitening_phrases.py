import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from edgeloom.llm import collocations as C
from edgeloom.llm import feast_whitening as W
from edgeloom.llm import piece_backtrack

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# ------------------------------------------------------------------ pieces
@pytest.fixture(scope="module")
def codec():
    return piece_backtrack.codec(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def same(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode(text, add_bos=True, add_eos=True)
    assert codec.decode(ids) == library.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(codec, library, text):
    same(codec, library, text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aehinorst ñé.,\n▁", max_size=60))
def test_words_and_space_marks(codec, library, text):
    same(codec, library, text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=14))
def test_decode_of_any_ids(codec, library, ids):
    assert codec.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "x" * 70_000, " " * 5000, "thethe" * 4000, "a\x00b", "<s> </s> <0x41>", "😀漢" * 500])
def test_long_and_odd_texts(codec, library, text):
    same(codec, library, text)


def test_caches_change_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(piece_backtrack, "MAX_WORDS", 2)
    monkeypatch.setattr(piece_backtrack, "MAX_FITS", 3)
    with open(MODEL, "rb") as file:
        small = piece_backtrack.Codec(piece_backtrack.Model(file.read()))
    same(small, library, "reinterpretations of unbelievable straightforwardness, überraschenderweise größtenteils missverständlich " * 3)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        piece_backtrack.Model(b"")


def test_pieces_over_tables(spark, docs, odd, library):
    rows = piece_backtrack.round_trip(docs(odd), MODEL).collect()
    def want(d, t):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        packed = np.array(ids, "<u4").tobytes()
        return str((d, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(str(tuple(r)) for r in rows) == sorted(want(d, t) for d, t in odd)
    back = piece_backtrack.decode(piece_backtrack.encode(docs(odd), MODEL), MODEL).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in back) == sorted(str((d, t or "")) for d, t in odd)
    assert piece_backtrack.round_trip(docs([]), MODEL).count() == 0


# ------------------------------------------------------------------ whitening
def cases():
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    yield from (np.cov(rng.standard_normal((500, d)).T, bias=True).reshape(d, d) for d in (1, 2, 5, 9, 64))
    yield np.cov((rng.standard_normal((500, 40)) * np.geomspace(1e5, 1, 40)).T, bias=True)
    yield np.cov(rng.standard_normal((5, 20)).T, bias=True)                # rank four
    yield (turn * np.r_[[5] * 3, [4] * 3, [3] * 6, np.ones(18)]) @ turn.T  # equal eigenvalues, also round the eighth
    yield np.eye(12)


@pytest.mark.parametrize("matrix", cases())
def test_components_of_matrices(matrix):
    values, vectors = W.leading_components(matrix, 8)
    true = np.linalg.eigvalsh(matrix)[::-1]
    expected = min(8, int((true > 1e-9 * true[0]).sum()))
    assert len(values) == expected and np.allclose(values, true[:expected], rtol=1e-12)
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * true[0]
    assert np.abs(vectors.T @ vectors - np.eye(expected)).max() < 1e-11


def test_inertia_counts_and_missed_eigenvalues():
    rng = np.random.default_rng(5)
    m = np.cov(rng.standard_normal((90, 20)).T)
    true = np.linalg.eigvalsh(m)
    for shift in np.linspace(0, true[-1] * 1.1, 30):
        assert W.above(m, shift) == (true > shift).sum()
    with pytest.raises(ArithmeticError):
        W.eigenpairs_between(m, true[-3] * 1.0001, true[-1] * 1.1, 3)      # two are there, three are asked for
    assert W.leading_components(np.zeros((4, 4)))[0].size == 0


def test_whitening_over_a_table(spark):
    rng = np.random.default_rng(6)
    data = [(i, [float(x) for x in rng.standard_normal(12) * np.arange(1, 13)]) for i in range(300)]
    data += [data[0], data[0], (None, data[1][1])]                         # repeats and no id count
    odd = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, [1.0, 2.0]), (905, []), (906, [1e300] * 12)]
    df = spark.createDataFrame([(i, v, 1) for i, v in data + odd], "vec_id bigint, embedding array<double>, n int")
    rows = W.whiten(df).collect()
    x = np.floor(1024 * np.array([v for _, v in data])).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    e, w = np.linalg.eigh(centred.T @ centred / n)
    e, w = e[::-1][:8], w[:, ::-1][:, :8]
    want = np.abs(centred @ w / np.sqrt(e))
    assert len(rows) == n * 8
    deviation = ((n * x - s) ** 2).sum(axis=1)
    place = {i: k for k, (i, _) in enumerate(data)}
    for r in rows:
        at = place[r["vec_id"]]
        c = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[at] and abs(abs(r["whitened"]) - want[at, c]) < 1e-8
        assert abs(r["explained"] / (e[c] / np.trace(centred.T @ centred / n)) - 1) < 1e-9 and r["identity_error"] < 1e-10
    got = np.array([[r["whitened"] for r in rows if r["component"] == c] for c in range(1, 9)])
    assert np.abs(np.cov(got, bias=True) - np.eye(8)).max() < 1e-9


def test_whitening_of_empty_single_and_equal_vectors(spark):
    schema = "vec_id bigint, embedding array<double>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)]):
        assert W.whiten(spark.createDataFrame(rows, schema)).count() == 0


def test_deviation_beyond_a_long():
    x = np.array([[1 << 40], [-(1 << 40)]])
    assert W._deviation(x, 4, [0]) == [None, None] and W._deviation(x >> 20, 4, [4]) == [(4 * (1 << 20) - 4) ** 2, (4 * (1 << 20) + 4) ** 2]


# ------------------------------------------------------------------ phrases
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-1, 6), max_size=60), st.sampled_from([2, 3, 4]), st.sampled_from([3, 9, 17, 32]), st.integers(0, 5))
def test_filters_lose_nothing(numbers, n, word_bits, shard_bits):
    spread = np.array([x if x < 0 else (x * 2654435761) % (1 << word_bits) for x in numbers], np.int64)
    bits = C.parts_of(n, word_bits)
    left, right = C.pack(spread, n, word_bits)
    moved = C.permute(left, right, *bits)
    assert all((a == b).all() for a, b in zip(C.unpermute(*moved, *bits), (left, right)))
    assert all(int(m.max(initial=0)) < 1 << b for m, b in zip(moved, bits))
    whole = C.QuotientFilter.count(*moved, bits)
    parts = [C.QuotientFilter.unpacked(p, bits) for _, p in whole.shards(shard_bits)]
    if parts:
        merged = C.QuotientFilter.merge(parts + parts)
        got = {tuple(k): c for k, c in zip(C.unpack(*C.unpermute(merged.left, merged.right, *bits), n, word_bits).tolist(), merged.counts.tolist())}
    else:
        got = {}
    plain = [tuple(spread[i:i + n].tolist()) for i in range(len(spread) - n + 1) if (spread[i:i + n] >= 0).all()]
    assert got == {k: 2 * v for k, v in Counter(plain).items()}


def test_large_counts_and_crowded_quotients():
    bits = (8, 40)
    left, right = np.full(700, 7, np.uint64), np.arange(700, dtype=np.uint64)
    counts = np.arange(1, 701) * 10 ** 9
    one = C.QuotientFilter(left, right, counts, bits)
    (_, data), = one.shards(3)
    back = C.QuotientFilter.unpacked(data, bits)
    assert (back.left == left).all() and (back.right == right).all() and (back.counts == counts).all()


def brute(rows, least, best):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i:i + m])] += 1
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(g == lang and len(q) > len(p) and c >= least and 100 * c >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), c in f.items())
        if not inside:
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:best]
        ranked += [(o[0], i + 1, *o[1:]) for i, o in enumerate(own)]
    return sorted(ranked)


def phrase_table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x") for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string, n int, phrase string")


def test_collocations_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    words = ["Alpha", "beta", "Γάμα", "delta", "é", "of", "the", "new x", "漢字"]
    rows = [(lang, "".join(rng.choice(words, p=np.array([9, 7, 5, 3, 3, 9, 9, 1, 1]) / 47) + rng.choice([" ", "  ", "\t", ", ", ".\n", "\x0b"], p=[.7, .1, .1, .05, .03, .02]) for _ in range(120)))
            for lang in ("en", None, "fr", "und") for _ in range(6)]
    rows += [("en", "Deep in the old forest stream. " * 20)] * 3 + [("en", None), (None, ""), ("de", "  \n .. "), ("de", "solo"), ("fr", "beta " * 3000)]
    for settings_ in ({}, {"chunk_words": 50, "filter_entries": 30, "shard_entries": 40}):
        got = C.collocations(phrase_table(spark, rows), least=5, best=40, **settings_).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, 5, 40)


def test_collocations_of_nothing(spark):
    for rows in ([], [("en", None)], [("en", "one two three")]):
        assert C.collocations(phrase_table(spark, rows)).count() == 0
