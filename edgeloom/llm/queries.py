"""Registered queries of the training-data operators: each over its whole table, with production parameters."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import (bpe_fst, collocations, feast_whitening, fingerprints, line_dedup, lm_scoring, packing, piece_backtrack, pii, quality,
                          simhash_vptree, substring, vafile)
from edgeloom.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op3_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_vptree.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str, ranks: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) -> DataFrame:
    return bpe_fst.round_trip(table(spark, sf_dir, "documents"), ranks)


def op7_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vafile.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller id holds already; one row a passage, with the documents it is first found in."""
    return substring.repeated_runs(table(spark, sf_dir, "documents")).drop("row")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as good; background: all documents."""
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select("doc_id")
    return lm_scoring.score(docs, good)


def op10_packing(spark: SparkSession, sf_dir: str, tokenizer: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer, cached_words=800_000)


def op11_pieces(spark: SparkSession, sf_dir: str, model: str = public_tokenizers.path("piece_bpe_32k.model")) -> DataFrame:
    return piece_backtrack.round_trip(table(spark, sf_dir, "documents"), model)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feast_whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op1_quality": op1_quality, "op2_pii": op2_pii, "op3_simhash_vptree": op3_simhash_vptree, "op4_line_dedup": op4_line_dedup,
           "op5_fingerprints": op5_fingerprints, "op6_bpe": op6_bpe, "op7_vafile": op7_vafile, "op8_substring": op8_substring, "op9_lm_scoring": op9_lm_scoring, "op10_packing": op10_packing,
           "op11_pieces": op11_pieces, "op12_whitening": op12_whitening, "op13_collocations": op13_collocations}

_LINE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, u.line, u.pos, translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
 FROM docs, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u),
held AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT l.doc_id, l.line, l.pos, h.first IS NOT NULL AND h.first <> l.doc_id AS gone FROM lines l LEFT JOIN held h ON h.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id
"""
_SEARCH_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e, len(embedding) AS d FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(e) AS e, any_value(d) AS d FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM q JOIN v ON v.vec_id <> q.vec_id AND v.d = q.d),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
_PHRASE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
grams AS (SELECT lang, 1 AS m, unnest(w) AS phrase FROM lists
 UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists
 UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM lists
 UNION ALL SELECT lang, 4, unnest(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) FROM lists),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
many AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 30),
ways AS (SELECT *, unnest(range(1, m)) AS k FROM many),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM ways),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, ((2000000::HUGEINT * c.a) // (h.f + t.f))::BIGINT AS score
 FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sizes AS (SELECT lang, a, w, m, unnest(range(2, m)) AS s FROM many),
places AS (SELECT lang, a, w, s, unnest(range(1, m - s + 2)) AS i FROM sizes),
inner_ AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer FROM places GROUP BY ALL),
kept AS (SELECT x.* FROM worst x LEFT JOIN inner_ i ON i.lang = x.lang AND i.phrase = x.phrase WHERE i.longer IS NULL OR 100 * i.longer < 80 * x.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::INTEGER AS rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
ORACLES = {"op7_vafile": _SEARCH_SQL, "op4_line_dedup": _LINE_SQL, "op13_collocations": _PHRASE_SQL}
