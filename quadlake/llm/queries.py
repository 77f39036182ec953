"""The queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, jaccard, lm_scoring, media, packing, pii, quality, token_counts, toxicity, warc
from .common import table


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op2_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read_back(table(spark, sf_dir, "pages"))


def op4_token_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(table(spark, sf_dir, "documents"))


def op6_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op8_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.spans(docs, pii.learn(docs))


def op9_count_tree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_brown_lm, op2_swap_packing, op3_warc_index, op4_token_digest_cache, op5_repetition_coverage, op6_cnn_toxicity, op7_media_columns, op8_skip_chain_pii, op9_count_tree_jaccard, op10_segment_tree_bpe)}

_BASE32 = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1) for i in range(0, 32)], '')"

_SHINGLES = f"""CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {jaccard.SHINGLE} THEN [array_to_string(words, ' ')]
    ELSE [array_to_string(words[i:i + {jaccard.SHINGLE - 1}], ' ') for i in range(1, len(words) - {jaccard.SHINGLE - 2})] END"""


def _grams(n: int) -> str:
    """A row for each window of n words that has n words: its place, how often it stands in the text, which of them it is."""
    gram = " || ' ' || ".join(f"lead(word, {k}) OVER d" for k in range(n))
    return f"g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS copies, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) AS copy FROM (SELECT doc_id, i, {gram} AS gram FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY i)) WHERE gram IS NOT NULL)"


def _cover(n: int, test: str, total: str) -> str:
    """Of each text: `total` over the words that windows passing `test` cover."""
    return f"c{n} AS (SELECT doc_id, sum({total}) AS covered FROM (SELECT w.doc_id, size, max({test}) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit FROM word w LEFT JOIN g{n} g ON g.doc_id = w.doc_id AND g.i = w.i) WHERE hit = 1 GROUP BY 1)"


_LIMITS = quality.NGRAM_LIMITS
_NGRAMS = ", ".join(f"{_grams(n)}, {_cover(n, 'CASE WHEN copy > 1 THEN 1 ELSE 0 END', 'size')}" for n in _LIMITS)
_SHARE = "coalesce(c{n}.covered, 0) / CAST(greatest(word_chars, 1) AS DOUBLE)"

_ORACLES: dict[str, str] = {
    "op3_warc_index": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), k AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY 1),
  x AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS hex, keeper FROM p JOIN k USING (h))
  SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to, true AS payload_ok FROM x""",
    "op5_repetition_coverage": rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  word AS (SELECT doc_id, word, i, length(word) AS size FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (SELECT doc_id, [x for x in regexp_split_to_array(text, '[	-
 ]+') if x <> ''] AS words FROM t))),
  n AS (SELECT doc_id, count(*) AS n_words, CAST(sum(size) AS BIGINT) AS word_chars FROM word GROUP BY 1),
  line AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS copy FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^	-
 ]')),
  dup AS (SELECT doc_id, count(*) AS n_dup, sum(length(regexp_replace(line, '[	-
 ]', '', 'g'))) AS chars FROM line WHERE copy > 1 GROUP BY 1),
  {_grams(3)}, {_cover(3, "CASE WHEN copies > 1 THEN 1 ELSE 0 END", "1")}, {_NGRAMS},
  m AS (SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup, 0) AS n_dup_lines, CAST(coalesce(c3.covered, 0) AS BIGINT) AS n_repeat_words, coalesce(dup.chars, 0) / CAST(greatest(coalesce(word_chars, 0), 1) AS DOUBLE) AS line_share, {", ".join(f"{_SHARE.format(n=n)} AS share{n}" for n in _LIMITS)}
    FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN dup ON dup.doc_id = t.doc_id LEFT JOIN c3 ON c3.doc_id = t.doc_id {" ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = t.doc_id" for n in _LIMITS)}),
  f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND line_share <= {quality.LINE_LIMIT} AND {" AND ".join(f"share{n} <= {limit}" for n, limit in _LIMITS.items())} AS kept,
    line_share, greatest({", ".join(f"share{n}" for n in _LIMITS)}) AS ngram_share FROM f""",
    "op9_count_tree_jaccard": rf"""WITH RECURSIVE w AS (SELECT DISTINCT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[	-
 ]+') if x <> ''] AS words FROM documents),
  s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest({_SHINGLES}) AS sh FROM w)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
  reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r), least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.doc_id = d.doc_id""",
}


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
