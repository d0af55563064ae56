"""The registered queries of this subpackage: thin views of the operators' results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import concat_cut, entropy_secrets, hyperlang, line_cuckoo, partenum, prefix_free, repair_tokens, repetition, tool_calls, wu_manber


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_tokens.encode_and_read(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), mode="byte", end_id=2)


def op2_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return repetition.repetition_quality(docs).drop("text")


def op3_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_secrets.digest(_documents(spark, sf_dir).select("doc_id", "text"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tool_calls.link_tool_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op5_hyperlang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    return hyperlang.learn_and_predict(docs).select("doc_id", "held_out", "lang_pred", "score")


def op6_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.remove_repeats(_documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    out = line_cuckoo.drop_repeated_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op8_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat_cut.pack(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), mode="word", window=4096, end_id=2)


def op9_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    out = wu_manber.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def op10_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.similar_components(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repair_tokens": op1_repair_tokens,
    "op2_repetition_quality": op2_repetition_quality,
    "op3_entropy_secrets": op3_entropy_secrets,
    "op4_tool_calls": op4_tool_calls,
    "op5_hyperlang": op5_hyperlang,
    "op6_prefix_free": op6_prefix_free,
    "op7_line_dedup": op7_line_dedup,
    "op8_concat_cut": op8_concat_cut,
    "op9_wu_manber": op9_wu_manber,
    "op10_partenum": op10_partenum,
}

_SPACE = r"[\x20\x09-\x0D]"

ORACLE_SQL: dict[str, str] = {
    "op2_repetition_quality": r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS x, coalesce(text, '') AS t FROM documents
), g AS (
  SELECT doc_id, n, i, array_to_string(list_slice(x, i, i + n - 1), ' ') AS k FROM (SELECT doc_id, x, n, unnest(generate_series(1, len(x) - n + 1)) AS i FROM w, (SELECT unnest([3, 5, 6, 7, 8, 9, 10]) AS n))
), r AS (
  SELECT doc_id, n, k FROM g GROUP BY doc_id, n, k HAVING count(*) > 1
), c AS (
  SELECT DISTINCT g.doc_id, g.n, unnest(generate_series(g.i, g.i + g.n - 1)) AS p FROM g JOIN r ON g.doc_id = r.doc_id AND g.n = r.n AND g.k = r.k
), s AS (
  SELECT c.doc_id, CAST(count(CASE WHEN n = 3 THEN 1 END) AS BIGINT) AS n_repeat_words,
         {sums} FROM c JOIN w ON w.doc_id = c.doc_id GROUP BY c.doc_id
), l AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), d AS (
  SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM l WHERE nth > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(x) AS BIGINT) AS n_words, CAST(length(array_to_string(x, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(d.chars, 0) / CAST(greatest(1, length(array_to_string(x, ''))) AS DOUBLE) AS line_coverage, {shares}
  FROM w LEFT JOIN s ON s.doc_id = w.doc_id LEFT JOIN d ON d.doc_id = w.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND line_coverage <= 0.2::DOUBLE AND {tests} AS kept FROM m
""".format(
        sums=", ".join(f"sum(CASE WHEN n = {n} THEN length(x[p]) ELSE 0 END) AS c{n}" for n in range(5, 11)),
        shares=", ".join(f"coalesce(c{n}, 0) / CAST(greatest(1, length(array_to_string(x, ''))) AS DOUBLE) AS coverage_{n}" for n in range(5, 11)),
        tests=" AND ".join(f"coverage_{n} <= {limit}::DOUBLE" for n, limit in repetition.NGRAM_LIMITS.items()),
    ),
    "op10_partenum": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(x, i, i + least(5, len(x)) - 1), ' ') AS k
  FROM (SELECT doc_id, x, unnest(generate_series(1, len(x) - least(5, len(x)) + 1)) AS i FROM w WHERE len(x) > 0)
), n AS (
  SELECT documents.doc_id, coalesce(c, 0) AS n_shingles FROM documents LEFT JOIN (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id) z ON documents.doc_id = z.doc_id
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_have FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * both_have >= 80 * (a.n_shingles + b.n_shingles - both_have)
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.other = e.u
)
SELECT n.doc_id, n.n_shingles, min(r.other) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n_shingles
""",
    "op6_prefix_free": r"""
WITH h AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents
), w AS (
  SELECT r, i, md5_number(substr(x, 2 * i - 1, 400)) AS k FROM (SELECT r, x, unnest(generate_series(1, n_bytes - 199)) AS i FROM h WHERE n_bytes >= 200)
), d AS (
  SELECT w.r, w.i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) z ON w.k = z.k
), e AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM d
), s AS (
  SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM e
), t AS (
  SELECT r, run, min(i) AS a, max(i) + 200 AS b FROM s GROUP BY r, run
), g AS (
  SELECT t.r, a, b, coalesce(lag(b) OVER (PARTITION BY t.r ORDER BY a), 1) AS c FROM t
), p AS (
  SELECT g.r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * c - 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) - 1) AS kept
  FROM g JOIN h ON h.r = g.r GROUP BY g.r
)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM h LEFT JOIN p ON h.r = p.r
""",
    "op7_line_dedup": r"""
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))
), s AS (
  SELECT k, min(doc_id) AS first_doc FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), d AS (
  SELECT l.doc_id, l.i, l.line, s.k IS NOT NULL AND l.doc_id > s.first_doc AS gone FROM l LEFT JOIN s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM d GROUP BY doc_id
""",
    "op9_wu_manber": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x FROM documents
), n AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')), 0) AS n_words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(10, len(x)) AS size, array_to_string(list_slice(x, i, i + least(10, len(x)) - 1), ' ') AS win
  FROM (SELECT item_id, x, unnest(generate_series(1, len(x) - least(10, len(x)) + 1)) AS i FROM b WHERE len(x) > 0)
), d AS (
  SELECT doc_id, size, i, array_to_string(list_slice(x, i, i + size - 1), ' ') AS win
  FROM (SELECT doc_id, x, size, unnest(generate_series(1, len(x) - size + 1)) AS i FROM w, (SELECT DISTINCT size FROM p))
), g AS (
  SELECT d.doc_id, d.i, p.size, p.item_id FROM d JOIN p ON p.size = d.size AND p.win = d.win
), hits AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS i FROM g
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed FROM g GROUP BY doc_id
)
SELECT n.doc_id, CAST(n.n_words AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.listed, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM n LEFT JOIN (SELECT doc_id, count(*) AS n_hit FROM hits GROUP BY doc_id) h ON n.doc_id = h.doc_id LEFT JOIN items ON n.doc_id = items.doc_id
""",
}
