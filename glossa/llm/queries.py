"""One query an operator, over its whole table with production parameters, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, metric_search, mixing, near_dedup, ngram_lm, piece_lattice, pii, quality, sharding, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_consensus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op2_trie_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents")).drop("row_no")


def op4_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op5_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", "taken")


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(_table(spark, sf_dir, "documents"))


def op8_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_search.top_k(_table(spark, sf_dir, "embeddings"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, files)


def op10_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.digest(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_consensus_text, op2_trie_near_duplicates, op3_feistel_shards, op4_private_spans, op5_line_first_quality, op6_mix_sources, op7_deleted_interpolation, op8_mtree_top_k, op9_token_files, op10_piece_ids)
}

_W = r"'[^\x20\x09-\x0D]+'"
_BOILER = "|".join(quality.BOILERPLATE)

#: The verdicts of the quality rules, from a relation d(rid, doc_id, t); also used by the pipeline.
QUALITY_CTES = rf"""
lines AS (SELECT rid, l, len(regexp_extract_all(l, {_W})) AS n, len(regexp_extract_all(l, '[#*$%&|<>]')) AS s
          FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)),
fails AS (SELECT rid, l, n, n > 0 AND ((s >= 3 AND 10 * s > n) OR NOT regexp_matches(l, '[.!?…。！？]')
                 OR (n <= 20 AND regexp_matches(lower(l), '{_BOILER}'))
                 OR (n >= 8 AND 4 * len(regexp_extract_all(l, '\p{{Lu}}')) > length(l)
                     AND 2 * len(regexp_extract_all(l, '\p{{Lu}}')) > len(regexp_extract_all(l, '\pL')))) AS bad FROM lines),
per_line AS (SELECT rid, sum(CASE WHEN bad THEN 0 ELSE n END) AS n_left FROM fails GROUP BY rid),
dups AS (SELECT rid, sum(c - 1) AS n_dup_lines FROM (SELECT rid, l, count(*) AS c FROM lines WHERE n > 0 GROUP BY rid, l) GROUP BY rid),
words AS (SELECT rid, regexp_extract_all(t, {_W}) AS ws FROM d),
grams AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k
          FROM (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM words))),
repeats AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE k > 1) GROUP BY rid),
figures AS (SELECT d.rid, d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(ws, '')), 0) AS BIGINT) AS word_chars,
                   CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(n_left AS BIGINT) AS n_kept_words
            FROM d JOIN words USING (rid) JOIN per_line USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN repeats USING (rid)),
verdicts AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_kept_words) <= 50 * n_words AS kept FROM figures)
"""

ORACLE_SQL: dict[str, str] = {
    "op5_line_first_quality": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_kept_words FROM verdicts""",
    "op6_mix_sources": f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {_W})), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE no % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
k AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
             CAST(coalesce(sum(source_size) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS held,
             sum(w) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
             CAST(2 * source_size AS DOUBLE) / w AS ratio FROM (SELECT w.*, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM w)),
level AS (SELECT min_by((1.5::DOUBLE * total - 2.0::DOUBLE * held) / rest, held) AS lam FROM k WHERE (1.5::DOUBLE * total - 2.0::DOUBLE * held) / rest < ratio),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(w * lam, 2.0::DOUBLE * source_size) AS target FROM w, level),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN CAST(CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r""",
    "op8_mtree_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
