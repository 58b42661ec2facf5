"""Queries of the native operators: URL filter (1), mixing (6), quality rules (10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulant.llm import mixing, quality, urls
from emulant.llm.registry import query, table

#: Fixed values of the query: verdict, host, path.
SITE_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


@query("op1_url_filter")
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Pages, labelled through the document of the same number, judged by site and mined rules."""
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"),
        (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"),
    )
    judged = urls.judge_urls(table(spark, folder, "pages").select("page_id", "url"), labels, SITE_RULES)
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.mined_rule")


@query("op6_mixing")
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Copies and words taken of every document for targets of 150 % of all words."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    m = mixing.mix_sources(docs)
    return m.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "mix.copies")


WORDS = r"[^\x20\x09-\x0D]+"
SQL_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORDS}') AS words FROM d),
win AS (SELECT r, len(words) AS n, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
win2 AS (SELECT r, n, i, array_to_string(words[i:i + 7], ' ') AS g FROM win),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win2) WHERE c > 1),
cov AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
        FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
l1 AS (SELECT r, line, len(regexp_extract_all(line, '{WORDS}')) AS n, regexp_extract_all(line, '{WORDS}') AS ws FROM l0),
l2 AS (SELECT r, line, n,
         (length(line) - length(translate(line, '|>»·•', '')) >= 3
            AND length(line) - length(translate(line, '|>»·•', '')) >= 0.15 * n)
         OR ({" OR ".join(f"contains(lower(line), '{p}')" for p in quality.BOILERPLATE)})
         OR length(line) - length(translate(line, '#*$%&|<>', '')) > 0.2 * n
         OR (n >= 3 AND len(list_filter(ws, lambda x: regexp_matches(x, '[!?][!?]$'))) > 0.3 * n)
         OR (n >= 6 AND len(list_filter(range(1, n), lambda i: ws[i] = ws[i + 1])) > 0.5 * n)
         OR (n >= 12 AND NOT regexp_matches(line, '[.!?;:…。！？"''”’)\]][\x20\x09-\x0D]*$')) AS fails
       FROM l1 WHERE n > 0),
ln AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines,
         coalesce(sum(n) FILTER (NOT fails), 0) AS kept_words FROM l2 GROUP BY r),
q AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(kept_words, 0) AS BIGINT) AS kept_words
      FROM w LEFT JOIN cov USING (r) LEFT JOIN ln USING (r))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kept_words >= 0.5 * n_words AS kept
FROM q
"""


@query("op10_quality", SQL_QUALITY)
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and verdict of every document."""
    q = quality.clean_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return q.select(
        "doc_id",
        *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_words")],
        "quality.base_failed",
        "quality.kept",
    )
