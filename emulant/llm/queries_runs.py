"""Query of periodic run detection (12)."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulant.llm import runs
from emulant.llm.registry import query, table
from emulant.llm.sql import CRC32, WORDS


@F.arrow_udf(T.StringType())
def planted(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """Texts of the query: every tenth document by crc32 of its id repeats itself from a word on."""
    out = []
    for i, text in zip(ids, texts):
        i, text = i.as_py(), text.as_py()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        words = (text or "").encode().split() if h % 10 == 0 else []
        if words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = b" ".join(words[:a] + [words[a + (k - a) % p] for k in range(a, n)]).decode()
        out.append(text)
    return pa.array(out, pa.string())


SQL = f"""
WITH base AS (
  SELECT doc_id, {WORDS} AS ws, {CRC32.format('doc_id')} AS h FROM documents
), counted AS (
  SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g FROM base
), placed AS (
  SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM counted
), spaced AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed
), texts AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws
  FROM spaced
), words AS (
  SELECT doc_id, n, unnest(ws) AS word, unnest(range(n)) AS i FROM texts
), grams AS (
  SELECT doc_id, n, i, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w
    || ' ' || lead(word, 4) OVER w || ' ' || lead(word, 5) OVER w AS gram
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), met AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM grams x JOIN grams y
  ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i AND 2 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM met
), found AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM islands GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM found
  WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length
), per AS (
  SELECT doc_id, count(*) AS n_runs, arg_max((start, length, period), (length, -start, -period)) AS top,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words w ANTI JOIN dropped d
  ON w.doc_id = d.doc_id AND w.i = d.i GROUP BY w.doc_id
)
SELECT t.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs,
  CAST(top[1] AS BIGINT) AS start, CAST(top[2] AS BIGINT) AS length, CAST(top[3] AS BIGINT) AS period,
  CAST(1000 * top[2] // top[3] AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM texts t LEFT JOIN per ON t.doc_id = per.doc_id LEFT JOIN kept ON t.doc_id = kept.doc_id
"""


@query("op12_periodic_runs", SQL)
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Number, longest and digests of the runs of every document, with repetition planted in a tenth of them."""
    docs = table(spark, folder, "documents").select("doc_id", planted("doc_id", "text").alias("text"))
    found = F.col("runs.found")
    top = F.element_at(
        F.array_sort(F.transform(found, lambda r: F.struct((-r["length"]).alias("l"), r["start"], r["period"]))), 1
    )
    line = F.transform(found, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in runs.RUN.names]), F.lit("\n")))
    out = runs.find_runs(docs).select(
        "doc_id",
        F.size(found).cast("long").alias("n_runs"),
        F.when(F.size(found) > 0, top).alias("top"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("runs.collapsed", 256).alias("collapsed_sha256"),
    )
    length, period = -F.col("top.l"), F.col("top.period")
    return out.select(
        "doc_id",
        "n_runs",
        F.col("top.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * (- top.l) div top.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
