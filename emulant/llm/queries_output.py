"""Queries of token-ID output (9) and the Merkle manifest (13)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulant.llm import merkle, tokens
from emulant.llm.registry import query, table
from emulant.llm.sql import CRC32

TOKENIZER = "word_bpe_49k.json"


@query("op9_token_output")
def op9_token_output(spark: SparkSession, folder: str) -> DataFrame:
    """Places and checksums of the ids of every document, read back through the index."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = tokens.encoded(docs, public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset")


def _merkle_sql(levels: int = 5) -> str:
    """SQL of the manifest for groups and sources of up to 16 ** ``levels`` nodes."""
    field = "coalesce(octet_length(encode({0})) || ':' || {0}, '-')".format
    fields = [field(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars")]
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf, lowered = (f"sha256({' || '.join([*fields, field(t)])})" for t in ("text", low))
    steps = [
        f"""leaves AS (
  SELECT doc_id, source, {leaf} AS leaf, CASE WHEN {CRC32.format("doc_id")} % 5 = 0 THEN {lowered} ELSE {leaf} END AS tampered
  FROM documents
), a0 AS (
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, leaf AS d FROM leaves
)"""
    ]

    def tree(prefix: str) -> None:
        for i in range(levels):
            steps.append(f"""{prefix}{i + 1} AS (
  SELECT source, k // 16 AS k, CASE WHEN max(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY k)) END AS d
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM {prefix}{i}) GROUP BY source, k // 16
)""")

    def walk(name: str, prefix: str, start: str) -> None:
        """Rows of ``start`` (doc_id, source, k, v, proof) folded up the tree of ``prefix``."""
        steps.append(start)
        for i in range(levels):
            steps.append(f"""{prefix}{i}l AS (
  SELECT source, k // 16 AS p, list(d ORDER BY k) AS ds, any_value(n) AS n
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM {prefix}{i}) GROUP BY source, k // 16
), {name}{i + 1} AS (
  SELECT doc_id, w.source, w.k // 16 AS k,
    CASE WHEN n = 1 THEN v ELSE sha256(array_to_string(ds[:w.k % 16], '') || v || array_to_string(ds[w.k % 16 + 2:], '')) END AS v,
    CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(ds[:w.k % 16], '') || array_to_string(ds[w.k % 16 + 2:], '') END AS proof
  FROM {name}{i} w JOIN {prefix}{i}l l ON w.source IS NOT DISTINCT FROM l.source AND l.p = w.k // 16
)""")

    tree("a")
    steps.append(f"b0 AS (SELECT 0 AS source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k, d, source AS name FROM a{levels})")
    tree("b")
    walk("w", "a", """w0 AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, tampered AS v, '' AS proof FROM leaves
)""")
    walk("u", "b", f"""u0 AS (
  SELECT doc_id, 0 AS source, b.k, v, proof FROM w{levels} w JOIN b0 b ON w.source IS NOT DISTINCT FROM b.name
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT l.doc_id, leaf, a.d AS subroot, b.d AS root, sha256(proof) AS proof_sha256, v AS folded_root, v = b.d AS verified
FROM leaves l JOIN u{levels} u USING (doc_id) JOIN a{levels} a ON l.source IS NOT DISTINCT FROM a.source CROSS JOIN b{levels} b"""


@query("op13_merkle_manifest", _merkle_sql())
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Proof of every document in the manifest, and the root folded from it; a fifth is tampered with."""
    docs = table(spark, folder, "documents")
    upper = "".join(map(chr, range(65, 91)))
    low = F.translate("text", upper, upper.lower())
    first = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf_digest(*first, low))
    out = merkle.manifest(docs, merkle.leaf_digest(*first, F.col("text")), tampered)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
