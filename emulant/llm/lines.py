"""Line dedup by log templates: a tree of fixed depth, in shuffles of hashes.

A line is parsed to its number of tokens, its first ``LEAD`` tokens, and the rest, which is cut
into ``BLOCKS`` parts. Variable fields (tokens with digits, addresses) become ``<*>``.
The path number of tokens / leading tokens / rest is a template; in lines of
``GENERAL`` tokens or more each part in turn is also generalised, which gives templates with a
variable part. A template is recurring if lines of ``LEAST_DOCS`` documents or more fit
it; every line that fits a recurring template is dropped. This doesn't depend on the order
of lines, and no group of a leaf is ever gathered: leaves are counted.

Documents are rows; a template counts once for each row. Lines without a token always stay.
Null and empty texts have no lines with tokens and lose none. Rows with the same id are told apart by number; other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulant.session import written

LEAD, BLOCKS, GENERAL, LEAST_DOCS = 2, 4, 10, 3
WHITE = "\t\x0b\x0c\r"  # white space of a line, but for the blank
#: Variable fields: tokens with a digit, a mail address or a link.
VARIABLE = "[0-9@]|://"


def _templates(tokens: Column) -> Column:
    """Hashes of the template of a line, and of its generalisations."""
    n = F.size(tokens)
    rest = n - LEAD
    cut = [F.lit(LEAD + 1) + F.floor(rest * k / BLOCKS).cast("int") for k in range(BLOCKS + 1)]
    parts = [F.slice(tokens, cut[k], F.greatest(cut[k + 1] - cut[k], F.lit(0))) for k in range(BLOCKS)]
    lead = F.slice(tokens, 1, LEAD)
    exact = F.xxhash64(n, tokens)

    def general(hashes: Column) -> Column:
        return F.array(
            exact,
            *[F.xxhash64(n, lead, F.lit(k), *[hashes[j] for j in range(BLOCKS) if j != k]) for k in range(BLOCKS)],
        )

    hashed = F.transform(F.array(F.array(*[F.xxhash64(p) for p in parts])), general)[0]
    return F.when(n >= GENERAL, hashed).otherwise(F.array(exact))


def parsed_lines(text: Column) -> Column:
    """array of (words, templates) of the lines of ``text``; no templates for lines without a token."""
    # Split at blanks, and one short search for each token: no pattern runs over the whole text.
    rows = F.split(F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE)), "\n")
    masked = lambda token: F.when(token.rlike(VARIABLE), F.lit("<*>")).otherwise(token)
    tokens = F.transform(rows, lambda line: F.transform(F.filter(F.split(line, " "), lambda x: x != ""), masked))
    return F.transform(
        tokens,
        lambda t: F.struct(
            F.size(t).alias("words"), F.when(F.size(t) > 0, _templates(t)).otherwise(F.array().cast("array<bigint>")).alias("templates")
        ),
    )


def recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(rows, dropped): ``rows`` has row, doc_id, n_lines, n_words; ``dropped`` has row, line (from 0), words.

    ``row`` numbers the rows of ``docs``. The numbers are written before they are used, so they
    stay when a task runs again.
    """
    lines = docs.select("doc_id", parsed_lines(F.col("text")).alias("_l"))
    lines = written(lines.withColumn("row", F.monotonically_increasing_id()), "line-templates")
    rows = lines.select(
        "row",
        "doc_id",
        F.size(F.filter("_l", lambda x: x["words"] > 0)).cast("long").alias("n_lines"),
        F.aggregate("_l", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("n_words"),
    )
    # A document counts once for each template.
    distinct = lines.select(F.explode(F.array_distinct(F.flatten(F.col("_l.templates")))).alias("template"))
    recurring = distinct.groupBy("template").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_docs).select("template")
    recurring = written(recurring, "recurring-templates")
    placed = lines.select("row", F.posexplode("_l").alias("line", "_x")).select(
        "row", "line", F.col("_x.words").alias("words"), F.explode("_x.templates").alias("template")
    )
    hit = placed.join(recurring.hint("shuffle_hash"), "template")
    return rows, hit.groupBy("row", "line").agg(F.first("words").alias("words"))


def line_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_words, n_dropped, dropped_words) for every row of ``docs``."""
    rows, dropped = recurring_lines(docs, least_docs)
    sums = dropped.groupBy("row").agg(F.count(F.lit(1)).alias("n_dropped"), F.sum("words").cast("long").alias("dropped_words"))
    zero = F.lit(0).cast("long")
    return rows.join(sums, "row", "left").select(
        "doc_id",
        "n_lines",
        "n_words",
        F.coalesce("n_dropped", zero).alias("n_dropped"),
        F.coalesce("dropped_words", zero).alias("dropped_words"),
    )


def cleaned_lines(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with the struct column ``lines``: n_lines, n_words, n_dropped, dropped_words, clean_text.

    ``clean_text`` is the text without recurring lines; null stays null. A column ``lines`` of ``docs`` is
    replaced; other names can't clash, as rows travel as a struct.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.monotonically_increasing_id().alias("_row"))
    numbered = written(packed, "numbered")
    base, dropped = recurring_lines(numbered.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text")), least_docs)
    gone = dropped.groupBy("row").agg(
        F.collect_set("line").alias("_gone"), F.count(F.lit(1)).alias("n_dropped"), F.sum("words").cast("long").alias("dropped_words")
    )
    met = numbered.join(base.join(gone, "row", "left"), F.col("_row") == F.col("doc_id"))
    kept = F.filter(F.split("_doc.text", "\n"), lambda x, i: ~F.coalesce(F.array_contains("_gone", i), F.lit(False)))
    zero = F.lit(0).cast("long")
    counts = ["n_lines", "n_words", *[F.coalesce(c, zero).alias(c) for c in ("n_dropped", "dropped_words")]]
    columns = [F.col("_doc")[c].alias(c) for c in docs.columns if c != "lines"]
    return met.select(*columns, F.struct(*counts, F.array_join(kept, "\n").alias("clean_text")).alias("lines"))


def drop_recurring(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with ``clean_text``, the text without recurring lines; null stays null.

    A column ``clean_text`` of ``docs`` is replaced; other names can't clash, as rows travel as a struct.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text"))
    clean = cleaned_lines(packed, least_docs)
    columns = [F.col("_doc")[c].alias(c) for c in docs.columns if c != "clean_text"]
    return clean.select("_doc", F.col("lines.clean_text").alias("_clean")).select(*columns, F.col("_clean").alias("clean_text"))
