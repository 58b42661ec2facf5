"""Quality rules, line first: drop failing lines, then documents that lose too much.

Every line is judged on its own. It fails if

* it is navigation: three or more separators, at least ``nav_share`` of its words;
* it is boilerplate: it holds one of ``BOILERPLATE``;
* its punctuation is wrong: too many symbols to a word, words that end in ``!!`` or
  ``??``, a run of one repeated word, or ``open_words`` words without a closing mark.

A document is rejected if the base counts fail, or if fewer than ``least_share`` of the
words remain. Only built-in column functions are used; arrays hold the lines and words
of one document, and nothing is shuffled.

Null and empty texts have no words and are rejected; other columns pass through. No helper
column is made, so none can clash.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>»·•"
CLOSING = ".!?;:…。！？\"'”’)]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Phrases of lines that belong to a site or a licence, not to a text.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "enable javascript",
    "privacy policy",
    "terms of use",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "share on facebook",
    "click here",
)


@dataclass(frozen=True)
class Rules:
    window: int = 8
    least_words: int = 20
    most_repeat_pct: int = 30
    nav_share: float = 0.15
    symbol_share: float = 0.2
    shout_share: float = 0.3
    same_word_share: float = 0.5
    open_words: int = 12
    least_share: float = 0.5


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def _count(text: Column, chars: str) -> Column:
    """Number of characters of ``text`` that are in ``chars``."""
    return F.regexp_count(text, F.lit("[" + "".join("\\" + c if c in "[]^-&|" else c for c in chars) + "]"))


def line_fails(line: Column, words: Column, rules: Rules) -> Column:
    """Whether a line with ``words`` words, one at least, breaks a rule."""
    nav = _count(line, SEPARATORS) >= F.greatest(F.lit(3.0), rules.nav_share * words)
    # Lower case is made once for all phrases.
    boilerplate = F.exists(
        F.array(F.lower(line)), lambda low: functools.reduce(lambda a, b: a | b, [low.contains(x) for x in BOILERPLATE])
    )
    symbols = _count(line, SYMBOLS) > rules.symbol_share * words
    shouts = (words >= 3) & (F.regexp_count(line, F.lit(rf"[!?]{{2}}(?=[{SPACE}]|$)")) > rules.shout_share * words)
    same = (words >= 6) & (
        F.regexp_count(line, F.lit(rf"(?:^|[{SPACE}])(?=({WORD}+)[{SPACE}]++\1(?:[{SPACE}]|$))")) > rules.same_word_share * words
    )
    unclosed = (words >= rules.open_words) & ~F.right(F.rtrim(line, F.lit(SPACE_CHARS)), F.lit(1)).isin(*CLOSING)
    return nav | boilerplate | symbols | shouts | same | unclosed


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once and bound to a variable.

    Arrays that other expressions look into are bound this way: as columns of a projection, a filter on the
    result would put them into the bodies of lambdas, to be made again for each element.
    """
    return F.transform(F.array(value), body)[0]


def _windows(hashes: Column, k: int) -> Column:
    """One 64-bit hash for each window of k words, in order, from the hashes of its words.

    (slice() would copy the whole array for each window.)
    """
    n = F.size(hashes)
    each = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    return F.when(n >= k, each).otherwise(F.array().cast("array<bigint>"))


def _sorted_places(windows: Column) -> Column:
    """Windows with their places, by hash; none if no hash repeats."""
    repeated = F.size(F.array_distinct(windows)) < F.size(windows)
    placed = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(repeated, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _repeated_places(here: Column) -> Column:
    """Places of windows found more than once: neighbours among the sorted hashes."""
    same = lambda x, i: (F.get(here, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(here, i + 1)["h"].eqNullSafe(x["h"]))
    return F.array_sort(F.transform(F.filter(here, same), lambda x: x["i"]))


def _covered(places: Column, k: int) -> Column:
    """Number of words in the windows at sorted ``places``."""
    steps = F.transform(places, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(places, i + 1) - x, F.lit(k))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def _lines(text: Column, rules: Rules) -> Column:
    """Lines with their number of words and whether they fail."""
    # Two steps, so that the words of a line are counted once.
    counted = F.transform(
        F.split(text, "\n"), lambda line: F.struct(line.alias("line"), F.regexp_count(line, F.lit(WORD)).alias("words"))
    )
    fails = lambda x: F.when(x["words"] > 0, line_fails(x["line"], x["words"], rules)).otherwise(F.lit(False))
    return F.transform(counted, lambda x: x.withField("fails", fails(x)))


def _counts(text: Column, words: Column, covered: Column, lines: Column) -> Column:
    full = F.transform(F.filter(lines, lambda x: x["words"] > 0), lambda x: x["line"])
    stay = F.filter(lines, lambda x: ~x["fails"])
    kept_words = F.aggregate(stay, F.lit(0), lambda a, x: a + x["words"])
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        let(full, lambda f: (F.size(f) - F.size(F.array_distinct(f))).cast("long")).alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        kept_words.cast("long").alias("kept_words"),
        F.array_join(F.transform(stay, lambda x: x["line"]), "\n").alias("clean_text"),
    )


def _verdict(q: Column, rules: Rules) -> Column:
    failed = (q["n_words"] < rules.least_words) | (100 * q["n_repeat_words"] > rules.most_repeat_pct * q["n_words"])
    kept = ~failed & (q["kept_words"] >= rules.least_share * q["n_words"])
    return q.withField("base_failed", failed).withField("kept", kept)


def judged(text: Column, rules: Rules = Rules()) -> Column:
    """The struct of ``clean_lines`` for one text, as one expression."""
    k = rules.window

    def of(t: Column, w: Column) -> Column:
        repeats = let(
            F.transform(w, lambda x: F.xxhash64(x)),
            lambda g: let(_windows(g, k), lambda h: let(_sorted_places(h), lambda s: let(_repeated_places(s), lambda p: _covered(p, k)))),
        )
        return let(_lines(t, rules), lambda lines: let(_counts(t, w, repeats, lines), lambda q: _verdict(q, rules)))

    return let(F.coalesce(text, F.lit("")), lambda t: let(words_of(t), lambda w: of(t, w)))


def clean_lines(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the struct column ``quality``: base counts, verdict and the cleaned text.

    ``quality`` has n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    kept_words, clean_text (failed lines removed, the others joined by line feeds; lines without a
    word stay), base_failed and kept. A column of that name is replaced, all others pass through.
    """
    return docs.withColumn("quality", judged(F.col("text"), rules))


def kept_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``clean_lines`` that are kept.

    The verdict is unpacked from a list of one, so that each text is judged once; a filter on a
    computed column would be judged before and the column be made again after it.
    """
    one = F.explode_outer(F.array(judged(F.col("text"), rules))).alias("quality")
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "quality"], one).filter("quality.kept")
