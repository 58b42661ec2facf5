"""Secret scan: fixed patterns, and values in a credential's context that are hard to guess.

``base_spans`` finds three kinds by pattern: assign, access, hex. The method adds kind
``guess``: a value that follows a credential word (``CONTEXT``) and whose cheapest
segmentation still takes ``MIN_LOG10`` decimal digits of guesses. A segmentation cuts the
value into words (cost: rank in the word list, twice for letters in upper case or swapped for
digits), dates, repeats, sequences, keyboard walks, and brute-force spans (10 guesses for
each character, 1.05 digits where letters and digits mix); the product over parts, times the
factorial of their number, is the cost. Least cost over all cuts by dynamic programming:
prose after "password" is cheap, a random key isn't.

Documents without any keyword or pattern are told apart by one native expression and never
reach Python. Null and empty texts have no spans. A value longer than ``PIECE`` characters costs
as much as the dearest of its pieces of that length, so work is linear in its length. Rows are judged one by one; other columns pass through.
"""

from __future__ import annotations

import math
import re
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "guess")
#: The base patterns.
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Words that announce a credential, more of them than the base has.
CONTEXT = r"""(?ai:\b(?:password|passwd|passphrase|pwd|pass|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|bearer|login))["']?(?:\x20*[:=]\x20*|\x20+is\x20+|\x20+)["']?([^\s"'<>]{8,})"""
PREFILTER = r"(?i)passw|passphrase|pwd|pass\b|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth\b|bearer|login|(?-i)AKIA[A-Z0-9]|[0-9a-f]{24}"
MIN_LOG10 = 11.0
PIECE = 64
#: Common words of passwords, the commonest first.
COMMON_WORDS = (
    "password pass admin login welcome user test root qwerty letmein dragon monkey master secret token key "
    "access default guest hello love summer winter spring autumn football baseball shadow sunshine princess "
    "example changeme system server database service account public private demo sample dummy fake value "
    "string none null true false your name here"
).split()
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qaz", "wsx", "edc", "rfv", "tgb", "yhn", "ujm")
LEET = str.maketrans("013457@$!", "oieastasi")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:[0-2]?\d|3[01])|(?:[0-2]?\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")


def _runs(value: str, follows) -> list[tuple[int, int]]:
    """Longest spans in which every character follows the one before."""
    out, start = [], 0
    for i in range(1, len(value) + 1):
        if i == len(value) or not follows(value[i - 1], value[i]):
            if i - start >= 3:
                out.append((start, i))
            start = i
    return out


_WALK = {(a, b) for row in KEYBOARD for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))}


def guess_cost(value: str, ranks: dict[str, int] | None = None) -> float:
    """Decimal digits of the number of guesses for ``value``: least over all segmentations."""
    ranks = ranks or RANKS
    if len(value) > PIECE:
        return max(guess_cost(value[i : i + PIECE], ranks) for i in range(0, len(value), PIECE))
    low, plain, n = value.lower(), value.lower().translate(LEET), len(value)
    spans: list[tuple[int, int, float]] = []
    longest = max(map(len, ranks))
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            for text, extra in ((low[i:j], 0), (plain[i:j], 1)):
                if text in ranks:
                    upper = value[i:j] != value[i:j].lower()
                    spans.append((i, j, math.log10(ranks[text] + 1) + math.log10(2) * (extra + upper)))
                    break
    spans += [(m.start(), m.end(), math.log10(365 * 100)) for m in DATE.finditer(low)]
    spans += [(i, j, math.log10(40 * (j - i))) for i, j in _runs(low, lambda a, b: a == b)]
    spans += [(i, j, math.log10(40 * (j - i))) for i, j in _runs(low, lambda a, b: abs(ord(b) - ord(a)) == 1)]
    spans += [(i, j, math.log10(100 * (j - i))) for i, j in _runs(low, lambda a, b: (a, b) in _WALK)]
    # A block that comes again costs the block once more.
    for size in range(2, n // 2 + 1):
        for i in range(n - 2 * size + 1):
            if low[i : i + size] == low[i + size : i + 2 * size]:
                spans.append((i + size, i + 2 * size, math.log10(2 * size)))
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in spans:
        ends.setdefault(j, []).append((i, cost))
    each = 1.05 if re.search(r"[0-9]", value) and re.search(r"[A-Za-z]", value) else 1.0
    # best[j][k]: least cost of the first j characters in k parts; a brute-force part may have any length.
    best = [{0: 0.0}] + [{} for _ in range(n)]
    open_ = [{} for _ in range(n + 1)]  # the last part is a brute-force span that may grow
    for j in range(1, n + 1):
        for k, cost in open_[j - 1].items():
            open_[j][k] = min(open_[j].get(k, math.inf), cost + each)
        for k, cost in best[j - 1].items():
            open_[j][k + 1] = min(open_[j].get(k + 1, math.inf), cost + each)
        for i, own in ends.get(j, ()):
            for part in (best[i], open_[i]):
                for k, cost in part.items():
                    best[j][k + 1] = min(best[j].get(k + 1, math.inf), cost + own)
    total = [cost + math.lgamma(k + 1) / math.log(10) for part in (best[n], open_[n]) for k, cost in part.items()]
    return min(total, default=0.0)


RANKS = {w: i + 1 for i, w in enumerate(COMMON_WORDS)}
_assign, _access, _hex, _context = map(re.compile, (ASSIGN, ACCESS, HEX, CONTEXT))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base kinds, by start, then kind; leftmost, not overlapping in a kind."""
    out = [(m.start(), m.end(), 0) for m in _assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), m.end(), 1) for m in _access.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), m.end(), 2) for m in _hex.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(out, key=lambda s: (s[0], s[2]))


def guess_spans(text: str) -> list[tuple[int, int, int]]:
    """Values in a credential's context that cost ``MIN_LOG10`` digits of guesses or more."""
    out = []
    for m in _context.finditer(text):
        value = m[1].rstrip(".,;:!?)]}")
        if len(value) >= 8 and guess_cost(value) >= MIN_LOG10 and re.search(r"[0-9]|[a-z][A-Z]", value):
            out.append((m.start(1), m.start(1) + len(value), 3))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


SPANS = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField(k, T.StringType()) for k in ("base", "spans")]
)


@F.pandas_udf(SPANS)
def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base = base_spans(text or "")
        every = sorted(base + guess_spans(text or ""), key=lambda s: (s[0], s[2]))
        counts = [sum(k == kind for _, _, k in every) for kind in range(4)]
        rows.append((*counts, _joined(base), _joined(every)))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_guess", "base", "spans"])


def may_hold_secret(text: Column) -> Column:
    """False only for texts without any span."""
    return F.coalesce(text.rlike(PREFILTER), F.lit(False))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the struct column ``secrets``: counts by kind, base and all spans (``kind:start:end``).

    Offsets are code points, ends exclusive.
    """
    found = docs.withColumn("secrets", _scan(F.when(may_hold_secret(F.col("text")), F.col("text"))))
    return found


def masked(text: Column, spans: Column, kinds=KINDS) -> Column:
    """``text`` with the spans of ``kinds`` replaced by ``[kind]``; overlapping ones are joined."""

    @F.pandas_udf(T.StringType())
    def cover(texts: pd.Series, joined: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, joined):
            if not spans:
                out.append(text)
                continue
            parts, at = [], 0
            for span in spans.split(","):
                kind, a, b = span.split(":")
                if kind in kinds and int(b) > at:
                    if int(a) >= at:
                        parts += [text[at : int(a)], f"[{kind}]"]
                    at = int(b)
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out)

    return cover(text, spans)
