"""Toxicity: misspelled lexicon terms by Levenshtein automata, weighed by their context.

1. Lexicon, learned from labelled rows: words, and stems (first 4 to 7 letters with ``*``), by the log odds of
   documents that hold them. A stem is taken where it is as sure as its words. At most ``SAMPLE_ROWS``
   labelled rows (by hash of the text) and ``LEXICON`` terms are used.
2. The terms are a trie. The Levenshtein automaton of a term allows one edit from six letters on
   (stems: from seven); its intersection with the trie is a deterministic automaton whose
   states are sets of (trie node, edits), made as they are met. A word is read once,
   letter by letter, and most words end in the empty state after a few.
3. A hit is weighed by its window of ``WINDOW`` words: within quotation marks, or after a word of
   report ("said", "called", ...), it counts as quoted.
4. A logistic model over weighed hits, quoted hits, their density and the densest window, fitted on the
   same sample, gives the score. Fuzzy hits of a term have the weight the sample shows for them.

Scores use the text alone. Null and empty texts have no hits and the lowest score. Rows are
scored one by one; repeated ids in labels count once for each pair of rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
LEXICON = 3_000
STEMS = (4, 5, 6, 7)
LEAST_DOCS = 3
LEAST_SHARE = 0.8
WINDOW = 10
MEMO = 300_000
#: Words that report what somebody said.
REPORT = frozenset("said says say called wrote quoted quote reported told saying".split())
OPEN_QUOTES, CLOSE_QUOTES = "\"“«„", "\"”»“"
TOKEN = re.compile(r"[^\W\d_]+")


class Lexicon:
    """Trie of terms, and its intersection with their Levenshtein automata."""

    def __init__(self, terms: dict[str, float]):
        self.terms = list(terms)
        self.weight = dict(terms)
        self.children: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]
        self.most: list[int] = [0]  # edits allowed to any term below
        for i, term in enumerate(self.terms):
            word, edits, node = term.rstrip("*"), self.edits(term), 0
            self.most[0] = max(self.most[0], edits)
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.end.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits)
            self.end[node] = i
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})
        self.memo: dict[str, tuple[int, int] | None] = {}

    @staticmethod
    def edits(term: str) -> int:
        return int(len(term.rstrip("*")) >= (7 if term.endswith("*") else 6))

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """Number of the state, closed under leaving letters of the term out; stems already read stay."""
        todo, best = list(pairs), {}
        while todo:
            node, e = todo.pop()
            if best.get(node, 9) <= e or (node >= 0 and e > self.most[node]):
                continue
            best[node] = e
            if node >= 0:
                todo += [(child, e + 1) for child in self.children[node].values()]
                if self.end[node] >= 0 and self.terms[self.end[node]].endswith("*") and e <= self.edits(self.terms[self.end[node]]):
                    todo.append((-1 - self.end[node], e))  # any suffix may follow
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        after = set()
        for node, e in self.sets[state]:
            if node < 0:
                after.add((node, e))
                continue
            child = self.children[node].get(c)
            if child is not None:
                after.add((child, e))
            if e < self.most[node]:
                after.add((node, e + 1))  # a letter too many
                after |= {(x, e + 1) for d, x in self.children[node].items() if d != c}
        found = self.moves[state][c] = self._state(after)
        return found

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the term that ``word`` spells, fewest edits first, then the heaviest."""
        if word in self.memo:
            return self.memo[word]
        state = self.start
        for c in word:
            state = self.moves[state][c] if c in self.moves[state] else self._move(state, c)
            if not self.sets[state]:
                break
        best = None
        for node, e in self.sets[state]:
            term = -1 - node if node < 0 else self.end[node]
            if term >= 0 and e <= self.edits(self.terms[term]):
                rank = (e, -self.weight[self.terms[term]], term)
                best = rank if best is None or rank < best else best
        found = None if best is None else (best[2], best[0])
        if len(self.memo) > MEMO:
            self.memo.clear()
        if len(self.sets) > MEMO:  # start the automaton anew; it is made as it is met
            self.states, self.sets, self.moves = {}, [], []
            self.start = self._state({(0, 0)})
        self.memo[word] = found
        return found


def hits_of(text: str, lexicon: Lexicon) -> tuple[list[tuple[int, int, int, bool]], int]:
    """((word number, term, edits, quoted) of each hit, number of words)."""
    low = text.lower()
    words = TOKEN.findall(low)
    memo, find = lexicon.memo, lexicon.find
    found = [(i, hit) for i, w in enumerate(words) if (hit := memo[w] if w in memo else find(w)) is not None]
    if not found:
        return [], len(words)
    places = [m.start() for m in TOKEN.finditer(low)]
    out = []
    for i, (term, edits) in found:
        before = low[max(0, places[i] - 200) : places[i]].rpartition("\n")[2]
        after = low[places[i] : places[i] + 200].partition("\n")[0]
        opened = max(map(before.rfind, OPEN_QUOTES))
        quoted = (opened >= 0 and before.count('"') % 2 == 1 or opened >= 0 and before[opened] != '"') and any(q in after for q in CLOSE_QUOTES)
        quoted = quoted or not REPORT.isdisjoint(words[max(0, i - WINDOW) : i])
        out.append((i, term, edits, bool(quoted)))
    return out, len(words)


FEATURES = 5


def features(text: str, lexicon: Lexicon, fuzzy: np.ndarray) -> list[float]:
    """log of weighed direct and quoted hits, share of hits among words, densest window, any hit."""
    hits, n = hits_of(text, lexicon)
    if not hits:
        return [0.0] * FEATURES
    weight = [(lexicon.weight[lexicon.terms[t]] if not e else fuzzy[t]) for _, t, e, _ in hits]
    direct = sum(w for w, h in zip(weight, hits) if not h[3])
    quoted = sum(w for w, h in zip(weight, hits) if h[3])
    densest, low, at = 0.0, 0, 0.0
    for k, (i, *_) in enumerate(hits):
        at += weight[k]
        while hits[low][0] <= i - WINDOW:
            at -= weight[low]
            low += 1
        densest = max(densest, at)
    return [np.log1p(direct), np.log1p(quoted), direct / n * 100 / 10, np.log1p(densest), float(direct > 0)]


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most about ``SAMPLE_ROWS`` rows of (doc_id, toxic), equal texts once."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    share = min(1.0, SAMPLE_ROWS / max(known.count(), 1))
    known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # About SAMPLE_ROWS pairs of numbers: bounded, whatever the corpus.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    return rows.filter("text IS NOT NULL").groupBy(F.md5("text").alias("_h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("_h")


def learn_terms(sample: DataFrame) -> dict[str, float]:
    """Terms with their log odds, from (text, toxic)."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1)))
    stems = [F.transform(F.filter("_w", lambda x, k=k: F.length(x) > k), lambda x, k=k: F.concat(F.substring(x, 1, k), F.lit("*"))) for k in STEMS]
    terms = sample.select("toxic", words.alias("_w")).select("toxic", F.explode(F.array_distinct(F.concat("_w", *stems))).alias("term"))
    counts = terms.filter(F.length("term") >= 3).groupBy("term").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n"))
    sure = counts.filter((F.col("pos") >= LEAST_DOCS) & (F.col("pos") >= LEAST_SHARE * F.col("n")))
    total = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    p, q = total["p"], total["n"] - total["p"]
    least = max(LEAST_DOCS, 0.002 * p)
    rows = sure.filter(F.col("pos") >= least).orderBy(F.desc("pos"), "term").limit(LEXICON).collect()  # at most LEXICON
    odds = {r["term"]: float(np.log((r["pos"] + 0.5) / (p + 1)) - np.log((r["n"] - r["pos"] + 0.5) / (q + 1))) for r in rows}
    # A term goes if a shorter stem of it is in.
    kept = {t: w for t, w in odds.items() if not any(t.rstrip("*")[:k] + "*" in odds for k in STEMS if k < len(t.rstrip("*")))}
    return {t: w for t, w in kept.items() if w > 0}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, intercept first, of a ridge logistic model by Newton steps."""
    design = np.column_stack((np.ones(len(x)), x))
    b = np.zeros(design.shape[1])
    penalty = np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        step = np.linalg.solve(design.T * (p * (1 - p)) @ design + penalty, design.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


class Model:
    def __init__(self, terms: dict[str, float], fuzzy: np.ndarray, coefficients: np.ndarray):
        self.terms, self.fuzzy, self.coefficients = terms, fuzzy, coefficients
        self._lexicon = None

    def __getstate__(self):
        return self.__dict__ | {"_lexicon": None}

    @property
    def lexicon(self) -> Lexicon:
        if self._lexicon is None:
            self._lexicon = Lexicon(self.terms)
        return self._lexicon

    def scores(self, texts: list[str | None]) -> list[tuple[float, int]]:
        x = np.array([features(t or "", self.lexicon, self.fuzzy) for t in texts], float).reshape(-1, FEATURES)
        z = np.clip(self.coefficients[0] + x @ self.coefficients[1:], -30, 30)
        return 1 / (1 + np.exp(-z))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from labelled rows of (doc_id, text) and (doc_id, toxic)."""
    sample = labelled_sample(docs, labels).persist()
    try:
        terms = learn_terms(sample)
        lexicon = Lexicon(terms)
        plain = sample.sparkSession.sparkContext.broadcast(terms)

        def fuzzy_hits(batches: Iterator[pa.RecordBatch]):
            own = Lexicon(plain.value)
            for batch in batches:
                out = [(t, y) for text, y in zip(batch[0].to_pylist(), batch[1].to_pylist()) for t in {h[1] for h in hits_of(text, own)[0] if h[2]}]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["t", "y"])

        seen = sample.select("text", "toxic").mapInArrow(fuzzy_hits, "t long, y long").groupBy("t").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).collect()
        # Without evidence a fuzzy hit has half the term's weight; with it, what the evidence shows.
        fuzzy = np.array([0.5 * lexicon.weight[t] for t in lexicon.terms])
        for r in seen:
            fuzzy[r["t"]] = lexicon.weight[lexicon.terms[r["t"]]] * r["pos"] / r["n"] if r["pos"] >= 0.5 * r["n"] else 0.0
        shared = sample.sparkSession.sparkContext.broadcast((terms, fuzzy))

        def rows(batches: Iterator[pa.RecordBatch]):
            terms, fuzzy = shared.value
            own = Lexicon(terms)
            for batch in batches:
                x = [features(t, own, fuzzy) for t in batch[0].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch[1], pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

        fit = sample.select("text", "toxic").mapInArrow(rows, "y int, x array<double>").toPandas()  # about SAMPLE_ROWS rows of five numbers
    finally:
        sample.unpersist()
    x = np.array(fit.x.tolist(), float).reshape(-1, FEATURES)
    return Model(terms, fuzzy, fit_logistic(x, fit.y.to_numpy(float)))


def score_toxicity(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with ``score``, the probability that the text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"_c{i}" for i in range(len(columns))]
    given = docs.select("text", *[F.col(c).alias(n) for c, n in zip(columns, names)])

    def score(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(shared.value.scores(batch[0].to_pylist()))], [*names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[1:])
    scored = given.mapInArrow(score, f"{kinds}, score double")
    return scored.select(*[F.col(n).alias(c) for n, c in zip(names, columns)], "score")
