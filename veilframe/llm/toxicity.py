"""Toxicity from a learnt lexicon, matched through Levenshtein automata, and from the context of each match.

Fitting reads labelled training rows, FIT_ROWS at most (those with the least hash of their id). Words and stems (word prefixes)
that toxic documents have RATIO times as often as others become terms; a stem is grown as long as it keeps nine tenths of its
documents. Terms stand in a trie. A word runs through the product of the trie and the terms' Levenshtein automata (one edit
from 5 letters on, two from 9, stems only from 7), determinised on the way, so most words end after a few letters, and each
distinct word of a task runs once. A match is told apart by whether quotation marks surround it within WINDOW words and by the
log odds of the words around it, learnt from the windows of the training matches. A ridge logistic regression on the counts of
matches by kind (exact or fuzzy, plain or quoted), their density and context gives the score.

Defined cases: null text counts as empty; texts without a match score by the intercept; repeated rows score alike; null ids
count as training rows (their checksum is that of the empty text) and have no label; without labels every score is 0; an
empty table gives no rows; further columns, and labels, lang and source, are never read for a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import table

#: The most labelled rows that a fit reads.
FIT_ROWS = 20_000
#: Least share of the toxic rows that have a term: with the length of a text it bounds the lexicon, whatever the corpus.
SHARE, LEAST, RATIO, KEEP = 0.015, 5, 20.0, 0.9
SHORTEST, LONGEST = 4, 14
WINDOW = 12
EDGE = "#$%&|@=+\"'`.,;:!?()[]{}<>«»“”„‘’…*_~-"
OPEN, SHUT, BOTH = "«“„", "»”", '"'
KINDS = 4  # exact plain, exact quoted, fuzzy plain, fuzzy quoted


@dataclass
class Lexicon:
    """A trie of terms; a stem matches every word that begins with it. allow: edits for each node's terms."""

    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[tuple[str, bool, int] | None] = field(default_factory=lambda: [None])
    allow: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self):
        self.forget()

    def forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.final: list[int] = []
        self.stuck: list[int] = []

    def add(self, term: str, stem: bool) -> None:
        edits = 0 if len(term) < (7 if stem else 5) else 1 if len(term) < 9 else 2
        at = 0
        self.allow[0] = max(self.allow[0], edits)
        for ch in term:
            if ch not in self.children[at]:
                self.children[at][ch] = len(self.children)
                self.children.append({})
                self.ends.append(None)
                self.allow.append(0)
            at = self.children[at][ch]
            self.allow[at] = max(self.allow[at], edits)
        self.ends[at] = (term, stem, edits)

    def _state(self, least: dict[int, int]) -> int:
        """The state of a set of (node, edits so far), with letters of terms left out added."""
        todo = list(least.items())
        while todo:
            node, k = todo.pop()
            for child in self.children[node].values():
                if k < self.allow[child] and least.get(child, 9) > k + 1:
                    least[child] = k + 1
                    todo.append((child, k + 1))
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(tuple(sorted(key)))
            self.moves.append({})
            ends = [(self.ends[n], k) for n, k in key if self.ends[n] and k <= self.ends[n][2]]
            self.final.append(1 if any(k == 0 for _, k in ends) else 2 if ends else 0)
            stems = [k for e, k in ends if e[1]]
            self.stuck.append(1 if 0 in stems else 2 if stems else 0)
        return self.states[key]

    def _move(self, state: int, ch: str) -> int:
        least: dict[int, int] = {}
        for node, k in self.sets[state]:
            got = self.children[node].get(ch)
            if got is not None:
                least[got] = min(least.get(got, 9), k)
            if k < self.allow[node]:  # a letter too many
                least[node] = min(least.get(node, 9), k + 1)
            for child in self.children[node].values():  # another letter
                if k < self.allow[child]:
                    least[child] = min(least.get(child, 9), k + 1)
        to = self._state(least) if least else -1
        self.moves[state][ch] = to
        return to

    def match(self, word: str) -> int:
        """0: no term, 1: a term as it is, 2: a term with edits."""
        if not self.sets:
            self._state({0: 0})
        state, found = 0, 0
        for ch in word:
            state = self.moves[state].get(ch, -2) if ch in self.moves[state] else self._move(state, ch)
            if state < 0:
                return found
            if stuck := self.stuck[state]:
                found = stuck if not found else min(found, stuck)
                if found == 1:
                    return 1
        end = self.final[state]
        return min(found, end) if found and end else found or end


def _matches(lexicon: Lexicon, cache: dict[str, int], words: list[str]) -> list[tuple[int, int]]:
    """(position, 1 or 2) of every match."""
    out = []
    for i, w in enumerate(words):
        m = cache.get(w)
        if m is None:
            if len(cache) > 1_000_000:  # bounds a task's memory
                cache.clear()
            m = cache[w] = lexicon.match(w.strip(EDGE))
        if m:
            out.append((i, m))
    return out


def _quoted(words: list[str], i: int) -> bool:
    core = words[i].strip(EDGE)
    cut = words[i].find(core)
    left = " ".join([*words[max(0, i - WINDOW) : i], words[i][:cut]])
    right = " ".join([words[i][cut + len(core) :], *words[i + 1 : i + 1 + WINDOW]])
    if any(left.count(a) > left.count(b) and b in right for a in OPEN for b in SHUT):
        return True
    return left.count(BOTH) % 2 == 1 and BOTH in right


def _around(words: list[str], i: int) -> set[str]:
    near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
    return {w.strip(EDGE) for w in near}


def _step(k: int) -> int:
    """k with its three first binary digits: 8, 10, 12, 14, 16, 20, ..."""
    cut = max(0, k.bit_length() - 3)
    return k >> cut << cut


def features(lexicon: Lexicon, context: dict[str, float], cache: dict[str, int], text: str | None) -> tuple[int, ...]:
    """Whole numbers, so that equal vectors can be counted: matches by kind, density in 200ths of the words, context in tenths. Counts go
    on by steps of a quarter from 8 on, so that a long text's are as telling as a short one's and distinct vectors stay few."""
    words = (text or "").lower().split()
    kinds, odds, found = [0] * KINDS, 0.0, _matches(lexicon, cache, words)
    for i, m in found:
        kinds[(m - 1) * 2 + _quoted(words, i)] += 1
        near = [context[w] for w in _around(words, i) if w in context]
        odds += sum(near) / (len(near) + 4)
    if not found:
        return (0,) * (KINDS + 2)
    density = round(200 * len(found) / max(20, len(words)))
    return (*[_step(k) for k in kinds], _step(density), round(10 * odds / len(found)))


def _inputs(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, float).reshape(-1, KINDS + 2)
    return np.column_stack([np.ones(len(v)), v[:, :KINDS] > 0, np.log1p(v[:, :KINDS]), np.log1p(v[:, KINDS]), v[:, KINDS + 1] / 10])


@dataclass
class Model:
    lexicon: Lexicon
    context: dict[str, float]
    weights: np.ndarray | None

    def scores(self, texts) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        cache: dict[str, int] = self.__dict__.setdefault("cache", {})
        rows = [features(self.lexicon, self.context, cache, t) for t in texts]
        return 1 / (1 + np.exp(-np.clip(_inputs(np.array(rows)) @ self.weights, -500, 500)))

    def __getstate__(self):
        self.lexicon.forget()
        return {k: v for k, v in self.__dict__.items() if k != "cache"}


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _candidates(text: str | None) -> set[str]:
    """Words (with a mark at the end) and stems of a text."""
    out = set()
    for w in {w.strip(EDGE) for w in (text or "").lower().split()}:
        if len(w) >= 3:
            out.add(w + "$")
        out.update(w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


def _counted(rows: DataFrame, of, name: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: Counter = Counter()
        for b in batches:
            for text, label in zip(b["text"], b["toxic"], strict=True):
                count.update((x, int(label)) for x in of(text))
            if len(count) > 500_000:
                yield frame(count)
                count.clear()
        yield frame(count)

    def frame(count: Counter) -> pd.DataFrame:
        return pd.DataFrame([(*k, n) for k, n in count.items()], columns=[name, "toxic", "n"])

    return rows.select("text", "toxic").mapInPandas(run, f"{name} string, toxic int, n long").groupBy(name, "toxic").agg(F.sum("n").alias("n"))


def choose_terms(counts: dict[str, tuple[int, int]], toxic: int, others: int) -> list[tuple[str, bool]]:
    """(term, stem) from the numbers of toxic and other rows with each candidate."""

    def telling(c: str) -> bool:
        a, b = counts[c]
        return (a + 0.5) / (toxic + 1) >= RATIO * (b + 0.5) / (others + 1)

    good = {c for c in counts if telling(c)}
    stems = sorted((c for c in good if c[-1] != "$"), key=lambda c: (len(c), c))
    chosen: set[str] = set()
    for c in stems:
        if any(c[:k] in chosen for k in range(SHORTEST, len(c))):
            continue
        while True:
            longer = [x for x in good if len(x) == len(c) + 1 and x.startswith(c) and counts[x][0] >= KEEP * counts[c][0]]
            if not longer or c[-1] == "$":
                break
            c = max(longer, key=lambda x: (x[-1] == "$", counts[x][0], x))
        chosen.add(c)
    covered = lambda w: any(w[:k] in chosen for k in range(SHORTEST, len(w)))
    chosen |= {c for c in good if c[-1] == "$" and not covered(c)}
    return sorted((c.rstrip("$"), c[-1] != "$") for c in chosen)


def regression(vectors: np.ndarray, n1: np.ndarray, n0: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a ridge logistic regression on counted vectors, by Newton steps."""
    x, n = _inputs(vectors), n1 + n0
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + keep, x.T @ (n1 - n * p) - keep @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    known = (
        labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(fit_rows)
    )
    # fit_rows rows of two numbers are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("text", "toxic")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return Model(Lexicon(), {}, None)
    least = max(LEAST, math.ceil(SHARE * size[1]))
    first = _counted(rows.where("toxic = 1"), _candidates, "term").where(F.col("n") >= least)
    common = {r["term"]: r["n"] for r in first.collect()}
    second = _counted(rows.where("toxic = 0"), lambda t: _candidates(t) & common.keys(), "term")
    other = {r["term"]: r["n"] for r in second.collect()}
    lexicon = Lexicon()
    for term, stem in choose_terms({c: (n, other.get(c, 0)) for c, n in common.items()}, size[1], size[0]):
        lexicon.add(term, stem)

    def windows(text: str | None) -> set[str]:
        words = (text or "").lower().split()
        return set().union(*[_around(words, i) for i, _ in _matches(lexicon, {}, words)])

    lexicon.forget()
    seen: dict[str, list[int]] = {}
    for r in _counted(rows, windows, "word").groupBy("word").pivot("toxic", [0, 1]).sum("n").na.fill(0).where(F.col("0") + F.col("1") >= least).collect():
        seen[r["word"]] = [r["0"], r["1"]]
    lexicon.forget()
    # whether there is anything to tell apart: words around matches in other rows
    ones, noes = sum(x[1] for x in seen.values()) + 1, sum(x[0] for x in seen.values()) + 1
    context = {w: math.log((b + 1) / ones * noes / (a + 1)) for w, (a, b) in seen.items()} if noes > 20 else {}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for b in batches:
            got: Counter = Counter(
                (",".join(map(str, features(lexicon, context, cache, t))), int(y)) for t, y in zip(b["text"], b["toxic"], strict=True)
            )
            yield pd.DataFrame([(*k, n) for k, n in got.items()], columns=["vector", "toxic", "n"])

    table_ = rows.mapInPandas(vectors, "vector string, toxic int, n long").groupBy("vector").pivot("toxic", [0, 1]).sum("n").na.fill(0)
    got = sorted((r["vector"], r["0"], r["1"]) for r in table_.collect())  # fit_rows at most
    lexicon.forget()
    x = np.array([[int(v) for v in r[0].split(",")] for r in got])
    weights = regression(x, np.array([r[2] for r in got], float), np.array([r[1] for r in got], float))
    return Model(lexicon, context, weights)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    score = F.pandas_udf(lambda texts: pd.Series(model.scores(texts.tolist()), dtype="float64"), "double")
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def op3_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
