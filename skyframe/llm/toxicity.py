"""Toxicity from a learned lexicon, matched by Levenshtein automata over its trie.

Terms and word beginnings that set toxic documents apart are learned from a bounded sample of labelled rows.  A token is
run through the automaton of all its terms at once: a lazily built state is a set of (trie node, edits so far), so
misspelled terms are found without comparing a word with each term.  A window of words around a hit tells quotation from
abuse.  A logistic model over the hits of a document gives its score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.llm.arrow import WORD, blocks, texts_of
from skyframe.llm.hashed import sigmoid
from skyframe.llm.labelled import labelled_sample

#: Labelled rows that the lexicon and the model are learned from, and entries of the lexicon.
FIT_ROWS = 16_000
MAX_TERMS = 4000
#: Toxic documents a term must occur in, and its log odds against clean documents.
MIN_DOCS = 4
MIN_LOG_ODDS = 1.2
#: Letters of a term from which one and two edits are allowed; only terms never seen in clean documents allow any.
ONE_EDIT, TWO_EDITS = 5, 9
#: Letters of the word beginnings that can be terms.
STEMS = range(3, 8)
#: Words on each side of a hit that are looked at.
WINDOW = 6
PREDICT_AT = 0.7

QUOTES = "\"'«»“”„‘’"
STRIP = QUOTES + ".,;:!?()[]{}<>|#*$%&_-~/\\"
#: Characters that stand for letters.
FOLD = str.maketrans("013457@$", "oieastas")
#: Words near a quoted term, and words that address the reader.
REPORTING = frozenset("said says called calls quote quoted word words term dit wort palabra sagte llamó mot".split())
ADDRESS = frozenset("you your you're youre u du dein dich tu te ton tú eres vous sie".split())


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    weight: float
    edits: int


@dataclass
class Lexicon:
    """A trie of terms and the states of its Levenshtein automaton that texts have reached so far."""

    terms: list[Term]
    child: list[dict[str, int]] = field(init=False)
    ends: list[Term | None] = field(init=False)
    room: list[int] = field(init=False)

    def __post_init__(self):
        self.child, self.ends, self.room = [{}], [None], [0]
        for t in self.terms:
            node = 0
            for c in t.text:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append(None)
                    self.room.append(0)
                node = self.child[node][c]
                # most edits that any term below allows
                self.room[node] = max(self.room[node], t.edits)
            if self.ends[node] is None or t.weight > self.ends[node].weight:
                self.ends[node] = t
        self._forget()

    def _forget(self):
        self.states: list[tuple[tuple[int, int], ...]] = [((0, 0),)]
        self.known = {self.states[0]: 0}
        self.step: list[dict[str, int]] = [{}]
        self.found: list[tuple[float, float, float] | None] = [(0.0, 0.0, 0.0)]

    def _close(self, at: dict[int, int]) -> tuple[tuple[int, int], ...]:
        """Add the nodes reached by leaving out letters of a term."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            for nxt in self.child[node].values():
                if e < self.room[nxt] and at.get(nxt, 99) > e + 1:
                    at[nxt] = e + 1
                    todo.append((nxt, e + 1))
        return tuple(sorted(at.items()))

    def _next(self, state: int, c: str) -> int:
        at: dict[int, int] = {}
        for node, e in self.states[state]:
            for letter, nxt in self.child[node].items():
                # the first letter of a term is never edited
                cost = e + (letter != c)
                if cost <= (self.room[nxt] if node else 0) and at.get(nxt, 99) > cost:
                    at[nxt] = cost
            if node and e < self.room[node] and at.get(node, 99) > e + 1:
                at[node] = e + 1
        key = self._close(at)
        if key not in self.known:
            if len(self.states) > 50_000:
                self._forget()
            self.known[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
            whole = max((t.weight for n, e in key if e == 0 and (t := self.ends[n]) and not t.stem), default=0.0)
            near = max((t.weight for n, e in key if e > 0 and (t := self.ends[n]) and not t.stem and e <= t.edits), default=0.0)
            stem = max((t.weight for n, e in key if e == 0 and (t := self.ends[n]) and t.stem), default=0.0)
            self.found.append((whole, near, stem))
        return self.known[key]

    def match(self, token: str) -> tuple[float, int]:
        """(weight, kind) of the best term in a token: 0 none, 1 whole, 2 misspelled, 3 beginning."""
        word = token.lower().strip(STRIP)
        best = self._run(word)
        if not best[1] and (folded := word.translate(FOLD)) != word:
            best = self._run(folded)
            best = (best[0], 2 if best[1] else 0)
        return best

    def _run(self, word: str) -> tuple[float, int]:
        state, stem = 0, 0.0
        for c in word:
            nxt = self.step[state].get(c)
            if nxt is None:
                size = len(self.states)
                nxt = self._next(state, c)
                if len(self.states) >= size:
                    self.step[state][c] = nxt
            state = nxt
            if not self.states[state]:
                return stem, 3 if stem else 0
            stem = max(stem, self.found[state][2])
        whole, near, _ = self.found[state]
        return (whole, 1) if whole else (stem, 3) if stem >= near and stem else (near, 2) if near else (0.0, 0)


class _Memo(dict):
    """Match of each distinct token; forgets all when it has grown large."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, token: str) -> tuple[float, int]:
        if len(self) > 300_000:
            self.clear()
        found = self.lexicon.match(token) if len(token) > 2 else (0.0, 0)
        self[token] = found
        return found


FEATURES = 8


def context(words: list[str], i: int) -> float:
    """Factor of a hit by its window: less inside quotation, more where someone is addressed."""
    token, factor = words[i], 1.0
    before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
    open_before = any(w[0] in QUOTES and w[-1] not in QUOTES for w in before)
    quoted = (token[0] in QUOTES and token.rstrip(".,;:!?")[-1:] in QUOTES) or (open_before and any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in [token, *after]))
    near = {w.lower().strip(STRIP) for w in before + after}
    if quoted:
        factor *= 0.5 if near.isdisjoint(REPORTING) else 0.2
    if not near.isdisjoint(ADDRESS):
        factor *= 1.3
    return factor


def features(text: str, memo: _Memo) -> list[float]:
    """Counts and weights of the hits of a text, by kind, as they are and by its length."""
    words = WORD.findall(text)
    found = list(map(memo.__getitem__, words))
    hits = [i for i, f in enumerate(found) if f[1]]
    weight, count, last = [0.0] * 4, [0.0] * 4, -99
    close = 0.0
    for i in hits:
        w, kind = found[i]
        factor = context(words, i)
        weight[kind] += w * factor
        count[kind] += factor
        if i - last <= WINDOW:
            close += factor
        last = i
    total, n = sum(weight), max(len(words), 1)
    return [np.log1p(weight[1]), np.log1p(weight[2]), np.log1p(weight[3]), np.log1p(count[1]), np.log1p(count[3]), np.log1p(close),
            np.log1p(100 * total / n), np.log1p(100 * weight[3] / n)]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float
    predict_at: float = PREDICT_AT

    def scores(self, texts: list[str], memo: _Memo) -> np.ndarray:
        x = np.array([features(t, memo) for t in texts]).reshape(-1, FEATURES)
        return sigmoid(x @ self.weights + self.bias)


_TERM_ROW = "term string, half int, toxic bigint, clean bigint"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and word beginnings of each document; a beginning ends in '*'."""
    for part in blocks(batches):
        for text, target, half in zip(*(part.column(c).to_pylist() for c in ("text", "target", "half")), strict=True):
            words = {w for t in set(WORD.findall(text)) if 2 < len(w := t.lower().strip(STRIP)) <= 40}
            terms = list(words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k})
            flag = [pa.array([int(v)] * len(terms), k) for v, k in ((half, pa.int32()), (target == 1, pa.int64()), (target != 1, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *flag], names=["term", "half", "toxic", "clean"])


def _lexicon(counts: list[tuple[str, int, int]], toxic_docs: int, clean_docs: int, min_docs: int, max_terms: int) -> Lexicon:
    """Terms by their odds.  A word beginning that is found in few more toxic documents than one of its words is left out."""
    strong = []
    for term, toxic, clean in counts:
        odds = np.log((toxic + 0.5) / (toxic_docs + 1)) - np.log((clean + 0.5) / (clean_docs + 1))
        if toxic >= min_docs and odds >= MIN_LOG_ODDS:
            strong.append((term, toxic, clean, float(odds)))
    strong.sort(key=lambda r: (-r[3] * r[1] ** 0.5, r[0]))
    words: dict[str, int] = {}
    for term, toxic, _, _ in strong:
        if term[-1] != "*":
            for k in STEMS:
                words[term[:k]] = max(words.get(term[:k], 0), toxic)
    out = []
    for term, toxic, clean, odds in strong[:max_terms]:
        stem = term[-1] == "*"
        text = term.rstrip("*")
        if not text or stem and words.get(text, 0) > 0.7 * toxic:
            continue
        sure = not stem and not clean and toxic >= 2 * min_docs
        out.append(Term(text, stem, odds, 0 if not sure else 2 if len(text) >= TWO_EDITS else 1 if len(text) >= ONE_EDIT else 0))
    return Lexicon(out)


def learn_lexicons(sample: DataFrame, max_terms: int = MAX_TERMS) -> list[Lexicon]:
    """Lexicons of half 0, of half 1 and of all rows of a labelled sample."""
    totals = {r["half"]: (r["toxic"], r["clean"]) for r in sample.groupBy("half").agg(
        F.sum((F.col("target") == 1).cast("bigint")).alias("toxic"), F.sum((F.col("target") != 1).cast("bigint")).alias("clean")).collect()}
    t0, c0, t1, c1 = *totals.get(0, (0, 0)), *totals.get(1, (0, 0))
    by_half = [F.sum(F.when(F.col("half") == h, F.col(k)).otherwise(0)).alias(f"{k}{h}") for h in (0, 1) for k in ("toxic", "clean")]
    odds = F.log((F.col("toxic0") + F.col("toxic1") + 0.5) / (t0 + t1 + 1)) - F.log((F.col("clean0") + F.col("clean1") + 0.5) / (c0 + c1 + 1))
    rows = (sample.mapInArrow(_occurrences, _TERM_ROW).groupBy("term").agg(*by_half)
            .filter(F.col("toxic0") + F.col("toxic1") >= MIN_DOCS).withColumn("odds", odds).filter(F.col("odds") >= MIN_LOG_ODDS / 2)
            .orderBy((F.col("odds") * F.sqrt(F.col("toxic0") + F.col("toxic1"))).desc(), "term").limit(2 * max_terms).collect())
    half = max(2, MIN_DOCS // 2)
    return [_lexicon([(r["term"], r["toxic0"], r["clean0"]) for r in rows], t0, c0, half, max_terms),
            _lexicon([(r["term"], r["toxic1"], r["clean1"]) for r in rows], t1, c1, half, max_terms),
            _lexicon([(r["term"], r["toxic0"] + r["toxic1"], r["clean0"] + r["clean1"]) for r in rows], t0 + t1, c0 + c1, MIN_DOCS, max_terms)]


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    z = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(100):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text",
        rule: Callable[[str], Column] | None = None) -> ToxicityModel:
    """Learn from at most ``max_rows`` labelled documents that ``rule`` admits.

    The model over the hits is fitted on hits in the lexicon of the other half of the sample, so that no term is judged on
    the rows that chose it.  Without labels every text gets the same low score.
    """
    sample = labelled_sample(docs, labels, label_col, max_rows, id_col, text_col, rule).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    first, second, lexicon = learn_lexicons(sample)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(second), _Memo(first)
        for part in blocks(batches):
            x = [features(t, memo[h]) for t, h in zip(part.column("text").to_pylist(), part.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), part.column("target").cast(pa.float64())], names=["x", "y"])

    rows = sample.mapInArrow(measured, "x array<double>, y double").collect()
    if not rows:
        return ToxicityModel(lexicon, np.zeros(FEATURES), -2.0)
    return ToxicityModel(lexicon, *_fit_logistic(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from ``predict_at`` on), one row per document.

    Null and empty texts have no hits and get the lowest score.  Repeated rows and null ids give a row each; an empty
    table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(model.lexicon)
        for part in blocks(batches):
            p = model.scores(part.column("text").to_pylist(), memo)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array((p >= model.predict_at).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns.

    A row counts by its whole text alone: a null text counts as the empty one, ids may be null or repeat, equal texts stay or go
    together, and an empty table stays empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(model.lexicon)
        for part in blocks(batches, text_col):
            yield part.filter(pa.array(model.scores(part.column(text_col).fill_null("").to_pylist(), memo) < model.predict_at))

    return docs.mapInArrow(run, docs.schema)
