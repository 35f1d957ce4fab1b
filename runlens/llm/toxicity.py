"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

`fit` learns a lexicon of terms and stems from a bounded sample of labelled rows, joins its trie with Levenshtein automata into one deterministic
automaton that accepts every word within one edit of a long enough term, and fits a logistic model on window scores. `scored` runs the automaton
over the distinct words of each batch of whole texts. A hit counts more with other hits in its window and less inside quotation marks.

Words are maximal runs of letters, in lower case. Defined results: null and empty texts and texts without hits get the model's score for no hits;
with no labelled rows, or only one class, the score is the (smoothed) share of toxic rows and the lexicon is empty; rows with equal ids are
scored one by one; of rows with equal ids one, by the text's hash, is learned from; a document with several labels counts as toxic if one of them says so;
an empty table gives no rows; texts may be of any length, as time is linear in a text; quotations end with their line; extra columns are kept by
`scored`.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import checkpointed, numbered, ship, slices

WORDS = re.compile(r"[^\W\d_]+")
_QUOTES = re.compile("[\"“”„«»‹›]")
#: Length from which a term may be met with one edit; shortest stem and longest.
FUZZY_FROM, STEMS = 5, (4, 6)
N_FEATURES = 6


class Automaton:
    """Deterministic automaton over words. `accept[state]` is 0 or the number of an outcome: 1 + 2 * entry + (1 if edited)."""

    def __init__(self, terms: list[str], max_edits: int = 1):
        """terms: words, or stems that end in `*` and accept what follows."""
        children: list[dict[str, int]] = [{}]
        ends: list[list[tuple[int, bool, int]]] = [[]]  # entry, whether a stem, edits allowed
        for k, term in enumerate(terms):
            body, node = term.rstrip("*"), 0
            for c in body:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append([])
                node = children[node][c]
            stem = term.endswith("*")
            ends[node].append((k, stem, 0 if stem or len(body) < FUZZY_FROM else max_edits))
        alphabet = sorted({c for x in children for c in x})
        # the most edits that any term below a node allows: positions beyond that are dropped
        slack = [0] * len(children)
        for node in range(len(children) - 1, -1, -1):
            slack[node] = max(chain((e for _, _, e in ends[node]), (slack[x] for x in children[node].values())), default=0)

        def closed(places: set[tuple[int, int]]) -> frozenset:
            todo, best = list(places), {}
            while todo:
                node, e = todo.pop()
                if e > (slack[node] if node >= 0 else 0) or best.get(node, 9) <= e:
                    continue
                best[node] = e
                if node >= 0:
                    todo += [(x, e + 1) for x in children[node].values()]  # a letter of the term is missing
            return frozenset(best.items())

        def after(state: frozenset, c: str | None) -> frozenset:
            out = set()
            for node, e in state:
                if node < 0:
                    out.add((node, e))  # a stem was met: the rest of the word doesn't matter
                    continue
                out.add((node, e + 1))  # a letter too many
                for x, child in children[node].items():
                    same = x == c
                    out.add((child, e + (not same)))
                    if same and e == 0:
                        out.update((-1 - k, 0) for k, stem, _ in ends[child] if stem)
            return closed(out)

        first = closed({(0, 0)})
        number, todo, rows = {first: 1, frozenset(): 0}, deque([first]), {0: [0] * (len(alphabet) + 1)}
        while todo:
            state = todo.popleft()
            row = []
            for c in [None, *alphabet]:
                new = after(state, c)
                if new not in number:
                    number[new] = len(number)
                    todo.append(new)
                row.append(number[new])
            rows[number[state]] = row
        self.table = np.array([rows[k] for k in range(len(number))], np.int32)
        self.accept = np.zeros(len(number), np.int32)
        for state, k in number.items():
            found = [(0, e, -1 - node) if node < 0 else (e, 0, entry) for node, e in state for entry in ([None] if node < 0 else [x for x, stem, most in ends[node] if not stem and e <= most])]
            found = [(e, stem, entry) for e, stem, entry in found]
            if exact := [x for x in found if x[0] == 0]:
                self.accept[k] = 1 + 2 * min(x[2] for x in exact)
            elif found:
                self.accept[k] = 2 + 2 * min(found)[2]
        self.code = np.zeros(0x110000, np.uint16)
        for k, c in enumerate(alphabet, 1):
            self.code[ord(c)] = k

    def match(self, words: list[str]) -> dict[str, int]:
        """Outcomes of the words that are accepted; all words step through the automaton together."""
        if not words:
            return {}
        size = np.fromiter(map(len, words), np.int64, len(words))
        codes = self.code[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        at, state = np.cumsum(size) - size, np.ones(len(words), np.int32)
        live, step = np.arange(len(words)), 0
        while len(live):
            live = live[(size[live] > step) & (state[live] > 0)]
            state[live] = self.table[state[live], codes[at[live] + step]]
            step += 1
        state[(size == 0)] = 0
        got = self.accept[state]
        return {words[k]: int(got[k]) for k in np.flatnonzero(got).tolist()}


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray  # of each term: log odds
    automaton: Automaton
    coefficients: np.ndarray
    intercept: float
    window: int = 12
    quoted_share: float = 0.25

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Rows of N_FEATURES window scores: most, sum of exact hits, of stems, of edited words, distinct terms, share of words hit."""
        lower = [(t or "").lower() for t in texts]
        words = [WORDS.findall(t) for t in lower]
        sets = [set(w) for w in words]
        met = self.automaton.match(list(set().union(*sets)))
        out = np.zeros((len(texts), N_FEATURES))
        for k, own in enumerate(sets):
            if met and not met.keys().isdisjoint(own):
                out[k] = self._windows(lower[k], words[k], met)
        return out

    def _windows(self, text: str, words: list[str], met: dict[str, int]) -> np.ndarray:
        hits = [(i, met[w]) for i, w in enumerate(words) if w in met]
        quoted = set()
        if _QUOTES.search(text):
            i = 0
            for line in text.split("\n"):
                marks = [m.start() for m in _QUOTES.finditer(line)]
                for m in WORDS.finditer(line):
                    before = bisect_left(marks, m.start()) if m[0] in met else 0
                    if before % 2 and before < len(marks):
                        quoted.add(i)
                    i += 1
        at = np.array([i for i, _ in hits])
        entry, edited = np.array([(o - 1) // 2 for _, o in hits]), np.array([(o - 1) % 2 for _, o in hits], bool)
        stem = np.array([self.terms[e].endswith("*") for e in entry])
        near = np.searchsorted(at, at + self.window, "right") - np.searchsorted(at, at - self.window, "left") - 1
        score = self.weights[entry] * (1 + 0.25 * np.log1p(near)) * np.where([i in quoted for i in at.tolist()], self.quoted_share, 1.0)
        exact = ~stem & ~edited
        return np.array([score.max(), np.log1p(score[exact].sum()), np.log1p(score[stem].sum()), np.log1p(score[edited].sum()), np.log1p(len(set(entry[exact].tolist()))), np.sqrt(len(hits) / len(words))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients + self.intercept, -30, 30)))


def _contexts(rows: DataFrame) -> DataFrame:
    """term, word, context: every word and stem of the texts with a hash of the words beside it. Copies of a text add nothing new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            found = set()
            for text in b.column(0).to_pylist():
                words = WORDS.findall((text or "").lower())
                for left, w, right in zip(["", *words], words, [*words[1:], ""]):
                    terms = [w, *(w[:n] + "*" for n in range(STEMS[0], STEMS[1] + 1) if len(w) > n)] if 3 <= len(w) <= 40 else []
                    found.update((t, w, f"{left} {right}") for t in terms)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*found) if found else ([], [], []))], names=["term", "word", "context"])

    return rows.select("text").mapInArrow(run, "term string, word string, context string")


def _counted(rows: DataFrame) -> DataFrame:
    seen = _contexts(rows).groupBy("term", F.xxhash64("word", "context").alias("h")).agg(F.first("word").alias("word"))
    return seen.groupBy("term").agg(F.count("*").alias("n"), F.approx_count_distinct("word").alias("words"))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Newton's method with an L2 penalty; the intercept goes free."""
    a = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(a.shape[1]), np.diag([penalty] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, most_toxic: int = 3000, most_clean: int = 4000, least: int = 6, least_odds: float = 2.3, most_terms: int = 400) -> Model:
    """Learns from at most `most_toxic` and `most_clean` labelled rows, chosen by the hash of doc_id (documented bounds).

    train: a condition on doc_id that labelled rows must meet. Terms come from three quarters of these rows, the model from the rest.
    All words and stems met in `least` contexts of toxic rows are weighed. The lexicon's size is bounded too: of those with `least_odds` (log odds)
    the `most_terms` with the largest product of contexts and log odds are kept.
    """
    spark = docs.sparkSession
    ship(spark)
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = (marks if train is None else marks.where(train)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n0, n1 = marks.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    by_hash = (F.xxhash64("doc_id", F.lit(11)), "doc_id")
    ids = marks.where("toxic = 1").orderBy(*by_hash).limit(most_toxic).unionByName(marks.where("toxic = 0").orderBy(*by_hash).limit(most_clean))
    one = F.min(F.struct(F.xxhash64("text"), "text"))["text"]  # ids may recur
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(one.alias("text"))
    some = checkpointed(some.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(4))), "labelled")
    learn, test = some.where("part < 3"), some.where("part = 3")
    size = {r.toxic: r.n for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    terms: list[str] = []
    weights = np.zeros(0)
    if n0 and n1 and size.get(1):
        toxic = _counted(learn.where("toxic = 1")).where((F.col("n") >= least) & (~F.col("term").endswith("*") | (F.col("words") >= 3)))
        good = _counted(learn.where("toxic = 0")).select("term", F.col("n").alias("n_good"))
        rate = (size.get(1, 0) + 1) / (size.get(0, 0) + 1)
        odds = F.log((F.col("n") + 0.5) / (F.coalesce("n_good", F.lit(0)) + 0.5) / rate)
        weighed = toxic.join(good, "term", "left").select("term", "n", odds.alias("odds")).where(F.col("odds") >= least_odds)
        found = sorted((r.term, r.odds) for r in weighed.orderBy(F.desc(F.col("n") * F.col("odds")), "term").limit(most_terms).collect())
        terms, weights = [t for t, _ in found], np.array([o for _, o in found])
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    model = Model(terms, weights, Automaton(terms), np.zeros(N_FEATURES), prior)
    if terms:
        rows = featured(test, model, ("doc_id", "toxic")).orderBy("doc_id").collect()
        x, y = np.array([r.features for r in rows]).reshape(len(rows), N_FEATURES), np.array([float(r.toxic) for r in rows])
        if 0 < y.sum() < len(y):
            model.coefficients, own = logistic(x, y)
            # the sample has another share of toxic rows than the labels
            model.intercept = own + prior - float(np.log(y.sum() / (len(y) - y.sum())))
    return model


def featured(docs: DataFrame, model: Model, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """`keep`, the window scores and the probability, of every whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, 6 << 20):
            x = shared.value.features(b.column(b.schema.get_field_index(text)).to_pylist())
            kept = [b.column(b.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(shared.value.probability(x))], names=[*keep, "features", "score"])

    rows = docs.select(*dict.fromkeys((text, *keep)))
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep), "features array<double>, score double"])
    return rows.mapInArrow(run, schema)


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and score, the probability of being toxic."""
    return featured(docs, model, keep).drop("features")


def accepted(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """The documents with a score below `limit`, with their own columns, whatever these are called."""
    plain = numbered(docs)
    rows = featured(plain, model, tuple(plain.columns), text=plain.columns[docs.columns.index("text")]).where(F.col("score") < limit)
    return rows.select(*plain.columns).toDF(*docs.columns)
