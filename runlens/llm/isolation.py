"""Quality rules: an isolation forest over rule statistics of each document.

`statistics` computes the rules' figures for whole texts. `fit` grows random isolation trees on a sample of at most `sample_rows` documents
(chosen by the hash of doc_id, a documented bound) and sets the threshold on all labelled rows: of the anomaly scores that at most `most_clean` of
the rows labelled good exceed, the one that best parts good from bad. `judged` scores every document: an isolated one (short mean path) is rejected.
Rows are counted by label and score, to `GRID` parts of 1, before they leave the executors.

Words are maximal runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return.
Time is linear in a text (but for sorting its windows), so texts may be of any length.
Defined results: null and empty texts have no words and fail the base rule; with no sample at all every document passes the method; with no
row labelled good the threshold is the quantile `1 - most_clean` of all scores; rows with equal ids are judged one by one and count each;
a document with several labels has the least of them; an empty table gives no rows; extra columns are kept by `judged`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import numbered, ship, slices

WINDOW = 8
#: Anomaly scores are counted, and the threshold is set, in steps of 1 / GRID.
GRID = 10_000
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further figures, for the forest alone.
MORE = ("n_chars", "n_upper", "n_punct", "n_distinct", "n_lines", "n_long")
_KEEP = bytes(range(256))
_NOT_SYMBOL = bytes(c for c in range(256) if c not in SYMBOLS)
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_PUNCT = bytes(c for c in range(256) if c not in b".,;:!?\"'()[]{}-")
_CONTINUED = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\v\f\r"
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more in the text, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key += h[k : k + n] * _POWERS[k]
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    if not same.any():
        return 0
    # equal hashes are compared word by word
    groups: dict[int, dict[tuple, list[int]]] = {}
    inside = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    for k, at in zip(key[inside].tolist(), order[inside].tolist()):
        groups.setdefault(k, {}).setdefault(tuple(words[at : at + WINDOW]), []).append(at)
    hit = np.zeros(len(words) + 1, np.int64)
    for found in groups.values():
        for places in found.values():
            if len(places) > 1:
                np.add.at(hit, places, 1)
                np.add.at(hit, np.array(places) + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(hit)[:-1]))


def row_of(text: str | None) -> list[int]:
    """COUNTS and MORE of one text."""
    raw = (text or "").encode()
    words = raw.split()
    solid = raw.translate(None, _SPACE)
    lines = [x for x in raw.split(b"\n") if x.translate(None, _SPACE)]
    return [
        len(words), len(solid.translate(None, _CONTINUED)), len(raw.translate(None, _NOT_SYMBOL)), len(lines) - len(set(lines)), repeated_words(words),
        len(raw.translate(None, _CONTINUED)), len(raw.translate(None, _NOT_UPPER)), len(raw.translate(None, _NOT_PUNCT)), len(set(words)), len(lines), max(map(len, words), default=0),
    ]


def features(counts: np.ndarray) -> np.ndarray:
    """The forest's inputs: shares and means that don't follow a text's length, from rows of COUNTS and MORE."""
    c = counts.astype(np.float64).T
    words, chars = np.maximum(c[0], 1), np.maximum(c[5], 1)
    distinct = c[8] / words**0.85  # distinct words grow more slowly than words
    return np.sqrt(np.stack([c[2] / words, c[2] / chars, c[1] / words, c[6] / chars, c[7] / words, distinct], 1))


@dataclass
class Forest:
    """Trees as flat arrays; path lengths of all rows are found level by level."""

    feature: np.ndarray  # trees x nodes, -1 at a leaf
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray  # at a leaf: its depth and the expected rest for the rows in it
    scale: float
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score, 0 to 1: 2 to the power of minus the mean path length over its expectation."""
        if not len(self.feature):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, cut, left, depth in zip(self.feature, self.cut, self.left, self.depth):
            node = np.zeros(len(x), np.int64)
            while True:
                at = f[node]
                inner = at >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(at, 0)] >= cut[node]
                node = np.where(inner, left[node] + right, node)
            total += depth[node]
        return 2.0 ** -(total / len(self.feature) / self.scale)


def expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int = 100, subsample: int = 256, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(subsample, len(x))
    limit = int(np.ceil(np.log2(max(size, 2))))
    built = []
    for _ in range(trees if size > 1 else 0):
        f, cut, left, depth = [-1], [0.0], [0], [0.0]
        todo = [(0, rng.choice(len(x), size, replace=False), 0)]
        while todo:
            node, rows, d = todo.pop()
            spread = np.flatnonzero(np.ptp(x[rows], axis=0) > 0) if len(rows) > 1 and d < limit else []
            if not len(spread):
                depth[node] = d + expected_path(len(rows))
                continue
            k = int(rng.choice(spread))
            lo, hi = x[rows, k].min(), x[rows, k].max()
            f[node], cut[node], left[node] = k, rng.uniform(lo, hi) if hi > lo else hi, len(f)
            f += [-1, -1]
            cut += [0.0, 0.0]
            left += [0, 0]
            depth += [0.0, 0.0]
            right = x[rows, k] >= cut[node]
            todo += [(left[node], rows[~right], d + 1), (left[node] + 1, rows[right], d + 1)]
        built.append((f, cut, left, depth))
    most = max((len(b[0]) for b in built), default=0)
    pad = lambda k, fill, kind: np.array([list(b[k]) + [fill] * (most - len(b[k])) for b in built], kind)
    return Forest(pad(0, -1, np.int64), pad(1, 0, float), pad(2, 0, np.int64), pad(3, 0, float), max(expected_path(size), 1.0))


STATS = ", ".join(f"{x} long" for x in (*COUNTS, *MORE))


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the rule figures of each document's whole text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 8 << 20):
            counts = np.array([row_of(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), *(pa.array(c) for c in counts.T)], names=[*keep, *COUNTS, *MORE])

    rows = docs.select("text", *keep)
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep), STATS])
    return rows.mapInArrow(run, schema)


def base_failed(n_words, n_repeat_words):
    """The base rule, for columns or arrays."""
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def calibrated(good: np.ndarray, bad: np.ndarray, most_clean: float) -> float:
    """good, bad: numbers of rows in each step of the score. The threshold, an upper end of a step, that rejects the largest share of bad rows less
    the share of good ones; at most `most_clean` of the good rows go."""
    over = lambda x: (x.sum() - np.cumsum(x)) / max(x.sum(), 1)
    allowed = np.flatnonzero(over(good) <= most_clean)
    gain = (over(bad) - over(good))[allowed] if bad.any() else np.zeros(len(allowed))
    best = np.flatnonzero(gain == gain.max())
    return float(allowed[best[-1] if bad.any() else 0] + 1) / GRID


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, most_clean: float = 0.01, trees: int = 100, subsample: int = 256, seed: int = 7) -> Forest:
    """The forest from at most `sample_rows` documents and its threshold from all labelled rows; documents that fail the base rule don't take part.

    Of rows with the same doc_id one, by the text's hash, stands in the sample; all of them count for the threshold.
    """
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample_rows)
    one = F.min(F.struct(F.xxhash64("text"), "text"))["text"]  # ids may recur
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(one.alias("text"))
    rows = statistics(chosen).orderBy("doc_id", *COUNTS, *MORE).toPandas()
    rows = rows[~base_failed(rows.n_words, rows.n_repeat_words)]
    if not len(rows):
        return grow(np.zeros((0, 6)), trees, subsample, seed)
    forest = grow(features(rows[[*COUNTS, *MORE]].to_numpy(np.int64)), trees, subsample, seed)
    marks = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    counts = _counted(docs, forest, marks)
    good, bad = counts[1], counts[0]
    if not good.any():
        good, bad = _counted(docs, forest, None).sum(axis=0), bad * 0
    forest.threshold = calibrated(good, bad, most_clean)
    return forest


#: Up to so many labelled documents their ids go to the documents; more of them meet the documents' scores in a join.
LABELS_BROADCAST = 1_000_000


def _counted(docs: DataFrame, forest: Forest, marks: DataFrame | None) -> np.ndarray:
    """Numbers of rows that pass the base rule, by quality (rows 0 and 1; 2 without marks) and step of the score. With marks, labelled rows alone."""
    step = F.least(F.floor(F.col("anomaly") * GRID), F.lit(GRID - 1)).cast("int").alias("step")
    scored = lambda d, *keep: judged(d, forest, keep).where("NOT base_failed").select(*keep, step)
    if marks is None:
        rows = scored(docs, "doc_id").select(F.lit(2).alias("quality"), "step")
    elif marks.limit(LABELS_BROADCAST + 1).count() <= LABELS_BROADCAST:
        rows = scored(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id"), "doc_id", "quality")
    else:
        rows = scored(docs, "doc_id").join(marks, "doc_id")
    counts = np.zeros((3, GRID), np.int64)
    for r in rows.groupBy("quality", "step").agg(F.count("*").alias("n")).collect():
        counts[r.quality, r.step] = r.n
    return counts


def judged(docs: DataFrame, forest: Forest, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, the rule figures, base_failed, the anomaly score and kept, for every document. text: the name of its column."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    keep = tuple(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, 8 << 20):
            counts = np.array([row_of(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()], np.int64)
            failed = base_failed(counts[:, 0], counts[:, 4])
            score = shared.value.score(features(counts))
            made = [*counts.T, failed, score, ~failed & (score <= shared.value.threshold)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), *map(pa.array, made)], names=[*keep, *COUNTS, *MORE, "base_failed", "anomaly", "kept"])

    rows = docs.select(*dict.fromkeys((text, *keep)))
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep), STATS, "base_failed boolean, anomaly double, kept boolean"])
    return rows.mapInArrow(run, schema)


def passed(docs: DataFrame, forest: Forest) -> DataFrame:
    """The documents that pass, with their own columns, whatever these are called."""
    plain = numbered(docs)
    kept = judged(plain, forest, keep=tuple(plain.columns), text=plain.columns[docs.columns.index("text")]).where("kept")
    return kept.select(*plain.columns).toDF(*docs.columns)
