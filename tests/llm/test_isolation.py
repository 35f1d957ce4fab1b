import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from runlens.llm import isolation
from tests.llm.conftest import SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))


def test_statistics(spark, edge_rows, edge, clashing):
    rnd = random.Random(2)
    texts = [r[1] for r in edge_rows] + [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))) for _ in range(60)] + ["a b\nc\na b\n \n \nc", "x\x0by\x85z w " * 9]
    for t in texts:
        assert tuple(isolation.row_of(t)[:5]) == brute(t)
    for d in (edge, clashing):
        rows = isolation.statistics(d).collect()
        assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == sorted(brute(r[1]) for r in edge_rows)


def test_path_lengths_by_hand():
    x = np.random.default_rng(0).normal(size=(300, 2))
    f = isolation.grow(x, trees=20, subsample=64)
    rows = np.vstack([x[:5], [[9.0, 9.0]]])

    def path(t, r):
        n = 0
        while f.feature[t, n] >= 0:
            n = f.left[t, n] + (r[f.feature[t, n]] >= f.cut[t, n])
        return f.depth[t, n]

    want = [2 ** -(np.mean([path(t, r) for t in range(20)]) / f.scale) for r in rows]
    got = f.score(rows)
    assert np.allclose(got, want) and got[-1] > got[:-1].max()
    assert isolation.grow(x[:0]).score(rows).tolist() == [0.0] * 6 and isolation.grow(np.ones((50, 2))).score(rows).shape == (6,)


def test_calibration():
    good, bad = np.zeros(isolation.GRID, int), np.zeros(isolation.GRID, int)
    good[[1000, 2000, 3000, 3999]] = 25
    assert isolation.calibrated(good, bad, 0.0) == 0.4 and isolation.calibrated(good, bad, 0.25) == 0.3001
    bad[[8000, 9000]] = 10
    assert isolation.calibrated(good, bad, 0.0) == 0.8
    bad[3500] = 30
    assert isolation.calibrated(good, bad, 0.0) == 0.8 and isolation.calibrated(good, bad, 0.25) == 0.35


def test_all_labelled_rows_set_the_threshold(spark):
    rnd = random.Random(6)
    rows = [(i, prose(rnd, rnd.randint(30, 120)) if i % 10 else re.sub(" ", "%%% ", prose(rnd, 60)), "en", "s", 0) for i in range(400)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    forest = isolation.fit(docs, marks, sample_rows=100)
    score = np.array([r.anomaly for r in isolation.judged(docs, forest).orderBy("doc_id").collect()])
    label = np.arange(400) % 10 > 0
    count = lambda x: np.bincount(np.minimum((x * isolation.GRID).astype(int), isolation.GRID - 1), minlength=isolation.GRID)
    assert forest.threshold == isolation.calibrated(count(score[label]), count(score[~label]), 0.01)
    assert (score[label] > forest.threshold).mean() <= 0.01


def test_an_id_that_recurs_leaves_the_sample_as_it_is(spark):
    rnd = random.Random(8)
    rows = [(i, prose(rnd, rnd.randint(30, 120)), "en", "s", 0) for i in range(100)]
    marks = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    once, often = (isolation.fit(spark.createDataFrame(x, SCHEMA), marks, sample_rows=100) for x in (rows, [rows[7]] * 900 + rows))
    assert all((getattr(once, k) == getattr(often, k)).all() for k in ("feature", "cut", "left", "depth"))
    other = prose(rnd, 50)
    mixed = [(7, other, "en", "s", 0)] * 300
    a, b = (isolation.fit(spark.createDataFrame(x, SCHEMA).repartition(n), marks, sample_rows=100) for n, x in ((3, rows + mixed), (8, mixed + rows)))
    assert (a.cut == b.cut).all() and a.threshold == b.threshold


def test_many_labels_and_few_give_one_threshold(spark, monkeypatch):
    rnd = random.Random(9)
    docs = spark.createDataFrame([(i % 90, prose(rnd, rnd.randint(30, 120)), "en", "s", 0) for i in range(120)], SCHEMA)
    marks = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    few = isolation.fit(docs, marks)
    monkeypatch.setattr(isolation, "LABELS_BROADCAST", 3)
    assert isolation.fit(docs, marks).threshold == few.threshold


def test_junk_goes_and_the_rest_stays(spark, edge, clashing, empty):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        junk = i % 12 == 0
        text = prose(rnd, rnd.randint(30, 120))
        rows.append((i, re.sub(" ", "%%% ", text) if junk else text, "en", "s", 0))
        labels.append((i, int(not junk), 0))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    forest = isolation.fit(docs, marks)
    kept = isolation.judged(docs, forest).join(marks, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    share = {r.quality: r.k for r in kept.collect()}
    assert share[1] >= 0.98 and share[0] <= 0.1
    out = isolation.judged(edge, forest).collect()
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in out)
    assert isolation.passed(clashing, forest).columns == clashing.columns
    assert isolation.judged(empty, isolation.fit(empty, marks.limit(0))).count() == 0
