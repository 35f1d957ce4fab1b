import math
import random

import numpy as np
from pyspark.sql import functions as F

from runlens.llm import langid
from runlens.llm.common import fold
from tests.llm.conftest import SCHEMA


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network.new(["a", "b", "c"], 4, 0)
    for k in ("embed", "recur", "out", "bias"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    x = rng.integers(0, 256, (7, 5)).astype(np.uint8)
    mask, y = (np.arange(7)[:, None] < np.array([7, 3, 5, 7, 1])).astype(np.float64), np.array([0, 1, 2, 0, 1])
    for name, g in zip(("embed", "recur", "out", "bias"), net.gradients(x, mask, y)[1]):
        w = getattr(net, name)
        for i in [tuple(i) for i in np.argwhere(np.abs(g) > 1e-4)[::17]][:5]:
            old = w[i]
            w[i] = old + 1e-2
            a = net.gradients(x, mask, y)[0]
            w[i] = old - 1e-2
            b = net.gradients(x, mask, y)[0]
            w[i] = old
            assert abs((a - b) / 2e-2 - g[i]) < 2e-3 * max(abs(g[i]), 1e-2)


def plain_forward(net, raw):
    """One position and one direction after the other, in plain Python."""
    soft = lambda v: v / (1 + abs(v))
    width, states = net.recur.shape[1], []
    for k, seen in enumerate((raw, raw[::-1])):
        h, out = [0.0] * width, []
        for byte in seen:
            gx = [float(v) for v in net.embed[k][byte]]
            gh = [sum(h[i] * float(net.recur[k][i][j]) for i in range(width)) for j in range(3 * width)]
            z = [soft(gx[j] + gh[j]) / 2 + 0.5 for j in range(width)]
            r = [soft(gx[width + j] + gh[width + j]) / 2 + 0.5 for j in range(width)]
            n = [soft(gx[2 * width + j] + r[j] * gh[2 * width + j]) for j in range(width)]
            h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(width)]
            out.append(h)
        states.append(out if k == 0 else out[::-1])
    rows = []
    for ahead, back in zip(*states):
        score = [sum(v * float(net.out[i][c]) for i, v in enumerate(ahead + back)) + float(net.bias[c]) for c in range(len(net.langs))]
        top = [math.exp(v) for v in score]
        rows.append([v / sum(top) for v in top])
    return rows


def test_forward_against_plain_python():
    net = langid.Network.new(["a", "b", "c"], 4, 5)
    text = "Any text, été 日 " * 5
    raw = text.encode().translate(langid._LOWER)
    want = [p for i in range(0, len(raw), 32) for p in plain_forward(net, raw[i : i + 32])]
    assert np.allclose(net.pooled([raw], 32)[0], np.mean(want, axis=0), atol=1e-5)
    assert net.labels(text, 32) == [net.langs[int(np.argmax(p))] for p in want]


def test_very_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 3)
    docs = spark.createDataFrame([(i, "some words", f"l{i % 40}", "s", 0) for i in range(90)], SCHEMA)
    assert langid.fit(docs, steps=2).langs == ["l0", "l1", "l2"]


def test_pooling_reads_whole_texts_and_lanes_change_nothing():
    net = langid.Network.new(["a", "b"], 4, 1)
    texts = [b"x" * 5, b"", b"abc" * 100, bytes(range(97, 120)) * 7, b"q"]
    p = net.pooled(texts, 16)
    assert np.allclose(p, net.pooled(texts, 16, lanes=2), atol=1e-5)
    for k, t in enumerate(texts):
        parts = [net.probabilities(net.run(np.frombuffer(t[i : i + 16], np.uint8)[:, None], np.ones((len(t[i : i + 16]), 1), np.float32)))[:, 0] for i in range(0, len(t), 16)]
        assert np.allclose(p[k], np.concatenate(parts).mean(0) if parts else 0, atol=1e-5)
    assert len(net.labels("héllo")) == 6


def test_held_out_rows_and_edges(spark, edge, edge_rows, clashing, empty):
    rnd = random.Random(3)
    stems = {"en": "the and thing erth blen oning".split(), "de": "und sch keit ung ließ über".split(), "fr": "eaux elle ment ère ouai que".split()}
    rows = [(i, " ".join(rnd.choice(stems[lang]) + rnd.choice(stems[lang]) for _ in range(rnd.randint(10, 60))), lang, "s", 0) for i, lang in enumerate(rnd.choice(list(stems)) for _ in range(600))]
    docs = spark.createDataFrame(rows, SCHEMA)
    net = langid.fit(docs, learn=fold("doc_id", 4) != 2, steps=60, batch=128)
    held = langid.predicted(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where(fold("doc_id", 4) == 2)
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    for d in (edge, clashing):
        got = langid.predicted(d, net).collect()
        assert len(got) == len(edge_rows)
        by = {r.doc_id: r for r in got}
        assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (2, 3, 4, 11)) and all(0 <= r.score <= 1 for r in got)
    assert langid.predicted(empty, net).count() == 0
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predicted(edge, none).collect()} == {"und"}
    assert {r.lang_pred for r in langid.predicted(docs.limit(3), langid.fit(docs.where("lang = 'en'"))).collect()} == {"en"}
