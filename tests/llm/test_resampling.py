import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from runlens.llm import resampling
from tests.llm.conftest import SCHEMA, prose


def features(text, depth=2):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, depth + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, buckets, least_words, percent, depth=2):
    each = [features(t, depth) for _, t in rows]
    s, t = Counter(x % buckets for _, f in each for x in f), Counter(x % buckets for y in target for x in features(y, depth)[1])
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[k] + 1.0) * (all_s + buckets) / ((s[k] + 1.0) * (all_t + buckets)))) for k in range(buckets)]
    out = []
    for (i, _), (n, f) in zip(rows, each):
        weight = sum(gain[x % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    apt = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    return out, apt[: percent * len(apt) // 100]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abAB 9-é日x", max_size=60)), max_size=12), st.integers(1, 4))
def test_trie_holds_all_paths(texts, depth):
    trie = resampling.Trie(pa.array([*texts, "w" * 90 + " " + "é" * 70 + " z"], pa.string()), depth)
    texts = [*texts, "w" * 90 + " " + "é" * 70 + " z"]
    want = Counter(x for t in texts for x in features(t, depth)[1])
    have = Counter()
    for state, count, _, _ in trie.levels:
        assert len(set(state.tolist())) == len(state)  # a node for each path
        have.update(dict(zip(state.tolist(), count.tolist())))
    assert have == want
    n, total, words = trie.walked(np.arange(1000))
    assert n.tolist() == [len(features(t, depth)[1]) for t in texts] and words.tolist() == [features(t)[0] for t in texts]
    assert total.tolist() == [sum(x % 1000 for x in features(t, depth)[1]) for t in texts]


def test_crc_table():
    one = np.array([zlib.crc32(bytes([k])) for k in range(256)], np.uint32)
    own = ~resampling._CRC[np.arange(256) ^ 255] ^ np.uint32(0x00FFFFFF)
    assert (own == one).all()


def same(got, rows, target, buckets, least, percent):
    want, drawn = brute(rows, target, buckets, least, percent)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(want, key=key)
    ranks = sorted((r["rank"], str(r.doc_id), r.score) for r in got if r["rank"] is not None)
    assert [r[0] for r in ranks] == list(range(1, len(drawn) + 1)) and [r[1:] for r in ranks] == [(str(x[0]), x[4]) for x in drawn]


def test_against_brute_force(spark, edge_rows, clashing):
    rnd = random.Random(3)
    rows = [r[:2] for r in edge_rows] + [(100 + k, prose(rnd, rnd.randint(0, 60))) for k in range(200)]
    target = [prose(rnd, 30) + " sigma tau" for _ in range(9)] + [None, ""]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).repartition(5)
    bench = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    same(resampling.resampled(docs, bench, buckets=500).collect(), rows, target, 500, 20, 25)
    same(resampling.resampled(clashing, bench, buckets=100, least_words=1, percent=60).collect(), [r[:2] for r in edge_rows], target, 100, 1, 60)


def test_empty_tables_and_kept_columns(spark, clashing, edge_rows, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(empty, none).count() == 0
    same(resampling.resampled(clashing, none, buckets=50).collect(), [r[:2] for r in edge_rows], [], 50, 20, 25)
    kept = resampling.resampled(clashing.drop("score", "n_words"), none, keep=("doc_id", "text", "spans"))
    assert kept.columns == ["doc_id", "text", "spans", "n_words", "n_features", "weight", "score", "rank"] and kept.count() == len(edge_rows)


def test_one_id_for_very_many_rows(spark):
    """Equal scores and ids are spread over partitions and still get a rank each."""
    docs = spark.createDataFrame([(5, "alpha beta gamma " * 8, None, None, None)] * 400, SCHEMA)
    rows = resampling.resampled(docs, docs.limit(3), percent=50).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 201))
