import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from runlens.llm import fmindex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            for k in range(max(len(b) - width + 1, 1) if b else 0):
                win = b[k : k + width]
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        hit.update(range(a, a + len(win)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=80))
def test_suffix_array_and_search(values):
    seq = np.array([*values, 0], np.int32)
    place = {int(i): k for k, i in enumerate(np.flatnonzero(seq == 0))}

    def key(i):
        out = []
        while seq[i]:
            out.append((1, int(seq[i])))
            i += 1
        return [*out, (0, place[i])]

    assert fmindex.suffix_array(seq).tolist() == sorted(range(len(seq)), key=key)
    index = fmindex.FMIndex(seq, 4)
    for phrase in ([1], [2, 1], [3, 3, 3], [1, 2, 3]):
        m = np.zeros((1, 3), np.int64)
        m[0, 3 - len(phrase) :] = phrase
        lo, hi = index.search(m, np.array([len(phrase)]))
        at = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
        assert at == [i for i in range(len(seq)) if seq[i : i + len(phrase)].tolist() == phrase]


def test_against_brute_force(spark, edge, edge_rows, empty, clashing):
    text = edge_rows[0][1]
    w = text.split(" ")
    items = [(1, " ".join(w[5:30])), (2, "SAME  text, here for: all of us"), (10, "same text"), (3, None), (4, "??"), (5, "aaa bbb"), (6, " ".join(w[5:30])), (None, "Ünïcode")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([r[:2] for r in edge_rows], [("null" if i is None else i, t) for i, t in items])
    for docs in (edge, clashing):
        for shard in (50, 10_000_000):
            rows = fmindex.report(fmindex.find_hits(docs, bench, shard_words=shard)).collect()
            assert sorted([tuple(r) for r in rows], key=str) == want
    assert fmindex.find_hits(empty, bench).count() == 0
    assert all(not r.contaminated for r in fmindex.report(fmindex.find_hits(edge, bench.limit(0))).collect())
    cut = fmindex.decontaminated(clashing, bench)
    assert cut.columns == clashing.columns and cut.count() == len(edge_rows)
    left = [tuple(r) for r in fmindex.report(fmindex.find_hits(cut.select("doc_id", "text").distinct(), bench.where("item_id in (1, 6)"))).collect()]
    assert not any(r[5] for r in left)
    clean = {r.doc_id: r.text for r in cut.where("doc_id = 13").collect()}
    assert clean == {13: "nul \x00 byte and \x7f"}


def test_benchmark_bound(spark, edge):
    import pytest

    with pytest.raises(ValueError):
        fmindex.find_hits(edge, spark.createDataFrame([(1, "x" * 100)], "item_id long, text string"), most_bytes=10)


def test_benchmark_in_parts(spark, edge, edge_rows, clashing):
    w = edge_rows[0][1].split(" ")
    items = [(k, " ".join(w[k : k + 14])) for k in range(0, 40, 5)] + [(3, "same text"), (3, "same text"), (77, None), (None, "Ünïcode")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    most = 4 * max(len((t or "").encode()) for _, t in items)
    assert 2 <= len(fmindex.parts_of(bench, most)) <= 4
    for docs in (edge, clashing):
        whole, parts = (sorted(map(str, fmindex.report(fmindex.find_hits(docs, bench, most_bytes=n)).collect())) for n in (1 << 20, most))
        assert whole == parts and any("contaminated=True" in x for x in parts)
        whole, parts = (fmindex.decontaminated(docs, bench, most_bytes=n) for n in (1 << 20, most))
        assert parts.columns == docs.columns and sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
