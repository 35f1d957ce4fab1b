import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from runlens.llm import divergence
from runlens.llm.common import slices
from runlens.llm.words import Words
from tests.llm.conftest import SCHEMA, prose


def brute(rows, least, top=50):
    """The contract, group by group, over all kept terms."""
    df, n = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        terms = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        df[lang or ""].update(set(terms))
        n[lang or "", source or ""].update(terms)
    out = []
    for lang in {g[0] for g in n}:
        kept = [t for t, k in df[lang].items() if k >= least]
        own = {s: c for (g, s), c in n.items() if g == lang}
        total = Counter()
        for c in own.values():
            total.update(c)

        def share(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in own.items()}, share(total)
        for a in own:
            found = sorted((-sum(abs(p[a][t] - p[b][t]) for t in kept), b.encode(), b) for b in own if b != a)
            out += [(lang, a, "pair", b, -x, k) for k, (x, _, b) in enumerate(found, 1)]
            found = sorted((q[t] - p[a][t], t.encode(), t) for t in kept if own[a][t] and p[a][t] > q[t])[:top]
            out += [(lang, a, "term", t, -x, k) for k, (x, _, t) in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(n, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        lang, source = rnd.choice(["de", "en", None, ""]), rnd.choice(["a", "b", None, "ü", "c", "Z"])
        own = f" {source}word {source}WORD" if rnd.random() < 0.4 else ""
        rows.append((k, prose(rnd, rnd.randint(0, 30)) + own, lang, source, 1))
    return rows + [(n, "", "xx", "empty", 0), (n + 1, None, "xx", "none", 0), (n + 2, "1 2 3", "yy", "digits", 0)]


@pytest.mark.parametrize("least,block,bits", [(3, 512, None), (30, 2, 16), (1, 1, 10)])
def test_against_brute_force(spark, edge_rows, least, block, bits):
    """Also with one source a block, and with a sketch so narrow that it lets through what the exact frequency must drop."""
    rows = [r for r in edge_rows if not r[1] or len(r[1]) < 9000] + corpus(150, 5)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(divergence.audit(docs, least=least, block=block, bits=bits)) == brute(rows, least)


def test_edges(spark, edge, edge_rows, clashing, empty):
    assert got(divergence.audit(empty)) == []
    assert got(divergence.audit(edge, least=2)) == brute(edge_rows, 2)
    assert got(divergence.audit(clashing, least=2)) == brute(edge_rows, 2)
    nothing = divergence.audit(edge, least=1000)
    assert {(r.part, r.value) for r in nothing.collect()} == {("pair", 0)}


def test_sketch_never_underestimates(spark):
    rows = corpus(400, 9)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    full = divergence.sketch(docs, 20, 12, 2)
    counted = divergence.counted(docs, full, 12)
    want = Counter((lang or "", t) for _, text, lang, *_ in rows for t in set(re.findall("[a-z]+", (text or "").lower())))
    have = {(r.lang, r.term) for r in counted.select("lang", "term").distinct().collect()}
    assert {k for k, n in want.items() if n >= 20} <= have
    assert len(have) < len(want)


def test_sums_of_many_digits(spark):
    """Counts whose product doesn't fit in 64 bits."""
    rows = spark.createDataFrame([(3 * 10**15, 9 * 10**15, 70), (8_999_999_999, 10**11, 3), (0, 0, 9)], "n long, total long, v long")
    want = [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in rows.collect()]
    assert [r.p for r in rows.select(divergence.parts_of("n", "total", "v").cast("long").alias("p")).collect()] == want


def test_capped_cells():
    cells = np.zeros(8, np.uint8)
    divergence.add_capped(cells, np.array([1, 1, 3, 1]), np.array([10, 15, 29, 10]), 30)
    divergence.add_capped(cells, np.array([3, 3]), np.array([200, 200]), 30)
    assert cells.tolist() == [0, 30, 0, 30, 0, 0, 0, 0]


def test_words_at_the_edges_of_texts():
    texts = ["", "ab", "cd", None, " x", "y ", "", " ", "Zö-ö1q", "e", "f", "", None]
    w = Words(pa.array(["hidden", *texts], pa.string()).slice(1), divergence.LETTERS)
    have = [(row, w.words[k].as_py().decode()) for row, k in zip(w.row.tolist(), w.word.tolist())]
    assert have == [(k, x) for k, t in enumerate(texts) for x in re.findall("[a-zö]+", (t or "").lower())]
    assert Words(pa.array(["", None], pa.string()), divergence.LETTERS).word.tolist() == []


def test_memory_of_a_batch_of_texts():
    """A worker's arrays follow the slice, not the batch that Spark sends: two workers share an executor with its heap."""
    rnd = random.Random(3)
    texts = [prose(rnd, 60) for _ in range(200)]
    texts = texts * ((24 << 20) // sum(map(len, texts)))
    b = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * len(texts), "source": ["a"] * len(texts)})
    tracemalloc.start()
    try:
        n = sum(len(divergence.Slice(s).word) for s in slices([b], "text", divergence.SLICE_BYTES))
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
    assert n == sum(len(re.findall("[A-Za-z]+", t)) for t in texts)


def test_counts_added_up_in_parts():
    rnd, want, batches = random.Random(4), Counter(), []
    for _ in range(40):
        rows = [("en", rnd.choice("ab"), rnd.choice(["x", "y", "ö", f"w{rnd.randrange(400)}"]), rnd.randint(1, 9), 1) for _ in range(100)]
        for lang, source, term, n, df in rows:
            want.update({(lang, source, term, "n"): n, (lang, source, term, "df"): df})
        batches.append(pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "term", "n", "df"), r)) for r in rows]))
    for limit in (1, 9_000, 1 << 20):
        out, have = list(divergence.added_up(iter(batches), limit)), Counter()
        for r in (r for b in out for r in b.to_pylist()):
            have.update({(r["lang"], r["source"], r["term"], "n"): r["n"], (r["lang"], r["source"], r["term"], "df"): r["df"]})
        assert have == want
        assert out[0].schema.names == ["lang", "source", "term", "n", "df"]
    assert sum(b.num_rows for b in out) == len(want) // 2
    assert list(divergence.added_up(iter([]), 1)) == []
