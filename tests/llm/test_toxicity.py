import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.llm import toxicity
from runlens.llm.common import fold
from tests.llm.conftest import SCHEMA, prose

TERMS = ["idiot", "moron", "scum", "abcde", "abcdf", "lowei*"]
AUTO = toxicity.Automaton(TERMS)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet="abcdefilmnortuwxyé", max_size=8), st.sampled_from(["idiot", "idot", "iddiot", "scam", "loweix", "lowe", "morn"])))
def test_automaton_accepts_what_is_near(word):
    fits = []
    for k, t in enumerate(TERMS):
        if t.endswith("*"):
            fits += [(0, k)] if word.startswith(t[:-1]) else []
        elif (d := distance(word, t)) <= (1 if len(t) >= toxicity.FUZZY_FROM else 0):
            fits.append((d, k))
    got = AUTO.match([word]).get(word, 0)
    assert bool(got) == bool(fits)
    if fits:
        assert (got - 1) % 2 == min(fits)[0] and ((got - 1) % 2, (got - 1) // 2) in fits


def test_quotes_against_counting_and_time():
    model = toxicity.Model(["badword"], np.array([2.0]), toxicity.Automaton(["badword"]), np.zeros(toxicity.N_FEATURES), 0.0)
    rnd = random.Random(4)
    for _ in range(200):
        text = "".join(rnd.choice(['"', " ", "badword", " ok ", "\n", "“"]) for _ in range(rnd.randint(1, 25)))
        words, quoted = [], []
        for line in text.split("\n"):
            for m in toxicity.WORDS.finditer(line):
                before = sum(c in '"“' for c in line[: m.start()])
                words.append(m[0])
                quoted.append(before % 2 == 1 and any(c in '"“' for c in line[m.start() :]))
        hits = [i for i, w in enumerate(words) if w == "badword"]
        near = {i: sum(abs(i - j) <= model.window for j in hits) - 1 for i in hits}
        best = max((2.0 * (1 + 0.25 * np.log1p(near[i])) * (model.quoted_share if quoted[i] else 1.0) for i in hits), default=0.0)
        assert abs(model.features([text])[0][0] - best) < 1e-9
    took = []
    for n in (8_000, 64_000):
        t = time.process_time()
        model.features(['"badword" ok ' * n])
        took.append(time.process_time() - t)
    assert took[1] < 20 * took[0] + 0.5


def labelled(spark, n=900):
    rnd = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.2
        words = prose(rnd, rnd.randint(20, 80)).split(" ")
        for _ in range(rnd.randint(2, 4) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["blockhead", "nitwit", "dunce", "vermin"]))
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows(spark, edge, clashing, empty):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels, train=fold("doc_id", 3) != 1)
    assert {"blockhead", "nitwit", "dunce", "vermin"} <= set(model.terms)
    held = toxicity.scored(docs, model).join(labels, "doc_id").where(fold("doc_id", 3) == 1)
    right = held.agg(F.avg(((F.col("score") >= 0.7) == (F.col("toxic") == 1)).cast("int"))).first()[0]
    assert right > 0.98
    one = lambda text: float(model.probability(model.features([text]))[0])
    base = prose(random.Random(3), 30)
    assert one(base + " you blockhead and nitwit") > one(base + ' they said "you blockhead and nitwit" there') >= one(base)
    assert one(base + " you blokhead dunnce vermin") > one(base)
    for d in (edge, clashing):
        rows = toxicity.scored(d, model).collect()
        assert len(rows) == d.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.accepted(clashing, model).columns == clashing.columns and toxicity.accepted(clashing, model).count() == clashing.count()
    assert toxicity.scored(empty, model).count() == 0


def test_a_rare_toxic_term_is_weighed_among_very_many_common_ones(spark):
    rnd = random.Random(7)
    common = ["".join("bcdfghklmnprstvw"[i >> k & 15] for k in (12, 8, 4, 0)) for i in range(21_000)]
    docs = []
    for i in range(24):
        words = rnd.sample(common, len(common))
        words[9:9] = ["blockhead"] if i < 12 and i % 3 else []
        docs.append((i, " ".join(words), "en", "s", 0))
    labels = spark.createDataFrame([(i, 1, int(i < 12)) for i in range(24)], "doc_id long, quality int, toxic int")
    assert "blockhead" in toxicity.fit(spark.createDataFrame(docs, SCHEMA), labels, least=3, least_odds=1.0).terms


def test_without_labels(spark, edge):
    docs, labels = labelled(spark, 30)
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = toxicity.fit(docs, some)
        assert not model.terms and len({r.score for r in toxicity.scored(edge, model).collect()}) == 1
