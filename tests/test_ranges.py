"""Folds that are carried from range to range against plain Python, with one key that fills many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import ranges


@pytest.fixture
def many_ranges(spark):
    """Small tables would end in one range each."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(n, seed):
    rnd = random.Random(seed)
    return [(rnd.choice(["hot"] * 8 + ["b", "c"]), k, rnd.choice([None, rnd.randint(-50, 50)])) for k in range(n)]


def test_folds_match_plain_python(spark, many_ranges):
    rows = rows_of(3000, 1)
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "k string, at int, v int")
    table = ranges.dealt(df, ("k",), ("at",), "t")
    assert table.where("k = 'hot'").select(ranges.RANGE).distinct().count() > 3
    v = F.col("v")
    got = ranges.running(table, ("k",), ("at",), {"total": ("sum", v), "top": ("max", v), "latest": ("last", v)}, "total").collect()
    want, state = {}, {}
    for k, at, x in rows:
        total, top, latest = state.get(k, (0, None, None))
        if x is not None:
            total, top, latest = total + x, x if top is None else max(top, x), x
        state[k] = want[k, at] = (total, top, latest)
    assert {(r.k, r.at): (r.total, r.top, r.latest) for r in got} == want
    assert all(r.total_all == state[r.k][0] for r in got)
    assert set(got[0].asDict()) == {"k", "at", "v", "total", "top", "latest", "total_all"}


def test_numbers_of_a_hot_key(spark, many_ranges):
    df = spark.createDataFrame(rows_of(2000, 3), "k string, at int, v int")
    got = ranges.numbered(df, ("k",), ("at",), "seq", "n").orderBy("k", "at").collect()
    for key in ("hot", "b", "c"):
        assert [r.seq for r in got if r.k == key] == list(range(sum(r.k == key for r in got)))


@pytest.mark.parametrize("most", [3, 1000])
def test_lower_median(spark, many_ranges, most):
    """Of even and odd numbers of values, with ties that hold several ranks."""
    rnd = random.Random(most)
    groups = {f"g{n}": [rnd.randint(0, most) for _ in range(n)] for n in (1, 2, 3, 7, 8, 999, 1000)}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v long")
    counts = ranges.dealt(df.groupBy("k", "v").agg(F.count("*").alias("n")), ("k",), ("v",), "c")
    got = [tuple(r) for r in ranges.lower_median(counts, ("k",), "v").collect()]
    assert sorted(got) == sorted((k, sorted(vs)[(len(vs) - 1) // 2]) for k, vs in groups.items())


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, v long, n long")
    assert ranges.lower_median(ranges.dealt(df, ("k",), ("v",), "c"), ("k",), "v").count() == 0
    assert ranges.numbered(df, ("k",), ("v",), "seq", "n").count() == 0
