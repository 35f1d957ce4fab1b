import pytest
from pyspark.sql import functions as F

from runlens.plans.publish import read_tables, versions, write_tables


def tables(spark, x):
    return {"a": spark.createDataFrame([(x,)], "x int"), "b": spark.range(x).withColumn("x", F.lit(x)), "empty": spark.createDataFrame([], "x int")}


def seen(spark, out, version=None):
    got = read_tables(spark, out, version)
    return got["a"].first().x, got["b"].count(), got["empty"].count()


def test_versions_replace_each_other_whole(spark, tmp_path):
    out = f"file://{tmp_path}/out/"
    assert versions(spark, out).count() == 0
    with pytest.raises(LookupError):
        read_tables(spark, out)
    first = write_tables(tables(spark, 3), out)
    assert seen(spark, out) == (3, 3, 0)
    write_tables(tables(spark, 5), out)
    assert seen(spark, out) == (5, 5, 0) and seen(spark, out, first) == (3, 3, 0)
    with pytest.raises(LookupError):
        read_tables(spark, out, "1-none")


def test_a_fault_between_tables_leaves_the_old_set(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    write_tables(tables(spark, 3), out)
    bad = spark.range(4).select(F.raise_error(F.lit("planted")).cast("int").alias("x"))
    for name in ("a", "b", "empty"):
        with pytest.raises(Exception, match="planted"):
            write_tables(tables(spark, 7) | {name: bad}, out)
        assert seen(spark, out) == (3, 3, 0)
    write_tables(tables(spark, 8), out)
    assert seen(spark, out) == (8, 8, 0)


def test_a_later_version_is_later_whatever_the_clock_says(spark, tmp_path, monkeypatch):
    out = f"file://{tmp_path}/out"
    write_tables(tables(spark, 3), out)
    monkeypatch.setattr("runlens.plans.publish.time.time_ns", lambda: 1000)
    write_tables(tables(spark, 4), out)
    assert seen(spark, out) == (4, 4, 0)
