"""Order within keys of any size: running sums, greatest and last values, and lower medians, carried from range to range.

A window by trace sorts a whole trace in one task. Here rows are dealt in ranges of (keys, order), so one large key fills many tasks; each range folds its
own rows, and one row for each range and key carries the fold on to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.workers import materialized

#: Column of the written table: the number of a row's range. Ranges with greater numbers come later.
RANGE = "_range"


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """The rows, written once with the number of their range of (keys, order). Written, so that a task that is run again sees the same ranges.

    Rows that agree in keys and order lie in one range: give an order in which few do, or add them up before.
    """
    return materialized(df.repartitionByRange(*keys, *order).withColumn(RANGE, F.spark_partition_id()), label)


def running(ranges: DataFrame, keys: Sequence[str], order: Sequence[str], folds: dict[str, tuple[str, Column]], whole: str | None = None) -> DataFrame:
    """Adds a column for each fold over the rows of a key up to and with the present one, in ascending order, nulls first.

    ranges: a table of `dealt` with the same keys and order. Keys aren't null.
    folds: name to ("sum" | "max" | "last", column). Nulls are passed over; a sum of none is 0, a greatest or last value of none is null.
    whole: the name of a sum fold; its sum over all rows of the key is added as `<name>_all`.
    """
    rows = ranges.withColumns({name: c for name, (_, c) in folds.items()})
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*order)
    within = {"sum": lambda c: F.sum(c).over(inside), "max": lambda c: F.max(c).over(inside), "last": lambda c: F.last(c, ignorenulls=True).over(inside)}
    # the fold of a whole range: the last value is that at the greatest place of a value
    at_end = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place))}
    ends = rows.groupBy(*keys, RANGE).agg(*(at_end[kind](name).alias(name) for name, (kind, _) in folds.items()))
    by = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    across = {"sum": lambda c: F.sum(c).over(by), "max": lambda c: F.max(c).over(by), "last": lambda c: F.last(c, ignorenulls=True).over(by)}
    carried = [across[kind](name).alias(f"_before_{name}") for name, (kind, _) in folds.items()]
    if whole:
        carried.append(F.sum(whole).over(Window.partitionBy(*keys)).alias(f"{whole}_all"))
    ends = ends.select(*keys, RANGE, *carried)
    zero = F.lit(0)
    joined = {
        "sum": lambda own, before: F.coalesce(own, zero) + F.coalesce(before, zero),
        "max": lambda own, before: F.greatest(own, before),
        "last": lambda own, before: F.coalesce(own, before),
    }
    rows = rows.withColumns({name: within[kind](name) for name, (kind, _) in folds.items()}).join(ends, [*keys, RANGE])
    rows = rows.withColumns({name: joined[kind](F.col(name), F.col(f"_before_{name}")) for name, (kind, _) in folds.items()})
    return rows.drop(RANGE, *(f"_before_{name}" for name in folds))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, label: str) -> DataFrame:
    """Adds `name`: the place of a row within its key, from 0."""
    return running(dealt(df, keys, order, label), keys, order, {name: ("sum", F.lit(1))}).withColumn(name, (F.col(name) - 1).cast("int"))


def lower_median(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys and value: the lower median of each key, exactly. counts: a table of `dealt`, distinct values and how often each occurs (n), by (keys, value)."""
    ranked = running(counts, keys, (value,), {"upto": ("sum", F.col("n"))}, "upto")
    # the lower median of N values is the one of rank (N + 1) // 2 from 1; the place of just one distinct value holds that rank
    rank = F.floor((F.col("upto_all") + 1) / 2)
    return ranked.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).select(*keys, value)
