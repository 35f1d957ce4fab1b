"""Values that are computed once for a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once, however often `use` names it. Spark doesn't share what branches of a condition repeat."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))
