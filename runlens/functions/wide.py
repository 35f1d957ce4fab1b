"""Whole numbers of up to 38 digits, in two parts where a product or a sum needs more.

A count is `decimal(38,0)`. Its low part has 18 digits and its high part 20; parts are taken from the digits, as a quotient of decimals would be rounded.
A count of more digits is kept as `MOST`, which stands for "more than can be held" and is never priced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.once import once

COUNT = "decimal(38,0)"
#: The greatest count; every greater one is read as this.
MOST = 10**38 - 1
LOW = 18
#: Digits of a rate behind the point; rates have at most five before it.
RATE_DIGITS = 12
RATE = f"decimal({5 + RATE_DIGITS},{RATE_DIGITS})"


def digits(x: Column) -> Column:
    """38 digits of a count."""
    return F.lpad(x.cast("string"), 38, "0")


def high(x: Column, low: int = LOW) -> Column:
    """x without its last `low` digits."""
    kind = f"decimal({38 - low},0)"
    return F.when(x < F.lit(str(10**low)).cast(COUNT), F.lit(0).cast(kind)).otherwise(F.substring(digits(x), 1, 38 - low).cast(kind))


def rest(x: Column, low: int = LOW) -> Column:
    """The last `low` digits of x."""
    kind = f"decimal({low},0)"
    return F.when(x < F.lit(str(10**low)).cast(COUNT), x.cast(kind)).otherwise(F.substring(digits(x), 39 - low, low).cast(kind))


def most() -> Column:
    return F.lit(str(MOST)).cast(COUNT)


def total(x: Column) -> Column:
    """The sum of counts, exact up to 38 digits, `MOST` beyond; 0 of none. Up to 10**10 rows."""
    low, up = F.sum(rest(x)), F.sum(high(x))
    up = up + high(low.cast(COUNT))
    whole = F.concat(up.cast("string"), F.lpad(rest(low.cast(COUNT)).cast("string"), LOW, "0"))
    fits = up < F.lit(str(10**20)).cast("decimal(21,0)")
    # a part that is no sum but the mark of one makes the sum one too
    return F.when(F.count(x) == 0, F.lit(0).cast(COUNT)).when(fits & (F.max(x) < most()), whole.cast(COUNT)).otherwise(most())


def added(*counts: Column) -> Column:
    """The sum of a row's counts, `MOST` beyond."""
    return reduce(lambda a, b: F.coalesce(F.try_add(a, b), most()), counts)


def micro_usd(pairs: list[tuple[Column, Column]]) -> Column:
    """Micro-dollars, half up, of counts and their rates in USD per million; null if a count isn't held or there are 10**37 or more.

    A count times a rate of 17 digits may have 55: both parts of each count are multiplied by the rate in whole units of its last digit.
    """
    unit = lambda rate: F.coalesce((rate * F.lit(10**RATE_DIGITS).cast("decimal(13,0)")).cast("decimal(17,0)"), F.lit(0).cast("decimal(17,0)"))
    sum_ = lambda parts: reduce(lambda a, b: a + b, (p.cast("decimal(38,0)") for p in parts))
    up, low = sum_(high(n) * unit(r) for n, r in pairs), sum_(rest(n) * unit(r) for n, r in pairs)
    held = reduce(lambda a, b: a & b, ((n < most()) | (unit(r) == 0) for n, r in pairs))

    def micro(s: Column) -> Column:
        half = s["low"] + F.lit(5 * 10 ** (RATE_DIGITS - 1)).cast("decimal(13,0)")
        whole = (s["up"].cast("decimal(31,0)") * F.lit(10 ** (LOW - RATE_DIGITS)).cast("decimal(7,0)")).cast(COUNT) + high(half.cast(COUNT), RATE_DIGITS)
        return F.when(s["up"] < F.lit(str(10**31)).cast("decimal(32,0)"), whole.cast(COUNT))

    return F.when(held, once(F.struct(up.alias("up"), low.alias("low")), micro))


def usd(micro: Column) -> Column:
    """Micro-dollars as dollars with six places."""
    return F.concat(F.substring(digits(micro), 1, 32), F.lit("."), F.substring(digits(micro), 33, 6)).cast("decimal(38,6)")
