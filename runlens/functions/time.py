"""Time and integer expressions. Durations are whole milliseconds, rounded down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.once import once

#: Date, time and a mandatory offset; letters in either case.
RFC3339 = r"\A\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\z"


def parse_timestamp(text: Column) -> Column:
    """Null unless the text has a date, a time and an offset and names a point in the years 0001 to 9999."""
    # what the pattern lets through has its letters in known places; only fractions of over six digits are cut by another pattern
    plain = F.concat(F.substring(text, 1, 10), F.lit("T"), F.translate(F.substring(text, 12, 1 << 20), "z", "Z"))
    micros = F.when(F.char_length(text) > 27, F.regexp_replace(plain, r"(\.\d{6})\d+", "$1")).otherwise(plain)
    at = F.when(text.rlike(RFC3339), F.try_to_timestamp(micros))
    # only in the outermost years can an offset lead out of the range
    inside = once(at, lambda x: F.when(x.between(F.lit("0001-01-01 00:00:00").cast("timestamp"), F.lit("9999-12-31 23:59:59.999999").cast("timestamp")), x))
    return F.when(F.substring(text, 1, 4).isin("0000", "0001", "9999"), inside).otherwise(at)


def millis_between(earlier: Column, later: Column) -> Column:
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.floor(micros / F.lit(1000).cast("decimal(20,0)")).cast("long")


def duration_ms(start: Column, end: Column) -> Column:
    """Null if an end is missing; never negative."""
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0).cast("long"), millis_between(start, end)))


def format_timestamp(at: Column) -> Column:
    return F.date_format(F.date_trunc("MILLISECOND", at), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def round_half_up(n: Column, d: Column) -> Column:
    """n / d to the nearest whole number, halves up, in integers."""
    return F.floor((2 * n + d) / (2 * d).cast("decimal(20,0)")).cast("long")
