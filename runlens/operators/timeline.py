"""Timeline geometry: integers on a scale of 1000, one lane an agent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.time import duration_ms, millis_between, round_half_up

SCALE = 1000


def severities(findings: DataFrame) -> DataFrame:
    """The highest severity rank that names a span."""
    return findings.select("trace_id", F.explode("span_seqs").alias("seq"), "severity_rank").groupBy("trace_id", "seq").agg(F.max("severity_rank").alias("severity_rank"))


def rectangles(spans: DataFrame, agents: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """trace_id, seq, lane, x, width, timed and severity_rank; spans without both ends aren't drawn (x and width null)."""
    timed = F.col("start").isNotNull() & F.col("end").isNotNull()
    edges = spans.where(timed).groupBy("trace_id").agg(F.min("start").alias("t0"), F.max(F.greatest("start", "end")).alias("t1"))
    rows = spans.join(edges, "trace_id", "left").join(agents.select("trace_id", "agent_id", F.col("agent_index").alias("lane")), ["trace_id", "agent_id"])
    whole = millis_between(F.col("t0"), F.col("t1"))
    x = F.when(whole <= 0, F.lit(0)).otherwise(round_half_up(SCALE * millis_between(F.col("t0"), F.col("start")), whole))
    width = F.when(whole <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), round_half_up(SCALE * duration_ms(F.col("start"), F.col("end")), whole)))
    rows = rows.withColumns({"x": F.least(F.when(timed, x), F.lit(SCALE - 1)).cast("int"), "width": F.when(timed, width).cast("int"), "timed": timed})
    rows = rows.withColumn("width", F.least("width", F.lit(SCALE) - F.col("x")))
    out = rows.select("trace_id", "seq", "agent_id", "lane", "kind", "x", "width", "timed")
    return out if findings is None else out.join(severities(findings), ["trace_id", "seq"], "left")


def lanes(rects: DataFrame, agents: DataFrame) -> DataFrame:
    drawn = rects.where("timed").groupBy("trace_id", "lane").agg(F.count("*").alias("drawn"))
    return agents.select("trace_id", F.col("agent_index").alias("lane"), "agent_id").join(drawn, ["trace_id", "lane"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))


def untimed(rects: DataFrame, most: int) -> DataFrame:
    """trace_id, seqs (the first `most` of the spans that aren't drawn, in order) and more (how many others there are); traces with all spans drawn have no row.

    Each task cuts its rows to the first of a trace before they are shuffled."""
    rest = rects.where("not timed").select("trace_id", "seq")
    place = F.row_number().over(Window.partitionBy("trace_id").orderBy("seq"))
    first = rest.withColumn("place", place).where(F.col("place") <= most).groupBy("trace_id").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))
    return rest.groupBy("trace_id").agg(F.count("*").alias("n")).join(first, "trace_id").select("trace_id", "seqs", (F.col("n") - F.size("seqs")).alias("more"))
