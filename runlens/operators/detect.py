"""Detectors: each is a plan from spans to findings and, where calls were wasted, to a table of wasted spans.

A detector counts a group in one aggregation and takes its evidence apart from that: the least rows by seq, cut to 50 (or 5) in each task before the
shuffle and again behind it, so a group of any size never meets in one row. `finished` names the finding by its digest; wasted spans stay rows, and
find their finding by its group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import wide
from runlens.functions.text import json_text, says_unknown_tool, short_sha, tool_name
from runlens.functions.time import duration_ms, millis_between
from runlens.operators import ranges
from runlens.schema import SEVERITIES, USAGE_FIELDS
from runlens.workers import materialized

EVIDENCE, PREVIEWS = 50, 5
# Thresholds.
REPEATED_CRITICAL = 4
LOOP_PERIODS, LOOP_REPEATS, LOOP_CRITICAL = 8, 3, 4
STORM_WINDOW, STORM_ERRORS, STORM_CRITICAL = 10, 3, 5
GAP_SECONDS, GAP_CRITICAL = 60, 300
OUTLIER_POPULATION, OUTLIER_WARNING, OUTLIER_CRITICAL = 8, 6, 12
OUTLIER_FLOORS = {"tokens": 10_000, "duration_ms": 30_000}


@dataclass(frozen=True)
class Config:
    gap_seconds: int = GAP_SECONDS
    enabled: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.gap_seconds < 0:
            raise ValueError("gap_seconds must be at least 0")
        if unknown := set(self.enabled or ()) - set(DETECTORS):
            raise ValueError(f"unknown detectors: {', '.join(sorted(unknown))}")


def total_tokens(usage: Column) -> Column:
    return wide.added(*(usage[f] for f in USAGE_FIELDS))


def evidence(seqs: Column) -> Column:
    return F.slice(F.array_sort(F.array_distinct(seqs)), 1, EVIDENCE)


def shown(previews: Column) -> Column:
    return F.slice(F.filter(previews, lambda x: x.isNotNull() & (x != "")), 1, PREVIEWS)


def group_key(*keys: Column | str) -> Column:
    """A group's keys as text, nulls told from texts, so that groups are joined by plain equality."""
    return F.to_json(F.struct(*(F.col(k) if isinstance(k, str) else k for k in keys)), {"ignoreNullFields": "false"})


def least(rows: DataFrame, most: int, name: str, value: Column, order: str = "seq") -> DataFrame:
    """trace_id, key and the values of the group's `most` least rows by `order`, in that order.

    The rank is a filter on a window, which Spark applies in each task first: of a group no more than `most` rows of a task are shuffled.
    """
    place = F.row_number().over(Window.partitionBy("trace_id", "key").orderBy(order))
    top = rows.select("trace_id", "key", F.col(order).alias(order), value.alias("x")).withColumn("place", place).where(F.col("place") <= most)
    return top.groupBy("trace_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda r: r["x"]).alias(name))


def with_least(groups: DataFrame, *parts: DataFrame) -> DataFrame:
    """Groups with their evidence; those without have empty arrays."""
    for part in parts:
        name = part.columns[-1]
        groups = groups.join(part, ["trace_id", "key"], "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return groups


def spoken(rows: DataFrame, text: Column) -> DataFrame:
    """Rows with a preview that is shown, as `text`."""
    return rows.withColumn("text", text).where("text is not null and text <> ''")


def metrics_json(pairs: list[tuple[str, Column, bool]]) -> Column:
    """A JSON object of numbers and plain strings, keys sorted."""
    parts = []
    for name, value, text in sorted(pairs, key=lambda p: p[0]):
        parts += [F.lit(f'{"," if parts else "{"}"{name}":'), json_text(value) if text else value.cast("string")]
    return F.concat(*parts, F.lit("}"))


def finished(core: DataFrame, detector: str, metrics: list[tuple[str, Column, bool]], summary: Column) -> DataFrame:
    """The common shape. The id is a digest of detector, metrics, capped evidence and trace; summary and previews don't enter it."""
    rows = core.withColumns({"detector": F.lit(detector), "metrics": metrics_json(metrics), "span_seqs": evidence(F.col("all_seqs")), "agent_ids": F.array_sort(F.array_distinct("agents")), "previews": shown(F.col("texts")), "summary": summary})
    text = F.concat(F.lit(f'{{"detector":"{detector}","metrics":'), "metrics", F.lit(',"spans":['), F.array_join(F.transform("span_seqs", lambda x: x.cast("string")), ","), F.lit('],"trace":'), json_text(F.col("trace_id")), F.lit("}"))
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int") - 1
    return rows.withColumns({"finding_id": F.concat(F.lit(f"{detector}:"), short_sha(text, 12)), "severity_rank": rank, "key": F.col("key") if "key" in core.columns else F.lit(None).cast("string")}).select(
        "trace_id", "detector", "finding_id", "severity", "severity_rank", "summary", "span_seqs", "agent_ids", "metrics", "previews", "key"
    )


def repeated_calls(spans: DataFrame) -> DataFrame:
    return spans.where("kind = 'tool_call'").withColumn("key", group_key("tool_name", "tool_input_digest"))


def repeated_tool_call(spans: DataFrame, warnings: DataFrame | None, config: Config) -> DataFrame:
    """The same tool with the same input, twice or more in a trace, whatever the agent."""
    calls = repeated_calls(spans)
    rows = calls.groupBy("trace_id", "key").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.collect_set("agent_id").alias("agents"), F.min_by(F.struct("tool_name", "tool_input_preview"), "seq").alias("t"),
    ).where("n >= 2")
    name, odd = tool_name(F.col("t.tool_name"))
    rows = with_least(rows, least(calls, EVIDENCE, "all_seqs", F.col("seq")))
    rows = rows.withColumns({"severity": F.when(F.col("n") >= REPEATED_CRITICAL, "critical").otherwise("warning"), "name": name, "texts": F.array("t.tool_input_preview", odd)})
    return finished(rows, "repeated_tool_call", [("first_seq", F.col("first_seq"), False), ("last_seq", F.col("last_seq"), False), ("occurrences", F.col("n"), False), ("tool_name", F.col("name"), True)], F.format_string("%s called %d times with the same input, first at span %d", "name", "n", "first_seq"))


def repeated_waste(spans: DataFrame) -> DataFrame:
    """The model calls that made every call of a group but its first."""
    calls = repeated_calls(spans)
    first = calls.groupBy("trace_id", "key").agg(F.min("seq").alias("first_seq"))
    return calls.join(first, ["trace_id", "key"]).where("seq > first_seq and parent_seq is not null").select("trace_id", "key", F.col("parent_seq").alias("seq"))


def signatures(spans: DataFrame) -> DataFrame:
    """Model calls with what they did: their first tool call, or their text; pos counts an agent's calls."""
    first = spans.where("kind = 'tool_call' and parent_seq is not null").groupBy("trace_id", F.col("parent_seq").alias("seq")).agg(F.min_by(F.struct("tool_name", "tool_input_digest"), "seq").alias("t"))
    calls = spans.where("kind = 'model_call'").select("trace_id", "agent_id", "seq", "text_preview").join(first, ["trace_id", "seq"], "left")
    sig = F.when(F.col("t").isNull(), "text").otherwise(F.concat_ws("\u0001", F.lit("tool"), F.coalesce("t.tool_name", F.lit("\u0002")), F.coalesce("t.tool_input_digest", F.lit(""))))
    return calls.withColumns({"sig": sig, "pos": F.row_number().over(Window.partitionBy("trace_id", "agent_id").orderBy("seq")) - 1}).drop("t")


def loops(rows: DataFrame, keys: tuple[str, ...], most_period: int = LOOP_PERIODS, least_repeats: int = LOOP_REPEATS) -> DataFrame:
    """Periodic runs in sequences (keys, pos, sig): smallest period first, then smallest start, each run as long as it goes, none inside another.

    Equality with the row `period` later, run lengths by islands, and one fold over the few candidates of each sequence.
    """
    by = Window.partitionBy(*keys).orderBy("pos")
    later = {f"same{p}": F.col("sig") == F.lead("sig", p).over(by) for p in range(1, most_period + 1)}
    each = rows.select(*keys, "pos", "sig").withColumns(later)
    each = each.select(*keys, "pos", F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.col(f"same{p}").alias("same")) for p in range(1, most_period + 1)))).alias("e"))
    each = each.select(*keys, "pos", "e.period").where("e.same")
    run = F.col("pos") - F.row_number().over(Window.partitionBy(*keys, "period").orderBy("pos"))
    runs = each.withColumn("run", run).groupBy(*keys, "period", "run").agg(F.min("pos").alias("start"), F.count("*").alias("m"))
    # a run of m equal places may start anywhere in it; the earliest start that the floor allows is what a search would find
    runs = runs.where(F.floor(F.col("m") / F.col("period")) + 1 >= least_repeats)
    candidates = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("period").cast("long").alias("period"), F.col("start").cast("long").alias("start"), F.col("m").cast("long").alias("m")))).alias("c"))
    empty = F.array().cast("array<struct<period:bigint,start:bigint,repeats:bigint>>")

    def take(acc: Column, c: Column) -> Column:
        start = F.greatest(c["start"], acc["floor"])
        left = c["m"] - (start - c["start"])
        repeats = F.floor(left / c["period"]) + 1
        ok = (left > 0) & (repeats >= least_repeats)
        hit = F.struct(c["period"].alias("period"), start.alias("start"), repeats.alias("repeats"))
        return F.struct(F.when(ok, start + repeats * c["period"]).otherwise(acc["floor"]).alias("floor"), F.when(ok, F.concat(acc["hits"], F.array(hit))).otherwise(acc["hits"]).alias("hits"))

    folded = F.aggregate("c", F.struct(F.lit(0).cast("long").alias("floor"), empty.alias("hits")), take, lambda a: a["hits"])
    return candidates.select(*keys, F.explode(folded).alias("h")).select(*keys, "h.*")


def looped_calls(spans: DataFrame) -> DataFrame:
    """Model calls inside loops, with their loop: period, start, repeats."""
    calls = signatures(spans)
    keys = ("trace_id", "agent_id")
    found = loops(calls, keys).select(*keys, F.col("start").alias("pos"), F.struct("period", "start", "repeats").alias("loop"), F.lit(0).alias("call"))
    # a call's loop: the last that began at or before it (loops of one agent don't overlap)
    marked = calls.withColumn("call", F.lit(1)).unionByName(found, allowMissingColumns=True)
    at = Window.partitionBy(*keys).orderBy("pos", "call").rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.withColumn("loop", F.last("loop", ignorenulls=True).over(at)).where("call = 1 and loop is not null").drop("call").select("*", "loop.*").drop("loop")
    return inside.where(F.col("pos") < F.col("start") + F.col("period") * F.col("repeats")).withColumn("key", group_key("agent_id", "period", "start", "repeats"))


def agent_loop(spans: DataFrame, warnings: DataFrame | None, config: Config) -> DataFrame:
    """An agent that does the same one to eight model calls three times or more in a row."""
    inside = looped_calls(spans)
    rows = inside.groupBy("trace_id", "key").agg(
        F.first(F.struct("agent_id", "period", "repeats")).alias("g"), F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.min_by("text_preview", "seq").alias("text"),
    ).select("*", "g.*").drop("g")
    rows = with_least(rows, least(inside, EVIDENCE, "all_seqs", F.col("seq")))
    rows = rows.withColumns({"severity": F.when(F.col("repeats") >= LOOP_CRITICAL, "critical").otherwise("warning"), "agents": F.array("agent_id"), "texts": F.array("text")})
    return finished(rows, "agent_loop", [(k, F.col(k), False) for k in ("end_seq", "period", "repeats", "start_seq")], F.format_string("a cycle of %d model calls ran %d times from span %d", "period", "repeats", "start_seq"))


def loop_waste(spans: DataFrame) -> DataFrame:
    """Every call of a loop behind its first round."""
    return looped_calls(spans).where(F.col("pos") >= F.col("start") + F.col("period")).select("trace_id", "key", "seq")


def error_kind() -> Column:
    """tool_error, api_error (a failed model call) or null."""
    return F.when((F.col("kind") == "tool_call") & (F.col("tool_result_status") == "error"), "tool_error").when((F.col("kind") == "model_call") & F.col("error").isNotNull(), "api_error")


def storm_runs(rows: DataFrame, keys: tuple[str, ...], order: str = "seq") -> DataFrame:
    """Runs of rows (with `err`) in which windows of ten hold three errors or more; overlapping windows are one run, cut to its first and last error."""
    by = Window.partitionBy(*keys).orderBy(order)
    placed = rows.withColumns({"pos": F.row_number().over(by) - 1, "n": F.count("*").over(Window.partitionBy(*keys)), "errors": F.sum(F.col("err").cast("int")).over(by.rowsBetween(0, STORM_WINDOW - 1))})
    starts = placed.where((F.col("pos") <= F.greatest(F.col("n") - STORM_WINDOW, F.lit(0))) & (F.col("errors") >= STORM_ERRORS)).select(*keys, "pos")
    starts = starts.withColumn("new", F.coalesce(F.col("pos") - F.lag("pos").over(Window.partitionBy(*keys).orderBy("pos")) >= STORM_WINDOW, F.lit(True)))
    starts = starts.withColumn("run", F.sum(F.col("new").cast("int")).over(Window.partitionBy(*keys).orderBy("pos")))
    runs = starts.groupBy(*keys, "run").agg(F.min("pos").alias("a"), (F.max("pos") + STORM_WINDOW).alias("b"))
    # a row's run: the last that began at or before it (runs of one sequence don't overlap)
    marked = placed.unionByName(runs.select(*keys, F.col("a").alias("pos"), F.col("b"), F.col("run"), F.lit(0).alias("tie")), allowMissingColumns=True)
    at = Window.partitionBy(*keys).orderBy("pos", F.coalesce("tie", F.lit(1)))
    inside = marked.withColumns({"run": F.last("run", ignorenulls=True).over(at), "b": F.last("b", ignorenulls=True).over(at)}).where("tie is null and run is not null and pos < b").drop("tie", "b")
    edge = Window.partitionBy(*keys, "run")
    inside = inside.withColumns({"lo": F.min(F.when(F.col("err"), F.col("pos"))).over(edge), "hi": F.max(F.when(F.col("err"), F.col("pos"))).over(edge)})
    return inside.where("pos between lo and hi")


def storm_spans(spans: DataFrame) -> DataFrame:
    """Spans of storms, from the first error to the last."""
    kinds = spans.withColumn("ek", error_kind()).withColumn("err", F.col("ek").isNotNull())
    rows = storm_runs(kinds.select("trace_id", "agent_id", "seq", "kind", "ek", "err", "tool_result_preview", F.col("error.detail").alias("detail")), ("trace_id", "agent_id"))
    return rows.withColumn("key", group_key("agent_id", "run"))


def retry_storm(spans: DataFrame, warnings: DataFrame | None, config: Config) -> DataFrame:
    """Three errors or more within ten spans of an agent."""
    inside = storm_spans(spans)
    errors = inside.where("err")
    of_error = lambda c: F.when(F.col("err"), c)
    rows = inside.groupBy("trace_id", "key").agg(
        F.first("agent_id").alias("agent_id"), F.count("*").alias("window_spans"), F.count_if("err").alias("n"), F.min(of_error(F.col("seq"))).alias("start_seq"), F.max(of_error(F.col("seq"))).alias("end_seq"), F.array_sort(F.collect_set("ek")).alias("eks"),
    )
    text = F.coalesce(F.nullif("tool_result_preview", F.lit("")), "detail")
    rows = with_least(rows, least(errors, EVIDENCE, "all_seqs", F.col("seq")), least(spoken(errors, text), PREVIEWS, "texts", F.col("text")))
    rows = rows.withColumns({"severity": F.when(F.col("n") >= STORM_CRITICAL, "critical").otherwise("warning"), "agents": F.array("agent_id"), "kinds": F.when(F.size("eks") > 1, "mixed").otherwise(F.get("eks", F.lit(0)))})
    return finished(rows, "retry_storm", [("end_seq", F.col("end_seq"), False), ("errors", F.col("n"), False), ("kinds", F.col("kinds"), True), ("start_seq", F.col("start_seq"), False), ("window_spans", F.col("window_spans"), False)], F.format_string("%d errors within %d spans from span %d", "n", "window_spans", "start_seq"))


def storm_waste(spans: DataFrame) -> DataFrame:
    """The model calls of a storm."""
    return storm_spans(spans).where("kind = 'model_call'").select("trace_id", "key", "seq")


def failed_tool_call(spans: DataFrame, warnings: DataFrame | None, config: Config) -> DataFrame:
    """Tools that failed, by agent and tool."""
    bad = spans.where("kind = 'tool_call' and tool_result_status = 'error'").withColumn("key", group_key("agent_id", "tool_name"))
    rows = bad.groupBy("trace_id", "key").agg(F.first(F.struct("agent_id", "tool_name")).alias("g"), F.count("*").alias("n"), F.min("seq").alias("first_seq")).select("*", "g.*").drop("g")
    said = spoken(bad, F.col("tool_result_preview")).groupBy("trace_id", "key", "text").agg(F.min("seq").alias("seq"))
    rows = with_least(rows, least(bad, EVIDENCE, "all_seqs", F.col("seq")), least(said, PREVIEWS, "results", F.col("text")))
    name, odd = tool_name(F.col("tool_name"))
    rows = rows.withColumns({"severity": F.when(F.col("n") >= 2, "warning").otherwise("info"), "name": name, "agents": F.array("agent_id"), "texts": F.concat("results", F.array(odd))})
    return finished(rows, "failed_tool_call", [("failures", F.col("n"), False), ("first_seq", F.col("first_seq"), False), ("tool_name", F.col("name"), True)], F.format_string("%s failed %d times, first at span %d", "name", "n", "first_seq"))


def unresolved_tool_call(spans: DataFrame, warnings: DataFrame | None, config: Config) -> DataFrame:
    """Calls without a result (an agent's last span may wait for one), calls of unknown tools, and results without a call."""
    last = F.max("seq").over(Window.partitionBy("trace_id", "agent_id"))
    calls = spans.withColumn("last", last).where("kind = 'tool_call'")
    reason = F.when((F.col("tool_result_status") == "missing") & (F.col("seq") != F.col("last")), "no_result").when((F.col("tool_result_status") == "error") & says_unknown_tool(F.col("tool_result_preview")), "unknown_tool")
    open_ = calls.withColumn("reason", reason).where("reason is not null").withColumn("key", group_key("agent_id", "reason"))
    rows = open_.groupBy("trace_id", "key").agg(F.first(F.struct("agent_id", "reason")).alias("g"), F.count("*").alias("n"), F.min_by(F.struct("tool_name"), "seq").alias("t")).select("*", "g.*").drop("g")
    text = F.coalesce(F.nullif("tool_result_preview", F.lit("")), "tool_input_preview")
    rows = with_least(rows, least(open_, EVIDENCE, "all_seqs", F.col("seq")), least(spoken(open_, text), PREVIEWS, "results", F.col("text")))
    name, odd = tool_name(F.col("t.tool_name"))
    rows = rows.select("trace_id", "reason", "n", "all_seqs", F.array("agent_id").alias("agents"), name.alias("name"), F.concat("results", F.array(odd)).alias("texts"))
    if warnings is not None:
        lost = warnings.where("code = 'orphan_tool_result'").groupBy("trace_id").agg(F.sum("count").alias("n"))
        rows = rows.unionByName(lost.select("trace_id", F.lit("orphan_result").alias("reason"), "n", F.array().cast("array<int>").alias("all_seqs"), F.array().cast("array<string>").alias("agents"), F.lit("<unknown>").alias("name"), F.array().cast("array<string>").alias("texts")))
    rows = rows.withColumn("severity", F.when(F.col("reason") == "unknown_tool", "critical").otherwise("warning"))
    return finished(rows, "unresolved_tool_call", [("occurrences", F.col("n"), False), ("reason", F.col("reason"), True), ("tool_name", F.col("name"), True)], F.format_string("%d tool calls are unresolved: %s", "n", "reason"))


def gaps(spans: DataFrame, seconds: int) -> DataFrame:
    """Pairs of an agent's consecutive spans (by seq) with at least so long between end and next start."""
    by = Window.partitionBy("trace_id", "agent_id").orderBy("seq")
    rows = spans.select("trace_id", "agent_id", "seq", F.col("end").alias("a"), F.lead("start").over(by).alias("b"), F.lead("seq").over(by).alias("after_seq"))
    rows = rows.where("a is not null and b is not null").withColumn("gap_ms", F.greatest(millis_between(F.col("a"), F.col("b")), F.lit(0)))
    return rows.where(F.col("gap_ms") >= seconds * 1000).withColumnRenamed("seq", "before_seq")


def active_runs(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """When agents worked: `runs` (trace_id, s, e), united over all agents, and `alone` (trace_id, agent_id, gs, ge, s, e): the parts in which an agent
    worked alone, with the run that each lies in. One sweep over a trace's starts and ends; both are linear in its spans."""
    busy = spans.where("start is not null and end > start").select("trace_id", "agent_id", F.col("start").alias("s"), F.col("end").alias("e"))
    by = Window.partitionBy("trace_id", "agent_id").orderBy("s", "e")
    new = F.coalesce(F.col("s") > F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    own = busy.withColumn("new", new).withColumn("run", F.sum(F.col("new").cast("int")).over(by))
    own = own.groupBy("trace_id", "agent_id", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    # with one agent at work the sum of numbers is that agent's number
    own = own.withColumn("number", F.dense_rank().over(Window.partitionBy("trace_id").orderBy("agent_id")).cast("long"))
    step = lambda t, sign: F.struct(F.col(t).alias("t"), F.lit(sign).alias("n"), (F.col("number") * sign).alias("sum"))
    points = own.select("trace_id", F.explode(F.array(step("s", 1), step("e", -1))).alias("p")).groupBy("trace_id", "p.t").agg(F.sum("p.n").alias("n"), F.sum("p.sum").alias("sum"))
    at = Window.partitionBy("trace_id").orderBy("t")
    parts = points.select("trace_id", F.col("t").alias("s"), F.lead("t").over(at).alias("e"), F.sum("n").over(at).alias("n"), F.sum("sum").over(at).alias("number"))
    parts = parts.withColumn("run", F.sum((F.col("n") == 0).cast("int")).over(Window.partitionBy("trace_id").orderBy("s"))).where("n > 0")
    edge = Window.partitionBy("trace_id", "run")
    runs = parts.groupBy("trace_id", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")
    names = own.select("trace_id", "number", "agent_id").distinct()
    alone = parts.withColumns({"gs": F.min("s").over(edge), "ge": F.max("e").over(edge)}).where("n = 1").join(names, ["trace_id", "number"])
    return runs, alone.select("trace_id", "agent_id", "gs", "ge", "s", "e")


def coverage(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Milliseconds of each gap during which other agents' spans ran, united; each run, clipped to the gap, counts in whole milliseconds.

    The runs of all agents, with prefix sums, serve every agent; for the few in which an agent worked alone it has its own runs in their place. Both
    ends of a gap look up the sum before them and the run around them, so no gap meets another agent's spans, and work is linear in spans and gaps.
    """
    runs, alone = active_runs(spans)
    span = lambda a, b: F.struct(F.col(a).alias("s"), F.col(b).alias("e"))
    ms = lambda r: millis_between(r["s"], r["e"])
    kind = "struct<s:timestamp,e:timestamp>"

    def events(rows: DataFrame, keys: tuple[str, ...], column: str, r: Column, sign: int) -> DataFrame:
        """A row at the start that names the run, and one at its end that adds its milliseconds."""
        first = F.struct(r["s"].alias("t"), r.alias(column), F.lit(0).cast("long").alias("add"))
        last = F.struct(r["e"].alias("t"), F.lit(None).cast(kind).alias(column), (ms(r) * sign).alias("add"))
        return rows.select(*keys, F.explode(F.array(first, last)).alias("x")).select(*keys, "x.*").withColumn("asks", F.lit(0))

    def looked_up(asked: DataFrame, told: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], total: str) -> DataFrame:
        rows = told.unionByName(asked.withColumn("asks", F.lit(1)), allowMissingColumns=True)
        by = Window.partitionBy(*keys).orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(by) for c in columns} | {total: F.coalesce(F.sum("add").over(by), F.lit(0))})
        return rows.where("asks = 1").select(*asked.columns, *columns, total)

    key = ("trace_id", "agent_id")
    ends = found.where("b > a").select(*key, "before_seq", F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(0).alias("side")), F.struct(F.col("b").alias("t"), F.lit(1).alias("side")))).alias("x")).select(*key, "before_seq", "x.*")
    ends = looked_up(ends, events(runs, ("trace_id",), "all", span("s", "e"), 1), ("trace_id",), ("all",), "before_all")
    # an agent's own runs: what lies between its lonely parts, in each run that has some
    by = Window.partitionBy(*key, "gs").orderBy("s")
    pieces = alone.select(*key, span("gs", "ge").alias("whole"), F.coalesce(F.lag("e").over(by), F.col("gs")).alias("s0"), F.col("s").alias("e0"), F.when(F.lead("s").over(by).isNull(), F.col("e")).alias("rest"))
    pieces = pieces.select(*key, "whole", F.explode(F.array(span("s0", "e0"), F.struct(F.col("rest").alias("s"), F.col("whole.e").alias("e")))).alias("piece"))
    pieces = pieces.where("piece.e > piece.s").select(*key, "piece")
    wholes = alone.select(*key, span("gs", "ge").alias("whole")).distinct()
    own = events(pieces, key, "piece", F.col("piece"), 1).unionByName(events(wholes, key, "whole", F.col("whole"), -1), allowMissingColumns=True)
    ends = looked_up(ends, own, key, ("whole", "piece"), "before_own")
    holds = lambda c: F.when((F.col(c)["s"] <= F.col("t")) & (F.col(c)["e"] > F.col("t")), F.col(c))
    around = F.when(holds("whole").isNotNull(), holds("piece")).otherwise(holds("all"))
    ends = ends.withColumns({"around": around, "before": F.col("before_all") + F.col("before_own")})
    side = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    ends = ends.groupBy(*key, "before_seq").agg(*(side(k, c).alias(f"{c}{k}") for k in (0, 1) for c in ("t", "around", "before")))
    first, last = F.col("around0"), F.col("around1")
    inner = F.col("before1") - F.col("before0")
    inner += F.when(first.isNotNull(), millis_between(F.col("t0"), first["e"]) - ms(first)).otherwise(0)
    inner += F.when(last.isNotNull(), millis_between(last["s"], F.col("t1"))).otherwise(0)
    # a gap inside one run is covered whole
    covered = F.when(first.isNotNull() & (first["e"] >= F.col("t1")), millis_between(F.col("t0"), F.col("t1"))).otherwise(inner)
    sums = ends.select(*key, "before_seq", covered.alias("covered_ms"))
    return found.join(sums, [*key, "before_seq"], "left").withColumn("covered_ms", F.coalesce("covered_ms", F.lit(0)))


def blocked_agent(spans: DataFrame, warnings: DataFrame | None, config: Config) -> DataFrame:
    """Long gaps of an agent of which other agents' work explains less than half."""
    rows = coverage(gaps(spans, config.gap_seconds), spans).where(F.col("covered_ms") * 2 < F.col("gap_ms"))
    rows = rows.withColumn("gap_seconds", F.floor(F.col("gap_ms") / 1000).cast("long"))
    rows = rows.withColumns({"severity": F.when(F.col("gap_seconds") >= GAP_CRITICAL, "critical").otherwise("warning"), "all_seqs": F.array("before_seq", "after_seq"), "agents": F.array("agent_id"), "texts": F.array().cast("array<string>")})
    return finished(rows, "blocked_agent", [(k, F.col(k), False) for k in ("after_seq", "before_seq", "gap_seconds")], F.format_string("nothing for %d seconds after span %d", "gap_seconds", "before_seq"))


def outliers(values: DataFrame, keys: tuple[str, ...], floor: int | Column) -> DataFrame:
    """Rows (keys, value) over the lower median by six times the lower median of absolute deviations, and at least the floor.

    Both medians are selected from distinct values with their counts, in ranges: a key of any size is spread over tasks."""
    counts = ranges.dealt(values.groupBy(*keys, "value").agg(F.count("*").alias("n")), keys, ("value",), "values")
    mid = materialized(ranges.lower_median(counts, keys, "value").withColumnRenamed("value", "median"), "medians")
    off = counts.join(mid, [*keys]).groupBy(*keys, F.abs(F.col("value") - F.col("median")).alias("mad")).agg(F.sum("n").alias("n"))
    mad = ranges.lower_median(ranges.dealt(off, keys, ("mad",), "deviations"), keys, "mad")
    rows = values.join(mid.join(mad, [*keys]), [*keys])
    return rows.where((F.col("value") > F.col("median") + OUTLIER_WARNING * F.col("mad")) & (F.col("value") >= floor)).withColumn("severity", F.when(F.col("value") > F.col("median") + OUTLIER_CRITICAL * F.col("mad"), "critical").otherwise("warning"))


def anomalous_span(spans: DataFrame, warnings: DataFrame | None, config: Config) -> DataFrame:
    """Model calls with far more tokens, or far longer, than the trace's other calls."""
    calls = spans.where("kind = 'model_call' and usage is not null")
    enough = calls.groupBy("trace_id").agg(F.count("*").alias("n")).where(F.col("n") >= OUTLIER_POPULATION).select("trace_id")
    calls = calls.join(enough, "trace_id", "left_semi").select("trace_id", "agent_id", "seq", "text_preview", F.least(total_tokens(F.col("usage")), F.lit((1 << 63) - 1)).cast("long").alias("tokens"), duration_ms(F.col("start"), F.col("end")).alias("duration_ms"))
    values = calls.select("trace_id", "agent_id", "seq", "text_preview", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in OUTLIER_FLOORS))).alias("v")).select("trace_id", "agent_id", "seq", "text_preview", "v.*").where("value is not null")
    floor = F.create_map(*(F.lit(x) for kv in OUTLIER_FLOORS.items() for x in kv))[F.col("dimension")]
    rows = outliers(values, ("trace_id", "dimension"), floor)
    rows = rows.withColumns({"dimension": F.when(F.col("dimension") == "duration_ms", "duration").otherwise(F.col("dimension")), "all_seqs": F.array("seq"), "agents": F.array("agent_id"), "texts": F.array("text_preview")})
    return finished(rows, "anomalous_span", [("dimension", F.col("dimension"), True), *((k, F.col(k), False) for k in ("mad", "median", "seq", "value"))], F.format_string("%s of span %d is %d, the median %d", "dimension", "seq", "value", "median"))


#: Registry, in the order of reports.
DETECTORS: dict[str, Callable[[DataFrame, DataFrame | None, Config], DataFrame]] = {
    f.__name__: f for f in (repeated_tool_call, agent_loop, retry_storm, failed_tool_call, unresolved_tool_call, blocked_agent, anomalous_span)
}
#: Wasted spans (trace_id, key of the group, seq) of the detectors whose waste is attributed.
WASTE: dict[str, Callable[[DataFrame], DataFrame]] = {"repeated_tool_call": repeated_waste, "agent_loop": loop_waste, "retry_storm": storm_waste}
WASTEFUL = tuple(WASTE)


def run(spans: DataFrame, warnings: DataFrame | None = None, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """findings, and finding_waste (trace_id, finding_id, detector, seq): plans of detectors that aren't enabled are never built."""
    chosen = {name: f for name, f in DETECTORS.items() if config.enabled is None or name in config.enabled}
    rows = materialized(reduce(DataFrame.unionByName, [f(spans, warnings, config) for f in chosen.values()]), "found")
    named = rows.select("trace_id", "detector", "key", "finding_id")
    every = [WASTE[name](spans).withColumn("detector", F.lit(name)) for name in chosen if name in WASTE]
    none = spans.sparkSession.createDataFrame([], "trace_id string, key string, seq int, detector string")
    waste = reduce(DataFrame.unionByName, every, none).join(named, ["trace_id", "detector", "key"]).select("trace_id", "finding_id", "detector", "seq").distinct()
    calls = spans.where("kind = 'model_call' and usage is not null").select("trace_id", "seq", "usage")
    waste = waste.join(calls, ["trace_id", "seq"]).select("trace_id", "finding_id", "detector", "seq", "usage")
    sums = waste.groupBy("trace_id", "finding_id").agg(F.struct(*(wide.total(F.col(f"usage.{f}")).alias(f) for f in USAGE_FIELDS)).alias("wasted"))
    nothing = F.struct(*(F.lit(0).cast(wide.COUNT).alias(f) for f in USAGE_FIELDS))
    findings = rows.drop("key").join(sums, ["trace_id", "finding_id"], "left").withColumn("wasted", F.coalesce("wasted", nothing))
    return findings, waste.drop("usage")


def sort_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("trace_id", "severity_rank", "detector", "finding_id")
