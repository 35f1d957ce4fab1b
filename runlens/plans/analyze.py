"""The whole analysis of many traces: scan, normalize, detect, price."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators import cost, detect, normalize, timeline
from runlens.schema import SEVERITIES, finding_rules
from runlens.sources import rates as rate_source
from runlens.sources.limits import Limits
from runlens.sources.registry import source_of
from runlens.workers import materialized


def analyze(spark: SparkSession, path: str | list[str], limits: Limits = Limits(), config: detect.Config = detect.Config(), snapshot: dict | None = None, previews: bool = True, one_trace: bool = False, source: str = "jsonl") -> dict[str, DataFrame]:
    """Tables of all traces below path: spans, agents, warnings, fatal, violations (rows that break an invariant, counted while tables are written), source_files, stats, findings, finding_waste, costs and their rollups. source: a name in the registry."""
    reader = source_of(source)
    scanned = reader.scan(spark, path, limits, one_trace)
    side = reader.sidecars(spark, path, scanned["index"], one_trace)
    out = normalize.normalized(scanned, side, previews)
    found, waste = detect.run(out["spans"], out["warnings"], config)
    broken: list[DataFrame] = []
    found, waste = materialized(found, "findings", finding_rules(), broken), materialized(waste, "waste")
    costs = materialized(cost.priced(out["spans"], rate_source.table(spark, snapshot)), "costs")
    out["violations"] = normalize.all_of([out["violations"], *broken], out["spans"])
    rects = timeline.rectangles(out["spans"], out["agents"], found)
    out |= {
        "findings": cost.waste_by_finding(found, waste, costs), "finding_waste": waste, "costs": costs, "cost_totals": cost.totals(costs), "cost_by_agent": cost.by_agent(costs, out["agents"]),
        "cost_by_model": cost.by_model(costs), "cost_by_detector": cost.by_detector(found, waste, costs), "timeline": rects, "lanes": timeline.lanes(rects, out["agents"]),
    }
    return out


def severity_counts(findings: DataFrame, traces: DataFrame) -> DataFrame:
    """Counts of each severity; traces without findings have zeros."""
    n = findings.groupBy("trace_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    return traces.select("trace_id").distinct().join(n, "trace_id", "left").na.fill(0, [*SEVERITIES])
