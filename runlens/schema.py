"""Schemas of the normalized tables and the checks of their invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.wide import COUNT

VERSION = "1.0.0"
USAGE_FIELDS = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_5m_tokens", "cache_creation_1h_tokens")
KINDS = ("model_call", "tool_call", "user_message", "system_event")
STATUSES = ("ok", "error", "missing")
SEVERITIES = ("info", "warning", "critical")
USAGE = "struct<" + ",".join(f"{f}:{COUNT}" for f in USAGE_FIELDS) + ">"
SPANS = (
    "trace_id string, seq int, span_id string, parent_span_id string, parent_seq int, agent_id string, kind string, start timestamp, end timestamp, model string, "
    f"usage {USAGE}, stop_reason string, tool_name string, tool_use_id string, tool_input_digest string, tool_result_status string, text_preview string, "
    "tool_input_preview string, tool_result_preview string, error struct<code:string,detail:string>, extras_dropped int"
)
AGENTS = "trace_id string, agent_id string, agent_index int, agent_type string, description string, parent_agent_id string, depth int, span_seqs array<int>, start timestamp, end timestamp"
WARNINGS = "trace_id string, code string, detail string, count long"
SOURCE_FILES = "trace_id string, name string, sha256 string, bytes long, records long"
FINDINGS = "trace_id string, detector string, finding_id string, severity string, severity_rank int, summary string, span_seqs array<int>, agent_ids array<string>, metrics string, previews array<string>"
# The closed set of warning codes.
WARNING_CODES = (
    "unknown_record_type", "unknown_content_block", "known_ignored_key", "unknown_extra_key", "timestamp_out_of_order", "negative_duration",
    "orphan_tool_result", "dangling_tool_use", "missing_usage", "synthetic_model", "compaction_boundary", "api_error_record",
)


def schema_document() -> str:
    """The schemas as one JSON document, keys sorted."""
    import json

    from pyspark.sql import SparkSession
    from pyspark.sql.types import StructType

    SparkSession.builder.getOrCreate()  # parsing a schema needs one
    parse = StructType.fromDDL
    tables = {"spans": SPANS, "agents": AGENTS, "warnings": WARNINGS, "source_files": SOURCE_FILES, "findings": FINDINGS}
    return json.dumps({"version": VERSION, "tables": {k: json.loads(parse(v).json()) for k, v in tables.items()}}, sort_keys=True, indent=2) + "\n"


def _sorted_once(c: str) -> Column:
    return F.col(c) == F.array_sort(F.array_distinct(c))


def span_rules() -> dict[str, Column]:
    """Conditions that no span may meet."""
    return {
        "kind": F.coalesce(~F.col("kind").isin(*KINDS), F.lit(True)),
        "status": F.col("tool_result_status").isNotNull() & ~F.col("tool_result_status").isin(*STATUSES),
        "agent_id": ~F.coalesce(F.col("agent_id").rlike(r"\A[A-Za-z0-9_.:\-]{1,64}\z"), F.lit(False)),
        "span_id": ~F.col("span_id").rlike(r"\A[0-9a-f]{16}\z"),
        "end_before_start": F.col("end") < F.col("start"),
        "negative_tokens": F.array_min(F.array(*(F.col(f"usage.{f}") for f in USAGE_FIELDS))) < 0,
        "parent_not_before": F.col("parent_seq") >= F.col("seq"),
    }


def finding_rules() -> dict[str, Column]:
    """Conditions that no finding may meet."""
    return {
        "evidence": (F.size("span_seqs") > 50) | ~_sorted_once("span_seqs"), "previews": (F.size("previews") > 5) | F.exists("previews", lambda x: x.isNull() | (x == "")),
        "finding_id": ~F.col("finding_id").startswith(F.concat("detector", F.lit(":"))), "severity": ~F.col("severity").isin(*SEVERITIES), "agents": ~_sorted_once("agent_ids"),
    }


def agent_rules() -> dict[str, Column]:
    """Conditions that no agent may meet."""
    return {"agent_spans": (F.size("span_seqs") == 0) | ~_sorted_once("span_seqs"), "agent_index": F.col("agent_index") < 0}


NO_VIOLATIONS = "trace_id string, rule string, n long"


def violations(spans: DataFrame, agents: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """trace_id, rule, n: rows of finished tables that break an invariant, and traces whose seq has gaps. Empty if all is well.

    `analyze` counts the same rules while it writes the tables; this is for tables from elsewhere.
    """
    tables = [(spans, span_rules()), (agents, agent_rules()), (findings, finding_rules())]
    out = [df.where(c).groupBy("trace_id").agg(F.count("*").alias("n")).select("trace_id", F.lit(rule).alias("rule"), "n") for df, rules in tables if df is not None for rule, c in rules.items()]
    dense = spans.groupBy("trace_id").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.count("*").alias("n"), F.count_distinct("seq").alias("d"))
    return reduce(DataFrame.unionByName, out, dense.where("a <> 0 or b <> n - 1 or d <> n").select("trace_id", F.lit("seq_not_contiguous").alias("rule"), "n"))
