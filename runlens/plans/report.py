"""Reports of one trace: a JSON document with all spans and findings, and a plain HTML page with all findings and the whole timeline.

Both are put together on the driver; what grows with the trace passes through it one partition at a time when it is written to a file.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from runlens.functions.text import escape_html, json_text, redact
from runlens.functions.time import format_timestamp
from runlens.operators.timeline import SCALE, untimed
from runlens.schema import SEVERITIES, VERSION

#: Caps of the HTML page's table of spans and of its list of spans without times.
SPAN_ROWS, UNTIMED_ROWS = 5000, 200


#: Columns, and fields of structs, that hold free text of the trace; without previews they are empty where they aren't null.
FREE_TEXT = ("text_preview", "tool_input_preview", "tool_result_preview", "model", "stop_reason", "tool_name", "tool_use_id", "detail", "description", "agent_type", "previews")
#: Metrics that are text.
TEXT_METRICS = ("tool_name", "reason", "kinds", "dimension")


def safe(value: Column, kind: DataType, blank: bool = False) -> Column:
    """Every string in a value is redacted, in arrays and structs too; blank: free text becomes empty."""
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), "") if blank else redact(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: safe(x, kind.elementType, blank))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(safe(value[f.name], f.dataType, blank and f.name in FREE_TEXT).alias(f.name) for f in kind)))
    return value


def redacted(df: DataFrame, previews: bool = True) -> DataFrame:
    """The table with all its strings redacted but `metrics` (JSON), of which the text values are. Ids of Spark's making hold digests only."""
    shown = {f.name: safe(F.col(f.name), f.dataType, not previews and (f.name in FREE_TEXT or f.name == "error")) for f in df.schema if f.name not in ("trace_id", "metrics")}
    if "metrics" in df.columns:
        each = F.array_sort(F.map_entries(F.from_json("metrics", "map<string,string>")))
        pair = lambda e: F.concat(json_text(e["key"]), F.lit(":"), F.when(e["key"].isin(*TEXT_METRICS), json_text(redact(e["value"]))).otherwise(e["value"]))
        shown["metrics"] = F.concat(F.lit("{"), F.array_join(F.transform(each, pair), ","), F.lit("}"))
    return df.withColumns(shown)


def span_documents(spans: DataFrame, costs: DataFrame, previews: bool = True) -> DataFrame:
    """trace_id, seq, document (JSON) of every span, redacted, with its cost as a string of six places."""
    rows = redacted(spans, previews).join(costs.select("trace_id", "seq", "cost_usd", "reason"), ["trace_id", "seq"], "left")
    rows = rows.withColumns({"start": format_timestamp(F.col("start")), "end": format_timestamp(F.col("end")), "cost_usd": F.col("cost_usd").cast("string")})
    return rows.select("trace_id", "seq", F.to_json(F.struct(*(c for c in rows.columns if c != "trace_id")), {"ignoreNullFields": "false"}).alias("document"))


def _plain(value):
    return json.loads(json.dumps(value, default=str))


def last_timestamp(spans: DataFrame) -> DataFrame:
    """trace_id, last_timestamp: the latest time of any span; null without times."""
    return spans.groupBy("trace_id").agg(format_timestamp(F.max(F.greatest("start", "end"))).alias("last_timestamp"))


def streamed(tables: dict[str, DataFrame], trace_id: str, previews: bool = True) -> dict:
    """The report of one trace, its findings and spans as iterators that hold one sorted partition at a time."""
    one = lambda name: tables[name].where(F.col("trace_id") == trace_id)
    rows = lambda df, *order: [_plain(r.asDict(recursive=True)) for r in redacted(df, previews).orderBy(*order).collect()]
    found = redacted(one("findings"), previews).orderBy("severity_rank", "detector", "finding_id")
    spans = span_documents(one("spans"), one("costs"), previews).orderBy("seq")
    latest = last_timestamp(one("spans")).first()
    return {
        "schema_version": VERSION, "trace_id": trace_id, "last_timestamp": latest.last_timestamp if latest else None, "source_files": rows(one("source_files"), "name"), "agents": rows(one("agents"), "agent_index"), "warnings": rows(one("warnings"), "code", "detail"),
        "findings": (x | {"metrics": json.loads(x["metrics"])} for x in (_plain(r.asDict(recursive=True)) for r in found.toLocalIterator())),
        "severity_counts": {s: one("findings").where(F.col("severity") == s).count() for s in SEVERITIES}, "spans": (json.loads(r.document) for r in spans.toLocalIterator()), "n_spans": one("spans").count(),
        "cost": {"totals": rows(one("cost_totals"), "trace_id"), "by_agent": rows(one("cost_by_agent"), "agent_id"), "by_model": rows(one("cost_by_model"), "model_key"), "by_detector": rows(one("cost_by_detector"), "detector")},
    }


def document(tables: dict[str, DataFrame], trace_id: str, previews: bool = True) -> dict:
    """The whole report of one trace in memory. Numbers of money are strings; keys are sorted when it is written."""
    return {k: list(v) if isinstance(v, Iterator) else v for k, v in streamed(tables, trace_id, previews).items()}


def json_parts(doc: dict) -> Iterator[str]:
    """The text of a report piece by piece; the elements of an iterator are written as those of a list."""
    text = lambda x, indent: json.dumps(x, sort_keys=True, indent=2, ensure_ascii=True, allow_nan=False).replace("\n", "\n" + " " * indent)
    for k, name in enumerate(sorted(doc)):
        yield f"{',' if k else '{'}\n  {json.dumps(name)}: "
        if not isinstance(doc[name], Iterator):
            yield text(doc[name], 2)
            continue
        before = "["
        for x in doc[name]:
            yield f"{before}\n    {text(x, 4)}"
            before = ","
        yield "[]" if before == "[" else "\n  ]"
    yield "\n}\n"


def json_report(doc: dict) -> str:
    return "".join(json_parts(doc))


def html_parts(tables: dict[str, DataFrame], trace_id: str, previews: bool = True) -> Iterator[str]:
    """One static page without scripts, piece by piece: all findings, critical ones first, the whole timeline, and the first spans. Texts are redacted, then
    escaped, by Spark. Rows without an end come one sorted partition at a time; spans and untimed spans are cut at their caps, each with a line for the rest."""
    one = lambda name: tables[name].where(F.col("trace_id") == trace_id)
    shown = lambda c: escape_html(redact(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c)
    row = lambda r: "<tr>" + "".join(f"<td>{x}</td>" for x in r) + "</tr>\n"
    rest = lambda n, what: f"<p>{n} more {what}</p>" if n > 0 else ""
    style = "body{font-family:sans-serif}td{padding:2px 8px}rect{fill:#789}.s1{fill:#d90}.s2{fill:#c33}"
    yield (
        '<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="default-src \'none\'; style-src \'unsafe-inline\'">'
        f"<title>Trace {trace_id}</title><style>{style}</style></head><body><h1>Trace {trace_id}</h1><h2>Findings</h2><table>\n"
    )
    found = one("findings").orderBy(F.desc("severity_rank"), "detector", "finding_id").select(*map(shown, ("severity", "detector", "summary", "wasted_cost_usd")))
    yield from map(row, found.toLocalIterator())
    height = 12 * ((one("timeline").where("timed").agg(F.max("lane").alias("lane")).first().lane or 0) + 1)
    yield f'</table><h2>Timeline</h2><svg viewBox="0 0 {SCALE} {height}" width="{SCALE}">\n'
    for r in one("timeline").where("timed").orderBy("lane", "seq").select("x", "lane", "width", "severity_rank").toLocalIterator():
        yield f'<rect x="{r.x}" y="{12 * r.lane}" width="{r.width}" height="10" class="s{r.severity_rank if r.severity_rank is not None else ""}"/>\n'
    undrawn = untimed(one("timeline"), UNTIMED_ROWS).first()
    yield f"</svg><p>Without times: {', '.join(map(str, undrawn.seqs)) if undrawn else 'none'}</p>{rest(undrawn.more, 'spans without times') if undrawn else ''}<h2>Spans</h2><table>\n"
    # the first rows are found before they are redacted
    spans = redacted(one("spans").orderBy("seq").limit(SPAN_ROWS), previews).join(one("costs").select("trace_id", "seq", "cost_usd"), ["trace_id", "seq"], "left").orderBy("seq")
    yield from map(row, spans.select(*map(shown, ("seq", "agent_id", "kind", "model", "tool_name", "tool_result_status", "text_preview", "cost_usd"))).toLocalIterator())
    yield f"</table>{rest(one('spans').count() - SPAN_ROWS, 'spans')}</body></html>\n"


def html_report(tables: dict[str, DataFrame], trace_id: str, previews: bool = True) -> str:
    """The whole page in memory."""
    return "".join(html_parts(tables, trace_id, previews))


def write_all(texts: dict[str, str | Iterable[str]]) -> None:
    """Writes several local files, each from a text or its pieces, all or none: each first beside its place, then all are renamed."""
    done: list[tuple[str, str]] = []
    try:
        for path, text in texts.items():
            fd, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".part-")
            done.append((part, path))
            with os.fdopen(fd, "w", encoding="utf-8") as f:
                f.writelines([text] if isinstance(text, str) else text)
                f.flush()
                os.fsync(f.fileno())
        for part, path in done:
            os.replace(part, path)
    finally:
        for part, _ in done:
            if os.path.exists(part):
                os.unlink(part)
