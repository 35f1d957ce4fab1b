"""Builders of transcripts and of span tables for tests."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from runlens.schema import SPANS

T0 = datetime(2025, 3, 1, 12, tzinfo=timezone.utc)


def at(seconds: float) -> str:
    return (T0 + timedelta(seconds=seconds)).isoformat().replace("+00:00", "Z")


def usage(i=0, o=0, read=0, w5=0, w1=None):
    u = {"input_tokens": i, "output_tokens": o, "cache_read_input_tokens": read, "cache_creation_input_tokens": w5}
    return u if w1 is None else u | {"cache_creation_input_tokens": w5 + w1, "cache_creation": {"ephemeral_5m_input_tokens": w5, "ephemeral_1h_input_tokens": w1}}


class Transcript:
    def __init__(self):
        self.lines: list[str] = []

    def add(self, kind: str, seconds: float, **more):
        self.lines.append(json.dumps({"type": kind, "uuid": f"u{len(self.lines)}", "timestamp": at(seconds)} | more))
        return self

    def assistant(self, seconds, message_id, blocks=(), use=None, model="atlas-large-2", request="r", **more):
        return self.add("assistant", seconds, requestId=request, message={"id": message_id, "model": model, "role": "assistant", "content": list(blocks)} | ({} if use is None else {"usage": use}), **more)

    def result(self, seconds, tool_id, text="fine", error=False, **more):
        return self.add("user", seconds, message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": tool_id, "content": text, "is_error": error}]}, **more)

    def write(self, path):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(self.lines) + "\n")


def tool(tool_id, name="read", **inputs):
    return {"type": "tool_use", "id": tool_id, "name": name, "input": inputs}


def spans_of(spark, rows: list[dict]):
    """A span table from dicts; seq, trace and times have defaults, `use` is a total of input tokens, times are seconds."""
    full = []
    names = [f.name for f in spark.createDataFrame([], SPANS).schema]
    for k, r in enumerate(rows):
        r = dict(r)
        use = r.pop("use", None)
        d = dict.fromkeys(names) | {"trace_id": "0" * 16, "seq": k, "span_id": f"{k:016x}", "agent_id": "root", "kind": "model_call", "text_preview": "", "tool_input_preview": "", "tool_result_preview": "", "extras_dropped": 0} | r
        for c in ("start", "end"):
            d[c] = None if d[c] is None else (T0 + timedelta(seconds=d[c]))
        d["usage"] = None if use is None else (use, 0, 0, 0, 0)
        full.append(tuple(d[n] for n in names))
    from decimal import Decimal

    full = [tuple(tuple(Decimal(x) for x in v) if n == "usage" and v is not None else v for n, v in zip(names, r)) for r in full]
    return spark.createDataFrame(full, SPANS)
