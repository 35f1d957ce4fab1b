import json
from decimal import Decimal

from pyspark.sql import functions as F

from runlens.functions.text import canonical
from runlens.operators import normalize
from runlens.plans import analyze, report
from runlens.queries import lines_of
from runlens.schema import violations
from runlens.sources.limits import Limits
from runlens.sources.scan import scan
from tests.traces import Transcript, tool, usage


def sample(tmp_path):
    t = Transcript()
    t.add("user", 0, message={"role": "user", "content": "please  look\nat it"})
    # three fragments of one call: the last one's usage counts, wholesale
    t.assistant(1, "m1", [{"type": "thinking", "thinking": "hm"}], usage(10, 1, 100, 5))
    t.assistant(2, "m1", [tool("a", path="x", n=1.0)], usage(10, 5, 100, 5))
    t.assistant(3, "m1", [tool("a", path="x", n=1.0)], usage(10, 9, 100, 5))
    t.result(5, "a", "no such tool: read", error=True)
    t.assistant(6, "m2", [{"type": "text", "text": "done"}], usage(3, 4, 0, 7, 2), request="r2", extra=1)
    t.result(7, "zz", "nobody asked")
    t.add("system", 8, subtype="compact_boundary", content="x")
    t.add("telemetry", 9)
    t.assistant(10, "m3", [tool("b", "write", q=[1, 2])], None, request="r3")
    t.write(tmp_path / "one" / "main.jsonl")
    bad = Transcript().add("user", 0, message={"role": "user", "content": "hi"})
    bad.lines.append('{"type": "user"')
    bad.write(tmp_path / "two" / "main.jsonl")
    return str(tmp_path)


def test_end_to_end(spark, tmp_path):
    t = analyze.analyze(spark, sample(tmp_path))
    spans = t["spans"].orderBy("seq").collect()
    assert [(s.kind, s.tool_name, s.tool_result_status, s.parent_seq) for s in spans] == [
        ("user_message", None, None, None), ("model_call", None, None, None), ("tool_call", "read", "error", 1), ("model_call", None, None, None),
        ("system_event", None, None, None), ("model_call", None, None, None), ("tool_call", "write", "missing", 5),
    ]
    assert spans[0].text_preview == "please look at it" and spans[1].text_preview == "hm"
    assert spans[1].usage.output_tokens == 9 and spans[3].usage.cache_creation_1h_tokens == 2
    assert spans[2].tool_input_preview == '{"n":1.0,"path":"x"}' and (spans[2].end - spans[2].start).total_seconds() == 2
    assert spans[5].usage is None and spans[4].error.code == "compact_boundary"
    stats = t["stats"].collect()[0]
    assert (stats.records, stats.model_calls, stats.naive_output_tokens, stats.collapsed_output_tokens) == (5, 3, 19, 13)
    log = {(w.code, w.detail): w["count"] for w in t["warnings"].collect()}
    assert log[("orphan_tool_result", "")] == 1 and log[("dangling_tool_use", "")] == 1 and log[("missing_usage", "")] == 1
    assert log[("unknown_record_type", "telemetry")] == 1 and log[("compaction_boundary", "")] == 1 and log[("unknown_extra_key", "")] == 1
    fatal = t["fatal"].collect()
    assert [(f.code, f.line) for f in fatal] == [("invalid_json", 2)] and t["source_files"].count() == 1
    found = {(f.detector, f.severity) for f in t["findings"].collect()}
    assert found == {("failed_tool_call", "info"), ("unresolved_tool_call", "critical"), ("unresolved_tool_call", "warning")}
    assert violations(t["spans"], t["agents"], t["findings"]).isEmpty()
    reasons = {c.seq: c.reason for c in t["costs"].collect()}
    assert reasons == {1: None, 3: None, 5: "usage_missing"}
    # 10*3 + 9*15 + 100*0.30 + 5*3.75 micro-dollars
    assert t["costs"].where("seq = 1").first().cost_usd == Decimal("0.000214")
    trace = t["spans"].first().trace_id
    doc = report.document(t, trace)
    text = report.json_report(doc)
    assert doc["severity_counts"] == {"info": 1, "warning": 1, "critical": 1} and text.endswith("}\n") and '"cost_usd": "0.000214"' in text
    assert "<script" not in report.html_report(t, trace)


def test_json_report_has_all_spans_and_findings(spark, tmp_path):
    t = analyze.analyze(spark, sample(tmp_path))
    n = spark.range(4000)
    t["findings"] = t["findings"].crossJoin(n).withColumn("finding_id", F.concat_ws("-", "finding_id", "id")).drop("id")
    t["spans"] = t["spans"].crossJoin(n.limit(800)).withColumn("seq", (F.col("seq") + 7 * F.col("id")).cast(t["spans"].schema["seq"].dataType)).drop("id")
    trace = t["spans"].first().trace_id
    report.write_all({str(tmp_path / "out.json"): report.json_parts(report.streamed(t, trace))})
    text = (tmp_path / "out.json").read_text()
    doc = json.loads(text)
    assert len(doc["findings"]) == 12_000 == sum(doc["severity_counts"].values()) and [x["seq"] for x in doc["spans"]] == list(range(5600))
    order = [(x["severity_rank"], x["detector"], x["finding_id"]) for x in doc["findings"]]
    assert order == sorted(order) and sum(x["severity"] == "critical" for x in doc["findings"]) == 4000
    assert text == json.dumps(doc, sort_keys=True, indent=2) + "\n"
    whole = report.document(t, trace)
    assert (len(whole["findings"]), len(whole["spans"])) == (12_000, 5600)
    assert report.json_report({"b": iter([]), "a": [], "c": {}}) == json.dumps({"a": [], "b": [], "c": {}}, indent=2) + "\n"


def test_html_has_all_findings_and_the_whole_timeline(spark, tmp_path):
    t = analyze.analyze(spark, sample(tmp_path))
    trace, n = t["spans"].first().trace_id, spark.range(6000)
    drawn = t["timeline"].where("timed").limit(1)
    t["findings"] = t["findings"].crossJoin(n.limit(4000)).withColumn("finding_id", F.concat_ws("-", "finding_id", "id")).drop("id")
    many = drawn.crossJoin(n).withColumn("seq", F.col("id").cast("int")).drop("id")
    t["timeline"] = many.unionByName(many.where("seq < 203").withColumns({"timed": F.lit(False), "x": F.lit(None).cast("int"), "width": F.lit(None).cast("int")}))
    t["spans"] = t["spans"].limit(1).crossJoin(n).withColumn("seq", F.col("id").cast("int")).drop("id")
    page = report.html_report(t, trace)
    assert page.count("<rect ") == 6000 and page.count("<td>critical</td>") == 4000 and page.count("<tr>") == 12_000 + 5000
    assert page.index("<td>critical</td>") < page.index("<td>warning</td>") < page.index("<td>info</td>")
    assert "198, 199</p><p>3 more spans without times</p>" in page and "<p>1000 more spans</p>" in page and page.endswith("</html>\n")
    t["timeline"], t["findings"] = many.limit(0), t["findings"].limit(0)
    assert "Without times: none" in report.html_report(t, trace)


def test_a_key_in_any_string_appears_nowhere(spark, tmp_path):
    key = "ghp_abcdefghij0123456789abcd"
    t = Transcript()
    t.add("user", 0, message={"role": "user", "content": f"say {key}"}, agentId=key)
    t.assistant(1, "m", [{"type": "text", "text": key}, tool(key, name=key, path=key)], usage(1, 1), model=key, agentId=key)
    t.lines[-1] = t.lines[-1].replace('"role": "assistant"', f'"role": "assistant", "stop_reason": "{key}"')
    t.result(2, key, text=key, error=True, agentId=key)
    t.assistant(3, "m2", [tool("t2", name=key, path=key), tool("t3", name=key, path=key)], usage(1, 1), agentId=key)
    t.assistant(4, "e", [], None, isApiErrorMessage=True, error=key, apiErrorStatus=key, agentId=key)
    t.add(key, 5)
    t.write(tmp_path / "t" / f"{key}.jsonl")
    (tmp_path / "t" / f"{key}.meta.json").write_text(json.dumps({"agentType": key, "description": key}))
    tables = analyze.analyze(spark, str(tmp_path / "t"))
    trace = tables["spans"].first().trace_id
    assert {f.detector for f in tables["findings"].collect()} >= {"repeated_tool_call", "failed_tool_call"}
    doc = report.document(tables, trace)
    text = report.json_report(doc)
    assert key not in text and key not in report.html_report(tables, trace) and text.count("[redacted:github_token]") > 12
    assert {x["metrics"]["tool_name"] for x in doc["findings"] if "tool_name" in x["metrics"]} >= {"[redacted:github_token]"} and doc["last_timestamp"].startswith("2025-03-01T12:00:04")
    blank = report.document(tables, trace, previews=False)
    assert ">say [redacted" in report.html_report(tables, trace) and ">say " not in report.html_report(tables, trace, previews=False)
    assert {s["model"] for s in blank["spans"]} <= {None, ""} and {s["tool_name"] for s in blank["spans"]} <= {None, ""} and key not in report.json_report(blank)


def test_large_files_are_not_read(spark, tmp_path):
    for name, n in (("small", 1), ("large", 400)):
        t = Transcript()
        for k in range(n):
            t.add("user", k, message={"role": "user", "content": "x"})
        t.write(tmp_path / name / "a.jsonl")
    found = scan(spark, str(tmp_path), Limits(file_bytes=2000))
    assert [(r.code, r.line) for r in found["fatal"].collect()] == [("file_too_large", 0)] and found["lines"].count() == 1
    sizes = {r.bytes: r.records for r in found["source_files"].collect()}
    assert len(sizes) == 2 and min(sizes) < 2000 < max(sizes)


def test_fatal_codes(spark, tmp_path):
    cases = {
        "not_an_object": ["[1]"], "missing_field": ['{"type":"user","uuid":"","timestamp":"2025-01-01T00:00:00Z"}'], "bad_timestamp": ['{"type":"user","uuid":"a","timestamp":"2025-01-01T00:00:00"}'],
        "bad_message": ['{"type":"user","uuid":"a","timestamp":"2025-01-01T00:00:00Z","message":[1]}'], "duplicate_uuid": ['{"type":"x","uuid":"a","timestamp":"2025-01-01t00:00:00z"}'] * 2, "json_too_deep": ["[" * 300 + "]" * 300],
    }
    for code, lines in cases.items():
        p = tmp_path / code / "a.jsonl"
        p.parent.mkdir()
        p.write_text("\n".join(lines) + "\n")
    rows, fatal = normalize.records(scan(spark, str(tmp_path)))
    assert sorted(r.code for r in fatal.collect()) == sorted(cases) and rows.isEmpty()


def test_groups_keep_null_and_empty_apart_and_api_errors_drop_usage(spark, tmp_path):
    t = Transcript()
    t.assistant(0, None, [], usage(1, 1), request=None)
    t.assistant(1, None, [], usage(1, 1), request=None)
    t.assistant(2, "", [], usage(1, 1), request=None)
    t.assistant(3, "", [], usage(1, 2), request=None)
    t.assistant(4, "e", [], usage(5, 5))
    t.assistant(5, "e", [], usage(5, 5), isApiErrorMessage=True, error="Rate Limit", apiErrorStatus="429")
    t.write(tmp_path / "t" / "a.jsonl")
    out = normalize.normalized(scan(spark, str(tmp_path)))
    calls = out["spans"].orderBy("seq").collect()
    assert len(calls) == 4 and calls[3].usage is None and (calls[3].error.code, calls[3].error.detail) == ("rate_limit", "429")
    s = out["stats"].first()
    assert (s.naive_output_tokens, s.collapsed_output_tokens, s.api_errors) == (10, 4, 1)


def test_coercion(spark):
    v = spark.sql("""select parse_json('{"a":5,"b":true,"c":"x","d":-3,"e":1.5,"f":{"k":1},"g":"true"}') as v""")
    c = F.col("v")
    row = v.select(normalize.count_at(c, "$.a").alias("a"), normalize.count_at(c, "$.b").alias("b"), normalize.count_at(c, "$.c").alias("c"), normalize.count_at(c, "$.d").alias("d"), normalize.count_at(c, "$.e").alias("e"), normalize.string_at(c, "$.a").alias("s"), normalize.true_at(c, "$.b").alias("t"), normalize.true_at(c, "$.g").alias("u")).first()
    assert tuple(row) == (5, 0, 0, 0, 0, None, True, False)


def test_typed_records_hold_no_variants(spark, tmp_path):
    """Everything is taken from a line in the one pass; the text of a line is kept only for canonical tool inputs."""
    rows, _ = normalize.records(scan(spark, sample(tmp_path)))
    assert "variant" not in rows.schema.simpleString()
    kept = {r.record_index: r.value for r in rows.select("record_index", "value").collect()}
    assert {k for k, v in kept.items() if v is not None} == {2, 3, 9}
    content = ["x", {"type": "text", "text": "a b"}, {"type": "text", "text": 5}, 7, None, {"type": "tool_use", "id": "i", "input": {"b": 1.0, "a": 2}}, {"text": "u"}]
    t = Transcript().add("assistant", 0, message={"id": "m", "content": content}).add("attachment", 1, message=[1], content=[tool("a")])
    t.write(tmp_path / "odd" / "t" / "a.jsonl")
    rows, fatal = normalize.records(scan(spark, str(tmp_path / "odd")))
    got = normalize.blocks(rows).where("record_index = 0").orderBy("pos").select("block_type", "id", "text", "input").collect()
    none = (None,) * 4
    assert fatal.isEmpty() and list(map(tuple, got)) == [none, ("text", None, "a b", None), ("text", None, None, None), none, none, ("tool_use", "i", None, '{"a":2,"b":1.0}'), (None, None, "u", None)]


def test_blocks_know_their_call(spark, tmp_path):
    """No join finds the call of a block, and blocks of one type are told apart without those of others."""
    rows, _ = normalize.records(scan(spark, sample(tmp_path)))
    every = normalize.blocks(rows)
    keys = {(r.trace_id, r.record_index): r.key for r in normalize.grouped(rows).collect()}
    assert all(r.key == keys.get((r.trace_id, r.record_index)) for r in every.collect())
    whole = sorted((r.record_index, r.pos, r.block_type) for r in normalize.distinct_blocks(every).collect())
    parts = sorted((r.record_index, r.pos, r.block_type) for kinds in (("text", "thinking"), ("tool_use",)) for r in normalize.distinct_blocks(every, kinds).collect())
    assert whole == parts == [(1, 0, "thinking"), (2, 0, "tool_use"), (5, 0, "text"), (9, 0, "tool_use")]


def test_plain_lines_are_read_as_odd_ones(spark):
    """What is read by schema is what the variant says, and lines where that could differ are looked at as variants."""
    whole = {"type": "assistant", "uuid": "u", "timestamp": "2025-01-01T00:00:00Z"}
    block = {"type": "tool_result", "tool_use_id": "t", "content": "[x", "is_error": True}
    messages = [
        {"id": "m", "content": [{"type": "text", "text": '{"text":5}'}, tool("a", path="x")], "usage": usage(1, 2, 3, 4, 5), "more": 1}, {"id": 5, "content": [{"type": "text", "text": 5}]}, {"content": "[1]"}, {"content": '[{"type":"text","text":"a"}]'},
        {"content": [5, {"type": "text", "text": "a"}, None]}, {"content": [{"text": "a"}]}, {"content": [block, block | {"content": [{"type": "text", "text": "b"}, {"type": "text", "text": 1}]}, block | {"is_error": "true"}]}, {"content": {"a": 1}},
        {"usage": {"input_tokens": 1.0, "output_tokens": "7", "cache_read_input_tokens": 10**25, "cache_creation_input_tokens": -1}}, {"usage": {"cache_creation": {}}}, {"usage": []}, {"content": ""}, {"content": None, "usage": None}, [1], None, "x",
    ]
    lines = [json.dumps(whole | {"message": m, "type": t, "agentId": a}, separators=sep) for m in messages for t, a in (("assistant", "a"), ("user", 7)) for sep in ((",", ":"), (" , ", " : "))]
    lines += [json.dumps(whole | more) for more in ({"uuid": 1}, {"content": "x", "type": "system"}, {"isApiErrorMessage": "true", "error": "e"}, {"isApiErrorMessage": True, "apiErrorStatus": 429}, {"a": {"type": 1}})]
    lines += [lines[0].replace('"content"', '"\\u0063ontent"').replace('"text":', '"te\\u0078t":'), f"[{lines[0]}]", "5", "{}"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, value string")
    keys = lambda df: df.select("k", F.col("t").withField("message_keys", F.array_sort("t.message_keys")).withField("usage_keys", F.array_sort("t.usage_keys")).withField("message_kind", F.nullif("t.message_kind", F.lit("VOID"))).alias("t"))
    got, want = ({r.k: r.t for r in keys(normalize.values_of(rows.withColumn("plain", F.lit(p)))).collect()} for p in (True, False))
    assert len(got) == len(lines) and got == want
    first = normalize.values_of(rows.where("k = 0").withColumns({"plain": F.lit(True), "v": F.lit(None).cast("variant")})).first().t
    assert first.usage.cache_creation_1h_tokens == 5 and first.parts[0].text == '{"text":5}'
    repeated = rows.limit(1).select("k", F.lit(lines[0].replace('"id":"m"', '"id":"q","id":"m"')).alias("value"), F.lit(False).alias("plain"), F.parse_json(F.lit(lines[0])).alias("v"))
    assert normalize.values_of(repeated).first().t.message_id == "m"


def test_the_log_writes_no_agents(spark, tmp_path, monkeypatch):
    labels = []
    write = normalize.materialized
    monkeypatch.setattr(normalize, "materialized", lambda df, label, *more: labels.append(label) or write(df, label, *more))
    scanned = scan(spark, sample(tmp_path))
    log = {tuple(r) for r in normalize.warning_log(scanned).collect()}
    assert "agents" not in labels and log == {tuple(r) for r in normalize.normalized(scanned)["warnings"].collect()}


def test_plain_inputs_are_canonical_as_they_are(spark):
    """Inputs that are canonical as they stand need no Python, and all others give what Python says."""
    sure = ["{}", '{"a":"x"}', '{"a": 1, "ab" : true, "b":null}', '{"a,b":"x, \\"y\\" \\\\ \\n"}', '{"a":-12}', '{"a":"\\/"}']
    other = [
        '{"b":1,"a":2}', '{"a":1.0}', '{"a":-0}', '{"a":1e400}', '{"a":-1e400,"b":1}', '{"a":"Infinity"}', '{"a":"\u00e9"}', '{"a":"\\u00e9"}', '{"a":"\x7f"}', '{"a":"\\u001f"}', '{"a":{"b":1}}', '{"a":[1]}', "null", '"x"', "[1]", "5",
        '{"a":12345678901234567890}', '{"a":1E2}', '{"\\u0061":1}', '{"a":"\\ud83d\\ude00"}', '{"a":"\u2028"}', '{"type":5}',
    ]
    line = '{"type":"assistant","uuid":"u%d","timestamp":"2025-01-01T00:00:00Z","message":{"id":"m","content":[{"type":"text","text":"a"},{"type":"tool_use","id":"t%d","name":"n","input":%s}]}}'
    rows = spark.createDataFrame([("t", k + 1, line % (k, k, x)) for k, x in enumerate(sure + other)], "trace_id string, line int, value string")
    records, _ = normalize.records(lines_of(rows))
    got = {r.record_index: r.input for r in normalize.blocks(records).where("block_type = 'tool_use'").collect()}
    assert got == {k: canonical(json.loads(x)) for k, x in enumerate(sure + other)}
    assert {r.record_index for r in records.where("value is null").collect()} >= set(range(len(sure)))


def test_outlined_spans_are_those_of_the_whole(spark, tmp_path, monkeypatch):
    """They need the places of records alone, and name the same spans, parents and digests."""
    written = {}
    write = normalize.materialized
    monkeypatch.setattr(normalize, "materialized", lambda df, label, *more: written.update({label: df.columns}) or write(df, label, *more))
    scanned = scan(spark, sample(tmp_path))
    named = ("trace_id", "seq", "span_id", "parent_seq", "parent_span_id", "agent_id", "kind", "tool_result_status", "tool_input_digest")
    got = sorted(map(tuple, normalize.outlined(normalize.records(scanned, normalize.PLACES)[0]).select(*named).collect()))
    assert set(written["records"]) == {"object", "code", "uuid", *normalize.PLACES} and "text" not in written["blocks"]
    spans = normalize.normalized(scanned)["spans"].select(*named).collect()
    ids = {(s.trace_id, s.seq): s.span_id for s in spans}
    assert len(spans) == 7 and got == sorted(map(tuple, spans))
    assert all(s.parent_span_id == ids.get((s.trace_id, s.parent_seq)) for s in spans)
