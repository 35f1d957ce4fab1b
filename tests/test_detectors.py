import math
import random
import time

from pyspark.sql import functions as F

from runlens.operators import cost, detect
from tests.traces import spans_of

CFG = detect.Config()


def brute_loops(seq):
    """The search: smallest period, then smallest start at or after the floor, as many repeats as there are; then again behind it."""
    out, floor = [], 0
    while True:
        hit = None
        for p in range(1, 9):
            for a in range(floor, len(seq)):
                r = 1
                while seq[a + r * p : a + (r + 1) * p] == seq[a : a + p] and a + (r + 1) * p <= len(seq):
                    r += 1
                if r >= 3:
                    hit = (p, a, r)
                    break
            if hit:
                break
        if not hit:
            return sorted(out)
        out.append(hit)
        floor = hit[1] + hit[0] * hit[2]


def test_loops_match_a_plain_search(spark):
    rnd = random.Random(1)
    seqs = ["ABABABCCC", "CCCABABAB", "AAAA", "ABCABCAB", ""] + ["".join(rnd.choice("AB" if k % 2 else "ABC") for _ in range(rnd.randint(1, 40))) for k in range(150)]
    rows = spark.createDataFrame([(k, i, c) for k, s in enumerate(seqs) for i, c in enumerate(s)], "k int, pos int, sig string")
    got: dict = {}
    for r in detect.loops(rows, ("k",)).collect():
        got.setdefault(r.k, []).append((r.period, r.start, r.repeats))
    for k, s in enumerate(seqs):
        assert sorted(got.get(k, [])) == brute_loops(s), s


def brute_storms(err):
    n = len(err)
    wins = [(i, min(i + 10, n)) for i in range(max(0, n - 10) + 1) if sum(err[i : i + 10]) >= 3]
    runs = []
    for a, b in wins:
        if runs and a < runs[-1][1]:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    return [(min(i for i in range(a, b) if err[i]), max(i for i in range(a, b) if err[i]), sum(err[a:b])) for a, b in runs]


def test_storms_match_brute_force(spark):
    rnd = random.Random(2)
    cases = [[rnd.random() < p for _ in range(rnd.randint(1, 60))] for p in (0.1, 0.2, 0.3, 0.5) for _ in range(40)]
    rows = spark.createDataFrame([(k, i, e) for k, c in enumerate(cases) for i, e in enumerate(c)], "k int, seq int, err boolean")
    runs = detect.storm_runs(rows, ("k",)).groupBy("k", "run").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count_if("err").alias("n")).collect()
    got: dict = {}
    for r in runs:
        got.setdefault(r.k, []).append((r.a, r.b, r.n))
    for k, c in enumerate(cases):
        assert sorted(got.get(k, [])) == brute_storms(c), c


def brute_coverage(rows, seconds):
    """Other agents' intervals, clipped to each gap and united one by one; whole milliseconds of each united part."""
    want = {}
    for a in {r["agent_id"] for r in rows}:
        own = [(k, r) for k, r in enumerate(rows) if r["agent_id"] == a]
        for (k, x), (_, y) in zip(own, own[1:]):
            gap = max(0, math.floor(round((y["start"] - x["end"]) * 1e6) / 1000))
            if gap >= seconds * 1000:
                united = []
                for s, e in sorted((max(r["start"], x["end"]), min(r["end"], y["start"])) for r in rows if r["agent_id"] != a and r["end"] > r["start"]):
                    if e > s and united and s <= united[-1][1]:
                        united[-1][1] = max(e, united[-1][1])
                    elif e > s:
                        united.append([s, e])
                want[a, k] = (gap, sum(math.floor(round((e - s) * 1e6) / 1000) for s, e in united))
    return want


def test_coverage_matches_brute_force(spark):
    rnd = random.Random(3)
    for agents, seconds, fine in (("abc", 60, 1), ("ab", 1, 1), ("abcdefgh", 30, 1000), ("a", 0, 1), ("abc", 0, 1000)):
        rows, t = [], 0.0
        for k in range(200):
            t += rnd.choice([0, 1, 30, 90, 400]) if fine == 1 else rnd.randint(0, 90_000_000) / 1e6
            rows.append({"agent_id": rnd.choice(agents), "start": t, "end": t + (rnd.choice([0, 5, 60, 300]) if fine == 1 else rnd.randint(0, 90_000_000) / 1e6)})
        rnd.shuffle(rows)
        rows[:150] = sorted(rows[:150], key=lambda r: r["start"])
        spans = spans_of(spark, rows)
        got = {(r.agent_id, r.before_seq): (r.gap_ms, r.covered_ms) for r in detect.coverage(detect.gaps(spans, seconds), spans).collect()}
        assert got == brute_coverage(rows, seconds)
        assert agents == "a" or any(c for _, c in got.values())


def seconds_of(make):
    t = time.time()
    make().write.format("noop").mode("overwrite").save()
    return time.time() - t


def test_growth_is_near_linear(spark):
    """One agent with nothing but errors, and two that take turns with every gap over the threshold: four times the spans, at most eight times the time."""
    fail = {"kind": "tool_call", "tool_name": "read", "tool_input_digest": "d", "tool_result_status": "error"}
    errors = lambda n: spans_of(spark, [fail | {"start": k, "end": k} for k in range(n)])
    turns = lambda n: spans_of(spark, [{"agent_id": "ab"[k % 2], "start": 200 * k, "end": 200 * k + 100} for k in range(n)])
    for shape, slug, found in ((errors, "retry_storm", lambda n: 1), (turns, "blocked_agent", lambda n: n - 2)):
        seconds_of(lambda: detect.DETECTORS[slug](shape(100), None, CFG))
        took = []
        for n in (2500, 10_000):
            spans = shape(n)
            took.append(seconds_of(lambda: detect.DETECTORS[slug](spans, None, CFG)))
            assert detect.DETECTORS[slug](spans, None, CFG).count() == found(n)
        assert took[1] <= 8 * max(took[0], 0.5)


def findings(spans, slug):
    return {(f.severity, f.metrics) for f in detect.DETECTORS[slug](spans, None, CFG).collect()}


def test_thresholds(spark):
    tool = lambda **k: {"kind": "tool_call", "tool_name": "read", "tool_input_digest": "d", "tool_result_status": "ok", "start": 0, "end": 0} | k
    assert not findings(spans_of(spark, [tool()]), "repeated_tool_call")
    assert {s for s, _ in findings(spans_of(spark, [tool()] * 3), "repeated_tool_call")} == {"warning"}
    assert findings(spans_of(spark, [tool()] * 4), "repeated_tool_call") == {("critical", '{"first_seq":0,"last_seq":3,"occurrences":4,"tool_name":"read"}')}
    assert {s for s, _ in findings(spans_of(spark, [tool(tool_result_status="error")]), "failed_tool_call")} == {"info"}
    assert {s for s, _ in findings(spans_of(spark, [tool(tool_result_status="error", tool_name="bad name")] * 2), "failed_tool_call")} == {"warning"}
    missing = tool(tool_result_status="missing")
    assert not findings(spans_of(spark, [missing]), "unresolved_tool_call")
    assert len(findings(spans_of(spark, [missing, tool()]), "unresolved_tool_call")) == 1
    gap = lambda s: spans_of(spark, [{"start": 0, "end": 0}, {"start": s, "end": s}])
    assert not findings(gap(59.999), "blocked_agent") and {s for s, _ in findings(gap(60), "blocked_agent")} == {"warning"} and {s for s, _ in findings(gap(300), "blocked_agent")} == {"critical"}
    call = lambda n: {"use": n, "start": 0, "end": 1}
    base = [call(n) for n in (2000, 2000, 4000, 4000, 4000, 6000, 6000)]
    assert not findings(spans_of(spark, [*base, call(16_000)]), "anomalous_span")
    assert {s for s, _ in findings(spans_of(spark, [*base, call(16_001)]), "anomalous_span")} == {"warning"}
    assert {s for s, _ in findings(spans_of(spark, [*base, call(29_000)]), "anomalous_span")} == {"critical"}
    assert not findings(spans_of(spark, base[1:] + [call(60_000)]), "anomalous_span")


def test_order_of_rows_and_partitions_change_nothing(spark):
    rnd = random.Random(5)
    rows = [{"agent_id": rnd.choice("ab"), "kind": rnd.choice(["tool_call", "model_call"]), "tool_name": rnd.choice(["read", "write"]), "tool_input_digest": rnd.choice("de"), "tool_result_status": rnd.choice(["ok", "error"]), "use": rnd.randint(1, 9), "start": k * 7, "end": k * 7 + 3} for k in range(60)]
    spans = spans_of(spark, rows)
    ids = [sorted(r.finding_id for r in detect.run(s, None, CFG)[0].collect()) for s in (spans, spans.orderBy(F.desc("seq")).repartition(3))]
    assert ids[0] == ids[1] and len(ids[0]) > 5


def test_cost_rollups_agree(spark):
    from runlens.sources import rates

    rows = [{"model": m, "use": n, "agent_id": a, "start": 0, "end": 1} for m, n, a in (("atlas-large-2", 1000, "a"), ("atlas-small-2-2025", 7, "a"), ("atlas", 3, "b"), ("nova", 5, "b"), ("<synthetic>", 1, "b"))]
    costs = cost.priced(spans_of(spark, rows), rates.table(spark))
    assert {r.seq: r.reason for r in costs.collect()} == {0: None, 1: None, 2: None, 3: "model_not_in_snapshot", 4: "synthetic_span"}
    total = costs.agg(F.sum("cost_usd")).first()[0]
    agents = spark.createDataFrame([("0" * 16, "a"), ("0" * 16, "z")], "trace_id string, agent_id string")
    by = cost.by_agent(costs, agents).collect()
    assert sum(r.cost_usd for r in by) == total == sum(r.cost_usd for r in cost.by_model(costs).collect()) and {r.agent_id for r in by} == {"a", "b", "z"}
    assert str(total) == "0.003015"  # 3000 + 5.6 (6) + 9 micro-dollars


def test_evidence_of_a_large_group_is_cut_in_each_task(spark):
    """The least 50 and the first five previews of a hot group, and no array of the whole group on the way."""
    rows = spark.range(0, 30_000, numPartitions=6).select(
        F.lit("t").alias("trace_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"), (30_000 - F.col("id")).cast("int").alias("seq"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("p"), "id")).alias("said"),
    )
    top = detect.least(rows, detect.EVIDENCE, "all_seqs", F.col("seq"))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial"), plan  # read from the bottom: cut, shuffled, cut again
    want: dict = {}
    for r in rows.collect():
        want.setdefault(r.key, []).append((r.seq, r.said))
    assert {r.key: r.all_seqs for r in top.collect()} == {k: [s for s, _ in sorted(v)][:50] for k, v in want.items()}
    said = detect.least(detect.spoken(rows, F.col("said")), detect.PREVIEWS, "texts", F.col("text"))
    assert {r.key: r.texts for r in said.collect()} == {k: [t for _, t in sorted(v) if t][:5] for k, v in want.items()}


def test_a_planted_break_is_counted_while_written(spark):
    from runlens.schema import finding_rules, span_rules, violations
    from runlens.workers import materialized

    spans = spans_of(spark, [dict(seq=k, kind="model_call", agent_id="a", start=k, end=k + 1) for k in range(3)])
    broken: list = []
    materialized(spans, "spans", span_rules(), broken)
    assert broken == [] and violations(spans).isEmpty()
    bad = spans.withColumn("agent_id", F.when(F.col("seq") == 1, "no good").otherwise(F.col("agent_id"))).withColumn("end", F.col("start") - F.expr("interval 1 second"))
    materialized(bad, "spans", span_rules(), broken)
    got = sorted((r.rule, r.n) for df in broken for r in df.collect())
    assert got == [("agent_id", 1), ("end_before_start", 3)] == sorted((r.rule, r.n) for r in violations(bad).collect())
    found = detect.run(spans, None, CFG)[0]
    assert set(finding_rules()) and violations(spans, None, found).isEmpty()
