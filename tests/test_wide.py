"""Counts and costs of any size, against Python's decimal."""

import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import functions as F

from runlens.functions import wide
from runlens.operators import cost
from runlens.operators.normalize import usage_of
from runlens.schema import USAGE_FIELDS
from runlens.sources import rates

KINDS = "t string, " + ", ".join(f"a{k} decimal(38,0), r{k} {wide.RATE}" for k in range(3))


def exact(pairs):
    with localcontext() as c:
        c.prec = 120
        return sum((Decimal(n) * (r or 0) for n, r in pairs), Decimal(0)).quantize(Decimal(1), ROUND_HALF_UP)


def test_products_and_rounding(spark):
    rnd = random.Random(4)
    rows = [(str(k), *(x for _ in range(3) for x in (Decimal(rnd.randrange(10 ** rnd.randint(1, 38))), Decimal(rnd.randrange(10 ** rnd.randint(1, 17))).scaleb(-12)))) for k in range(300)]
    rows += [("half", 500_000, Decimal("0.000001"), 0, None, 0, Decimal(1)), ("none", 0, None, 0, None, 0, None), ("mark", wide.MOST, Decimal("0.000000000001"), 0, Decimal(1), 0, Decimal(1)), ("free", wide.MOST, None, 7, Decimal(2), 0, Decimal(1))]
    df = spark.createDataFrame([tuple(Decimal(x) if isinstance(x, int) else x for x in r) for r in rows], KINDS)
    got = {r.t: r.m for r in df.select("t", wide.micro_usd([(F.col(f"a{k}"), F.col(f"r{k}")) for k in range(3)]).alias("m")).collect()}
    beyond = 0
    for t, *x in rows:
        want = exact(list(zip(x[::2], x[1::2])))
        if t == "mark" or want >= 10**37:
            assert got[t] is None, t
            beyond += 1
        elif t == "free":
            assert got[t] == 14
        else:
            assert got[t] == want, t
    assert 5 < beyond < 250


def test_sums(spark):
    rnd = random.Random(5)
    groups = {k: [rnd.randrange(10 ** rnd.randint(1, 37)) for _ in range(rnd.randint(1, 40))] for k in range(30)}
    groups |= {100: [10**18 - 1] * 3, 101: [9 * 10**37, 9 * 10**37], 102: [wide.MOST, 1], 103: [None, None], 104: [10**38 - 2, 1], 105: [10**38 - 2]}
    df = spark.createDataFrame([(k, x if x is None else Decimal(x)) for k, v in groups.items() for x in v], "k int, x decimal(38,0)")
    got = {r.k: int(r.s) for r in df.groupBy("k").agg(wide.total(F.col("x")).alias("s")).collect()}
    for k, v in groups.items():
        assert got[k] == min(sum(x or 0 for x in v), wide.MOST), k


def test_a_trace_of_large_counts(spark):
    """From the JSON text to priced calls: exact to 38 digits, reported beyond, and never 0."""
    counts = ["7", "9" * 20, "9" * 21, "1" * 30, "1" * 38, "1" * 39, "1" * 60, "1e50", "-" + "1" * 45, "12345678901234567890123456789012345678.5"]
    rows = spark.createDataFrame([(k, f'{{"message":{{"usage":{{"input_tokens":{n}}}}}}}') for k, n in enumerate(counts)], "seq long, line string")
    use = usage_of(F.try_variant_get(F.try_parse_json("line"), "$.message", "variant"), F.col("line")).alias("usage")
    one = {"meta": {}, "aliases": {}, "models": {"m": {"input": rates.parse_rate("0.300000000001")}}}
    spans = rows.select(F.lit("t").alias("trace_id"), "seq", F.lit("a").alias("agent_id"), F.lit("model_call").alias("kind"), F.lit("m").alias("model"), use, F.lit(None).cast("struct<code:string,detail:string>").alias("error"))
    priced = cost.priced(spans, rates.table(spark, one))
    got = {r.seq: r for r in priced.collect()}
    for k, n in enumerate(counts[:5]):
        assert got[k].usage[USAGE_FIELDS[0]] == int(n) and got[k].reason is None
        assert str(got[k].cost_usd).replace(".", "").lstrip("0") == str(exact([(int(n), Decimal("0.300000000001"))])).lstrip("0")
    assert [got[k].reason for k in (5, 6)] == ["cost_precision_exceeded"] * 2 and all(got[k].usage[USAGE_FIELDS[0]] == wide.MOST for k in (5, 6))
    assert all(got[k].usage[USAGE_FIELDS[0]] == 0 and got[k].cost_usd == 0 for k in (7, 8, 9))
    total = cost.totals(priced).first()
    with localcontext() as c:
        c.prec = 60
        assert total.cost_precision_exceeded == 2 and total[USAGE_FIELDS[0]] == wide.MOST and total.cost_usd == sum(got[k].cost_usd for k in range(5))


def test_a_usage_object_is_read_once(spark):
    """Its plan names each value a few times; it grew to over 200 readings of the line, one below another."""
    rows = spark.createDataFrame([('{"message":{"usage":{"input_tokens":1}}}',)], "line string").select("line", F.try_parse_json("line").alias("v"))
    plan = rows.select(usage_of(F.col("v"), F.col("line")).alias("usage"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_variant_get(") < 40
