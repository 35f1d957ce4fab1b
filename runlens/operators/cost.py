"""Exact cost: counts of up to 38 digits times rates of up to 12 places, in USD per million tokens. Tokens times rate is in micro-dollars, so one rounding
gives six places. What is too large to be held exactly has no cost but the reason `cost_precision_exceeded`: a count of over 38 digits, a cost of 10**31 USD
or more."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import wide
from runlens.functions.once import once
from runlens.schema import USAGE_FIELDS
from runlens.sources.rates import PRICE_KEYS

SYNTHETIC = "<synthetic>"
PAIRS = tuple(zip(USAGE_FIELDS, PRICE_KEYS))
#: Counts below this are priced by one product and one rounding.
SMALL = 10**15
# Why a call has no price, in order of priority.
REASONS = ("synthetic_span", "usage_missing", "model_not_in_snapshot", "rate_key_missing", "cost_precision_exceeded")


def resolve(models: DataFrame, rates: DataFrame) -> DataFrame:
    """models: distinct `model`. The ladder: a rate of that name, else an alias, else the longest name that is a prefix up to a dash.

    Prefixes at dashes are spelled out for each model, so the ladder is an equi-join with the broadcast rates.
    """
    parts = F.split("model", "-")
    steps = models.where("model is not null").select("model", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))).alias("name"))
    hits = steps.join(F.broadcast(rates), "name")
    exact = F.col("name") == F.col("model")
    usable = hits.where(~F.col("is_alias") | exact)
    order = F.struct((exact & ~F.col("is_alias")).alias("a"), exact.alias("b"), F.length("name").alias("c"))
    return usable.groupBy("model").agg(F.max_by(F.struct("model_key", *PRICE_KEYS), order).alias("r")).select("model", "r.*")


def price(usage: Column) -> Column:
    """USD with six places, half up, from a usage struct and rate columns; null rates of zero counts don't matter. Null: too large."""
    small = reduce(lambda a, b: a & b, (usage[f] < SMALL for f in USAGE_FIELDS))
    terms = [(usage[f].cast("decimal(15,0)") * F.coalesce(F.col(k), F.lit(0).cast(wide.RATE))).cast("decimal(34,12)") for f, k in PAIRS]
    micro = F.round(reduce(lambda a, b: a + b, terms), 0).cast(wide.COUNT)
    return once(F.when(small, micro).otherwise(wide.micro_usd([(usage[f], F.col(k)) for f, k in PAIRS])), wide.usd)


def priced(spans: DataFrame, rates: DataFrame) -> DataFrame:
    """Model calls with cost or, where that is null, the reason and the missing price keys. Every call is in exactly one of the two."""
    calls = spans.where("kind = 'model_call'").select("trace_id", "seq", "agent_id", "model", "usage", "error")
    found = resolve(calls.select("model").distinct(), rates)
    # distinct models are few (each has a price or a name of its own): the join may broadcast them by their measured size
    rows = calls.join(found, "model", "left")
    lacks = F.array_sort(F.array_compact(F.array(*(F.when((F.col(f"usage.{f}") != 0) & F.col(k).isNull(), k) for f, k in PAIRS))))
    reason = F.when(F.col("error").isNotNull() | (F.col("model") == SYNTHETIC), REASONS[0]).when(F.col("usage").isNull(), REASONS[1]).when(F.col("model_key").isNull(), REASONS[2]).when(F.size(lacks) > 0, REASONS[3])
    rows = rows.withColumns({"missing_keys": lacks, "reason": reason})
    rows = rows.withColumn("cost_usd", F.when(F.col("reason").isNull(), price(F.col("usage"))))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("cost_usd").isNull(), REASONS[4])))
    return rows.select("trace_id", "seq", "agent_id", "model", F.when(F.col("reason").isNull(), F.col("model_key")).alias("model_key"), "usage", "cost_usd", "reason", F.when(F.col("reason") == REASONS[3], F.col("missing_keys")).alias("missing_keys"))


def _usage_sums(condition: Column | None = None) -> list[Column]:
    pick = (lambda c: c) if condition is None else (lambda c: F.when(condition, c))
    return [wide.total(pick(F.col(f"usage.{f}"))).alias(f) for f in USAGE_FIELDS]


def _cost(column: str = "cost_usd") -> Column:
    """A sum of costs; null if it is too large."""
    return F.when(F.count(column) == 0, F.lit(0).cast("decimal(38,6)")).otherwise(F.try_sum(column).cast("decimal(38,6)"))


def totals(costs: DataFrame) -> DataFrame:
    return costs.groupBy("trace_id").agg(_cost().alias("cost_usd"), F.count("cost_usd").alias("priced_calls"), F.count("reason").alias("unpriced_calls"), F.count_if(F.col("reason") == REASONS[4]).alias("cost_precision_exceeded"), *_usage_sums())


def by_agent(costs: DataFrame, agents: DataFrame) -> DataFrame:
    """Every agent of the trace, those without calls with zeros, and agents that only the calls name."""
    sums = costs.groupBy("trace_id", "agent_id").agg(_cost().alias("cost_usd"), F.count("cost_usd").alias("priced_calls"), F.count("reason").alias("unpriced_calls"))
    every = agents.select("trace_id", "agent_id").unionByName(sums.select("trace_id", "agent_id")).distinct()
    zero = {"cost_usd": F.when(F.col("priced_calls").isNull(), F.lit(0).cast("decimal(38,6)")).otherwise(F.col("cost_usd")), "priced_calls": F.coalesce("priced_calls", F.lit(0).cast("long")), "unpriced_calls": F.coalesce("unpriced_calls", F.lit(0).cast("long"))}
    return every.join(sums, ["trace_id", "agent_id"], "left").withColumns(zero)


def by_model(costs: DataFrame) -> DataFrame:
    return costs.where("reason is null").groupBy("trace_id", "model_key").agg(_cost().alias("cost_usd"), F.count("*").alias("calls"))


def _relevant(waste: DataFrame, costs: DataFrame) -> DataFrame:
    """Wasted spans that are model calls with usage, each once for a finding."""
    return waste.distinct().join(costs.where("usage is not null").select("trace_id", "seq", "usage", "cost_usd", "reason"), ["trace_id", "seq"])


def waste_by_finding(findings: DataFrame, waste: DataFrame, costs: DataFrame) -> DataFrame:
    """wasted_cost_usd of each finding: null if a part of it has no price, 0 if there is no waste."""
    sums = _relevant(waste, costs).groupBy("trace_id", "finding_id").agg(F.count("reason").alias("lost"), F.sum("cost_usd").alias("cost"))
    cost = F.when(F.col("lost").isNull(), F.lit(0)).when(F.col("lost") == 0, F.col("cost")).cast("decimal(38,6)")
    return findings.join(sums, ["trace_id", "finding_id"], "left").withColumn("wasted_cost_usd", cost).drop("lost", "cost")


def by_detector(findings: DataFrame, waste: DataFrame, costs: DataFrame) -> DataFrame:
    """Waste of each detector: a span counts once for a detector, though several of its findings may name it; detectors may overlap."""
    spans = _relevant(waste, costs).dropDuplicates(["trace_id", "detector", "seq"])
    sums = spans.groupBy("trace_id", "detector").agg(_cost().alias("cost_usd"), F.count("reason").alias("unpriced_calls"), *_usage_sums(F.col("reason").isNull()), wide.total(F.when(F.col("reason").isNotNull(), wide.added(*(F.col(f"usage.{f}") for f in USAGE_FIELDS)))).alias("unpriced_tokens"))
    lost = waste_by_finding(findings, waste, costs).groupBy("trace_id", "detector").agg(F.count("*").alias("findings"), F.count_if(F.col("wasted_cost_usd").isNull()).alias("findings_unpriced"))
    return lost.join(sums, ["trace_id", "detector"], "left")


def format_usd(value: Column) -> Column:
    return value.cast("decimal(38,6)").cast("string")


def display_usd(value: Column) -> Column:
    return F.round(value, 2).cast("decimal(38,2)").cast("string")
