"""Rates: a JSON snapshot of prices in USD per million tokens, checked on the driver and broadcast (its size is checked too)."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from importlib import resources

from pyspark.sql import DataFrame, SparkSession

from runlens.functions.wide import RATE as RATE_TYPE

PRICE_KEYS = ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h")
RATE = re.compile(r"(0|[1-9]\d*)(\.\d{1,12})?")
#: More than this is no price list; the table is broadcast.
MOST_MODELS = 100_000
SCHEMA = "model_key string, is_alias boolean, name string, " + ", ".join(f"{k} {RATE_TYPE}" for k in PRICE_KEYS)


class RateError(ValueError):
    pass


def parse_rate(text: object) -> Decimal:
    if not isinstance(text, str) or not RATE.fullmatch(text):
        raise RateError(f"bad rate: {text!r}")
    value = Decimal(text)
    if value >= 100_000:
        raise RateError(f"a rate has at most 5 digits before the point: {text}")
    return value


def parse_snapshot(text: str) -> dict:
    """The snapshot; alias targets must exist, and each model must be claimed by exactly one source."""
    try:
        doc = json.loads(text)
        models = {m: {k: parse_rate(v) for k, v in prices.items()} for m, prices in doc["models"].items()}
        aliases, claimed = doc.get("aliases", {}), [m for s in doc["meta"]["sources"] for m in s["models"]]
    except (KeyError, TypeError, AttributeError, json.JSONDecodeError) as e:
        raise RateError(f"bad snapshot: {e}") from e
    if len(models) + len(aliases) > MOST_MODELS:
        raise RateError(f"over {MOST_MODELS} models")
    if bad := {k for p in models.values() for k in p} - set(PRICE_KEYS):
        raise RateError(f"unknown price keys: {sorted(bad)}")
    if bad := set(aliases.values()) - set(models):
        raise RateError(f"aliases of unknown models: {sorted(bad)}")
    if sorted(claimed) != sorted(models):
        raise RateError("each model must be claimed by exactly one source")
    return {"meta": doc["meta"], "models": models, "aliases": aliases}


def bundled() -> dict:
    return parse_snapshot((resources.files("runlens") / "data" / "rates.json").read_text())


def load(spark: SparkSession, path: str) -> dict:
    """A snapshot from any place that Spark reads."""
    return parse_snapshot("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def table(spark: SparkSession, snapshot: dict | None = None) -> DataFrame:
    """One row for each model and alias: name (as looked up), model_key and its five rates (null where there is none)."""
    s = snapshot or bundled()
    rows = [(m, False, m, *(p.get(k) for k in PRICE_KEYS)) for m, p in s["models"].items()]
    rows += [(m, True, a, *(s["models"][m].get(k) for k in PRICE_KEYS)) for a, m in s["aliases"].items()]
    return spark.createDataFrame(rows, SCHEMA)
