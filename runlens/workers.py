"""What workers need: this package on their path, and tables that outlive executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])


def ship(spark: SparkSession) -> None:
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def materialized(df: DataFrame, label: str, rules: dict[str, Column] | None = None, broken: list[DataFrame] | None = None) -> DataFrame:
    """Writes a table in the shared folder and reads it again: the plan is cut there, and a lost executor costs no recomputation.

    The folder is that of spark.checkpoint.dir; only where that is unset in a local session a temporary folder is used.

    rules: conditions that no row may meet. They are counted while the rows are written; only if a count isn't 0 are the rows looked for, and a table of
    them (trace_id, rule, n) is put in `broken`.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark, "_runlens_work_dir", None) or f"file://{tempfile.mkdtemp(prefix='runlens-')}"
        spark._runlens_work_dir = base
    out = f"{base.rstrip('/')}/runlens-{label}-{uuid.uuid4().hex}"
    if not rules:
        df.write.parquet(out)
        return spark.read.schema(df.schema).parquet(out)
    seen = Observation()
    df.observe(seen, *(F.count_if(c).alias(rule) for rule, c in rules.items())).write.parquet(out)
    written = spark.read.schema(df.schema).parquet(out)
    for rule, n in seen.get.items():
        if n:
            broken.append(written.where(rules[rule]).groupBy("trace_id").agg(F.count("*").alias("n")).select("trace_id", F.lit(rule).alias("rule"), "n"))
    return written
