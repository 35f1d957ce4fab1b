"""Many tables published as one: a version is a folder of tables, and readers see it once its line in the log of versions is committed."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "number long, version string, tables array<string>"


def versions(spark: SparkSession, out: str) -> DataFrame:
    """number, version and tables of all published versions; without a row where nothing has been published."""
    try:
        return spark.read.schema(LOG).json(f"{out.rstrip('/')}/published")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def write_tables(tables: dict[str, DataFrame], out: str) -> str:
    """Writes all tables as Parquet in a folder of their own and then publishes them together; returns the version.

    The last step appends one line, which Spark commits by renaming one file. A run that fails before leaves its folder unread and the version before it in
    force; readers that have begun keep the files that they listed. Folders are never overwritten: when old ones go is the owner's decision.
    """
    base = out.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    latest = versions(spark, base).agg(F.max("number").alias("n")).first().n
    # later than all before it, whatever the clocks of the writers say
    number = max(time.time_ns() // 1000, (latest or 0) + 1)
    version = f"{number}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.parquet(f"{base}/versions/{version}/{name}")
    spark.createDataFrame([(number, version, sorted(tables))], LOG).coalesce(1).write.mode("append").json(f"{base}/published")
    return version


def read_tables(spark: SparkSession, out: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of the version published last, or of a named one. Raises LookupError where it isn't published."""
    base = out.rstrip("/")
    known = versions(spark, base).where(F.lit(True) if version is None else F.col("version") == version)
    found = known.orderBy(F.desc("number"), F.desc("version")).first()
    if found is None:
        raise LookupError(f"nothing published at {out}" if version is None else f"{version} isn't published at {out}")
    return {name: spark.read.parquet(f"{base}/versions/{found.version}/{name}") for name in found.tables}
