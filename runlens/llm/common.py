"""Small helpers that the operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Workers give large blocks back as soon as they are freed: they outlive their tasks, and what they keep adds up beside the heap.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package when the session was started from another folder, and return memory that they freed."""
    env = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all executors see, below spark.checkpoint.dir.

    Only where that setting is absent in a local session, as in tests, a temporary folder is made and used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark, "_runlens_local_dir", None) or f"file://{tempfile.mkdtemp(prefix='runlens-')}"
        spark._runlens_local_dir = base
    return f"{base.rstrip('/')}/runlens-{label}-{uuid.uuid4().hex}"


#: Rows of a narrow table to a file, where their number is known.
FILE_ROWS = 20_000


def observed(df: DataFrame, label: str, rows: int | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
    """As `checkpointed`, with aggregates of the rows that are taken while they are written: no job besides the write."""
    seen = Observation()
    written = checkpointed(df.observe(seen, *(c.alias(name) for name, c in metrics.items())), label, rows)
    return written, seen.get


def checkpointed(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Cuts the lineage by a table written in the shared folder; it survives the loss of executors.

    rows: about how many there are. The number of files then grows with them, from one, instead of being that of the shuffle's partitions, which for small
    tables makes thousands of files of a few rows.
    """
    out = shared_dir(df.sparkSession, label)
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def write_file(uri: str, data: bytes) -> None:
    """Writes a file whole: first under another name, so that a lost or repeated task leaves no half file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def numbered(df: DataFrame) -> DataFrame:
    """The same columns under names that clash with nothing an operator adds."""
    return df.toDF(*(f"_own{k}" for k in range(len(df.columns))))


def fold(col: str, n: int) -> Column:
    """crc32 of an id as text, modulo n: the rule by which rows are held out of training."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    array = lambda x, kind: x if isinstance(x, pa.Array) else pa.array(x, type=kind)
    return pa.RecordBatch.from_arrays([array(columns[f.name], f.type) for f in schema], schema=schema)


def slices(batches, text: str, limit: int):
    """Cuts Arrow batches so that each holds at most `limit` bytes of text (or one row): bounds a task's memory."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        total, start = 0, 0
        for i, x in enumerate(size):
            if total + x > limit and i > start:
                yield b.slice(start, i - start)
                total, start = 0, i
            total += int(x)
        yield b.slice(start)
