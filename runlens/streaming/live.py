"""Live transcripts, as an extension: model calls collapsed from a stream of lines, and error density of each agent's last spans.

Lines of a stream have no place in a file, so fragments are ordered by their time stamps; where those ascend, the calls are those of `normalize`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runlens.functions.text import safe_agent_id
from runlens.functions.time import parse_timestamp
from runlens.operators.detect import STORM_WINDOW
from runlens.operators.normalize import object_at, string_at, usage_of
from runlens.workers import ship


def lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of folder, value: the lines of .jsonl files below `path`, as files arrive."""
    rows = spark.readStream.format("text").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    return rows.select(F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]*$", 1).alias("folder"), "value")


def model_calls(rows: DataFrame, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """One row a model call, from folder and value, as batch or stream. Fragments of a call are less than `gap` apart; a stream gives the call out
    once its watermark, `delay` behind the latest record, has passed, and its state holds no closed call. Lines that don't parse are left out."""
    v = F.col("v")
    some = rows.withColumn("v", F.try_parse_json("value")).where(string_at(v, "$.type") == "assistant").select(
        "folder", parse_timestamp(string_at(v, "$.timestamp")).alias("when"), string_at(v, "$.uuid").alias("uuid"), string_at(v, "$.sessionId").alias("session"), safe_agent_id(string_at(v, "$.agentId")).alias("agent_id"),
        string_at(v, "$.requestId").alias("request"), object_at(v, "$.message").alias("m"),
    ).where("when is not null")
    some = some.select("folder", "when", "uuid", "session", "agent_id", "request", string_at(F.col("m"), "$.id").alias("message_id"), string_at(F.col("m"), "$.model").alias("model"), usage_of(F.col("m")).alias("usage"))
    solo = F.when(F.col("request").isNull() & F.col("message_id").isNull(), F.col("uuid")).alias("solo")
    by = (F.session_window("when", gap).alias("open"), "folder", "session", "agent_id", "message_id", "request", solo)
    last = F.max_by(F.struct("model", "usage"), F.struct("when", "uuid")).alias("last")
    out = some.withWatermark("when", delay).groupBy(*by).agg(F.min("when").alias("start"), F.max("when").alias("end"), F.count("*").alias("fragments"), last)
    return out.select("folder", "session", "agent_id", "message_id", "request", "start", "end", "fragments", "last.model", "last.usage")


def error_density(spans: DataFrame, least: int = 3, window: int = STORM_WINDOW) -> DataFrame:
    """trace_id, agent_id, end_seq, errors: frames of `window` consecutive spans of an agent with at least `least` errors, from a stream of trace_id,
    agent_id, seq, err. An agent's state is its last window - 1 flags. An agent with fewer spans than a window gives nothing yet."""
    ship(spans.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flags = [c == "1" for c in state.get[0]] if state.exists else []
        new = pd.concat(list(parts)).sort_values("seq")
        flags += new["err"].fillna(False).astype(bool).tolist()
        total = pd.Series(flags, dtype="int64").rolling(window).sum().iloc[-len(new) :]
        state.update(("".join("01"[x] for x in flags[1 - window :]),))
        hit = (total >= least).to_numpy()
        yield pd.DataFrame({"trace_id": key[0], "agent_id": key[1], "end_seq": new["seq"].to_numpy()[hit], "errors": total.to_numpy()[hit].astype("int64")})

    rows = spans.select("trace_id", "agent_id", "seq", "err").groupBy("trace_id", "agent_id")
    return rows.applyInPandasWithState(run, "trace_id string, agent_id string, end_seq int, errors long", "flags string", "append", GroupStateTimeout.NoTimeout)
