import json
import os
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.streaming import live


def record(minute, second, call, tokens, agent="a", uuid=None):
    usage = {"input_tokens": tokens, "output_tokens": 1}
    message = {"id": call, "model": "m", "usage": usage} if call else {"model": "m", "usage": usage}
    return json.dumps({"type": "assistant", "uuid": uuid or f"{minute}-{second}-{call}-{agent}", "timestamp": f"2025-01-01T{minute // 60:02d}:{minute % 60:02d}:{second:02d}Z", "sessionId": "s", "agentId": agent, "requestId": call, "message": message})


def run(stream, tmp_path, name):
    stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
    return stream.sparkSession.table(name)


def test_collapse_of_a_stream_is_that_of_the_batch(spark, tmp_path):
    texts = []
    for k in range(3):
        rows = [record(20 * k + i, s, f"c{k}{i}", 10 * s + 1) for i in range(5) for s in range(1 + i % 3)] + [record(20 * k + 7, s, None, s) for s in (1, 2)]
        texts.append(rows + ["no json", json.dumps({"type": "user"}), ""])
    n = len(texts)
    texts += [[record(22 * 60, 0, "end", 1)], [record(22 * 60, 1, "end", 1)]]  # the first moves the watermark past all the others, which the next batch sees
    (tmp_path / "in" / "t").mkdir(parents=True)
    for k, rows in enumerate(texts):
        (tmp_path / "in" / "t" / f"f{k}.jsonl").write_text("\n".join(rows))
        os.utime(tmp_path / "in" / "t" / f"f{k}.jsonl", (1_700_000_000 + k,) * 2)  # files come by age
    got = run(live.model_calls(live.lines(spark, str(tmp_path / "in"), files_per_batch=1)), tmp_path, "calls").select("message_id", "start", "end", "fragments", "usage.input_tokens").collect()
    batch = spark.createDataFrame([("t", x) for rows in texts[:n] for x in rows], "folder string, value string")
    want = live.model_calls(batch).select("message_id", "start", "end", "fragments", "usage.input_tokens").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 3 * (5 + 2)
    assert {(r.message_id, r.fragments, int(r.input_tokens)) for r in got if r.message_id == "c12"} == {("c12", 3, 21)}


def test_error_density_over_batches_is_the_window_frame(spark, tmp_path):
    rnd = random.Random(4)
    rows = [("t", rnd.choice("xyz"), k, rnd.random() < 0.3 if rnd.random() < 0.95 else None) for k in range(300)]
    schema = "trace_id string, agent_id string, seq int, err boolean"
    for k in range(0, 300, 60):
        spark.createDataFrame(rows[k : k + 60], schema).coalesce(1).write.parquet(f"{tmp_path}/spans/{k}")
        for f in (tmp_path / "spans" / str(k)).glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/spans/*")
    got = {tuple(r) for r in run(live.error_density(stream), tmp_path, "density").collect()}
    frame = Window.partitionBy("trace_id", "agent_id").orderBy("seq")
    want = spark.createDataFrame(rows, schema).withColumns({"n": F.row_number().over(frame), "errors": F.sum(F.coalesce(F.col("err"), F.lit(False)).cast("int")).over(frame.rowsBetween(-9, 0))})
    assert got == {tuple(r) for r in want.where("n >= 10 and errors >= 3").select("trace_id", "agent_id", "seq", "errors").collect()} and got
