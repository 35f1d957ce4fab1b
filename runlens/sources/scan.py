"""Scan of JSONL transcripts: many traces at once, one folder a trace.

A file is read in ranges of bytes, by as many tasks as it has ranges. Lines are numbered without moving them: their place in a range, and prefix sums over
the ranges' counts, one row a range. A line over its limit is neither decoded nor parsed nor kept (a reader's row holds it, at most the limit of a
file). Each line is parsed once, and the checked lines are written once. A file over its limit is never read. Errors are rows of `fatal` and exclude
their trace, never the batch.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.functions.text import plain_json
from runlens.sources.limits import NAME_MAX, SIDECAR_MAX, InputError, Limits
from runlens.workers import materialized, ship

PHASES = {"resolve": 0, "scan": 1, "parse": 2}


def check_paths(paths: list[str], limits: Limits = Limits()) -> list[str]:
    """Local paths of one trace before they are scanned: folders become their .jsonl files; sorted by name. Raises InputError."""
    found = []
    for path in paths:
        if "\0" in path:
            raise InputError("unreadable_path")
        found += sorted(os.path.join(path, x) for x in os.listdir(path) if x.endswith(".jsonl")) if os.path.isdir(path) else [path]
    if not found:
        raise InputError("empty_input")
    if len(found) > limits.files:
        raise InputError("too_many_files")
    named = {os.path.realpath(x) for x in found if not os.path.islink(x)}
    for path in found:
        if len(os.path.basename(path)) > NAME_MAX:
            raise InputError("name_too_long")
        if not os.path.exists(path) or not os.access(path, os.R_OK):
            raise InputError("unreadable_path", os.path.basename(path))
        if os.path.islink(path) and os.path.realpath(path) not in named:
            raise InputError("symlink_escape", os.path.basename(path))
        if not os.path.isfile(path):
            raise InputError("not_a_regular_file", os.path.basename(path))
    if len({os.path.basename(x) for x in found}) < len(found):
        raise InputError("duplicate_input")
    return sorted(found, key=os.path.basename)


#: The most that a row of `binaryFile` holds.
ROW_MAX = (1 << 31) - 1


def files(spark: SparkSession, path: str | list[str], most: int, pattern: str = "*.jsonl", one_trace: bool = False) -> DataFrame:
    """group, name, bytes, content: a group is the folder of a file (or everything). Files of over `most` bytes have no content and aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    most = min(most, ROW_MAX)
    large = found.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"))
    raw = found.where(F.col("length") <= most).select("path", "length", "content").unionByName(large)
    group = F.lit("all") if one_trace else F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return raw.select(group.alias("group"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"), "content")


def depth_over(text: Column, most: int) -> Column:
    """Whether brackets outside strings nest deeper than `most`. Lines with few brackets are settled without the fold."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    deepest = F.aggregate(
        F.split(bare, ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda a, c: F.struct(
            F.when(c.isin("[", "{"), a["now"] + 1).when(c.isin("]", "}"), F.greatest(a["now"] - 1, F.lit(0))).otherwise(a["now"]).alias("now"),
            F.greatest(a["top"], F.when(c.isin("[", "{"), a["now"] + 1).otherwise(a["top"])).alias("top"),
        ),
        lambda a: a["top"],
    )
    return F.when(F.length(F.regexp_replace(text, r"[^\[{]", "")) <= most, False).otherwise(deepest > most)


def trace_id_of(named: Column) -> Column:
    """The id of a trace from its files' names and digests, an array of (name, sha256) in the order of names."""
    return F.substring(F.sha2(F.array_join(F.transform(named, lambda x: F.concat(x["name"], F.lit(":"), x["sha256"])), "\n"), 256), 1, 16)


#: Ranges whose numbers are broadcast; more are joined.
BROADCAST_RANGES = 200_000


def listing(spark: SparkSession, path: str | list[str], most: int, one_trace: bool = False) -> DataFrame:
    """path, group, name, bytes, sha256 (empty over `most` bytes): one row a file; its digest is that of the bytes as they are."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(path)
    uri = F.col("_metadata.file_path").alias("uri")
    small = found.where(F.col("length") <= most).select(uri, "path", "length", F.sha2("content", 256).alias("sha256"))
    every = small.unionByName(found.where(F.col("length") > most).select(uri, "path", "length", F.lit("").alias("sha256")))
    group = F.lit("all") if one_trace else F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return every.select("uri", group.alias("group"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"), "sha256")


def raw_lines(spark: SparkSession, path: str | list[str], most: int) -> DataFrame:
    """uri, start (of the range), at (rises with the place in the range), raw: all lines of the files of at most `most` bytes."""
    reader = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").option("lineSep", "\n")
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("raw"))
    return rows.where(F.col("size") <= most).select("uri", "start", F.monotonically_increasing_id().alias("at"), "raw")


def numbered_lines(lines: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds trace_id, file_index, name, line (in the file, from 1) and record_index (in the trace, from 0, blank lines left out), and drops blank lines.

    lines: uri, start, at, blank and more; index: uri, trace_id, file_index, name. Also returns the ranges: one row each, with its counts.
    """
    ranges = lines.groupBy("uri", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.count_if("blank").alias("blanks"), F.count_if("odd_bytes").alias("odd_bytes"))
    ranges = ranges.join(index.select("uri", "trace_id", "file_index", "name"), "uri")
    before = lambda c, *keys: F.coalesce(F.sum(c).over(Window.partitionBy(*keys).orderBy("file_index", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = materialized(ranges.withColumns({"lines_before": before(F.col("n"), "trace_id", "file_index"), "records_before": before(F.col("n") - F.col("blanks"), "trace_id")}), "ranges")
    few = F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges
    place = F.col("at") - F.col("first")
    rows = lines.where("not blank").join(few.drop("odd_bytes"), ["uri", "start"])
    gaps = ranges.where("blanks > 0").select("uri", "start")
    if gaps.isEmpty():
        skipped = F.lit(0)
    else:  # only ranges with blank lines count them, by their places alone
        by = Window.partitionBy("uri", "start").orderBy("at")
        places = lines.select("uri", "start", "at", "blank").join(gaps, ["uri", "start"], "left_semi").withColumn("skipped", F.sum(F.col("blank").cast("long")).over(by))
        rows = rows.join(places.where("not blank and skipped > 0").select("at", "skipped"), "at", "left")
        skipped = F.coalesce("skipped", F.lit(0))
    rows = rows.withColumns({"line": (F.col("lines_before") + place + 1).cast("int"), "record_index": (F.col("records_before") + place - skipped).cast("int")})
    return rows.drop("at", "start", "first", "n", "blanks", "blank", "lines_before", "records_before", "skipped"), ranges


def scan(spark: SparkSession, path: str | list[str], limits: Limits = Limits(), one_trace: bool = False) -> dict[str, DataFrame]:
    """source_files, lines (trace_id, file_index, name, line, record_index, value, v, plain) and fatal (trace_id, phase, file_index, line, code).

    plain: the text of `value` says what `v` does, without repeated keys.
    """
    ship(spark)
    most = min(limits.file_bytes, ROW_MAX)
    named = materialized(listing(spark, path, most, one_trace), "files")
    index = named.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("name", "sha256", "uri", "bytes"))).alias("all"))
    index = index.select("group", trace_id_of(F.col("all")).alias("trace_id"), F.size("all").alias("n_files"), F.posexplode("all").alias("file_index", "x")).select("group", "trace_id", "n_files", "file_index", "x.*")
    raw = raw_lines(spark, path, most)
    odd_bytes, long = ~F.is_valid_utf8("raw"), F.octet_length("raw") > limits.line_bytes
    text = F.when(~odd_bytes, F.regexp_replace("raw", r"\r\z", ""))
    rows = raw.withColumns({"odd_bytes": odd_bytes & ~long, "long": long, "value": F.when(~long, text)})
    rows = rows.withColumns({"blank": ~F.col("long") & ~F.col("odd_bytes") & (F.trim("value") == ""), "deep": F.coalesce(depth_over(F.col("value"), limits.depth), F.lit(False))})
    rows = rows.drop("raw").withColumn("v", F.when(~F.col("blank") & ~F.col("deep"), F.try_parse_json("value")))
    lines, ranges = numbered_lines(materialized(rows, "lines"), index)
    whole = F.col("v").isNotNull() | F.col("long") | F.col("deep") | F.col("odd_bytes")
    checked = lines.where(whole).withColumn("plain", F.col("v").isNotNull()).unionByName(lines.where(~whole).withColumns({"v": F.try_parse_json(plain_json("value")), "plain": F.lit(False)}))
    kind = F.schema_of_variant("v")
    code = F.when(F.col("long"), "line_too_long").when(F.col("record_index") >= limits.records, "too_many_records").when(F.col("deep"), "json_too_deep").when(F.col("v").isNull(), "invalid_json").when(~kind.startswith("OBJECT"), "not_an_object")
    error = lambda df, phase, line, c: df.select("trace_id", F.lit(PHASES[phase]).alias("phase"), "file_index", line.alias("line"), c.alias("code")).where("code is not null")
    fatal = [
        error(checked.where("not odd_bytes"), "scan", F.col("line"), code),
        error(ranges.where("odd_bytes > 0").select("trace_id", "file_index").distinct(), "scan", F.lit(0), F.lit("invalid_encoding")),
        error(index.where(F.col("bytes") > most), "scan", F.lit(0), F.lit("file_too_large")),
        error(index, "resolve", F.lit(0), F.when(F.length("name") > NAME_MAX, "name_too_long").when(F.col("n_files") > limits.files, "too_many_files")),
    ]
    records = ranges.groupBy("trace_id", "name").agg(F.sum(F.col("n") - F.col("blanks")).alias("records"))
    sources = index.select("trace_id", "name", "sha256", "bytes").join(records, ["trace_id", "name"], "left").withColumn("records", F.coalesce("records", F.lit(0).cast("long")))
    return {"source_files": sources, "lines": checked.drop("long", "deep", "odd_bytes", "uri"), "fatal": reduce(DataFrame.unionByName, fatal), "index": index.select("group", "trace_id", "file_index", "name")}


def sidecars(spark: SparkSession, path: str | list[str], index: DataFrame, one_trace: bool = False) -> DataFrame:
    """trace_id, file_index, m (variant) of `<stem>.meta.json` beside a transcript. Whatever is wrong with one makes it absent."""
    raw = files(spark, path, SIDECAR_MAX, "*.meta.json", one_trace).where("content is not null")
    stem = raw.select("group", F.regexp_replace("name", r"\.meta\.json\z", ".jsonl").alias("name"), F.try_parse_json(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))).alias("m"))
    return stem.where(F.schema_of_variant("m").startswith("OBJECT")).join(index, ["group", "name"]).select("trace_id", "file_index", "m")
