"""From scanned lines to spans, agents and warnings. Everything is partitioned by trace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.text import digest_id, preview, preview_within, safe_agent_id, short_sha, slug, tool_inputs
from runlens.functions import wide
from runlens.functions.once import once
from runlens.functions.time import parse_timestamp
from runlens.functions.wide import COUNT, most
from runlens.operators.ranges import numbered
from runlens.schema import NO_VIOLATIONS, USAGE, USAGE_FIELDS, agent_rules, span_rules
from runlens.sources.scan import PHASES
from runlens.workers import materialized

RECORD_TYPES = ("assistant", "user", "system", "attachment")
BLOCK_TYPES = ("text", "thinking", "tool_use", "tool_result")
SYNTHETIC = "<synthetic>"
# Keys that are known and not modelled, and those that are.
IGNORED_KEYS = ("iterations", "output_tokens_details", "server_tool_use", "diagnostics", "stop_details", "container", "context_management", "quotaLimits", "rendered", "apiBlockIndex", "logicalParentUuid", "compactMetadata")
RECORD_KEYS = ("type", "uuid", "timestamp", "parentUuid", "agentId", "sessionId", "requestId", "subtype", "isSidechain", "isMeta", "isApiErrorMessage", "apiErrorStatus", "error", "message", "content")
MESSAGE_KEYS = ("id", "model", "role", "type", "stop_reason", "stop_sequence", "content", "usage")
BLOCK_KEYS = ("type", "id", "tool_use_id", "name", "is_error", "text", "thinking", "content")
USAGE_KEYS = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cache_creation")
KEY_LEVELS = (("keys", RECORD_KEYS), ("message_keys", MESSAGE_KEYS), ("usage_keys", USAGE_KEYS))


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def text_of(x: Column) -> Column:
    """A variant's string, or null if it isn't one (a number isn't made a string)."""
    return F.when(kind_of(x) == "STRING", F.try_variant_get(x, "$", "string"))


def string_at(v: Column, path: str) -> Column:
    """A string, or null if what is there isn't one."""
    return once(F.try_variant_get(v, path, "variant"), text_of)


def count_of(x: Column, line: Column | None = None, line_path: str | None = None) -> Column:
    """A whole number of 0 or more; 0 for anything else, fractions written as 1.0 and booleans included.

    A variant holds 38 digits. Where `line` is the JSON text with the number at line_path, one of more digits is `MOST`; it is looked up only then.
    """
    kind = kind_of(x)
    whole = (kind == "BIGINT") | kind.rlike(r"\ADECIMAL\((19|2\d|3\d),0\)\z")
    count = F.when(whole, F.greatest(F.coalesce(F.try_variant_get(x, "$", COUNT), F.lit(0).cast(COUNT)), F.lit(0).cast(COUNT)))
    if line is not None:
        count = count.when((kind == "DOUBLE") & (F.try_variant_get(x, "$", "double") > 9e37) & F.get_json_object(line, line_path).rlike(r"\A\d{39,}\z"), most())
    return count.otherwise(F.lit(0).cast(COUNT))


def count_at(v: Column, path: str) -> Column:
    return once(F.try_variant_get(v, path, "variant"), count_of)


def true_of(x: Column) -> Column:
    """Only the JSON value true is true."""
    return F.coalesce((kind_of(x) == "BOOLEAN") & F.try_variant_get(x, "$", "boolean"), F.lit(False))


def true_at(v: Column, path: str) -> Column:
    return once(F.try_variant_get(v, path, "variant"), true_of)


def object_at(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, path, "variant")
    return F.when(kind_of(x).startswith("OBJECT"), x)


def fields_at(v: Column, path: str, names: tuple[str, ...]) -> Column:
    """The named values of an object as a struct of variants, in one pass over it; null if there is no object."""
    return F.try_variant_get(v, path, f"struct<{','.join(f'{n}:variant' for n in names)}>")


def items_at(v: Column, path: str) -> Column:
    """An object as a map of variants; null if there is none."""
    return F.try_variant_get(v, path, "map<string,variant>")


def joined_text(content: Column) -> Column:
    """A string as it is, or the `text` strings of a list's text blocks, with blanks between."""
    parts = F.transform(F.try_variant_get(content, "$", "array<struct<type:variant,text:variant>>"), lambda b: F.when(text_of(b["type"]) == "text", text_of(b["text"])))
    return F.when(kind_of(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(F.coalesce(F.array_join(parts, " "), F.lit("")))


def usage_in(items: Column, line: Column | None = None) -> Column:
    """Five counters that don't overlap, from the items of a usage object; null without one. line: the record's JSON text."""
    zero = F.lit(0).cast(COUNT)

    def counters(u: Column, split: Column) -> Column:
        at = lambda name: count_of(u[name], line, f"$.message.usage.{name}")
        part = lambda name, without: F.when(split.isNotNull(), count_of(split[name], line, f"$.message.usage.cache_creation.{name}")).otherwise(without)
        parts = (at("input_tokens"), at("output_tokens"), at("cache_read_input_tokens"), part("ephemeral_5m_input_tokens", at("cache_creation_input_tokens")), part("ephemeral_1h_input_tokens", zero))
        return F.when(u.isNotNull(), F.struct(*(c.alias(f) for c, f in zip(parts, USAGE_FIELDS))))

    split_of = lambda u: fields_at(u["cache_creation"], "$", ("ephemeral_5m_input_tokens", "ephemeral_1h_input_tokens"))
    return once(items, lambda u: once(split_of(u), lambda split: counters(u, split))).cast(USAGE)


def usage_of(message: Column, line: Column | None = None) -> Column:
    return usage_in(items_at(message, "$.usage"), line)


def block_of(b: Column) -> Column:
    """A content block, given as variants, with its types."""
    return F.struct(
        text_of(b["type"]).alias("block_type"), text_of(b["id"]).alias("id"), text_of(b["tool_use_id"]).alias("tool_use_id"), text_of(b["name"]).alias("name"), true_of(b["is_error"]).alias("is_error"),
        F.coalesce(text_of(b["text"]), text_of(b["thinking"])).alias("text"), joined_text(b["content"]).alias("result_text"),
    )


#: What makes a line odd, so that its values are looked at as variants: a key that holds a string (or an object, a flag, a count) elsewhere holds something
#: else, or a content starts like JSON. It may match too much (the keys of a tool's input), never too little. Keys stand behind `{` or `,`.
ODD = r'[{,]\s*+"(?:' + "|".join((
    r't(?:ype|imestamp|ext|hinking|ool_use_id)"\s*+:\s*+[^"n]', r's(?:essionId|ubtype|top_reason)"\s*+:\s*+[^"n]', r'(?:uuid|id|error|model|name|requestId|agentId|apiErrorStatus)"\s*+:\s*+[^"n]',
    r'content"\s*+:\s*+(?:[^"\[n]|"[\[{])', r'(?:message|usage|cache_creation)"\s*+:\s*+[^{n]', r'is(?:_error|ApiErrorMessage)"\s*+:\s*+[^tfn]',
    r'(?:input|output|cache_read_input|cache_creation_input|ephemeral_5m_input|ephemeral_1h_input)_tokens"\s*+:\s*+(?!\d{1,18}\s*+[,}])',
)) + ")"
#: An escape that may stand for a character of a key, or half of a surrogate pair.
ESCAPED = r"\\u(?:00[2-7]|[dD][89a-fA-F])"
PLAIN_RECORD = "type string, uuid string, timestamp string, agentId string, sessionId string, requestId string, subtype string, isApiErrorMessage boolean, apiErrorStatus string, error string, content string, message map<string,string>"
PLAIN_USAGE = "input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long, cache_creation struct<ephemeral_5m_input_tokens:long,ephemeral_1h_input_tokens:long>"
PLAIN_BLOCKS = "array<struct<type:string,id:string,tool_use_id:string,name:string,is_error:boolean,text:string,thinking:string,content:string,input:string>>"


#: An input whose text is canonical JSON if its keys ascend: a flat object of plain strings, whole numbers of up to 18 digits, true, false and null.
FLAT_ITEM = r'"[ !#-\[\]-~]*+":(?:"(?:[ !#-\[\]-~]|\\["\\nrt])*+"|0|-?[1-9]\d{0,17}|true|false|null)'
FLAT_INPUT = rf"\A\{{(?:{FLAT_ITEM}(?:,{FLAT_ITEM})*+)?\}}\z"
#: What a number beyond the doubles is written as when a value is copied.
INFINITE = ('"Infinity"', '"-Infinity"')


def canonical_input(text: Column) -> Column:
    """An input, as a reader copied it, if that is canonical JSON (see `text.canonical`) for certain, else null."""
    finite = reduce(lambda a, b: a & b, (~text.contains(x) for x in INFINITE))

    def ascending(keys: Column) -> Column:
        return (F.size(keys) < 2) | (keys == F.array_sort(F.array_distinct(keys)))

    return F.when(text.rlike(FLAT_INPUT) & finite & (~text.contains(",") | once(F.json_object_keys(text), ascending)), text)


def typed(v: Column, line: Column) -> Column:
    """The typed values of a record from its variant; every value is looked at once. `object` is false where it is no object."""

    def values(o: Column, m: Column) -> Column:
        content = F.when(m.isNull(), o["content"]).otherwise(m["content"])
        kind = text_of(o["type"])
        parts = F.transform(F.try_variant_get(content, "$", f"array<struct<{','.join(f'{k}:variant' for k in BLOCK_KEYS)}>>"), block_of)
        use = items_at(m["usage"], "$")
        return F.struct(
            o.isNotNull().alias("object"), kind.alias("type"), text_of(o["uuid"]).alias("uuid"), text_of(o["timestamp"]).alias("stamp"), F.when(m.isNull(), kind_of(F.try_variant_get(v, "$.message", "variant"))).alias("message_kind"),
            text_of(o["agentId"]).alias("agent"), text_of(o["sessionId"]).alias("session"), text_of(o["requestId"]).alias("request"), text_of(o["subtype"]).alias("subtype"), true_of(o["isApiErrorMessage"]).alias("api_error"),
            text_of(o["apiErrorStatus"]).alias("api_status"), text_of(o["error"]).alias("api_code"), text_of(m["id"]).alias("message_id"), text_of(m["model"]).alias("model"), text_of(m["stop_reason"]).alias("stop_reason"),
            F.map_keys(m).alias("message_keys"), F.map_keys(use).alias("usage_keys"), F.when(kind == "assistant", usage_in(use, line)).alias("usage"), parts.alias("parts"),
            F.coalesce(kind_of(content) == "STRING", F.lit(False)).alias("is_text"), F.when(kind.isin("system", "user"), joined_text(content)).alias("said"),
        )

    o = fields_at(v, "$", ("type", "uuid", "timestamp", "agentId", "sessionId", "requestId", "subtype", "isApiErrorMessage", "apiErrorStatus", "error", "content"))
    return once(o, lambda o: once(items_at(v, "$.message"), lambda m: values(o, m)))


def plainly_typed() -> list[Column]:
    """The same of a record that isn't odd, each value by itself, from what `values_of` read of its text: p, content, blocks and use."""
    p, m, content, parts, use = (F.col(c) for c in ("p", "p.message", "content", "blocks", "use"))
    is_list = content.startswith("[")
    split = use["cache_creation"]
    part = lambda name, without: F.when(split.isNotNull(), split[name]).otherwise(without)
    counts = (use["input_tokens"], use["output_tokens"], use["cache_read_input_tokens"], part("ephemeral_5m_input_tokens", use["cache_creation_input_tokens"]), part("ephemeral_1h_input_tokens", F.lit(0).cast("long")))
    usage = F.when(use.isNotNull(), F.struct(*(F.coalesce(c, F.lit(0)).cast(COUNT).alias(f) for c, f in zip(counts, USAGE_FIELDS)))).cast(USAGE)
    flag = lambda c: F.coalesce(c, F.lit(False))
    block = lambda b: F.struct(b["type"].alias("block_type"), b["id"].alias("id"), b["tool_use_id"].alias("tool_use_id"), b["name"].alias("name"), flag(b["is_error"]).alias("is_error"), F.coalesce(b["text"], b["thinking"]).alias("text"), F.coalesce(b["content"], F.lit("")).alias("result_text"))
    said = F.when(is_list, F.array_join(F.transform(parts, lambda b: F.when(b["type"] == "text", b["text"])), " ")).otherwise(F.coalesce(content, F.lit("")))
    return [
        F.lit(True).alias("object"), p["type"].alias("type"), p["uuid"].alias("uuid"), p["timestamp"].alias("stamp"), F.lit(None).cast("string").alias("message_kind"),
        p["agentId"].alias("agent"), p["sessionId"].alias("session"), p["requestId"].alias("request"), p["subtype"].alias("subtype"), flag(p["isApiErrorMessage"]).alias("api_error"),
        p["apiErrorStatus"].alias("api_status"), p["error"].alias("api_code"), m["id"].alias("message_id"), m["model"].alias("model"), m["stop_reason"].alias("stop_reason"),
        F.map_keys(m).alias("message_keys"), F.json_object_keys(m["usage"]).alias("usage_keys"), F.when(p["type"] == "assistant", usage).alias("usage"), F.transform(parts, block).alias("parts"),
        F.coalesce(~is_list, F.lit(False)).alias("is_text"), F.when(p["type"].isin("system", "user"), said).alias("said"),
    ]


def odd_keys(name: str, known: tuple[str, ...]) -> Column:
    """The keys of a level that aren't modelled there: those that are ignored and those that nobody knows."""
    return F.coalesce(F.filter(name, lambda k: ~k.isin(*(x for x in known if x not in IGNORED_KEYS))), F.array().cast("array<string>"))


def values_of(lines: DataFrame) -> DataFrame:
    """Lines with their typed values as one struct `t`."""
    rows = valued(lines)
    kept = [c for c in lines.columns if c not in ("v", "plain")]
    return rows.select(*kept, F.struct(*(c for c in rows.columns if c not in (*kept, "inputs"))).alias("t"))


def valued(lines: DataFrame) -> DataFrame:
    """Lines with their typed values: plain records are read from their text by schema, odd ones through their variant.

    inputs: for each block of a plain record its input, if it is a tool use whose input is canonical as it stands; else null.

    Without a column `v`, only odd lines are parsed as variants. Each value is a column of its own, so that those that nobody uses aren't taken.
    """
    v = F.col("v") if "v" in lines.columns else F.try_parse_json("value")
    value = F.col("value")
    even = F.col("plain") & value.startswith("{") & ~(value.contains("\\u") & value.rlike(ESCAPED)) & ~value.rlike(ODD)
    rows = lines.withColumn("p", F.from_json(F.when(even, value), PLAIN_RECORD))
    rows = rows.withColumn("content", F.when(F.col("p.message").isNull(), F.col("p.content")).otherwise(F.col("p.message")["content"]))
    rows = rows.withColumns({"blocks": F.from_json(F.when(F.col("content").startswith("["), F.col("content")), PLAIN_BLOCKS), "use": F.from_json(F.col("p.message")["usage"], PLAIN_USAGE)})
    # items that aren't objects with a type, and results in parts, are odd
    whole = F.coalesce((F.size("blocks") == F.json_array_length("content")) & F.forall("blocks", lambda b: b["type"].isNotNull() & ~F.coalesce(b["content"].startswith("["), F.lit(False))), F.lit(False))
    odd = F.coalesce(F.col("p.type").isNull() | F.col("p.uuid").isNull() | F.col("p.timestamp").isNull() | F.col("content").startswith("[") & ~whole, F.lit(False))
    rows = rows.withColumns({"odd": odd, "t": F.when(odd, once(v, lambda x: typed(x, value)))})
    plain = dict(zip(rows.schema["t"].dataType.names, plainly_typed()))
    certain = F.when(~F.col("odd"), F.transform("blocks", lambda b: F.when(b["type"] == "tool_use", canonical_input(b["input"]))))
    values = {name: F.when(F.col("odd"), F.col(f"t.{name}")).otherwise(c) for name, c in plain.items()}
    return rows.withColumns(values | {"inputs": F.coalesce(certain, F.array().cast("array<string>"))}).drop("v", "p", "content", "blocks", "use", "plain", "odd", "t")


#: Columns of records that every query of spans needs: places, keys of calls and blocks.
PLACES = ("trace_id", "file_index", "line", "record_index", "value", "type", "agent_id", "when", "session", "request", "message_id", "parts", "inputs", "spoken")


def records(scanned: dict[str, DataFrame], only: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed records of the traces without a fatal error, and all fatal errors.

    Every value is taken from a line once: one pass writes the typed records of all lines, their content blocks included, with the error of each, and all
    else reads that table. No variant is written. `value`, the JSON text, is kept where the input of a tool use isn't known to be canonical.

    only: columns that are taken from the lines and written, for a caller that uses no others; the others are null. All lines are checked in any case.
    """
    rows = valued(scanned["lines"]).withColumn("keys", F.json_object_keys("value"))
    rows = rows.withColumns({
        "agent_id": safe_agent_id(F.col("agent")), "when": parse_timestamp(F.col("stamp")), "n_extra": F.coalesce(F.size(F.array_distinct(F.filter("keys", lambda k: ~k.isin(*RECORD_KEYS, *IGNORED_KEYS)))), F.lit(0)), "odd_keys": F.concat(*(odd_keys(*level) for level in KEY_LEVELS)),
        "spoken": F.col("is_text") | F.coalesce(F.exists("parts", lambda b: F.coalesce(b["block_type"] != "tool_result", F.lit(False))), F.lit(False)),
    })
    missing = (F.coalesce("type", F.lit("")) == "") | (F.coalesce("uuid", F.lit("")) == "") | (F.coalesce("stamp", F.lit("")) == "")
    bad_message = F.coalesce(F.col("message_kind") != "VOID", F.lit(False))
    code = F.when(missing, "missing_field").when(F.col("when").isNull(), "bad_timestamp").when(F.col("type").isin("assistant", "user") & bad_message, "bad_message")
    rows = rows.withColumns({
        "code": F.when(F.col("object"), code), "said": F.when((F.col("type") == "system") | (F.col("type") == "user") & F.col("spoken"), F.col("said")),
        "value": F.when(F.size(F.filter("parts", lambda b: b["block_type"] == "tool_use")) > F.size(F.filter("inputs", lambda x: x.isNotNull())), F.col("value")),
    })
    rows = rows.drop("agent", "stamp", "message_kind", "is_text", "keys", "message_keys", "usage_keys")
    whole = rows.schema
    if only is not None:
        rows = rows.select("object", "code", "uuid", *only)
    rows = materialized(rows, "records").where("object").drop("object")
    rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in whole if f.name not in rows.columns and f.name != "object"})
    parse = rows.select("trace_id", F.lit(PHASES["parse"]).alias("phase"), "file_index", "line", "code").where("code is not null")
    # rows that share a hash are few; only they are sorted
    hashed = rows.withColumn("hash", F.xxhash64("trace_id", "file_index", "uuid"))
    shared = hashed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    nth = F.row_number().over(Window.partitionBy("trace_id", "file_index", "uuid").orderBy("line"))
    again = hashed.join(shared, "hash", "left_semi").withColumn("nth", nth).where("nth > 1").select("trace_id", F.lit(PHASES["parse"]).alias("phase"), "file_index", "line", F.lit("duplicate_uuid").alias("code"))
    fatal = scanned["fatal"].unionByName(parse).unionByName(again)
    # the error that a reader of one file after another would meet first
    fatal = fatal.groupBy("trace_id").agg(F.min(F.struct("phase", "file_index", "line", "code")).alias("e")).select("trace_id", "e.*")
    fatal = materialized(fatal, "fatal")
    return rows.drop("code").join(fatal.select("trace_id"), "trace_id", "left_anti"), fatal


def blocks(rows: DataFrame) -> DataFrame:
    """Content blocks: one row each, with the digest input of tool calls. Only records with an input that isn't known to be canonical go through Python."""
    calls = rows.where("value is not null").withColumn("read", tool_inputs("value"))
    some = calls.unionByName(rows.where("value is null").withColumn("read", F.lit(None).cast("array<string>")))
    key = F.when(F.col("type") == "assistant", key_of()).alias("key")
    out = some.select("trace_id", "file_index", "record_index", "agent_id", "when", F.col("type").alias("record_type"), key, "inputs", "read", F.posexplode("parts").alias("pos", "b"))
    input_ = F.coalesce(F.get("inputs", F.col("pos")), F.get("read", F.col("pos")))
    return out.select("trace_id", "file_index", "record_index", "agent_id", "when", "record_type", "key", "pos", "b.*", input_.alias("input"))


def key_of() -> Column:
    """The key of the call that an assistant record is a fragment of. Null ids are ids of their own; without both, a record stands alone."""
    solo = F.col("message_id").isNull() & F.col("request").isNull()
    return F.when(solo, F.concat(F.lit("solo:"), F.col("record_index"))).otherwise(F.to_json(F.struct("session", "agent_id", "message_id", "request"), {"ignoreNullFields": "false"}))


def grouped(rows: DataFrame) -> DataFrame:
    """Assistant records with the key of their call."""
    return rows.where("type = 'assistant'").withColumn("key", key_of())


def collapsed(rows: DataFrame) -> DataFrame:
    """One row a model call: what it was at the first fragment, and what the last fragment says of it, wholesale."""
    last = F.max_by(F.struct("when", "model", "usage", "stop_reason", "api_error", "api_code", "api_status"), "record_index")
    out = rows.groupBy("trace_id", "key", "agent_id").agg(  # the key has the agent in it, or is one record's
        F.min("record_index").alias("anchor"), F.min_by("when", "record_index").alias("start"), F.min_by("file_index", "record_index").alias("file_index"),
        last.alias("last"), F.sum("n_extra").cast("int").alias("extras_dropped"), F.count("*").alias("fragments"),
    )
    api = F.col("last.api_error")
    return out.select(
        "trace_id", "key", "anchor", "agent_id", "file_index", "start", F.greatest("start", "last.when").alias("end"), (F.col("last.when") < F.col("start")).alias("negative"), "last.model",
        F.when(~api, F.col("last.usage")).alias("usage"), "last.stop_reason", api.alias("api_error"), "extras_dropped", "fragments",
        F.when(api, F.struct(slug(F.coalesce("last.api_code", F.lit("unknown"))).alias("code"), preview_within(F.col("last.api_status"), 200).alias("detail"))).alias("error"),
    )


def collapse_stats(rows: DataFrame) -> DataFrame:
    """Records and calls of each trace, and token sums counted naively and after the collapse. API errors count in neither sum."""
    parts = grouped(rows)
    total = lambda name: [wide.total(F.col(f"usage.{f}")).alias(f"{name}_{f}") for f in USAGE_FIELDS]
    naive = parts.where("not api_error").groupBy("trace_id").agg(*total("naive"))
    records_ = parts.groupBy("trace_id").agg(F.count("*").alias("records"))
    calls = collapsed(parts)
    sums = calls.groupBy("trace_id").agg(F.count("*").alias("model_calls"), F.count_if("api_error").alias("api_errors"), *total("collapsed"))
    return records_.join(naive, "trace_id", "left").join(sums, "trace_id", "left")


def distinct_blocks(all_blocks: DataFrame, kinds: tuple[str, ...] = BLOCK_TYPES) -> DataFrame:
    """Blocks of these types of each call without repeats, in order of first appearance. Only blocks of one type can be equal."""
    own = all_blocks.where(F.col("key").isNotNull() & F.col("block_type").isin(*kinds))
    identity = F.when(F.col("block_type") == "tool_use", F.concat(F.lit("u:"), F.coalesce("id", F.concat(F.lit("#"), "record_index", F.lit("."), "pos")))).when(
        F.col("block_type") == "tool_result", F.concat(F.lit("r:"), F.coalesce("tool_use_id", F.concat(F.lit("#"), "record_index", F.lit("."), "pos")))
    ).when(F.col("text").isNotNull(), F.concat(F.lit("t:"), "block_type", F.lit(":"), F.sha2("text", 256))).otherwise(F.concat(F.lit("p:"), "record_index", F.lit("."), "pos"))
    first = F.row_number().over(Window.partitionBy("trace_id", "key", "identity").orderBy("record_index", "pos"))
    return own.withColumn("identity", identity).withColumn("nth", first).where("nth = 1").drop("nth", "identity")


def tool_results(all_blocks: DataFrame) -> DataFrame:
    """The first result for each tool use id of a trace, whatever record or file it is in."""
    first = F.row_number().over(Window.partitionBy("trace_id", "tool_use_id").orderBy("record_index", "pos"))
    some = all_blocks.where((F.col("block_type") == "tool_result") & (F.coalesce("tool_use_id", F.lit("")) != "")).withColumn("nth", first).where("nth = 1")
    return some.select("trace_id", "tool_use_id", F.col("when").alias("result_when"), "is_error", "result_text")


def normalized(scanned: dict[str, DataFrame], side: DataFrame | None = None, previews: bool = True) -> dict[str, DataFrame]:
    """spans, agents, warnings, fatal, source_files and stats of all traces. previews=False leaves free text out."""
    rows, fatal = records(scanned)
    broken: list[DataFrame] = []
    spans, every, calls = spanned(rows, previews, broken)
    agents = materialized(agents_of(spans, side), "agents", agent_rules(), broken)
    sources = scanned["source_files"].join(fatal.select("trace_id"), "trace_id", "left_anti")
    return {"spans": public(spans), "agents": agents, "warnings": warnings_of(rows, every, calls, spans), "fatal": fatal, "source_files": sources, "stats": collapse_stats(rows), "violations": all_of(broken, spans)}


def public(spans: DataFrame) -> DataFrame:
    return spans.select(
        "trace_id", "seq", "span_id", "parent_span_id", "parent_seq", "agent_id", "kind", "start", "end", "model", "usage", "stop_reason", "tool_name", "tool_use_id", "tool_input_digest",
        "tool_result_status", "text_preview", "tool_input_preview", "tool_result_preview", "error", "extras_dropped",
    )


def warning_log(scanned: dict[str, DataFrame]) -> DataFrame:
    """The log alone: no agents are written for it."""
    rows, _ = records(scanned)
    spans, every, calls = spanned(rows)
    return warnings_of(rows, every, calls, spans)


def outlined(rows: DataFrame) -> DataFrame:
    """Spans without free text, models, usage and times, from records of which only PLACES need be taken."""
    every = blocks(rows).where(F.col("block_type").isin("tool_use", "tool_result")).drop("text", "result_text")
    none = F.lit(None).cast("string")
    every = materialized(every, "blocks").withColumns({"text": none, "result_text": none})
    calls = materialized(collapsed(grouped(rows)).select("trace_id", "key", "anchor", "agent_id"), "calls")
    own = ["trace_id", "anchor", F.lit(0).alias("sub"), "agent_id"]
    bare = lambda df, kind: df.select(*own, F.lit(kind).alias("kind"), none.alias("tool_result_status"), none.alias("tool_input_digest"))
    alone = rows.withColumn("anchor", F.col("record_index"))
    uses = tool_uses(every).join(calls, ["trace_id", "key"]).join(tool_results(every), ["trace_id", "tool_use_id"], "left")
    tools = uses.select("trace_id", "anchor", "sub", "agent_id", F.lit("tool_call").alias("kind"), result_status().alias("tool_result_status"), short_sha(F.col("input")).alias("tool_input_digest"))
    parts = [bare(calls, "model_call"), tools, bare(alone.where((F.col("type") == "user") & F.col("spoken")), "user_message"), bare(alone.where("type = 'system'"), "system_event")]
    return placed(reduce(DataFrame.unionByName, parts))


def tool_uses(every: DataFrame) -> DataFrame:
    """Tool uses of each call without repeats, `sub` being their place in it, from 1."""
    order = F.row_number().over(Window.partitionBy("trace_id", "key").orderBy("record_index", "pos"))
    # dealt by call once, for both windows and the join with the calls
    own = every.where("block_type = 'tool_use'").repartition("trace_id", "key")
    return distinct_blocks(own, ("tool_use",)).withColumn("sub", order).select("trace_id", "key", "sub", F.col("id").alias("tool_use_id"), "name", "input")


def result_status() -> Column:
    return F.when(F.col("result_when").isNull(), "missing").when(F.col("is_error"), "error").otherwise("ok")


def placed(pending: DataFrame) -> DataFrame:
    """Adds seq, span_id, parent_seq and parent_span_id. An anchor is one call's, and its tool calls follow it with sub 1, 2, 3 and so on."""
    # written before it is dealt in ranges, as their bounds are sampled in a run of their own
    spans = numbered(materialized(pending, "unnumbered"), ("trace_id",), ("anchor", "sub", "kind"), "seq", "pending")
    spans = spans.withColumns({"span_id": digest_id(*map(F.col, ("trace_id", "agent_id", "seq", "kind"))), "parent_seq": F.when(F.col("kind") == "tool_call", F.col("seq") - F.col("sub"))})
    return spans.withColumn("parent_span_id", F.when(F.col("kind") == "tool_call", digest_id(F.col("trace_id"), F.col("agent_id"), F.col("parent_seq"), F.lit("model_call"))))


def spanned(rows: DataFrame, previews: bool = True, broken: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans, with file_index and `negative`, the blocks and the calls that they are made of. broken: takes tables of rows that break a rule."""
    shown = (lambda c, n=240: preview(c, n)) if previews else (lambda c, n=240: F.lit(""))
    every = materialized(blocks(rows), "blocks")
    calls = materialized(collapsed(grouped(rows)), "calls")
    results = tool_results(every)

    texts = distinct_blocks(every, ("text", "thinking")).groupBy("trace_id", "key").agg(F.array_sort(F.collect_list(F.struct("record_index", "pos", "block_type", "text"))).alias("texts"))
    said = lambda kind: F.transform(F.filter("texts", lambda x: (x["block_type"] == kind) & x["text"].isNotNull()), lambda x: x["text"])
    text = F.coalesce(F.when(F.size(said("text")) > 0, F.array_join(said("text"), " ")).otherwise(F.array_join(said("thinking"), " ")), F.lit(""))
    none = lambda kind: F.lit(None).cast(kind)
    error = "struct<code:string,detail:string>"
    model = calls.join(texts, ["trace_id", "key"], "left").select(
        "trace_id", "anchor", F.lit(0).alias("sub"), "agent_id", "file_index", F.lit("model_call").alias("kind"), "start", "end", "model", "usage", "stop_reason", none("string").alias("tool_name"),
        none("string").alias("tool_use_id"), none("string").alias("tool_input_digest"), none("string").alias("tool_result_status"), shown(text).alias("text_preview"), F.lit("").alias("tool_input_preview"),
        F.lit("").alias("tool_result_preview"), F.col("error").cast(error).alias("error"), "extras_dropped", F.col("negative"),
    )
    uses = tool_uses(every).join(calls.select("trace_id", "key", "anchor", "agent_id", "file_index", F.col("end").alias("start")), ["trace_id", "key"]).join(results, ["trace_id", "tool_use_id"], "left")
    tools = uses.select(
        "trace_id", "anchor", "sub", "agent_id", "file_index", F.lit("tool_call").alias("kind"), "start", F.when(F.col("result_when").isNotNull(), F.greatest("start", "result_when")).alias("end"), none("string").alias("model"),
        none(USAGE).alias("usage"), none("string").alias("stop_reason"), F.col("name").alias("tool_name"), "tool_use_id", short_sha(F.col("input")).alias("tool_input_digest"),
        result_status().alias("tool_result_status"), F.lit("").alias("text_preview"), shown(F.col("input")).alias("tool_input_preview"),
        shown(F.col("result_text")).alias("tool_result_preview"), none(error).alias("error"), F.lit(0).alias("extras_dropped"), F.coalesce(F.col("result_when") < F.col("start"), F.lit(False)).alias("negative"),
    )
    blank = lambda kind, err: ["trace_id", F.col("record_index").alias("anchor"), F.lit(0).alias("sub"), "agent_id", "file_index", F.lit(kind).alias("kind"), F.col("when").alias("start"), F.col("when").alias("end"), none("string").alias("model"), none(USAGE).alias("usage"), none("string").alias("stop_reason"), none("string").alias("tool_name"), none("string").alias("tool_use_id"), none("string").alias("tool_input_digest"), none("string").alias("tool_result_status"), shown(F.col("said")).alias("text_preview"), F.lit("").alias("tool_input_preview"), F.lit("").alias("tool_result_preview"), err.alias("error"), F.col("n_extra").alias("extras_dropped"), F.lit(False).alias("negative")]
    users = rows.where((F.col("type") == "user") & F.col("spoken")).select(*blank("user_message", none(error)))
    boundary = F.coalesce(F.col("subtype") == "compact_boundary", F.lit(False))
    system = rows.where("type = 'system'").select(*blank("system_event", F.when(boundary, F.struct(F.lit("compact_boundary").alias("code"), F.lit("").alias("detail"))).cast(error)))
    pending = reduce(DataFrame.unionByName, [model, tools, users, system])
    rules = None if broken is None else span_rules()
    return materialized(placed(pending), "spans", rules, broken), every, calls


def all_of(broken: list[DataFrame], like: DataFrame) -> DataFrame:
    """Tables of broken rules as one."""
    return reduce(DataFrame.unionByName, broken, like.sparkSession.createDataFrame([], NO_VIOLATIONS))


def agents_of(spans: DataFrame, side: DataFrame | None = None) -> DataFrame:
    """Agents in order of first appearance, with what a sidecar of a one-agent file says of them."""
    base = spans.groupBy("trace_id", "agent_id").agg(F.min("seq").alias("first"), F.array_sort(F.collect_list("seq")).alias("span_seqs"), F.min("start").alias("start"), F.max("end").alias("end"))
    base = base.withColumn("agent_index", (F.row_number().over(Window.partitionBy("trace_id").orderBy("first")) - 1).cast("int"))
    if side is None:
        return base.select("trace_id", "agent_id", "agent_index", F.lit(None).cast("string").alias("agent_type"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("parent_agent_id"), F.lit(None).cast("int").alias("depth"), "span_seqs", "start", "end")
    alone = spans.groupBy("trace_id", "file_index").agg(F.count_distinct("agent_id").alias("n"), F.min("agent_id").alias("agent_id")).where("n = 1")
    m = F.col("m")
    depth = F.try_variant_get(m, "$.spawnDepth", "int")
    depth = F.when((kind_of(F.try_variant_get(m, "$.spawnDepth", "variant")) == "BIGINT") & (depth >= 0), depth)
    said = side.join(alone, ["trace_id", "file_index"]).select("trace_id", "agent_id", "file_index", preview(string_at(m, "$.agentType"), 64).alias("agent_type"), preview(string_at(m, "$.description")).alias("description"), depth.alias("depth"), string_at(m, "$.toolUseId").alias("tool_use_id"))
    said = said.groupBy("trace_id", "agent_id").agg(F.max_by(F.struct("agent_type", "description", "depth", "tool_use_id"), "file_index").alias("s")).select("trace_id", "agent_id", "s.*")
    emitters = spans.where("kind = 'tool_call' and tool_use_id is not null").groupBy("trace_id", "tool_use_id").agg(F.min_by("agent_id", "seq").alias("emitter"))
    out = base.join(said, ["trace_id", "agent_id"], "left").join(emitters, ["trace_id", "tool_use_id"], "left")
    return out.select("trace_id", "agent_id", "agent_index", F.nullif("agent_type", F.lit("")).alias("agent_type"), F.nullif("description", F.lit("")).alias("description"), F.nullif("emitter", "agent_id").alias("parent_agent_id"), "depth", "span_seqs", "start", "end")


def warnings_of(rows: DataFrame, every: DataFrame, calls: DataFrame, spans: DataFrame) -> DataFrame:
    """The log: (code, detail) and how often. Each emitter is a small table; one aggregation adds them up."""

    def emit(df: DataFrame, code: str, detail: Column | None = None, n: Column | None = None) -> DataFrame:
        return df.select("trace_id", F.lit(code).alias("code"), (F.lit("") if detail is None else detail).alias("detail"), (F.lit(1) if n is None else n).cast("long").alias("count"))

    some = rows.where(F.col("type").isin("assistant", "user", "system"))
    odd_ones = some.select("trace_id", F.explode("odd_keys").alias("key"))
    ignored = F.col("key").isin(*IGNORED_KEYS)

    uses = every.where("block_type = 'tool_use' and id is not null").select("trace_id", F.col("id").alias("tool_use_id")).distinct()
    orphans = every.where("block_type = 'tool_result' and tool_use_id <> ''").select("trace_id", "tool_use_id").distinct().join(uses, ["trace_id", "tool_use_id"], "left_anti")
    before = F.lag("when").over(Window.partitionBy("trace_id", "file_index").orderBy("line"))
    last = spans.groupBy("trace_id", "agent_id").agg(F.max_by(F.struct("kind", "tool_result_status"), "seq").alias("x"))
    parts = [
        emit(rows.where(~F.col("type").isin(*RECORD_TYPES)), "unknown_record_type", slug(F.col("type"))),
        emit(rows.where("type = 'attachment'"), "known_ignored_key", F.lit("attachment")),
        emit(every.where(F.coalesce(~F.col("block_type").isin(*BLOCK_TYPES), F.lit(True))), "unknown_content_block", F.when(F.col("block_type").isNull(), "malformed").otherwise(slug(F.col("block_type")))),
        emit(rows.withColumn("before", before).where(F.col("when") < F.col("before")), "timestamp_out_of_order"),
        emit(spans.where("negative"), "negative_duration"),
        emit(orphans, "orphan_tool_result"),
        emit(last.where("x.kind = 'tool_call' and x.tool_result_status = 'missing'"), "dangling_tool_use"),
        emit(calls.where("usage is null and not api_error"), "missing_usage"),
        emit(calls.where((F.col("model") == SYNTHETIC) & ~F.col("api_error")), "synthetic_model"),
        emit(rows.where("type = 'system' and subtype = 'compact_boundary'"), "compaction_boundary"),
        emit(calls.where("api_error"), "api_error_record"),
        odd_ones.select("trace_id", F.when(ignored, "known_ignored_key").otherwise("unknown_extra_key").alias("code"), F.when(ignored, F.col("key")).otherwise("").alias("detail"), F.lit(1).cast("long").alias("count")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("trace_id", "code", "detail").agg(F.sum("count").alias("count"))
