"""Preference formatting: prompt and paired, masked completions from chosen and rejected conversations. DataFrame functions only.

The longest common prefix of turns (equal in role and text) is rendered once as the prompt; what follows in either conversation is its completion.
A completion's mask lists the character spans that are trained on: the texts of the trained roles with their end marks.

A conversation is an array of turns and is gathered in one row, as its rendering is one string; different conversations share nothing.
Defined results: a null role is rendered as `unknown`, a null text as empty (and both equal null only); turns with the same number are ordered by
role and text; a conversation without turns is an empty array; if one conversation is a prefix of the other its completion is empty, and equal
conversations are marked `identical`; rows whose conversation id is null are in no pair; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, AFTER_ROLE, END = "<|", "|>\n", "<|end|>\n"
TURN = "struct<role:string,text:string>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text, in order) from rows of conv_id, turn, role, text."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(rows.alias("rows")).select("conv_id", F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def head(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), F.coalesce(turn["role"], F.lit("unknown")), F.lit(AFTER_ROLE))


def body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(head(x), body(x))), "")


def mask(turns: Column, trained: tuple[str, ...]) -> Column:
    """Character spans [start, end) of the trained turns in their rendering."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(head(x)) + F.length(body(x))).alias("at"),
        F.when(x["role"].isin(*trained), F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(head(x))).alias("start"), (acc["at"] + F.length(head(x)) + F.length(body(x))).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in role and text."""
    most = F.least(F.size(a), F.size(b))
    differ = lambda i: ~(F.get(a, i)["role"].eqNullSafe(F.get(b, i)["role"]) & F.get(a, i)["text"].eqNullSafe(F.get(b, i)["text"]))
    first = F.get(F.filter(F.sequence(F.lit(0), most - 1), differ), F.lit(0))
    return F.when(most > 0, F.coalesce(first, most)).otherwise(0)


def formatted(pairs: DataFrame, trained: tuple[str, ...] = ("assistant",), keep: tuple[str, ...] = ()) -> DataFrame:
    """pairs: pair_id, chosen, rejected (arrays of turns; null is empty). Returns the prompt, completions and masks of each pair, and `keep`."""
    empty = F.array().cast(f"array<{TURN}>")
    rows = pairs.select("pair_id", *keep, F.coalesce("chosen", empty).alias("chosen"), F.coalesce("rejected", empty).alias("rejected"))
    rows = rows.withColumn("n_prompt_turns", common_prefix(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.size(c))
    rows = rows.withColumns({"head": F.slice("chosen", F.lit(1), F.col("n_prompt_turns")), "a": rest(F.col("chosen")), "b": rest(F.col("rejected"))})
    return rows.select(
        "pair_id",
        *keep,
        "n_prompt_turns",
        rendered(F.col("head")).alias("prompt"),
        rendered(F.col("a")).alias("chosen"),
        rendered(F.col("b")).alias("rejected"),
        mask(F.col("a"), trained).alias("chosen_mask"),
        mask(F.col("b"), trained).alias("rejected_mask"),
        ((F.size("a") == 0) & (F.size("b") == 0)).alias("identical"),
    )


def last_answer(turns: Column) -> Column:
    """The place (from 1) of the last assistant turn, 0 if there is none."""
    places = F.transform(turns, lambda x, i: F.when(x["role"] == "assistant", i + 1))
    return F.coalesce(F.array_max(places), F.lit(0))


def branched(turns: DataFrame) -> DataFrame:
    """One pair for each conversation, from plain conversations: pair_id, pairing, chosen, rejected.

    Chosen is a conversation up to its last assistant turn. Rejected keeps its first `pair_id` modulo (number of these turns) turns and goes on with the
    turns that the partner, cut in the same way, has from there on, or with the partner's last answer if it is shorter. Partners are the
    conversations whose ids differ in the lowest bit, so both stand in one group of the only shuffle, whatever the turns hold. `pairing` says `paired`,
    `no_partner` (that is absent or without an answer: rejected is null) or `no_answer` (both are null).
    """
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "conv_id")))
    both = turns.where(F.col("conv_id").isNotNull()).groupBy(F.shiftright("conv_id", 1).alias("two")).agg(rows.alias("rows"))

    def side(bit: int) -> Column:
        id_ = F.shiftleft("two", 1) + bit
        own = F.transform(F.filter("rows", lambda x: x["conv_id"] == id_), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
        return F.struct(id_.alias("id"), F.size(own).alias("n"), F.slice(own, F.lit(1), last_answer(own)).alias("turns"))

    both = both.select(side(0).alias("a"), side(1).alias("b"))
    each = both.select(F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other")))).alias("p")).select("p.*").where("own.n > 0")
    n, m = F.size("own.turns"), F.size("other.turns")
    kept = F.pmod(F.col("own.id"), F.greatest(n, F.lit(1))).cast("int")
    start = F.least(kept, m - 1)
    rejected = F.concat(F.slice("own.turns", F.lit(1), kept), F.slice("other.turns", start + 1, m - start))
    pairing = F.when(n == 0, "no_answer").when(m == 0, "no_partner").otherwise("paired")
    return each.select(F.col("own.id").alias("pair_id"), pairing.alias("pairing"), F.when(n > 0, F.col("own.turns")).alias("chosen"), F.when((n > 0) & (m > 0), rejected).alias("rejected"))


def swapped_answers(turns: DataFrame, unpaired: bool = False) -> DataFrame:
    """Pairs from plain conversations: chosen is a conversation up to its last assistant turn, rejected the same with the last answer of its neighbour.

    The neighbour is the conversation whose id differs in the lowest bit, so partners meet by an even equi-join, whatever the turns hold.
    A conversation without an assistant turn has no answer and is in no pair. One whose neighbour is absent or has no answer is left out too,
    as in the query's SQL; with `unpaired` it is returned with a null (empty) rejected side.
    """
    rows = conversations(turns)
    n = F.size("turns")
    last = F.coalesce(F.array_max(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.get(F.col("turns"), i - 1)["role"] == "assistant", i))), F.lit(0))
    rows = rows.where(n > 0).withColumn("last", last).where("last > 0").select("conv_id", F.slice("turns", F.lit(1), F.col("last")).alias("chosen"), F.element_at("turns", F.col("last")).alias("answer"))
    other = rows.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("answer").alias("other"))
    both = rows.join(other, "conv_id", "left" if unpaired else "inner")
    lead = F.slice("chosen", F.lit(1), F.size("chosen") - 1)
    return both.select(F.col("conv_id").alias("pair_id"), "chosen", F.when(F.col("other").isNotNull(), F.concat(lead, F.array("other"))).alias("rejected"))
