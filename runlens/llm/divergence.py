"""Source divergence audit: how far the words of each source lie from those of the other sources of its language.

1. Sketch. Each task counts in how many of its documents each (lang, term) occurs, in a count-min table of `depth` rows whose cells stop at `least`. The
   tables are added up, cell by cell, on Spark. A cell never holds less than the frequency of any of its terms (or `least`), so a term with a cell
   below `least` can't be kept; what remains of the merged table is one bit for each cell.
2. Counting. A second pass counts the surviving terms of each (lang, source) exactly, in bytes and not by hashes; all others never reach the
   shuffle. What the sketch let through by chance falls to the exact document frequency.
3. Divergences. p of a term that a group lacks depends on the group alone. So |p - q| over all kept terms is, for two groups, a sum over the terms of
   each by itself (prefix sums over its distinct values of p, in which the other groups look up theirs) and a correction for the terms that both
   have, from a join on (lang, term). Languages with very many sources are joined in pairs of blocks of sources.

All arithmetic is in whole numbers. Broadcast: the bits, at most depth * most_width / 8 bytes. The width grows with the number of documents.

Terms are maximal runs of ASCII letters and characters beyond ASCII, with A-Z lower-cased. Defined results: null text, lang and source are empty strings;
a group whose documents have no terms takes part with counts of 0; a language without kept terms has pairs with value 0; repeated rows are documents of
their own; a text of any length is read whole (it is a slice of its own); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import checkpointed, ship, slices
from runlens.llm.words import Words, fold_table

LETTERS = fold_table(digits=False)
#: Bytes of text whose words a task holds at once (or one text); they take many times as much memory.
SLICE_BYTES = 2 << 20
#: Bytes of counts of several slices that a task adds up before it sends them.
HELD_BYTES = 16 << 20
#: Cells of the sketch that are shipped and added up together.
CHUNK = 1 << 16
#: p is in parts of a thousand million; each kept term has five occurrences more than were counted.
PARTS, PRIOR = 1_000_000_000, 5
#: Sources in a block; languages with more are joined in pairs of blocks.
BLOCK = 512


def width_for(n_docs: int, least_bits: int = 16, most_bits: int = 25) -> int:
    """log2 of the cells of a row: about eight to a document, so that rare terms rarely fill one."""
    return min(max(int(8 * n_docs).bit_length(), least_bits), most_bits)


class Slice:
    """Terms of some documents; a pair's number is code * n_words + word, code being that of the language or group."""

    def __init__(self, b: pa.RecordBatch):
        w = Words(b.column(0), LETTERS)
        self.terms, self.n = w.words, max(len(w.words), 1)
        lang, source = b.column(1).dictionary_encode(), b.column(2).dictionary_encode()
        self.langs, self.sources = lang.dictionary, source.dictionary
        self.lang = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.group = self.lang * len(self.sources) + source.indices.to_numpy(zero_copy_only=False)
        self.row, self.word = w.row, w.word
        once = np.unique(self.row * self.n + self.word)
        self.doc_row, self.doc_word = once // self.n, once % self.n

    def hashes(self, pairs: np.ndarray) -> np.ndarray:
        """64 bits of each (lang, term), the same in every task."""
        words = np.array([xxhash.xxh3_64_intdigest(x) for x in self.terms.to_pylist()], np.uint64)
        langs = np.array([xxhash.xxh3_64_intdigest(x, 7) for x in self.langs.to_pylist()], np.uint64)
        h = words[pairs % self.n] ^ langs[pairs // self.n]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def cells_of(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Where a hash lies in a row of the sketch."""
    odd = np.uint64(0xD6E8FEB86659FD93 + 2 * (0x5851F42D4C957F2D * (row + 1) % (1 << 60)) & 0xFFFFFFFFFFFFFFFF)
    return ((h * odd) >> np.uint64(64 - bits)).astype(np.int64)


def add_capped(cells: np.ndarray, at: np.ndarray, n: np.ndarray, cap: int) -> None:
    """Adds n at cells, which may recur; no cell goes over cap."""
    order = np.argsort(at, kind="stable")
    at, n = at[order], n[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    if len(first):
        sums = np.add.reduceat(n, first) + cells[at[first]]
        cells[at[first]] = np.minimum(sums, cap)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))


def sketch(docs: DataFrame, least: int, bits: int, depth: int) -> list[np.ndarray]:
    """For each row of the merged count-min table, one bit for each cell: whether it reached `least`."""
    kind = np.min_scalar_type(least)
    chunk = min(CHUNK, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((depth, 1 << bits), kind)
        for b in slices(batches, "text", SLICE_BYTES):
            s = Slice(b)
            pairs, n = np.unique(s.lang[s.doc_row] * s.n + s.doc_word, return_counts=True)
            h = s.hashes(pairs)
            for d in range(depth):
                add_capped(cells[d], cells_of(h, d, bits), n, least)
        for d in range(depth):
            for k, some in enumerate(cells[d].reshape(-1, chunk)):
                if some.any():
                    yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "k": pa.array([k], pa.int32()), "cells": pa.array([some.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def done():
            bits_ = np.packbits(total >= least).tobytes()
            return pa.RecordBatch.from_pydict({"d": pa.array([at[0]], pa.int32()), "k": pa.array([at[1]], pa.int32()), "cells": pa.array([bits_], pa.binary())})

        for b in batches:
            for d, k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (d, k) != at:
                    if at is not None:
                        yield done()
                    at, total = (d, k), np.zeros(chunk, np.int64)
                total = np.minimum(total + np.frombuffer(raw.as_buffer(), kind), least)
        if at is not None:
            yield done()

    shape = "d int, k int, cells binary"
    parts = _texts(docs).mapInArrow(count, shape).repartition("d", "k").sortWithinPartitions("d", "k").mapInArrow(add, shape)
    out = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(depth)]
    for r in parts.toLocalIterator():
        out[r.d][r.k * chunk // 8 : (r.k + 1) * chunk // 8] = np.frombuffer(r.cells, np.uint8)
    return out


def added_up(counts: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The same sums in fewer rows, as the slices of a task share terms; about 1.5 times `limit` bytes of counts are held, and as much while they are added up."""
    held, size, least = [], 0, limit

    def total() -> pa.Table:
        by = ["lang", "source", "term"]
        return pa.Table.from_batches(held).group_by(by, use_threads=False).aggregate([("n", "sum"), ("df", "sum")]).select([*by, "n_sum", "df_sum"]).rename_columns([*by, "n", "df"])

    for b in counts:
        held.append(b)
        size += b.nbytes
        if size >= least:
            rows = total()
            held, size = rows.to_batches(), rows.nbytes
            if size > limit // 2:
                yield from rows.to_batches(max_chunksize=20_000)
                held, size = [], 0
            least = size + limit
            del rows
    if held:
        yield from total().to_batches(max_chunksize=20_000)


def counted(docs: DataFrame, full: list[np.ndarray], bits: int) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents) for all terms that the sketch can't rule out."""
    sent = docs.sparkSession.sparkContext.broadcast(full)

    def by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        for b in slices(batches, "text", SLICE_BYTES):
            s = Slice(b)
            pairs = np.unique(s.lang[s.doc_row] * s.n + s.doc_word)
            h = s.hashes(pairs)
            may = np.ones(len(h), bool)
            for d, bit in enumerate(rows):
                at = cells_of(h, d, bits)
                may &= (bit[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
            alive = np.zeros(len(s.langs) * s.n, bool)
            alive[pairs[may]] = True
            take, once = alive[s.lang[s.row] * s.n + s.word], alive[s.lang[s.doc_row] * s.n + s.doc_word]
            keys, n = np.unique(s.group[s.row[take]] * s.n + s.word[take], return_counts=True)
            _, df = np.unique(s.group[s.doc_row[once]] * s.n + s.doc_word[once], return_counts=True)
            group, word = keys // s.n, keys % s.n
            yield pa.RecordBatch.from_arrays(
                [s.langs.take(pa.array(group // len(s.sources))), s.sources.take(pa.array(group % len(s.sources))), s.terms.take(pa.array(word)).cast(pa.binary()).cast(pa.string()), pa.array(n), pa.array(df)],
                names=["lang", "source", "term", "n", "df"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added_up(by_slice(batches), HELD_BYTES)

    rows = _texts(docs).mapInArrow(count, "lang string, source string, term string, n long, df long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def parts_of(n: str, total: str, v: str) -> Column:
    """p of a term with n occurrences; 128 bits where 64 don't hold the product."""
    below, wide = f"({total} + {PRIOR} * {v})", "DECIMAL(38,0)"
    return F.expr(f"1 + CASE WHEN {n} < 9000000000 THEN ({PARTS}L * ({n} + {PRIOR})) DIV {below} ELSE (CAST({PARTS} AS DECIMAL(10,0)) * CAST({n} + {PRIOR} AS DECIMAL(28,0))) DIV CAST({below} AS {wide}) END")


def kept_terms(docs: DataFrame, least: int = 30, depth: int = 3, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Kept terms of each group (lang, source, term, n, total: that of the language, p, base, q) and all groups (lang, source, n, v, n_terms, sum_p, base)."""
    ship(docs.sparkSession)
    bits = bits or width_for(docs.count())
    counts = checkpointed(counted(docs, sketch(docs, least, bits, depth), bits), "counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("df").alias("all_df"), F.sum("n").alias("total")).where(F.col("all_df") >= least).drop("all_df")
    kept = checkpointed(counts.drop("df").join(terms, ["lang", "term"]), "terms")
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("n_terms"))
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    zero = lambda *names: {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in names}
    groups = _texts(docs).select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").withColumns(zero("n", "n_terms", "v", "lang_n"))
    groups = checkpointed(groups.withColumn("base", F.when(F.col("v") > 0, parts_of("0L", "n", "v")).otherwise(0)), "groups")
    named = groups.select("lang", "source", F.col("n").alias("group_n"), "v", "lang_n", "base")
    kept = kept.join(named, ["lang", "source"]).withColumns({"p": parts_of("n", "group_n", "v"), "q": parts_of("total", "lang_n", "v")})
    kept = checkpointed(kept.select("lang", "source", "term", "n", "total", "p", "q", "base"), "shares")
    sums = kept.groupBy("lang", "source").agg(F.sum("p").alias("sum_p"))
    return kept, checkpointed(groups.join(sums, ["lang", "source"], "left").withColumns(zero("sum_p")), "groups")


def distinctive(kept: DataFrame, top: int = 50) -> DataFrame:
    """lang, source, item, value, rank: a group's terms that are more frequent there than in its language, most so first."""
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = kept.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def _own_sums(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, a, b, own: the sum of |p - base of b| over the terms of a, for all pairs of groups."""
    points = kept.groupBy("lang", F.col("source").alias("a"), F.col("p").alias("x")).agg(F.count("*").alias("m"))
    asked = pairs.select("lang", "a", F.col("base_b").alias("x"), "b", "n_terms_a", "sum_p_a")
    both = points.withColumn("s", F.col("m") * F.col("x")).unionByName(asked, allowMissingColumns=True)
    by = Window.partitionBy("lang", "a").orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"below": F.coalesce(F.sum("m").over(by), F.lit(0)), "below_sum": F.coalesce(F.sum("s").over(by), F.lit(0))}).where("b is not null")
    own = F.col("sum_p_a") - F.col("n_terms_a") * F.col("x") + 2 * (F.col("x") * F.col("below") - F.col("below_sum"))
    return both.select("lang", "a", "b", own.alias("own"))


def _common(kept: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """lang, a, b (a < b), fix: what the terms that both have add to the sums of each by itself."""
    n = groups.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    rows = kept.select("lang", "term", "source", "p", "base").join(F.broadcast(n) if n.count() <= 10_000 else n, "lang")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lang", "term", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "source", "p", "base")
    left, right = (rows.select("lang", "term", "i", "j", F.col("own").alias(f"own_{s}"), F.col("source").alias(s), F.col("p").alias(f"p_{s}"), F.col("base").alias(f"base_{s}")) for s in "ab")
    met = left.join(right, ["lang", "term", "i", "j"]).where("a < b and (i = j or own_a <> own_b)")
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    fix = gap("p_a", "p_b") - gap("p_a", "base_b") - gap("base_a", "p_b") + gap("base_a", "base_b")
    return met.groupBy("lang", "a", "b").agg(F.sum(fix).alias("fix"))


def distances(kept: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, source, item, value, rank: the distance of each group to every other group of its language, largest first."""
    side = lambda s: groups.select("lang", *(F.col(c).alias(f"{c}_{s}") for c in ("n_terms", "sum_p", "base")), F.col("source").alias(s), *(("v",) if s == "a" else ()))
    pairs = side("a").join(side("b"), "lang").where("a <> b")
    own = checkpointed(_own_sums(kept, pairs), "own")
    other = own.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("own").alias("own_b"))
    once = pairs.where("a < b").join(own, ["lang", "a", "b"]).join(other, ["lang", "a", "b"]).join(_common(kept, groups, block), ["lang", "a", "b"], "left")
    neither = (F.col("v") - F.col("n_terms_a") - F.col("n_terms_b")) * F.abs(F.col("base_a") - F.col("base_b"))
    value = F.col("own") + F.col("own_b") + neither + F.coalesce("fix", F.lit(0))
    once = once.select("lang", "a", "b", F.when(F.col("v") > 0, value).otherwise(0).cast("long").alias("value"))
    rows = once.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.*", "value")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, least: int = 30, top: int = 50, depth: int = 3, bits: int | None = None, block: int = BLOCK) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    kept, groups = kept_terms(docs, least, depth, bits)
    rows = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in (("pair", distances(kept, groups, block)), ("term", distinctive(kept, top)))]
    return rows[0].unionByName(rows[1])
