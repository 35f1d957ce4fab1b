"""Target-distribution importance resampling: documents drawn with weights that make their word features look like those of a target.

1. Tries. A task reads its documents in slices. The words of a slice are a trie: a node of level k is a path of k consecutive words, with its count and
   the state of a CRC-32 over the path's words joined by blanks, so a node's hash takes only the bytes of its last word. Each path of the slice is walked
   once for each place where it occurs, but hashed once.
2. Totals. A node's count goes to its bucket (CRC modulo `buckets`); the buckets of all slices are added up on Spark: at most `buckets` rows.
3. Gains. ln of the ratio of smoothed bucket shares, target to source, in thousandths, rounded down: at most `buckets` numbers, broadcast.
4. Weights. In a second pass over the documents the nodes get their bucket's gain, and a document walks its paths and adds up what they hold.
5. Draw. Gumbel noise from a hash of the id makes the highest scores a weighted draw without replacement. Ranks come from a range-partitioned sort and
   the numbers of rows before each partition: no window over all rows, nothing gathered but one number for each partition.

Words are those of `fmindex` (A-Z lower-cased; ASCII letters, digits, characters beyond ASCII). Defined results: null and empty texts have no features and
weight 0; a null id is hashed as if it were empty and comes first among equal scores; rows with equal scores and ids are ranked in any order, each
with a rank of its own; without a target all gains follow from its smoothed, even shares; a text of any length is read whole; extra columns are ignored
or kept under `keep`; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import checkpointed, numbered, ship, slices
from runlens.llm.words import Words, fold_table

LETTERS_DIGITS = fold_table(digits=True)
#: Bytes of text in a slice (or one text), which is what a trie holds.
SLICE_BYTES = 8 << 20
#: Words of more bytes are hashed one by one.
LONG = 40


def _crc_table() -> np.ndarray:
    """CRC-32 of single bytes, from its polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


class Trie:
    """Paths of one to `depth` consecutive words of some texts.

    For each level: `state` (CRC-32 of each node's path), `count`, and for each place in the texts where a path begins its `node` and `row`.
    """

    def __init__(self, texts: pa.Array, depth: int):
        w = Words(texts, LETTERS_DIGITS)
        self.n_rows = w.n_rows
        self.data, self.offsets = w.bytes_and_offsets()
        self.size = np.diff(self.offsets)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        words, row, node = w.word, w.row, w.word
        state = self._extended(np.zeros(len(self.size), np.uint32), np.arange(len(self.size)), blank=False)
        self.levels.append((state, np.bincount(node, minlength=len(state)), node, row))
        for k in range(1, depth):
            whole = row[k:] == row[: len(row) - k] if len(row) > k else np.zeros(0, bool)
            at = np.flatnonzero(whole)
            # the node of the path without its last word is that of the same place, one level up
            up = np.full(len(row), -1, np.int64)
            up[self._places(k - 1, row)] = node
            parent, last = up[at], words[at + k]
            coded = pa.array(parent * max(len(self.size), 1) + last).dictionary_encode()
            keys = coded.dictionary.to_numpy(zero_copy_only=False)
            node = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            state = self._extended(state[keys // max(len(self.size), 1)], keys % max(len(self.size), 1), blank=True)
            self.levels.append((state, np.bincount(node, minlength=len(state)), node, row[at]))

    @staticmethod
    def _places(k: int, row: np.ndarray) -> np.ndarray:
        """Where paths of k + 1 words begin."""
        return np.flatnonzero(row[k:] == row[: len(row) - k]) if len(row) > k else np.zeros(0, np.int64)

    def _extended(self, state: np.ndarray, word: np.ndarray, blank: bool) -> np.ndarray:
        """The CRC states after another word (and the blank before it)."""
        c = ~state
        if blank:
            c = _CRC[(c ^ np.uint32(32)) & np.uint32(255)] ^ (c >> np.uint32(8))
        start, size = self.offsets[word], self.size[word]
        order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
        c, start, size = c[order], start[order], size[order]
        many = int((size > LONG).sum())
        for i in range(many):
            c[i] = ~np.uint32(zlib.crc32(self.data[start[i] : start[i] + size[i]].tobytes(), int(~c[i])))
        left = len(c)
        for j in range(LONG):
            left = int(np.searchsorted(-size[many:], -j, "left")) + many  # those with more than j bytes
            if left <= many:
                break
            some = c[many:left]
            c[many:left] = _CRC[(some ^ self.data[start[many:left] + j]) & np.uint32(255)] ^ (some >> np.uint32(8))
        out = np.empty_like(c)
        out[order] = ~c
        return out

    def totals(self, buckets: int) -> np.ndarray:
        """Features in each bucket."""
        out = np.zeros(buckets, np.int64)
        for state, count, _, _ in self.levels:
            np.add.at(out, (state % np.uint32(buckets)).astype(np.int64), count)
        return out

    def walked(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its features, the sum of their gains, and its words."""
        n, total = np.zeros(self.n_rows, np.int64), np.zeros(self.n_rows, np.int64)
        for state, _, node, row in self.levels:
            gain = gains[(state % np.uint32(len(gains))).astype(np.int64)]
            n += np.bincount(row, minlength=self.n_rows)
            total += np.bincount(row, weights=gain[node], minlength=self.n_rows).astype(np.int64)
        return n, total, np.bincount(self.levels[0][3], minlength=self.n_rows)


def bucket_counts(docs: DataFrame, buckets: int = 10_000, depth: int = 2) -> DataFrame:
    """bucket, n: how many features of all texts fall in each bucket."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in slices(batches, "text", SLICE_BYTES):
            total += Trie(b.column(0), depth).totals(buckets)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "n": pa.array(total[at])})

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """For each bucket floor(1000 ln(target's share / source's share)), both smoothed by one feature a bucket, in doubles."""
    s, t = ({r.bucket: r.n for r in df.collect()} for df in (source, target))
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    return np.array([math.floor(1000 * math.log((t.get(k, 0) + 1.0) * (all_s + buckets) / ((s.get(k, 0) + 1.0) * (all_t + buckets)))) for k in range(buckets)], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, depth: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_words, n_features and weight (the mean gain of a document's features, rounded down)."""
    ship(docs.sparkSession)
    own = numbered(docs.select(*keep))
    sent = docs.sparkSession.sparkContext.broadcast(gains)
    rows = docs.select(F.col("text").alias("text"), *(F.col(c).alias(n) for c, n in zip(keep, own.columns)))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            n, total, words = Trie(b.column(0), depth).walked(sent.value)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(words), pa.array(n), pa.array(weight)], names=[*b.schema.names[1:], "_n_words", "_n_features", "_weight"])

    out = rows.mapInArrow(run, f"{shape}, _n_words long, _n_features long, _weight long")
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, own.columns)), F.col("_n_words").alias("n_words"), F.col("_n_features").alias("n_features"), F.col("_weight").alias("weight"))


def noisy(rows: DataFrame, seed: int) -> DataFrame:
    """Adds score: weight and Gumbel noise in thousandths, from the first 32 bits of a SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))))


#: Bits of `monotonically_increasing_id` that number a partition's rows.
ROW_BITS = 33


def ranked(rows: DataFrame, least_words: int, percent: int) -> DataFrame:
    """Adds rank (from 1, null where not drawn): the highest floor(percent * N / 100) scores of the N rows with `least_words` words or more."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = checkpointed(rows.withColumn("_row", F.monotonically_increasing_id()), "weighted")
    apt = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    key = (F.desc("score"), F.asc_nulls_first("doc_id"), "_row")  # the last spreads equal rows over partitions
    placed = rows.where(apt).repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id())
    placed = checkpointed(placed, "ranked")
    sizes = {r.part: r.n for r in placed.groupBy(F.shiftright("_at", ROW_BITS).alias("part")).agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    starts = F.broadcast(spark.createDataFrame(starts, "_part long, _before long"))
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << ROW_BITS) - 1) + 1
    drawn = placed.withColumn("_part", F.shiftright("_at", ROW_BITS)).join(starts, "_part").withColumn("rank", F.when(rank <= percent * before // 100, rank))
    rest = rows.where(~apt).withColumn("rank", F.lit(None).cast("long"))
    return drawn.drop("_part", "_before", "_at", "_row").unionByName(rest.drop("_row"))


def resampled(docs: DataFrame, target: DataFrame, buckets: int = 10_000, depth: int = 2, seed: int = 7, least_words: int = 20, percent: int = 25, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns (doc_id among them), n_words, n_features, weight, score and rank of every document; those with a rank are the drawn ones."""
    gains = gains_of(bucket_counts(docs, buckets, depth), bucket_counts(target, buckets, depth), buckets)
    return ranked(noisy(weighted(docs, gains, depth, keep), seed), least_words, percent)
