"""Benchmark decontamination by an FM-index per training shard.

Symbols are words over the alphabet of the benchmark's words: a document word that no item contains can't be part of an occurrence, so
every run of such words is one separator. A shard (the documents of one task, at most `shard_words` words or one document) gets a suffix
array over its symbols, its Burrows-Wheeler transform in a wavelet tree of bit-planes, and suffix positions sampled by text position.
All windows of the benchmark are searched backward at once; occurrences are located by LF steps to sampled positions and merged into spans.

Words: A-Z lower-cased, then maximal runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. A window: `width` consecutive words of an item; an item
of fewer words, but not none, is one window. Defined results: null and empty texts have no words; repeated items each count with their own
item_id; documents with the same doc_id are treated as rows of their own; null item ids are read as the text 'null'; extra columns are ignored.

What is broadcast at once holds at most `most_bytes` of benchmark text. A larger benchmark is dealt into parts by a hash of its items, and the
documents are searched once for each part, with the hits so far written in between; only an item that is over `most_bytes` by itself raises.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import batch_of, checkpointed, numbered, ship, slices

#: The same words found in a text before A-Z is lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: A-Z to lower case, all other ASCII but a-z and digits to blanks; bytes of other characters stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Phrases:
    """The benchmark's windows as rows of word numbers (1 and up), with the items that contain each."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.width = width
        words = [(i, words_of(t)) for i, t in items]
        self.number = {w: k for k, w in enumerate(sorted({w for _, ws in words for w in ws}), 1)}
        found: dict[tuple[int, ...], set[int]] = {}
        self.items = sorted({i for i, ws in words if ws})
        place = {i: k for k, i in enumerate(self.items)}
        for i, ws in words:
            ids = [self.number[w] for w in ws]
            for k in range(max(len(ids) - width + 1, 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + width]), set()).add(place[i])
        self.windows = sorted(found)
        self.of = [sorted(found[w]) for w in self.windows]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.matrix = np.zeros((len(self.windows), width), np.int64)  # right-aligned: backward search starts at the right
        for k, w in enumerate(self.windows):
            self.matrix[k, width - len(w) :] = w


class FMIndex:
    """FM-index of a sequence of symbols; 0 separates, each of its places being smaller than any word and than later separators."""

    SAMPLE = 8

    def __init__(self, seq: np.ndarray, sigma: int):
        n = self.n = len(seq)
        self.sigma = sigma
        order = suffix_array(seq)
        bwt = seq[order - 1] if n else seq  # the first suffix is preceded by the last symbol: a separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma + 1))])[: sigma + 1]
        self.levels = max(1, int(sigma).bit_length())
        self.zeros, self.words, self.ranks = [], [], []
        low = bwt.astype(np.uint16 if sigma < 1 << 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            ones = (low & low.dtype.type(1 << level)) != 0
            raw = np.packbits(ones, bitorder="little")
            raw = np.concatenate([raw, np.zeros(16 - len(raw) % 8, np.uint8)]).view(np.uint64)
            self.words.append(raw)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(raw), dtype=np.int64)]))
            self.zeros.append(n - int(np.count_nonzero(ones)))
            low = np.concatenate([low[~ones], low[ones]])
        # which rows have a sampled position, as bits with ranks, and these positions in row order
        # (a step back never crosses a separator: what follows one is sampled too)
        marked = (order % self.SAMPLE == 0) | (bwt == 0)
        raw = np.packbits(marked, bitorder="little")
        self.mark = np.concatenate([raw, np.zeros(16 - len(raw) % 8, np.uint8)]).view(np.uint64)
        self.mark_ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.mark), dtype=np.int64)])
        self.sampled = order[marked].astype(np.int32)

    @staticmethod
    def _rank(words: np.ndarray, ranks: np.ndarray, i: np.ndarray) -> np.ndarray:
        k, r = i >> 6, (i & 63).astype(np.uint64)
        return ranks[k] + np.bitwise_count(words[k] & ((np.uint64(1) << r) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, i: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Occurrences of each symbol among the first i symbols of the transform."""
        lo = np.zeros_like(i)
        for level in range(self.levels):
            one = (symbol >> (self.levels - 1 - level)) & 1 == 1
            a, b = self._rank(self.words[level], self.ranks[level], lo), self._rank(self.words[level], self.ranks[level], i)
            lo, i = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + b, i - b)
        return i - lo

    def step(self, rows: np.ndarray) -> np.ndarray:
        """LF: the row of the suffix that is longer by one symbol."""
        symbol, i, lo = np.zeros_like(rows), rows, np.zeros_like(rows)
        for level in range(self.levels):
            one = (self.words[level][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            a, b = self._rank(self.words[level], self.ranks[level], lo), self._rank(self.words[level], self.ranks[level], i)
            lo, i = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + b, i - b)
            symbol = symbol << 1 | one
        return self.first[symbol] + i - lo

    def search(self, matrix: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each phrase; phrases are right-aligned rows of word numbers."""
        lo, hi = np.zeros(len(matrix), np.int64), np.full(len(matrix), self.n, np.int64)
        alive = np.arange(len(matrix))
        for k in range(matrix.shape[1] - 1, -1, -1):
            alive = alive[(lengths[alive] >= matrix.shape[1] - k) & (hi[alive] > lo[alive])]
            if not len(alive):
                break
            c = matrix[alive, k]
            lo[alive], hi[alive] = self.first[c] + self.rank(c, lo[alive]), self.first[c] + self.rank(c, hi[alive])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled one, fewer than SAMPLE."""
        out, todo, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            k = rows >> 6
            hit = (self.mark[k] >> (rows & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[todo[hit]] = self.sampled[self._rank(self.mark, self.mark_ranks, rows[hit])] + steps
            todo, rows, steps = todo[~hit], rows[~hit], steps + 1
            rows = self.step(rows) if len(rows) else rows
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes in order; every 0 is smaller than what it is compared with, and zeros among themselves are in text order.

    Words up to the next separator decide. Rounds double the compared length and sort only the places that are still tied.
    """
    n = len(seq)
    zero = np.flatnonzero(seq == 0)
    rest = np.flatnonzero(seq)
    if not len(rest):
        return zero
    # every separator is a rank of its own (below len(zero)); words come after
    rank = seq.astype(np.int64) + (len(zero) - 1)
    rank[zero] = np.arange(len(zero))
    bits = int(rank.max() + 1).bit_length()
    k = 1
    while True:
        todo = rest
        take = max(2, 63 // bits) if k == 1 else 2
        key = rank[todo].copy()
        for j in range(1, take):
            at = np.minimum(todo + j * k, n - 1)  # the text ends with a separator: what lies beyond one is never compared
            key = (key << bits) | rank[at]
        order = np.argsort(key, kind="quicksort")
        key, todo = key[order], todo[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        if k == 1:
            base = np.full(len(todo), len(zero), np.int64)
            at = np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))
            slots = base + at
        else:
            # ranks stay within the group's own slots: the group's first slot plus the place of the first equal key in it
            group = rank[todo]
            starts = np.concatenate([[True], group[1:] != group[:-1]])
            pos = np.arange(len(todo))
            slots = group + np.maximum.accumulate(np.where(new, pos, 0)) - np.maximum.accumulate(np.where(starts, pos, 0))
        rank[todo] = slots
        last = np.concatenate([new[1:], [True]])
        tied = ~(new & last)
        rest = todo[tied]
        k *= take
        bits = max(int(n).bit_length(), 1)
        if not len(rest):
            break
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def windows_of(benchmark: DataFrame, width: int) -> Phrases:
    """Gathers a benchmark, or a part of one, whose size was checked by `parts_of`."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").collect()
    return Phrases([(r.i, r.text) for r in rows], width)


def parts_of(benchmark: DataFrame, most_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of at most `most_bytes` of text each, mostly one; it raises if a single item is over that."""
    bytes_of = F.octet_length("text").cast("long")
    size, longest = (x or 0 for x in benchmark.agg(F.sum(bytes_of), F.max(bytes_of)).first())
    if longest > most_bytes:
        raise ValueError(f"an item of the benchmark has {longest} bytes; at most {most_bytes} are broadcast")
    if size <= most_bytes:
        return [benchmark]
    # a repeated item says nothing new, and copies would fall into one part for ever
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    code, n = F.xxhash64("item_id", "text"), 1
    sizes = {}
    while not sizes or max(sizes.values()) > most_bytes:
        n *= 2
        bucket = F.pmod(code, F.lit(n))
        sizes = {r.bucket: r.size for r in items.groupBy(bucket.alias("bucket")).agg(F.sum(bytes_of).alias("size")).collect()}
    parts, room = [], 0
    for k, size in sorted(sizes.items()):
        if size > room:
            parts.append([])
            room = most_bytes
        parts[-1].append(k)
        room -= size
    return [items.where(bucket.isin(ks)) for ks in parts]


def tokens_of(text: str | None, number: dict[bytes, int]) -> np.ndarray:
    """Word numbers of a text; 0 for words that the benchmark doesn't have."""
    words = words_of(text)
    return np.fromiter(map(number.get, words, repeat(0)), np.int32, len(words))


def shard_hits(docs: list[np.ndarray], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """For each document of a shard, given as word numbers (0: no word of the benchmark): merged spans of words, and items found."""
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[list[int]] = [[] for _ in docs]
    lengths = np.array([len(d) for d in docs], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    whole = np.zeros(int(starts[-1]), np.int32)
    for s, d in zip(starts, docs):
        whole[s : s + len(d)] = d
    # a run of separators becomes one
    keep = whole != 0
    keep[1:] |= keep[:-1]
    keep[-1:] = True
    place = np.flatnonzero(keep)
    seq = whole[place]
    if not phrases.windows or not seq.any():
        return spans, items
    index = FMIndex(seq, len(phrases.number))
    lo, hi = index.search(phrases.matrix, phrases.lengths)
    count = hi - lo
    found = np.repeat(np.arange(len(count)), count)
    if not len(found):
        return spans, items
    rows = np.repeat(lo, count) + np.arange(len(found)) - np.repeat(np.cumsum(count) - count, count)
    at = place[index.locate(rows)]
    doc = np.searchsorted(starts, at, "right") - 1
    order = np.lexsort((at, doc))
    end = at + phrases.lengths[found]
    seen: dict[int, set[int]] = {}
    for d, a, e, w in zip(doc[order].tolist(), (at - starts[doc])[order].tolist(), (end - starts[doc])[order].tolist(), found[order].tolist()):
        own = spans[d]
        if own and a <= own[-1][1]:
            own[-1] = (own[-1][0], max(e, own[-1][1]))
        else:
            own.append((a, e))
        seen.setdefault(d, set()).update(phrases.of[w])
    for d, s in seen.items():
        items[d] = sorted(s)
    return spans, items


HITS = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", _SPAN), ("items", pa.list_(pa.string()))])


def shards(batches: Iterator[pa.RecordBatch], phrases: Phrases, shard_words: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list, list, list]]:
    """A task's rows in shards: the rows, their words' counts, merged spans and items."""
    held, rows, size = [], [], 0
    for b in slices(batches, text, 4 << 20):
        held += [tokens_of(t, phrases.number) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
        rows.append(b)
        size += sum(map(len, held[-b.num_rows :]))
        if size >= shard_words:
            yield pa.concat_batches(rows), [len(d) for d in held], *shard_hits(held, phrases)
            held, rows, size = [], [], 0
    if held:
        yield pa.concat_batches(rows), [len(d) for d in held], *shard_hits(held, phrases)


def united(spans: list[dict]) -> list[dict]:
    """Spans merged where they overlap or touch, in order."""

    def add(out: list[dict], x: dict) -> list[dict]:
        if out and x["start"] <= out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], x["end"])}
            return out
        out.append(x)
        return out

    return reduce(add, sorted(spans, key=lambda x: x["start"]), [])


def hits_by_parts(docs: DataFrame, parts: list[DataFrame], width: int, shard_words: int) -> DataFrame:
    """All columns of docs as `_own0`, `_own1` ... with n_words, spans and items: one search for each part, each written before the next begins."""
    text = f"_own{docs.columns.index('text')}"
    rows = numbered(docs).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<start:long,end:long>>"), "items": F.array().cast("array<string>")})
    for part in parts:
        shared = docs.sparkSession.sparkContext.broadcast(windows_of(part, width))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for b, n_words, spans, items in shards(batches, phrases, shard_words, text):
                now = [united([*old, *({"start": x, "end": y} for x, y in s)]) for old, s in zip(b.column("spans").to_pylist(), spans)]
                known = [sorted({*old, *(phrases.items[i] for i in x)}) for old, x in zip(b.column("items").to_pylist(), items)]
                own = {f.name: c for f, c in zip(b.schema, b.columns)}
                yield batch_of(b.schema, **own | {"n_words": n_words, "spans": now, "items": known})

        rows = checkpointed(rows.mapInArrow(run, rows.schema), "hits")
        shared.unpersist()
    return rows


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_words: int = 2_000_000, most_bytes: int = 8 << 20) -> DataFrame:
    """For each row of `doc_id, text`: its words, merged spans of hit words (from, to) and the items found."""
    ship(docs.sparkSession)
    parts = parts_of(benchmark, most_bytes)
    if len(parts) > 1:
        return hits_by_parts(docs.select("doc_id", "text"), parts, width, shard_words).select(F.col("_own0").alias("doc_id"), "n_words", "spans", "items")
    shared = docs.sparkSession.sparkContext.broadcast(windows_of(benchmark, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for rows, n_words, spans, items in shards(batches, phrases, shard_words):
            yield batch_of(_HITS, doc_id=rows.column(0).to_pylist(), n_words=n_words, spans=[[{"start": a, "end": e} for a, e in s] for s in spans], items=[[phrases.items[i] for i in x] for x in items])

    return docs.select("doc_id", "text").mapInArrow(run, HITS)


def report(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    joined = F.array_join(F.array_sort("items"), ",")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its hit words: each span goes from its first word's first character to its last word's last."""
    if not spans:
        return text
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for a, e in spans:
        out.append(text[last : at[a][0]])
        last = at[e - 1][1]
    return "".join([*out, text[last:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_words: int = 2_000_000, most_bytes: int = 8 << 20) -> DataFrame:
    """The documents, all columns, with every hit span removed from `text`; clean rows are unchanged, and no row is dropped."""
    ship(docs.sparkSession)
    parts = parts_of(benchmark, most_bytes)
    k = docs.columns.index("text")

    def without(rows: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        if not any(spans):
            return rows
        field = rows.schema.field(k)
        texts = [cut(t, s) if s else t for t, s in zip(rows.column(k).to_pylist(), spans)]
        return rows.set_column(k, field, pa.array(texts, field.type))

    if len(parts) > 1:
        n = len(docs.columns)

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, f"_own{k}", 4 << 20):
                spans = [[(x["start"], x["end"]) for x in s] for s in b.column("spans").to_pylist()]
                yield without(b.select(list(range(n))), spans)

        return hits_by_parts(docs, parts, width, shard_words).mapInArrow(finish, numbered(docs).schema).toDF(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(windows_of(benchmark, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, spans, _ in shards(batches, shared.value, shard_words):
            yield without(rows, spans)

    return docs.mapInArrow(run, docs.schema)
