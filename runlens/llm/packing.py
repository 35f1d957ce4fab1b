"""Best-fit packing of documents into sequences of a fixed length, online and in bounded space.

A task reads its documents as they come, encodes them and places each piece in the open sequence with the least room that holds it. Open sequences are
kept by their free tokens: one bit for each number of free tokens, so the best fit is the lowest set bit at or above a piece's length. At most `open_bins`
sequences are open; when another would be, the fullest closes first. A closed sequence is written with its token ids. What is open when a task ends is
written too, and packed again: `fan_in` tasks' leftovers to a task, round by round, until one task holds all that is left. So a task holds at most
`open_bins` sequences besides the documents at hand, no documents are shuffled but those of the leftovers, and a lost task packs its own documents again.

A document is its ids and an end id. One of more than `size` tokens is cut into pieces of `size` tokens, the first of which takes the rest and may be
shorter; no other is cut. Defined results: a null text is empty, so its document is the end id alone; rows with the same id (or none) are documents of
their own; a text of any length is encoded whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import batch_of, shared_dir, ship, slices
from runlens.llm.wavelet import ChunkEncoder

PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
SEQUENCES = pa.schema([("sequence_id", pa.int64()), ("closed", pa.bool_()), ("ids", pa.binary()), ("pieces", pa.list_(PIECE))])
SEQUENCE = "sequence_id long, closed boolean, ids binary, pieces array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint>>"
DIGESTS = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


#: Bytes of text parts whose ids a worker remembers.
KNOWN_BYTES = 128 << 20
_ENCODERS: dict[tuple, ChunkEncoder] = {}


def _encoder(tokenizer: str, end_id: int) -> ChunkEncoder:
    """One for each Python worker."""
    if (tokenizer, end_id) not in _ENCODERS:
        _ENCODERS[tokenizer, end_id] = ChunkEncoder(tokenizer, end_id, KNOWN_BYTES)
    return _ENCODERS[tokenizer, end_id]


class Bins:
    """Open sequences by free tokens. `free` has bit f set while some open sequence has f tokens free."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.n, self.free = size, most, 0, 0
        self.by: list[list[list]] = [[] for _ in range(size + 1)]

    def _take(self, f: int) -> list:
        held = self.by[f].pop()
        self.n -= 1
        if not self.by[f]:
            self.free ^= 1 << f
        return held

    def place(self, item, length: int) -> list | None:
        """Puts an item in the best open sequence, or a new one. Returns the items of a sequence that this closes."""
        fit, closed = self.free >> length, None
        if fit:
            f = length + (fit & -fit).bit_length() - 1
            held = self._take(f)
        else:
            f, held = self.size, []
            if self.n == self.most and length < self.size:
                closed = self._take((self.free & -self.free).bit_length() - 1)
        held.append(item)
        if f == length:
            return held  # full; a new one that is full at once displaces none
        self.by[f - length].append(held)
        self.free |= 1 << (f - length)
        self.n += 1
        return closed

    def rest(self) -> Iterator[list]:
        for held in self.by:
            yield from held


class Writer:
    """Batches of sequences from lists of items (doc_id, piece, start, ids)."""

    def __init__(self, first_id: int, tokens: int = 2_000_000):
        self.next, self.most = first_id, tokens
        self._clear()

    def _clear(self) -> None:
        self.ids, self.ends, self.pieces, self.counts, self.closed, self.n = [], [0], [], [0], [], 0

    def add(self, items: list, closed: bool) -> Iterator[pa.RecordBatch]:
        for doc, piece, start, ids in items:
            self.ids.append(ids)
            self.n += len(ids)
            self.pieces.append((doc, piece, start, len(ids)))
        self.ends.append(self.n)
        self.counts.append(len(self.pieces))
        self.closed.append(closed)
        if self.n >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.closed:
            return
        k = len(self.closed)
        columns = [pa.array(c, f.type) for c, f in zip(zip(*self.pieces), PIECE)]
        pieces = pa.StructArray.from_arrays(columns, fields=list(PIECE))
        ids = pa.BinaryArray.from_buffers(pa.binary(), k, [None, pa.py_buffer(4 * np.array(self.ends, np.int32)), pa.py_buffer(np.concatenate(self.ids).astype("<u4"))])
        yield batch_of(SEQUENCES, sequence_id=range(self.next, self.next + k), closed=self.closed, ids=ids, pieces=pa.ListArray.from_arrays(pa.array(self.counts, pa.int32()), pieces))
        self.next += k
        self._clear()


def _packed(items: Iterator[tuple], size: int, open_bins: int, first_id: int, last: bool) -> Iterator[pa.RecordBatch]:
    bins, out = Bins(size, open_bins), Writer(first_id)
    for item in items:
        closed = bins.place(item, len(item[3]))
        if closed is not None:
            yield from out.add(closed, True)
    for held in bins.rest():
        yield from out.add(held, last)
    yield from out.flush()


def _first_id(turn: int) -> int:
    """Ids of different rounds and tasks don't meet: 7 bits for the round, 24 for the task, 32 for its sequences."""
    from pyspark import TaskContext

    return turn << 56 | TaskContext.get().partitionId() << 32


def sequences(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, open_bins: int = 512, fan_in: int = 16) -> DataFrame:
    """sequence_id, ids (at most `size`, little-endian unsigned 32-bit), pieces (doc_id, piece, start, length, in the order of the ids): each sequence once."""
    spark = docs.sparkSession
    ship(spark)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            enc = _encoder(tokenizer, end_id)
            for b in slices(batches, "text", 8 << 20):
                tokens, lengths = enc.encode(b.column(1))
                at = 0
                for doc, n in zip(b.column(0).to_pylist(), lengths.tolist()):
                    cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                    for k, (a, e) in enumerate(zip(cuts, cuts[1:])):
                        yield doc, k, a, tokens[at + a : at + e].copy()
                    at += n

        yield from _packed(pieces(), size, open_bins, _first_id(0), False)

    def again(turn: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def pieces():
                for b in batches:
                    for ids, own in zip(b.column(0), b.column(1).to_pylist()):
                        ids, at = np.frombuffer(ids.as_buffer(), "<u4"), 0
                        for p in own:
                            yield p["doc_id"], p["piece"], p["start"], ids[at : at + p["length"]].copy()
                            at += p["length"]

            yield from _packed(pieces(), size, open_bins, _first_id(turn), last)

        return run

    out, turn = shared_dir(spark, "sequences"), 0
    docs.select("doc_id", "text").mapInArrow(first, SEQUENCE).write.parquet(f"{out}/0")
    while True:
        left = spark.read.schema(SEQUENCE).parquet(f"{out}/{turn}").where("not closed").select("ids", "pieces")
        tasks = -(-left.count() // (fan_in * open_bins))
        if not tasks:
            break
        turn += 1
        left.repartition(tasks).mapInArrow(again(turn, tasks == 1), SEQUENCE).write.parquet(f"{out}/{turn}")
    done = [spark.read.schema(SEQUENCE).parquet(f"{out}/{k}").where("closed").drop("closed") for k in range(turn + 1)]
    whole = done[0]
    for df in done[1:]:
        whole = whole.unionByName(df)
    return whole


def placements(packed: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece, from the ids in the sequences."""
    ship(packed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own, counts = b.column(2).flatten(), b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            length = own.field("length").to_numpy(zero_copy_only=False)
            last = np.cumsum(counts) - 1
            ends = np.cumsum(length)
            offset = ends - length - np.repeat(np.concatenate([[0], ends[last[:-1]]]), counts)  # each sequence begins at 0
            crc, k = np.zeros(len(length), np.int64), 0
            for ids, n in zip(b.column(1), counts.tolist()):
                raw = memoryview(ids.as_buffer())
                for j in range(k, k + n):
                    crc[j] = zlib.crc32(raw[4 * offset[j] : 4 * (offset[j] + length[j])])
                k += n
            yield batch_of(DIGESTS, doc_id=own.field("doc_id"), piece=own.field("piece"), start=own.field("start"), length=own.field("length"), ids_crc32=pa.array(crc), sequence_id=pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), counts)), offset=pa.array(offset.astype(np.int64)))

    return packed.select("sequence_id", "ids", "pieces").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
