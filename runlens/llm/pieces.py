"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback and blanks as marks.

`encoded` gives each whole text's piece ids, and decodes them again to see that nothing was lost; `decoded` turns ids into texts.
Blanks are marks, and one blank is put before each text; a mark character in a text is spelled by byte pieces, so decoding restores every text.
Texts may be of any length: a part of over `LONG` characters is walked alone, in time linear in it. Of equally good paths that with the longer last
piece is taken, from the end on.
Defined results: a null or empty text has no pieces (null stays null); an empty table gives no rows; repeated rows are encoded each; extra columns are passed on by `keep`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runlens.llm.common import ship, slices
from runlens.llm.unigram import LONG, MARK, OWN, Forest, Pieces, best_paths, long_path, parts_of, spell


class Encoder:
    """Encodes texts part by part. Parts that recur are encoded once; the table of known parts is dropped at `most` bytes, which changes no result."""

    def __init__(self, path: str, scores: str = "log", most: int = 160 << 20):
        self.pieces, self.most, self.held = Pieces.load(path, scores), most, 0
        own = [int(self.pieces.byte_ids[b]) for b in MARK.encode()]
        self._own = {OWN: np.array(own, np.int32).tobytes()}
        self.known = dict(self._own)
        names = [x.replace(MARK, " ").encode() for x in self.pieces.pieces]
        for b, i in enumerate(self.pieces.byte_ids.tolist()):
            names[i] = bytes([b])
        self._names = names

    def _learn(self, new: list[str]) -> None:
        for x in new:
            if len(x) > LONG:
                self.known[x] = long_path(self.pieces, x.encode()).tobytes()
                self.held += 5 * len(x)
        new = [x for x in new if len(x) <= LONG]
        for i in range(0, len(new), 40_000):
            some = new[i : i + 40_000]
            forest = Forest([x.encode() for x in some], shared=False)
            _, count, last, before = best_paths(self.pieces, forest)
            ids, start = spell(last, before, count, forest.terminal)
            raw, at = ids.tobytes(), (4 * start).tolist()
            self.known.update(zip(some, (raw[a:b] for a, b in zip(at, at[1:]))))
            self.held += len(raw) + sum(map(len, some)) + 250 * len(some)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.held > self.most:
            self.known, self.held = dict(self._own), 0
        parts = [parts_of(t) if t else [] for t in texts]
        self._learn(list(set().union(*parts) - self.known.keys()))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), np.int32) for p in parts]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self._names.__getitem__, ids)).decode()[1:]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, scores: str) -> Encoder:
    """One for each Python worker."""
    if (path, scores) not in _ENCODERS:
        _ENCODERS[path, scores] = Encoder(path, scores)
    return _ENCODERS[path, scores]


def encoded(docs: DataFrame, model: str, scores: str = "log", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, ids, n_pieces, n_byte_pieces, ids_crc32 (of little-endian 32-bit ids) and lossless (decoding gives the text)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model, scores)
        is_byte = np.zeros(len(enc.pieces.pieces), bool)
        is_byte[enc.pieces.byte_ids] = True
        for b in slices(batches, "text", 4 << 20):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            ids = enc.encode(texts)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            made = [
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat)),
                pa.array(sizes), pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64()),
                pa.array([enc.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), *made], names=[*keep, "ids", "n_pieces", "n_byte_pieces", "ids_crc32", "lossless"])

    rows = docs.select(*dict.fromkeys(("text", *keep)))
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep), "ids array<int>, n_pieces long, n_byte_pieces long, ids_crc32 long, lossless boolean"])
    return rows.mapInArrow(run, schema)


def decoded(rows: DataFrame, model: str, scores: str = "log", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the text of `ids`; null ids give null."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model, scores)
        for b in batches:
            texts = [None if x is None else enc.decode(x) for x in b.column(b.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    some = rows.select("ids", *keep)
    return some.mapInArrow(run, ", ".join([*(f"`{k}` {some.schema[k].dataType.simpleString()}" for k in keep), "text string"]))
