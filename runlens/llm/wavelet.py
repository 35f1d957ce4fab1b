"""Token-ID output: one wavelet matrix per shard.

`write_shards` encodes texts in ascending doc_id order and writes, for each shard, one compressed file of bit-planes.
`read_shards` opens the files again and rebuilds all ids. `WaveletFile` answers access, count and occurrence queries
from the compressed file and opens only the blocks it needs.

Defined results: a null or empty text has only the end id; equal doc_ids are ordered by text; extra columns are ignored;
an empty table gives no file and no row.
"""

from __future__ import annotations

import gc
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.llm.common import batch_of, shared_dir, ship, slices, write_file

MAGIC = b"WVM1"
#: Bits in a block that is compressed by itself: what one access has to open.
BLOCK = 1 << 19
#: Bits between two stored ranks.
STEP = 512
_ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


def pack(tokens: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray) -> bytes:
    """The file of one shard: header, documents and bit-planes, highest bit first."""
    n = len(tokens)
    levels = max(1, int(tokens.max()).bit_length()) if n else 1
    seq = tokens.astype(np.uint16 if levels <= 16 else np.uint32)
    press = zstandard.ZstdCompressor(level=1)
    body, zeros, planes = [], [], []

    def add(data: bytes) -> int:
        body.append(press.compress(data))
        return len(body[-1])

    ids = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    docs = [add(ids.tobytes()), add(np.ascontiguousarray(lengths, np.int64).tobytes()), add(np.packbits(pc.is_null(doc_ids).to_numpy(zero_copy_only=False)).tobytes())]
    for b in range(levels - 1, -1, -1):
        ones = (seq & seq.dtype.type(1 << b)) != 0
        bits = np.packbits(ones)
        planes.append([add(bits[i : i + BLOCK // 8].tobytes()) for i in range(0, len(bits), BLOCK // 8)])
        low = seq[np.flatnonzero(~ones)]
        zeros.append(len(low))
        seq = np.concatenate([low, seq[np.flatnonzero(ones)]])
    head = json.dumps({"n": n, "docs": docs, "levels": levels, "zeros": zeros, "planes": planes}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *body])


class WaveletFile:
    """A shard's file: token access, rank, select and occurrences by its bit-planes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet file")
        (size,) = struct.unpack_from("<I", data, 4)
        self.head = json.loads(data[8 : 8 + size])
        self._data, at = memoryview(data), 8 + size
        self._docs, self._at = [], []
        for x in self.head["docs"]:
            self._docs.append((at, x))
            at += x
        for plane in self.head["planes"]:
            self._at.append([])
            for x in plane:
                self._at[-1].append((at, x))
                at += x
        self.n, self.levels, self.zeros = self.head["n"], self.head["levels"], self.head["zeros"]
        self._blocks: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self._before: dict[int, np.ndarray] = {}

    def _open(self, at: int, size: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._data[at : at + size])

    @property
    def doc_ids(self) -> pa.Array:
        ids = np.frombuffer(self._open(*self._docs[0]), np.int64)
        return pa.array(ids, mask=np.unpackbits(np.frombuffer(self._open(*self._docs[2]), np.uint8), count=len(ids)).view(bool))

    @property
    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._open(*self._docs[1]), np.int64)

    def _block(self, level: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a block and the ones before every STEP-th bit of it."""
        if (level, k) not in self._blocks:
            raw = np.frombuffer(self._open(*self._at[level][k]), np.uint8)
            ones = np.add.reduceat(_ONES[raw].astype(np.int64), np.arange(0, len(raw), STEP // 8)) if len(raw) else np.zeros(0, np.int64)
            self._blocks[level, k] = raw, np.concatenate([[0], np.cumsum(ones)])
        return self._blocks[level, k]

    def _ones_before(self, level: int, k: int) -> int:
        """Ones in the blocks before block k."""
        if level not in self._before:
            self._before[level] = np.cumsum([0, *(int(self._block(level, j)[1][-1]) for j in range(len(self._at[level])))])
        return int(self._before[level][k])

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i <= 0:
            return 0
        k, r = divmod(i, BLOCK)
        if r == 0:
            return self._ones_before(level, k)
        raw, step = self._block(level, k)
        s, rest = divmod(r, STEP)
        whole, tail = divmod(rest, 8)
        at = s * (STEP // 8)
        ones = int(step[s]) + int(_ONES[raw[at : at + whole]].sum())
        return self._ones_before(level, k) + ones + (bin(int(raw[at + whole]) >> (8 - tail)).count("1") if tail else 0)

    def _bit(self, level: int, i: int) -> int:
        k, r = divmod(i, BLOCK)
        return int(self._block(level, k)[0][r >> 3]) >> (7 - (r & 7)) & 1

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            one = self._rank1(level, i)
            i = self.zeros[level] + one if bit else i - one
            token = token << 1 | bit
        return token

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences among the first i positions lie below the last plane."""
        if token < 0 or token >> self.levels:
            return 0, 0
        lo, hi = 0, min(max(i, 0), self.n)
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token among the first i positions."""
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane, by bisection over ranks."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            one = self._rank1(level, mid + 1)
            if (one if bit else mid + 1 - one) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All ids in order: the planes are undone from the lowest bit up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            raw = b"".join(self._open(*x) for x in self._at[level])
            ones, z = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool), self.zeros[level]
            seq[z:] |= kind(1 << (self.levels - 1 - level))
            out = np.empty_like(seq)
            out[np.flatnonzero(~ones)] = seq[:z]
            out[np.flatnonzero(ones)] = seq[z:]
            seq = out
        return seq


#: Kinds of bytes: ASCII letter, other visible ASCII character, plain white space; 0 for all others.
_LETTER, _MARK, _SPACE = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[[0x20, 0x0A, 0x0D, 0x09]] = _SPACE
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def part_starts(raw: np.ndarray) -> np.ndarray:
    """Marks bytes at which a piece of the byte-level pattern begins for certain, whatever stands before and behind.

    A letter's piece ends before any other visible ASCII character, and no piece runs from a visible character into white space. Letters are
    those of ASCII and U+00C0 to U+023F (all but two signs); other characters never take part in a cut.
    """
    kind = _KIND[raw]
    late = (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC8) & ~((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)))
    kind[1:][late] = _LETTER
    cut = np.zeros(len(raw) + 1, bool)
    before, here = kind[:-1], kind[1:]
    cut[1:-1] = ((here == _SPACE) & ((before == _LETTER) | (before == _MARK))) | ((here == _MARK) & (before == _LETTER))
    return cut


def _apt(part: bytes) -> bool:
    """Does a part start with plain white space and end in a character that is visible for certain?"""
    end, lead = part[-1], part[-2] if len(part) > 1 else 0
    return part[0] in b" \n\r\t" and (0x20 < end < 0x7F or (end >= 0x80 and 0xC3 <= lead <= 0xC8 and not (lead == 0xC3 and end in b"\x97\xb7")))


class PartTable:
    """Known parts and their ids in flat arrays: an open hash table over parts of up to 16 bytes, compared whole, and a dict for longer ones."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.n, self.used = 0, 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.keys = np.zeros((3, 1 << 15), np.uint64)  # first and second eight bytes, length
        self.at, self.count = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    @property
    def nbytes(self) -> int:
        return self.slots.nbytes + self.keys.nbytes + self.at.nbytes + self.count.nbytes + self.pool.nbytes + self.long_bytes

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        h = (keys[0] ^ (keys[0] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + keys[1] * np.uint64(0xC2B2AE3D27D4EB4F) + keys[2]
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where it is unknown."""
        slot = (self._hash(keys) >> np.uint64(32)).astype(np.int64) & (len(self.slots) - 1)
        out = self.slots[slot]
        same = out >= 0
        for k in range(3):
            same &= self.keys[k][out] == keys[k]
        left = np.flatnonzero((out >= 0) & ~same)
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
            entry = self.slots[slot[left]]
            out[left] = entry
            same = (self.keys[:, entry] == keys[:, left]).all(axis=0)
            left = left[(entry >= 0) & ~same]
        return out

    def add(self, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """New entries with these ids, in no hash table yet."""
        first, need = self.n, self.n + len(counts)
        if need > len(self.at):
            more = lambda x: np.concatenate([x, np.zeros((*x.shape[:-1], need), x.dtype)], axis=-1)
            self.keys, self.at, self.count = more(self.keys), more(self.at), more(self.count)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(self.used + len(ids), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.count[first:need] = counts
        self.at[first:need] = self.used + np.cumsum(counts) - counts
        self.n, self.used = need, self.used + len(ids)
        return np.arange(first, need)

    def remember(self, entries: np.ndarray, keys: np.ndarray) -> None:
        """Puts new entries with different keys in the hash table."""
        self.keys[:, entries] = keys
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << int(4 * self.n).bit_length(), -1, np.int32)
            entries = np.flatnonzero(self.keys[2, : self.n])
        slot = (self._hash(self.keys[:, entries]) >> np.uint64(32)).astype(np.int64) & (len(self.slots) - 1)
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            left = self.slots[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & (len(self.slots) - 1)


class ChunkEncoder:
    """The tokenizers library's ids of whole texts; parts that recur are encoded once for each worker.

    Where the file uses the byte-level pattern without a normalizer, texts are cut as in `part_starts` and a text's ids are those of its parts.
    With any other file, and for texts that hold the string of an added token, the library gets the whole text. The table of known parts is
    emptied when it holds over `most` bytes; that changes no result.
    """

    def __init__(self, path: str, end_id: int, most: int = 256 << 20):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        config = json.loads(self.tok.to_str())
        pre = config.get("pre_tokenizer") or {}
        model = config["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not config.get("normalizer")
        self.cuts = bool(plain and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
        self.added = [x["content"] for x in config.get("added_tokens", ())]
        vocab = self.tok.get_vocab()
        if max(vocab.values(), default=0) >= 1 << 32:
            raise ValueError("ids of over 32 bits")
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, i in vocab.items():
            self.size[i] = len(piece)  # in the byte-level alphabet a character stands for a byte
        self.most, self.end, self.table = most, end_id, PartTable()

    def _singly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of texts that are encoded one by one."""
        found = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.uint32)

    def _joined(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of parts that start with white space and end in a visible character: joined, they are cut again where they meet."""
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for k in range(0, len(parts), 8000):
            some = parts[k : k + 8000]
            got = np.array(self.tok.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)[0].ids, np.int64)
            ends, sizes = np.cumsum([len(x) for x in some]), np.cumsum(self.size[got])
            at = np.searchsorted(sizes, ends) + 1
            if (sizes[at - 1] != ends).any():
                raise AssertionError("a piece runs over a cut")
            counts.append(np.diff(at, prepend=0))
            ids.append(got.astype(np.uint32))
        return np.concatenate(counts), np.concatenate(ids)

    def _encoded(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of parts, in their order."""
        apt = np.array([_apt(x) for x in parts], bool)
        order = np.concatenate([np.flatnonzero(apt), np.flatnonzero(~apt)])
        a, b = self._joined([parts[k] for k in np.flatnonzero(apt)]), self._singly([parts[k].decode() for k in np.flatnonzero(~apt)])
        counts, ids = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        return _reordered(counts, ids, np.argsort(order, kind="stable"))

    def _entries(self, raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The table's entry of each part; unknown parts are encoded first."""
        table, out = self.table, np.full(len(starts), -1, np.int64)
        pad = np.concatenate([raw, np.zeros(16, np.uint8)])
        words = np.ndarray(len(pad) - 7, "<u8", pad, strides=(1,))
        short = np.flatnonzero(lens <= 16)
        s, n = starts[short], lens[short]
        keys = np.stack([words[s] & _KEEP[np.minimum(n, 8)], words[s + 8] & _KEEP[np.maximum(n - 8, 0)], n.astype(np.uint64)])
        found = table.find(keys)
        miss = np.flatnonzero(found < 0)
        while len(miss):
            # one of the parts with the same hash is learned; the others meet it in the table, or are learned in another turn
            _, one = np.unique(table._hash(keys[:, miss]), return_index=True)
            new = miss[one]
            parts = [pad[a : a + b].tobytes() for a, b in zip(s[new].tolist(), n[new].tolist())]
            table.remember(table.add(*self._encoded(parts)), keys[:, new])
            found[miss] = table.find(keys[:, miss])
            miss = miss[found[miss] < 0]
        out[short] = found
        rest = np.flatnonzero(out < 0)
        parts = [pad[a : a + b].tobytes() for a, b in zip(starts[rest].tolist(), lens[rest].tolist())]
        new = list({x: None for x in parts if x not in table.long})
        known = dict(zip(new, table.add(*self._encoded(new)).tolist())) if new else {}
        out[rest] = [known[x] if x in known else table.long[x] for x in parts]
        for x, k in known.items():
            if len(x) <= 1024:
                table.long[x] = k
                table.long_bytes += len(x) + 150
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind it, and their numbers."""
        gc.disable()  # very many small lists and no cycles: collections would only walk through the tables
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        table = self.table
        if table.nbytes > self.most:
            table.clear()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        alone = np.full(len(texts), not self.cuts)
        for x in self.added:
            alone |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        alone &= np.diff(ends) > 0
        cut = part_starts(raw) if len(raw) else np.zeros(1, bool)
        cut[ends] = True
        for k in np.flatnonzero(alone):
            cut[ends[k] : ends[k + 1]] = False
        starts = np.flatnonzero(cut[:-1])
        # the last part before a text of its own ends where that begins
        stops = np.append(starts[1:], len(raw))
        heads = ends[:-1][alone]
        if len(heads):
            near = np.append(heads, len(raw))[np.searchsorted(heads, starts, "right")]
            stops = np.minimum(stops, near)
        entries = self._entries(raw, starts, stops - starts)
        whole = table.add(*self._singly([texts[int(k)].as_py() for k in np.flatnonzero(alone)]))
        end = table.add(np.array([1]), np.array([self.end], np.uint32))
        # a text's own entry stands where its parts would, the end id behind each text
        place, own = np.searchsorted(starts, ends), np.flatnonzero(alone)
        order = np.argsort(np.concatenate([2 * own, 2 * np.arange(len(texts)) + 1]))
        entries = np.insert(entries, np.concatenate([place[own], place[1:]])[order], np.concatenate([whole, np.repeat(end, len(texts))])[order])
        counts, ids = table.count[entries], _gathered(table.pool, table.at[entries], table.count[entries])
        upto = np.concatenate([[0], np.cumsum(counts)])
        bounds = place + np.arange(len(place)) + np.concatenate([[0], np.cumsum(alone)])
        return ids, np.diff(upto[bounds])


def _gathered(pool: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """pool[at : at + count] for all, joined."""
    ends = np.cumsum(counts)
    return pool[np.repeat(at - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


def _reordered(counts: np.ndarray, ids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.cumsum(counts) - counts
    return counts[order], _gathered(ids, at[order], counts[order])


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, end_id: int) -> ChunkEncoder:
    """One for each Python worker."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = ChunkEncoder(path, end_id)
    return _ENCODERS[path, end_id]


MANIFEST = "part int, k int, shard string, first_doc long, n_docs long, shard_tokens long"
ROWS = pa.schema([("shard", pa.string()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("row", pa.int64())])


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int, shard_tokens: int = 2_000_000, partitions: int | None = None) -> DataFrame:
    """Encodes `doc_id, text`, writes wavelet files below `out`, and returns the manifest: one row for each file.

    Documents are dealt by ranges of doc_id, so the files' names are in doc_id order; a file is closed when it holds `shard_tokens`.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("part", pa.int32()), ("k", pa.int32()), ("shard", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("shard_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer, end_id), TaskContext.get().partitionId()
        held, size, k = [], 0, 0

        def close():
            nonlocal held, size, k
            ids, tokens, lengths = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            name = f"shard-{part:06d}-{k:05d}.wvm"
            write_file(f"{out}/{name}", pack(tokens, ids, lengths))
            row = batch_of(schema, part=[part], k=[k], shard=[name], first_doc=ids.slice(0, 1), n_docs=[len(ids)], shard_tokens=[len(tokens)])
            held, size, k = [], 0, k + 1
            return row

        for b in slices(batches, "text", 8 << 20):
            tokens, lengths = enc.encode(b.column(1))
            upto, done = np.cumsum(lengths), 0
            while done < len(lengths):
                # as far as the document that fills the shard
                before = int(upto[done - 1]) if done else 0
                stop = min(int(np.searchsorted(upto, before + shard_tokens - size)) + 1, len(lengths))
                held.append((b.column(0).slice(done, stop - done), tokens[before : int(upto[stop - 1])], lengths[done:stop]))
                size += int(upto[stop - 1]) - before
                done = stop
                if size >= shard_tokens:
                    yield close()
        if held:
            yield close()

    # the second key splits an id that very many rows share
    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id"), F.left("text", F.lit(32))).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, MANIFEST)


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    """Reads wavelet files: shard, doc_id, at (ids of the shard before it), n_tokens, ids_crc32, row (number in the shard)."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                f = WaveletFile(content.as_buffer().to_pybytes())
                raw, ends = f.tokens().astype("<u4").tobytes(), np.cumsum(f.lengths)
                at = ends - f.lengths
                crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(at.tolist(), ends.tolist())]
                yield batch_of(ROWS, shard=[path.as_py().rpartition("/")[2]] * len(at), doc_id=f.doc_ids, at=at, n_tokens=f.lengths, ids_crc32=crc, row=np.arange(len(at)))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(out).select("path", "content")
    return files.mapInArrow(read, "shard string, doc_id long, at long, n_tokens long, ids_crc32 long, row long")


def token_shards(docs: DataFrame, tokenizer: str, end_id: int, out: str | None = None, **options) -> DataFrame:
    """Writes the shards, reads them again and returns doc_id, start, n_tokens, ids_crc32, shard and at for each document."""
    spark = docs.sparkSession
    out = out or shared_dir(spark, "wavelet")
    manifest = f"{out}-manifest"
    write_shards(docs, out, tokenizer, end_id, **options).write.parquet(manifest)
    shards = spark.read.parquet(manifest)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, at long")
    # ids before a shard: those of earlier partitions (one row for each partition in this window) and of earlier files of its own
    parts = shards.groupBy("part").agg(F.sum("shard_tokens").alias("tokens"))
    ahead = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", ahead("tokens", Window.orderBy("part")).alias("earlier"))
    own = shards.select("part", "shard", ahead("shard_tokens", Window.partitionBy("part").orderBy("k")).alias("own"))
    starts = own.join(parts, "part").select("shard", (F.col("earlier") + F.col("own")).alias("before"))
    rows = read_shards(spark, out).join(starts, "shard")
    return rows.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard", "at")
