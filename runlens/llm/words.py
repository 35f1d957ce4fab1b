"""Words of many texts at once: distinct words, and for each word of each text its number and its row.

A word is a maximal run of bytes that a table of 256 entries doesn't turn into blanks; the table also makes A-Z lower case. Bytes of characters beyond
ASCII stay as they are, so a word never ends inside a character, and no word runs from one text into the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def fold_table(digits: bool) -> bytes:
    """a-z, characters beyond ASCII and, if asked for, 0-9 stay, A-Z become a-z, everything else is a blank."""
    return bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 or (digits and 48 <= c <= 57) else 32 for c in range(256))


class Words:
    """`words` (distinct, large binary), and for each occurrence `word` (its number) and `row` (its text), in the order of the texts."""

    def __init__(self, texts: pa.Array, table: bytes):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        raw = np.frombuffer((memoryview(data)[ends[0] : ends[-1]].tobytes() if data is not None else b"").translate(table), np.uint8)
        ends = ends - ends[0]
        solid = raw != 32
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        heads = ends[:-1][ends[:-1] < len(raw)]
        first[heads] = solid[heads]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        heads = heads[heads > 0] - 1
        last[heads] = solid[heads]
        starts = np.flatnonzero(first)
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(np.flatnonzero(last) + 1 - starts, out=offsets[1:])
        joined = raw[solid]
        del raw, solid, first, last
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
        coded = every.dictionary_encode()
        del every, offsets, joined
        self.n_rows = len(texts)
        self.words = coded.dictionary
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.searchsorted(ends, starts, "right") - 1

    def bytes_and_offsets(self) -> tuple[np.ndarray, np.ndarray]:
        """All distinct words joined, and where each begins."""
        if not len(self.words):
            return np.zeros(0, np.uint8), np.zeros(1, np.int64)
        offsets = np.frombuffer(self.words.buffers()[1], np.int64)[self.words.offset : self.words.offset + len(self.words) + 1]
        return np.frombuffer(self.words.buffers()[2], np.uint8), offsets
