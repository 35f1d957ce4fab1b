"""A unigram model over a double-array trie of pieces, for encoding and for counting.

Pieces and their scores come from a SentencePiece model file. That file's own scores may be merge ranks; `scores="log"` turns the ranks into log
probabilities by Zipf's rule (the k-th piece has a probability in proportion to 1 / k), `scores="file"` takes them as they are. Bytes without a
piece fall back to the byte pieces at a score below any other, so they are used for characters that no piece covers and for nothing else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

#: The mark that stands for a blank.
MARK = "▁"


class DoubleArray:
    """A trie over bytes in two arrays: the child of state s by byte b is base[s] + b + 1 if check there is s. value: number or -1."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=lambda k: keys[k])
        self.size = 1 << 10
        self.base, self.check, self.value = np.zeros(self.size, np.int32), np.full(self.size, -1, np.int32), np.full(self.size, -1, np.int32)
        self.check[0] = 0
        free = np.ones(self.size, bool)
        free[0] = False
        start = 257  # below, no base that isn't negative reaches every place
        todo = [(0, 0, len(order), 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            if lo < hi and len(keys[order[lo]]) == depth:
                self.value[state] = values[order[lo]]
                lo += 1
            if lo >= hi:
                continue
            heads, at = [], lo
            for k in range(lo, hi):
                b = keys[order[k]][depth]
                if not heads or heads[-1][0] != b:
                    heads.append((b, k))
            codes = np.array([b + 1 for b, _ in heads])
            while not free[start]:
                start += 1
                if start + 1 == len(free):
                    free = np.concatenate([free, np.ones(len(free), bool)])
            if len(codes) == 1:
                base = start - int(codes[0])
                if base + 257 >= len(free) - 1:
                    free = np.concatenate([free, np.ones(len(free), bool)])
            else:
                # where all children find a free place: many bases are tried at once
                begin = start - int(codes[0])
                while True:
                    while begin + 1024 + 257 >= len(free):
                        free = np.concatenate([free, np.ones(len(free), bool)])
                    fits = free[np.arange(begin, begin + 1024)[:, None] + codes].all(axis=1)
                    if fits.any():
                        base = begin + int(np.argmax(fits))
                        break
                    begin += 1024
            free[base + codes] = False
            self._reach(len(free))
            self.base[state] = base
            self.check[base + codes] = state
            for n, (b, at) in enumerate(heads):
                todo.append((base + b + 1, at, heads[n + 1][1] if n + 1 < len(heads) else hi, depth + 1))
        self._reach(len(free) + 257)

    def _reach(self, n: int) -> None:
        if n > self.size:
            grown = n - self.size
            self.base, self.check, self.value = (np.concatenate([x, np.full(grown, fill, np.int32)]) for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))
            self.size = n

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is no child, and from -1."""
        to = self.base[np.maximum(state, 0)] + byte + 1
        return np.where((state >= 0) & (self.check[to] == state), to, -1)


@dataclass
class Pieces:
    """Vocabulary with log scores. pieces[i] is the text of id i; only normal pieces are in the trie."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    trie: DoubleArray
    longest: int
    fallback: float

    @classmethod
    def load(cls, path: str, scores: str = "log") -> Pieces:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        byte_ids = np.full(256, -1, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                byte_ids[int(names[i][1:-1], 16)] = i
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        value = np.array([sp.get_score(i) for i in range(n)], np.float64)
        if scores == "log":
            rank = np.empty(len(normal))
            rank[np.argsort(-value[normal], kind="stable")] = np.arange(1, len(normal) + 1)
            value[normal] = -np.log(rank) - np.log(np.sum(1 / np.arange(1, len(normal) + 1)))
        elif scores != "file":
            raise ValueError(scores)
        keys = [names[i].encode() for i in normal]
        # a piece's marks all stand at its start, so that a text may be cut before a run of them
        if any(MARK in names[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece has a blank inside")
        longest = max(map(len, keys))
        return cls(names, value, byte_ids, DoubleArray(keys, normal), longest, float(value[normal].min()) - 10)


#: Stands in the parts of a text for a mark of the text itself; it is spelled by byte pieces.
OWN = "\0own"
_RUN, _REST = re.compile(f"{MARK}+[^{MARK}]*"), re.compile(f"[^{MARK}]+|{MARK}+[^{MARK}]*")


def parts_of(text: str) -> list[str]:
    """Cuts a text, with a blank put before it, before each run of blanks, and writes marks for blanks. No piece reaches over such a cut."""
    if MARK in text:
        first, *others = text.split(MARK)
        out = parts_of(first)
        for other in others:
            out.append(OWN)
            out += _REST.findall(other.replace(" ", MARK))
        return out
    if "  " in text or text.startswith(" "):
        return _RUN.findall(MARK + text.replace(" ", MARK))
    return (MARK + text.replace(" ", f" {MARK}")).split(" ")


class Forest:
    """Places of many chunks as nodes with parents, level by level: node 0 is the start; `shared` merges equal prefixes into a trie."""

    def __init__(self, data: list[bytes], shared: bool):
        self.data = data
        size = np.fromiter(map(len, data), np.int64, len(data))
        text, at = np.frombuffer(b"".join(data), np.uint8), np.cumsum(size) - size
        node = np.zeros(len(data), np.int64)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # first node, parents, bytes
        self.n, live, step = 1, np.arange(len(data)), 0
        while True:
            live = live[size[live] > step]
            if not len(live):
                break
            byte = text[at[live] + step].astype(np.int64)
            key = node[live] << 8 | byte
            if shared:
                unique, place = np.unique(key, return_inverse=True)
            else:
                unique, place = key, np.arange(len(key))
            self.levels.append((self.n, unique >> 8, unique & 255))
            node[live] = self.n + place
            self.n += len(unique)
            step += 1
        self.terminal = node


def best_paths(pieces: Pieces, forest: Forest, spelled: dict[int, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward dynamic program over a forest: for each node best score, number of pieces, last piece and the node before it.

    All nodes of a level go together. Each node carries the trie states of the pieces that began at its last `longest` ancestors, which it
    takes from its parent, so the work for a prefix is done once, however many chunks share it. Ties go to the longer last piece.
    """
    n, trie = forest.n, pieces.trie
    score, count = np.zeros(n), np.zeros(n, np.int32)
    last, before = np.full(n, -1, np.int32), np.zeros(n, np.int64)
    width = pieces.longest
    states = np.zeros((1, 1), np.int32)  # of the previous level: nodes x starts, newest first; a new start is at the root
    origins = np.zeros((1, 1), np.int64)
    first_before = 0
    for first, parent, byte in forest.levels:
        rows = parent - first_before
        went = trie.step(states[rows], byte[:, None])
        origin = origins[rows]
        value = trie.value[np.maximum(went, 0)]
        ok = (went >= 0) & (value >= 0)
        gain = np.where(ok, score[origin] + pieces.scores[np.where(ok, value, 0)], -np.inf)
        pick = gain.shape[1] - 1 - np.argmax(gain[:, ::-1], axis=1)
        k = np.arange(len(rows))
        found = gain[k, pick]
        fall = score[parent] + pieces.fallback
        use = found >= fall
        here = slice(first, first + len(rows))
        score[here] = np.where(use, found, fall)
        last[here] = np.where(use, value[k, pick], pieces.byte_ids[byte])
        before[here] = np.where(use, origin[k, pick], parent)
        count[here] = count[before[here]] + 1
        # what still lives goes on, with a new start at each node
        own = np.arange(first, first + len(rows))[:, None]
        live = np.flatnonzero((went >= 0).any(axis=0))[: width - 1]
        states = np.concatenate([np.zeros((len(rows), 1), np.int32), went[:, live].astype(np.int32)], axis=1)
        origins = np.concatenate([own, origin[:, live]], axis=1)
        first_before = first
    return score, count, last, before


def spell(last: np.ndarray, before: np.ndarray, count: np.ndarray, terminal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks, one after the other, and where each begins: all chunks step back together."""
    size = count[terminal].astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    ids, at, node = np.zeros(int(start[-1]), np.int32), start[1:] - 1, terminal.copy()
    live = np.flatnonzero(size > 0)
    while len(live):
        ids[at[live]] = last[node[live]]
        at[live] -= 1
        node[live] = before[node[live]]
        live = live[at[live] >= start[live]]
    return ids, start


#: Bytes from which a part is walked alone: a level of a forest with one node costs as much as one with thousands.
LONG = 400


def long_path(pieces: Pieces, data: bytes, window: int = 1 << 16) -> np.ndarray:
    """Ids of the best path of one long part, as `best_paths` finds it: the same sums in the same order, ties to the longer last piece.

    The pieces that begin in a window of places are looked up together; the path takes them place by place. Time is linear in the part.
    """
    n, longest, trie, fall = len(data), pieces.longest, pieces.trie, pieces.fallback
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    last, size = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    none = float("-inf")
    best, how, long = [0.0], [0], [0]  # of the places from the window's first on: score, piece and its length
    for a in range(0, n, window):
        b = min(a + window, n)
        state, at, found = np.zeros(b - a, np.int64), np.arange(a, b), []
        for k in range(longest):
            inside = at + k < n
            state, at = state[inside], at[inside]
            state = trie.step(state, raw[at + k])
            live = state >= 0
            state, at = state[live], at[live]
            if not len(at):
                break
            ends = trie.value[state] >= 0
            found.append(np.stack([at[ends], np.full(int(ends.sum()), k + 1), trie.value[state[ends]]]))
        starts, lengths, ids = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        order = np.argsort(starts, kind="stable")
        bounds = np.searchsorted(starts[order], np.arange(a, b + 1)).tolist()
        gains, lengths, ids = pieces.scores[ids[order]].tolist(), lengths[order].tolist(), ids[order].tolist()
        for x, fill in ((best, none), (how, 0), (long, 0)):
            x.extend([fill] * (b - a + longest + 1 - len(x)))
        bytes_here = data[a:b]
        for s in range(b - a):
            score = best[s]
            for k in range(bounds[s], bounds[s + 1]):
                to = s + lengths[k]
                gain = score + gains[k]
                if gain > best[to]:
                    best[to], how[to], long[to] = gain, ids[k], lengths[k]
            # all pieces that end at the next place are known now
            if best[s + 1] < score + fall:
                best[s + 1], how[s + 1], long[s + 1] = score + fall, -1 - bytes_here[s], 1
        last[a + 1 : b + 1], size[a + 1 : b + 1] = how[1 : b - a + 1], long[1 : b - a + 1]
        best, how, long = best[b - a :], how[b - a :], long[b - a :]
    out, at = [], n
    while at:
        out.append(int(last[at]))
        at -= int(size[at])
    ids = np.array(out[::-1], np.int64)
    return np.where(ids < 0, pieces.byte_ids[np.where(ids < 0, -1 - ids, 0)], ids).astype(np.int32)
