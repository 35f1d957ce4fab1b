"""Language ID by a bidirectional gated recurrent network over bytes.

`fit` trains the network in numpy by backpropagation through time on a bounded, documented sample: about `per_lang` labelled documents of each
language, `windows` windows of `train_window` bytes each. `predicted` reads whole texts in windows of `window` bytes: the network labels every
position with language probabilities, and a document's probabilities are their mean over all of its positions.

Gates use x / (1 + |x|) in place of tanh and its shifted half in place of the logistic function: as good here, and cheaper.
At most `MOST_LANGS` languages are learned, those with the most rows (ties by name). A position's label comes from its window of a text too, so that
`labels` and `predicted` speak of the same probabilities. Time is linear in a text, so texts may be of any length.
Defined results: a null text or one without letters is `und` with score 0; with no labelled rows every document is `und` with score 0; with one
language everything with letters is that language; an empty table gives no rows; repeated rows are predicted each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import ship, slices

LETTER = re.compile(r"[^\W\d_]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Most languages that are learned.
MOST_LANGS = 500
#: Bytes that the network reads at a time.
WINDOW = 128


@dataclass
class Network:
    """Axis 0 of the recurrent weights is the direction: 0 reads on, 1 reads back."""

    langs: list[str]
    embed: np.ndarray  # 2 x 256 x 3H: what a byte adds to update gate, reset gate and candidate
    recur: np.ndarray  # 2 x H x 3H
    out: np.ndarray  # 2H x languages
    bias: np.ndarray

    @classmethod
    def new(cls, langs: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(langs, draw(2, 256, 3 * hidden, scale=0.3), draw(2, hidden, 3 * hidden, scale=hidden**-0.5), draw(2 * hidden, len(langs), scale=0.2), np.zeros(len(langs), np.float32))

    def run(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x, mask: positions x lanes. Returns the states, positions x 2 x lanes x H; of direction 1 in reading order. keep: gets what backward() needs."""
        steps, lanes = x.shape
        width = self.recur.shape[1]
        both, live = np.stack([x, x[::-1]], 1), np.stack([mask, mask[::-1]], 1)[..., None]
        states, h = np.empty((steps, 2, lanes, width), np.float32), np.zeros((2, lanes, width), np.float32)
        gx, gates = np.empty((2, lanes, 3 * width), np.float32), np.empty((2, lanes, 2 * width), np.float32)
        size = np.empty_like(gates)
        for t in range(steps):
            np.take(self.embed[0], both[t, 0], axis=0, out=gx[0])
            np.take(self.embed[1], both[t, 1], axis=0, out=gx[1])
            gh = h @ self.recur
            np.add(gx[..., : 2 * width], gh[..., : 2 * width], out=gates)
            np.abs(gates, out=size)
            size += 1
            gates /= size
            z, r = gates[..., :width] * 0.5 + 0.5, gates[..., width:] * 0.5 + 0.5
            n = r * gh[..., 2 * width :]
            n += gx[..., 2 * width :]
            n /= np.abs(n) + 1
            new = h - n
            new *= z
            new += n
            new *= live[t]
            if keep is not None:
                keep.append((h, gates.copy(), z, r, gh[..., 2 * width :].copy(), n))
            states[t] = h = new
        return states

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """Language probabilities at every position: positions x lanes x languages."""
        width = self.recur.shape[1]
        score = states[:, 0] @ self.out[:width]
        score += states[::-1, 1] @ self.out[width:]
        score += self.bias
        score -= score.max(axis=-1, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(axis=-1, keepdims=True)
        return score

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over positions, and gradients of embed, recur, out and bias by backpropagation through time."""
        keep: list = []
        states = self.run(x, mask, keep)
        p = self.probabilities(states)
        steps, lanes, width = *x.shape, self.recur.shape[1]
        total = max(float(mask.sum()), 1.0)
        loss = float(-(np.log(p[:, np.arange(lanes), y] + 1e-9) * mask).sum() / total)
        d = p.copy()
        d[:, np.arange(lanes), y] -= 1
        d *= mask[..., None] / total
        ahead, back = states[:, 0], states[::-1, 1]
        g_out = np.concatenate([np.einsum("tbh,tbk->hk", ahead, d), np.einsum("tbh,tbk->hk", back, d)])
        g_bias = d.sum((0, 1))
        to_states = np.stack([d @ self.out[:width].T, (d @ self.out[width:].T)[::-1]], 1)
        live = np.stack([mask, mask[::-1]], 1)[..., None]
        g_recur, carry = np.zeros_like(self.recur), np.zeros((2, lanes, width), np.float32)
        to_input = np.empty((steps, 2, lanes, 3 * width), np.float32)
        for t in range(steps - 1, -1, -1):
            h, gates, z, r, m, n = keep[t]
            dh = (carry + to_states[t]) * live[t]
            dc = dh * (1 - z) * (1 - np.abs(n)) ** 2
            slope = 0.5 * (1 - np.abs(gates)) ** 2
            dz, dr = dh * (h - n) * slope[..., :width], dc * m * slope[..., width:]
            to_input[t] = np.concatenate([dz, dr, dc], -1)
            dg = np.concatenate([dz, dr, dc * r], -1)
            g_recur += h.transpose(0, 2, 1) @ dg
            carry = dh * z + dg @ self.recur.transpose(0, 2, 1)
        g_embed = np.zeros_like(self.embed)
        for k, seen in enumerate((x, x[::-1])):
            hot = np.zeros((seen.size, 256), np.float32)
            hot[np.arange(seen.size), seen.ravel()] = 1
            g_embed[k] = hot.T @ to_input[:, k].reshape(seen.size, -1)
        return loss, [g_embed, g_recur, g_out, g_bias]

    def pooled(self, texts: list[bytes], window: int, lanes: int = 1024) -> np.ndarray:
        """Mean language probabilities over all positions of each text (rows of zeros for empty ones)."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        parts = -(-size // window)
        total = np.zeros((len(texts), len(self.langs)))
        if not parts.sum():
            return total
        raw = np.frombuffer(b"".join(texts), np.uint8)
        owner = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = (np.cumsum(size) - size)[owner] + nth * window
        length = np.minimum(window, size[owner] - nth * window)
        order = np.argsort(-length, kind="stable")  # lanes of like length go together
        sums = np.zeros((len(owner), len(self.langs)))
        for i in range(0, len(order), lanes):
            some = order[i : i + lanes]
            steps = np.arange(int(length[some[0]]))[:, None]
            mask = steps < length[some]
            x = np.where(mask, raw[np.minimum(begin[some] + steps, len(raw) - 1)], 0)
            p = self.probabilities(self.run(x, mask.astype(np.float32)))
            sums[some] = np.einsum("tbk,tb->bk", p, mask.astype(np.float32))
        np.add.at(total, owner, sums)
        return total / np.maximum(size, 1)[:, None]

    def labels(self, text: str, window: int = WINDOW) -> list[str]:
        """The language of every byte position of a text, read in the same windows as in `pooled`."""
        raw = text.encode().translate(_LOWER)
        if not raw or not self.langs:
            return []
        size = -(-len(raw) // window)
        x = np.frombuffer(raw.ljust(size * window, b"\0"), np.uint8).reshape(size, window).T
        mask = (np.arange(size * window) < len(raw)).astype(np.float32).reshape(size, window).T
        best = np.concatenate([self.probabilities(self.run(x[:, i : i + 1024], mask[:, i : i + 1024])).argmax(-1).T.ravel() for i in range(0, size, 1024)])
        return [self.langs[k] for k in best[: len(raw)].tolist()]


def train(net: Network, x: np.ndarray, mask: np.ndarray, y: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> list[float]:
    """Adam over random batches of lanes; the step size falls to a tenth. Returns the losses."""
    rng, weights, losses = np.random.default_rng(seed), [net.embed, net.recur, net.out, net.bias], []
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for k in range(1, steps + 1):
        some = rng.choice(x.shape[1], min(batch, x.shape[1]), replace=False)
        loss, grads = net.gradients(x[:, some], mask[:, some], y[some])
        losses.append(loss)
        norm = float(np.sqrt(sum((g**2).sum() for g in grads)))
        for w, g, m, s in zip(weights, grads, mean, square):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            s += 0.001 * (g**2 - s)
            w -= rate * 0.1 ** (k / steps) * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return losses


def fit(docs: DataFrame, learn: Column | None = None, per_lang: int = 800, windows: int = 3, train_window: int = 64, hidden: int = 12, steps: int = 240, batch: int = 256, rate: float = 0.02, seed: int = 3) -> Network:
    """Trains on rows with a lang that meet `learn`: those whose doc_id hashes below a share that leaves about `per_lang` of each language."""
    ship(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows if learn is None else rows.where(learn)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    found = {r.lang: r.n for r in counts.orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()}
    langs = sorted(found)
    net = Network.new(langs, hidden, seed)
    if len(langs) < 2:
        return net
    share = F.create_map([F.lit(x) for lang in langs for x in (lang, per_lang / found[lang])])
    drawn = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    some = rows.where(drawn < share[F.col("lang")]).select("doc_id", "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            got: dict[str, list] = {"doc_id": [], "nth": [], "lang": [], "part": []}
            for i, lang, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                raw = text.encode().translate(_LOWER)
                spread = max(len(raw) - train_window, 0)
                for k, at in enumerate(sorted({spread * j // max(windows - 1, 1) for j in range(windows)})):
                    if raw:
                        for n, x in zip(got, (i, k, lang, raw[at : at + train_window])):
                            got[n].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(got["doc_id"], pa.int64()), pa.array(got["nth"], pa.int32()), pa.array(got["lang"], pa.string()), pa.array(got["part"], pa.binary())], names=[*got])

    # the order must not depend on how the rows were dealt
    sample = some.mapInArrow(cut, "doc_id long, nth int, lang string, part binary").orderBy("doc_id", "nth", "part", "lang").limit(3 * per_lang * windows * len(langs)).collect()
    if not sample:
        return net
    x, mask = np.zeros((train_window, len(sample)), np.uint8), np.zeros((train_window, len(sample)), np.float32)
    for k, r in enumerate(sample):
        x[: len(r.part), k], mask[: len(r.part), k] = np.frombuffer(bytes(r.part), np.uint8), 1
    train(net, x, mask, np.array([langs.index(r.lang) for r in sample]), steps, batch, rate, seed)
    return net


def predicted(docs: DataFrame, net: Network, window: int = WINDOW) -> DataFrame:
    """doc_id, lang_pred and score (its pooled probability) of every whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in slices(batches, "text", 4 << 20):
            texts = [t if t and LETTER.search(t) else "" for t in b.column(1).to_pylist()]
            if not net.langs:
                names, score = ["und"] * len(texts), np.zeros(len(texts))
            else:
                p = net.pooled([t.encode().translate(_LOWER) for t in texts], window)
                best = p.argmax(1)
                names, score = [net.langs[k] if t else "und" for k, t in zip(best.tolist(), texts)], np.minimum(p[np.arange(len(p)), best], 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
