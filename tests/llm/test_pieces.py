import base64
import math
import random
import time

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from runlens.llm import pieces, token_counts, unigram
from runlens.llm.unigram import MARK, DoubleArray, Pieces

PATH = P.path("piece_bpe_32k.model")
ENC, COUNT = pieces.encoder(PATH, "log"), token_counts.Counter(PATH)
TABLE = {ENC.pieces.pieces[i].encode(): float(ENC.pieces.scores[i]) for i in range(len(ENC.pieces.pieces)) if i > 2 and i not in set(ENC.pieces.byte_ids.tolist())}


def best_score(text):
    """Viterbi over the whole text, byte by byte, without parts, tries or caches."""
    raw, own = bytearray(MARK.encode()), set()
    for c in text:
        if c == MARK:
            own.update(range(len(raw), len(raw) + 3))
        raw += MARK.encode() if c == " " else c.encode()
    best = [0.0] + [-math.inf] * len(raw)
    for j in range(1, len(raw) + 1):
        best[j] = best[j - 1] + ENC.pieces.fallback
        for n in range(1, min(ENC.pieces.longest, j) + 1):
            s = bytes(raw[j - n : j])
            if s in TABLE and not own.intersection(range(j - n, j)):
                best[j] = max(best[j], best[j - n] + TABLE[s])
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from([*"abcdefghij THE ing\n\t ", MARK, "é", "日", "😀", "\0"]), max_size=60))
def test_best_and_lossless(text):
    ids = ENC.encode([text])[0].tolist()
    assert ENC.decode(ids) == text and COUNT.counts([text])[0][0] == len(ids)
    if text:
        by = set(ENC.pieces.byte_ids.tolist())
        assert abs(sum(ENC.pieces.fallback if i in by else ENC.pieces.scores[i] for i in ids) - best_score(text)) < 1e-6


def test_double_array():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\xfe", b"zz"]
    trie = DoubleArray(keys, list(range(len(keys))))
    import numpy as np

    for word in [*keys, b"ac", b"z", b"abcd", b"\xff"]:
        state = np.array([0])
        for c in word:
            state = trie.step(state, np.array([c]))
        value = int(trie.value[state[0]]) if state[0] >= 0 else -1
        assert value == (keys.index(word) if word in keys else -1)


def test_cache_may_be_dropped():
    small = pieces.Encoder(PATH, most=3)
    texts = ["one two three four", "five six", "one two"]
    assert [small.encode([t])[0].tolist() for t in texts] == [x.tolist() for x in ENC.encode(texts)]


def test_file_scores():
    assert Pieces.load(PATH, "file").scores[300] < 0


def test_operators(spark, edge, edge_rows, empty, clashing):
    for docs in (edge, clashing):
        rows = pieces.encoded(docs, PATH, keep=("doc_id", "source")).collect()
        assert len(rows) == len(edge_rows) and all(r.lossless for r in rows)
        counts = token_counts.token_counts(docs, PATH).collect()
        assert sorted(r.n_tokens for r in counts) == sorted(r.n_pieces for r in rows)
    back = pieces.decoded(pieces.encoded(edge, PATH), PATH).collect()
    assert sorted(r.text for r in back) == sorted(r[1] or "" for r in edge_rows)
    assert pieces.encoded(empty, PATH).count() == 0 and token_counts.token_counts(empty, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from([*"abetionTHE7+/=", MARK, "é", "日"]), min_size=1, max_size=300), st.integers(1, 80))
def test_long_parts_as_short_ones(text, window):
    forest = unigram.Forest([text.encode()], shared=False)
    _, count, last, before = unigram.best_paths(ENC.pieces, forest)
    ids, _ = unigram.spell(last, before, count, forest.terminal)
    assert unigram.long_path(ENC.pieces, text.encode(), window).tolist() == ids.tolist()


def test_long_runs_take_linear_time():
    rnd = random.Random(2)
    for make in (lambda n: base64.b64encode(rnd.randbytes(n)).decode(), lambda n: "a" * n, lambda n: "日本" * (n // 6)):
        took = []
        for n in (200_000, 800_000):
            text, t = make(n), time.process_time()
            ids = ENC.encode([text])[0]
            took.append(time.process_time() - t)
            assert ENC.decode(ids.tolist()) == text and COUNT.counts([text])[0][0] == len(ids)
        assert took[1] < 8 * took[0] + 0.5 and took[1] < 30
