import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from runlens.llm import wavelet
from runlens.llm.common import shared_dir

PATH = P.path("byte_bpe_50k.json")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300))
def test_file_answers_as_a_list(tokens):
    f = wavelet.WaveletFile(wavelet.pack(np.array(tokens, np.uint32), pa.array([1]), np.array([len(tokens)])))
    assert f.tokens().tolist() == tokens and [f.access(i) for i in range(len(tokens))] == tokens
    for t in {*tokens[:5], 3, 99_999}:
        assert f.count(t) == tokens.count(t) and f.occurrences(t) == [i for i, x in enumerate(tokens) if x == t]
        assert f.rank(t, len(tokens) // 2) == tokens[: len(tokens) // 2].count(t)


def test_blocks(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 1024)
    tokens = np.random.default_rng(0).integers(0, 40, 9000).astype(np.uint32)
    f = wavelet.WaveletFile(wavelet.pack(tokens, pa.array([1, None, -(2**63)]), np.array([4000, 0, 5000])))
    assert (f.tokens() == tokens).all() and f.access(8191) == tokens[8191] and f.select(7, 100) == np.flatnonzero(tokens == 7)[100]
    assert f.lengths.tolist() == [4000, 0, 5000] and f.doc_ids.to_pylist() == [1, None, -(2**63)]


def brute(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_against_the_library(spark, edge, edge_rows, clashing):
    for docs in (edge, clashing):
        got = wavelet.token_shards(docs, PATH, 2, shard_tokens=5000, partitions=3).collect()
        key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
        assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got], key=key) == sorted(brute([r[:2] for r in edge_rows]), key=key)


def test_empty_table(spark, empty):
    assert wavelet.token_shards(empty, PATH, 2).count() == 0


def test_written_twice_is_the_same(spark, edge):
    outs = [shared_dir(spark, "t") for _ in range(2)]
    for out in outs:
        wavelet.write_shards(edge, out, PATH, 2, partitions=2).collect()
    a, b = ({r.path.rpartition("/")[2]: bytes(r.content) for r in spark.read.format("binaryFile").load(o).collect()} for o in outs)
    assert a == b and a


PIECES = st.sampled_from(list("aZé×ñ÷ȿɀß'.,!$019 \n\t\r\x0b\x1c\x85\xa0\u2003日😀\u0301ʼ") + ["'re", "'S", "  ", "\n\n", " the", "<|endoftext|>", "<|endof", "aschenpfverpfenver", "b" * 1100])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(PIECES, max_size=25).map("".join)), max_size=6))
def test_parts_against_whole_texts(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    ids, lengths = wavelet.encoder(PATH, 2).encode(pa.array(texts, pa.string()))
    want = [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_small_table_and_other_files():
    from tokenizers import Tokenizer

    texts = ["Some words, and more words.", "", "some  words", "x" * 5000 + " tail", None, "<|endoftext|> mid <|endoftext|>"] * 3
    for name, most in (("byte_bpe_50k.json", 1), ("word_bpe_49k.json", 1 << 28)):
        enc, tok = wavelet.ChunkEncoder(P.path(name), 2, most), Tokenizer.from_file(P.path(name))
        for _ in range(2):
            ids, lengths = enc.encode(pa.array(texts, pa.string()))
            want = [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
            assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
