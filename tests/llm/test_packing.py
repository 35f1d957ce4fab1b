import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from runlens.llm import packing
from tests.llm.conftest import SCHEMA, prose

PATH = P.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=120), st.integers(1, 9))
def test_best_fit_by_search(lengths, most):
    """The bitset picks what a search through all open sequences would."""
    bins, own, closed, want = packing.Bins(20, most), [], [], []
    for k, n in enumerate(lengths):
        fits = [b for b in own if 20 - sum(b) >= n]
        if fits:
            best = max(fits, key=sum)
            best.append(n)
        else:
            if len(own) == most and n < 20:
                fullest = max(own, key=sum)
                own.remove(fullest)
                want.append(sum(fullest))
            best = [n]
            own.append(best)
        if sum(best) == 20:
            own.remove(best)
            want.append(20)
        if (x := bins.place(n, n)) is not None:
            closed.append(sum(x))
    assert closed == want and sorted(map(sum, bins.rest())) == sorted(map(sum, own)) and bins.n == len(own) <= most


def check(rows, got, size):
    """Every piece is right, and sequences have no gaps."""
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(PATH), []
    for i, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        n = len(ids)
        cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
        want += [(str(i), k, a, e - a, zlib.crc32(np.array(ids[a:e], "<u4").tobytes())) for k, (a, e) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for x in held.values():
        x.sort()
        assert [a for a, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= size
    return len(held), sum(r.length for r in got)


def test_pieces_and_sequences(spark, edge, edge_rows, clashing, empty):
    rows = [r[:2] for r in edge_rows]
    for docs in (edge, clashing):
        check(rows, packing.placements(packing.sequences(docs, PATH, size=256)).collect(), 256)
    assert packing.placements(packing.sequences(empty, PATH)).count() == 0


def test_rounds_leave_few_open(spark):
    """With few open sequences the leftovers go through several rounds; no piece is lost, and little room is."""
    rnd = random.Random(2)
    rows = [(k, prose(rnd, rnd.randint(0, 90))) for k in range(1500)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).repartition(12)
    packed = packing.sequences(docs, PATH, size=128, open_bins=8, fan_in=2)
    assert packed.columns == ["sequence_id", "ids", "pieces"]
    n, tokens = check(rows, packing.placements(packed).collect(), 128)
    assert n <= 1.06 * tokens / 128 + 8
    assert packed.selectExpr("max(octet_length(ids)) m").first().m <= 4 * 128
