"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens (parts between blanks, with their marks) of a batch are put in one trie. Unigram forward scores go from node to node, once for
each shared prefix; the node where a pre-token ends keeps the number of pieces of its best path. A document's count is the sum over its pre-tokens.

Texts may be of any length: a pre-token of over `LONG` characters is walked alone, in time linear in it. Of equally good paths that with the longer
last piece is counted. Defined results: a null or empty text has 0 tokens and 0 pre-tokens; an empty table gives no rows; repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from runlens.llm.common import batch_of, ship, slices
from runlens.llm.unigram import LONG, OWN, Forest, Pieces, best_paths, long_path, parts_of


class Counter:
    """Counts of pre-tokens. The table of known ones is dropped at `most` bytes, which changes no result."""

    def __init__(self, path: str, scores: str = "log", most: int = 100 << 20):
        self.pieces, self.most, self.held = Pieces.load(path, scores), most, 0
        self.known: dict[str, int] = {OWN: 3}

    def counts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """Tokens and pre-tokens of each text."""
        if self.held > self.most:
            self.known, self.held = {OWN: 3}, 0
        parts = [parts_of(t) if t else [] for t in texts]
        new = sorted(set().union(*parts) - self.known.keys())
        self.held += sum(map(len, new)) + 200 * len(new)
        self.known.update((x, len(long_path(self.pieces, x.encode()))) for x in new if len(x) > LONG)
        new = [x for x in new if len(x) <= LONG]
        for i in range(0, len(new), 60_000):  # neighbours in order share prefixes
            some = new[i : i + 60_000]
            forest = Forest([x.encode() for x in some], shared=True)
            count = best_paths(self.pieces, forest)[1]
            self.known.update(zip(some, count[forest.terminal].tolist()))
        get = self.known.__getitem__
        return [(sum(map(get, p)), len(p)) for p in parts]


_COUNTERS: dict[tuple[str, str], Counter] = {}
OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_pretokens", pa.int64())])


def token_counts(docs: DataFrame, model: str, scores: str = "log") -> DataFrame:
    """doc_id, n_tokens and n_pretokens of every whole text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model, scores) not in _COUNTERS:
            _COUNTERS[model, scores] = Counter(model, scores)
        for b in slices(batches, "text", 6 << 20):
            found = _COUNTERS[model, scores].counts(b.column(1).to_pylist())
            yield batch_of(OUT, doc_id=b.column(0), n_tokens=[x for x, _ in found], n_pretokens=[x for _, x in found])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long")
