"""N-gram Jaccard join by a MinHash LSH forest.

1. Equal texts become one node (partly aggregated by a 128-bit hash of the text).
2. Each node's signature gives one label for each tree, a sequence of `depth` values of 16 bits. The labels of a tree, sorted, are its prefix trie: a
   range-partitioned sort brings neighbours together, and one pass ties each node to the head of the run of labels that share its longest common
   prefix with the label before it. No pairs are made, and a run may be spread over any number of partitions.
3. The join starts at whole labels and shortens the prefix value by value. At each depth the components of the ties at least so long are the candidate
   groups; those that are new at this depth are verified exactly. Each link found at similarity s stands for 1 / p(s) links, p being the chance that a
   pair like it shares a prefix so long in some tree. Shortening stops when the links found are the target share of that sum, at the latest at the depth
   at which even pairs at the threshold meet with that chance.
4. A group of more than `block` texts is cut first, by an exact filter that ships hashes of shingles and no texts: two sets at the threshold t share one
   of each other's |x| - ceil(t |x|) + 1 rarest shingles, rarest within the group. Texts are kept together only by such shingles, so pages that have
   a template in common, but no more, are never compared: the template's shingles are their most frequent ones.
5. Within what is left of each group all pairs are verified exactly, in blocks: a large one is dealt over pairs of blocks (at most `block` texts and
   `BLOCK_BYTES` bytes each, or one text), which go to partitions in turn and return counts and a spanning forest and no pairs.
6. The components of verified links are the classes.

Exact counts of links take time in proportion to the square of a family's different texts (copies are one node). A text over `BLOCK_BYTES` is a block of
its own.

Words are those of `fmindex`: A-Z lower-cased, ASCII letters, digits and all other characters beyond ASCII. A text with fewer words than a shingle
has, but not none, is one shingle. Defined results: a text without words (also null) is linked to equal texts only, null counting as empty; ids
may recur; a class's id is its least doc_id (null only if all are null); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import batch_of, checkpointed, observed, ship, slices
from runlens.llm.components import components
from runlens.llm.fmindex import _TABLE as TABLE

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base to the power of 0 .. n-1, modulo 2**64."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    if len(have) <= 1 << 20:
        _powers[base] = have
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of `words` words."""
    raw = np.frombuffer((text or "").encode().translate(TABLE), np.uint8)
    solid = raw != 32
    if not solid.any():
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]))
    each = np.where(solid, _BYTE[raw] * _power(_P, len(raw)), np.uint64(0))
    h = _mixed(np.add.reduceat(each, starts) * _power(_P_INVERSE, len(raw))[starts])
    n = max(len(h) - words + 1, 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        total += h[k : k + n] * np.uint64(pow(_Q, k + 1, 1 << 64))
    return np.unique(_mixed(total))


def depth_for(threshold: float, trees: int, depth: int, recall: float) -> int:
    """Shortens the prefix from `depth` until a pair at the threshold meets in some tree with the target recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    if 1 - (1 - threshold**depth) ** trees < recall:
        raise ValueError("too few trees for this recall")
    return depth


def labels(sh: np.ndarray, trees: int, depth: int, seed: int) -> bytes:
    """The labels of all trees, one after the other: `depth` values of two bytes each, from the least of as many hashes of the shingles."""
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 1 << 32, (trees * depth, 1), np.uint32)
    times = rng.integers(0, 1 << 32, (trees * depth, 1), np.uint32) | np.uint32(1)
    x = (sh >> np.uint64(32)).astype(np.uint32)
    least = np.full(trees * depth, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, ((x[i : i + 2048] ^ flip) * times).min(axis=1), out=least)
    return (_mixed(least.astype(np.uint64)) >> np.uint64(48)).astype(">u2").tobytes()


def with_text_hash(docs: DataFrame) -> DataFrame:
    """doc_id, text and two 64-bit hashes h1, h2 of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def _signed(docs: DataFrame, words: int, trees: int, depth: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 8 << 20):
            each = [shingles(text, words) for text in b.column(1).to_pylist()]
            found = pa.array([labels(sh, trees, depth, seed) if len(sh) else None for sh in each], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), found], names=["doc_id", "h1", "h2", "labels"])

    return with_text_hash(docs).mapInArrow(run, "doc_id long, h1 long, h2 long, labels binary")


TIE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("shared", pa.int32()), ("part", pa.int32()), ("last", pa.bool_()), ("label", pa.binary())])


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values that rows of labels (a byte for the tree, then two bytes for each value) share from the start; 0 in different trees."""
    same = a == b
    values = same[:, 1::2] & same[:, 2::2]
    return np.where(same[:, 0], np.logical_and.accumulate(values, axis=1).sum(axis=1), 0)


def forest_ties(nodes: DataFrame, trees: int, depth: int, least: int, parts: int | None = None) -> DataFrame:
    """u, v, shared: each node and the head of the run, in some sorted trie, of those with which it shares `shared` values, `least` or more.

    parts: ranges of the sorted labels (None: as many as the session's shuffle partitions). The ties with `shared` of d or more join the nodes that have a prefix of d values in common with another, and no others.
    """
    width = 2 * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), None
        heads = np.zeros(depth + 1, np.int64)  # of the run at each depth
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, width + 1)
            node = b.column(1).to_numpy()
            with_last = np.concatenate([rows[:1] ^ 255 if before is None else before, rows])
            shared = _shared(with_last[:-1], with_last[1:])
            own, tied = np.arange(len(node)), np.zeros(len(node), np.int64)
            for d in range(1, depth + 1):
                starts = np.maximum.accumulate(np.where(shared < d, own, -1))
                head = np.where(starts >= 0, node[starts], heads[d])
                tied[shared == d] = head[shared == d]
                heads[d] = head[-1]
            take = np.flatnonzero((shared >= least) & (tied != node))
            none = pa.nulls(len(take), pa.int32())
            yield batch_of(TIE, u=node[take], v=tied[take], shared=shared[take].astype(np.int32), part=none, last=pa.nulls(len(take), pa.bool_()), label=pa.nulls(len(take), pa.binary()))
            if before is None:
                yield batch_of(TIE, u=[node[0]], v=[node[0]], shared=[0], part=[part], last=[False], label=[rows[0].tobytes()])
            before, final = rows[-1:], int(node[-1])
        if before is not None:
            yield batch_of(TIE, u=[final], v=[final], shared=[0], part=[part], last=[True], label=[before[0].tobytes()])

    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    rows = nodes.where("labels is not null").select("node", "labels", tree.alias("tree"))
    label = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.substring(F.col("labels"), F.col("tree") * width + 1, F.lit(width)))
    rows = rows.select(label.alias("label"), "node")
    rows = (rows.repartitionByRange("label", "node") if parts is None else rows.repartitionByRange(parts, "label", "node")).sortWithinPartitions("label", "node")
    found = checkpointed(rows.mapInArrow(run, "u long, v long, shared int, part int, last boolean, label binary"), "ties")
    inner = found.where("part is null").select("u", "v", "shared")
    # two rows for each partition: the last label of one and the first of the next may share a prefix
    edges = sorted(found.where("part is not null").select("part", "last", "label", "u").collect(), key=lambda r: (r.part, r["last"]))
    over = []
    for a, b in zip(edges, edges[1:]):
        n = int(_shared(*(np.frombuffer(x.label, np.uint8)[None] for x in (a, b)))[0])
        if a.part != b.part and n >= least and a.u != b.u:
            over.append((b.u, a.u, n))
    return inner.unionByName(found.sparkSession.createDataFrame(over, "u long, v long, shared int")) if over else inner


def linked(own: list[np.ndarray], other: list[np.ndarray] | None, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Which of `own` (rows) are similar to which of `other` (columns; None: own among themselves, without the diagonal), and all similarities."""
    sets = own if other is None else own + other
    size = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = times > 1  # a shingle of one text only is in no intersection
    number = np.cumsum(shared) - 1
    take = shared[column]
    row, column = row[take], number[column[take]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n, total = len(own), int(shared.sum())
    common = np.zeros((n, n if other is None else len(other)), np.int64)
    for lo in range(0, total, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        dense = np.zeros((len(sets), min(4096, total - lo)), np.float32)
        dense[row[a:b], column[a:b] - lo] = 1
        common += (dense[:n] @ (dense if other is None else dense[n:]).T).astype(np.int64)
    union = size[:n, None] + (size if other is None else size[n:])[None, :] - common
    found = common * threshold.denominator >= threshold.numerator * union
    if other is None:
        np.fill_diagonal(found, False)
    return found, common / np.maximum(union, 1)


def _roots(found: np.ndarray) -> np.ndarray:
    """For each node of a symmetric matrix the least node of its component."""
    label = np.arange(len(found))
    while True:
        new = np.minimum(label, np.where(found, label[None, :], len(found)).min(axis=1, initial=len(found)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


OUT = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("last", pa.bool_()), ("comp", pa.int64()), ("size", pa.int64()), ("bins", pa.list_(pa.int64()))])
#: Tables of texts, shingles and labels get files of so many times fewer rows than narrow ones.
WIDE = 16
#: Labels of all trees to a range of their sort.
LABEL_ROWS = 200_000
#: Similarities of links are counted in this many bins from 0 to 1.
BINS = 200
#: Most bytes of text in a block of several texts.
BLOCK_BYTES = 16 << 20


SHINGLE = pa.schema([("comp", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("shingle", pa.int64())])


def _rare_groups(large: DataFrame, words: int, threshold: Fraction, n_docs: int) -> DataFrame:
    """large: comp, node, text; n_docs: of the whole table. Returns node, label: the parts of each group that shingles among the rarest of a text hold together.

    No pair at the threshold is parted. A text that shares none of its rarest shingles has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            each = [shingles(text, words) for text in b.column(2).to_pylist()]
            n = np.array([len(x) for x in each], np.int64)
            repeated = lambda k: pa.array(np.repeat(b.column(k).to_numpy(), n))
            yield batch_of(SHINGLE, comp=repeated(0), node=repeated(1), n=pa.array(np.repeat(n, n)), shingle=pa.array(np.concatenate(each).view(np.int64)))

    rows = checkpointed(large.select("comp", "node", "text").mapInArrow(run, "comp long, node long, n long, shingle long"), "shingles", WIDE * n_docs)
    # one row a shingle meets those that hold it: a join whose large partitions can be split
    shared = rows.join(rows.groupBy("comp", "shingle").agg(F.count("*").alias("f")).where("f > 1"), ["comp", "shingle"])
    by = Window.partitionBy("node")
    t, of = threshold.numerator, threshold.denominator
    most = F.expr(f"n - ({t} * n + {of - 1}) DIV {of} + 1")
    alone = F.col("n") - F.count("*").over(by)  # shingles of no other text come first among the rarest
    tokens = shared.withColumns({"at": F.row_number().over(by.orderBy("f", "shingle")), "alone": alone}).where(F.col("at") + F.col("alone") <= most)
    tokens, seen = observed(tokens.select("comp", "shingle", "node"), "rarest", WIDE * n_docs, n=F.count("*"))
    heads = tokens.groupBy("comp", "shingle").agg(F.min("node").alias("head"))
    return components(tokens.join(heads, ["comp", "shingle"]).where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")).distinct(), seen["n"])


def _cut(members: DataFrame, words: int, threshold: Fraction, block: int, n_docs: int) -> DataFrame:
    """Members of all groups with the part to verify (part, part_size, part_bytes): small groups whole, large ones as `_rare_groups` parts them."""
    small = members.where(F.col("size") <= block).withColumns({"part": F.col("comp"), "part_size": F.col("size"), "part_bytes": F.col("n_bytes")})
    large = members.where(F.col("size") > block)
    if large.isEmpty():
        return small
    parts = _rare_groups(large, words, threshold, n_docs)
    own = large.join(parts, "node")
    sizes = own.groupBy("label").agg(F.count("*").alias("part_size"), F.sum(F.octet_length("text")).alias("part_bytes"))
    return small.unionByName(own.join(sizes, "label").withColumn("part", F.col("label")).drop("label"))


def _verified(members: DataFrame, words: int, threshold: Fraction, block: int) -> DataFrame:
    """members: comp, size, part, part_size, part_bytes, node, copies, text. Returns node, links (documents of other texts that are similar), root (a tie),
    last (whether the group is one block), comp, size and, once for each pair of blocks, the numbers of links by similarity."""

    def group(rows: list[dict]) -> Iterator[tuple]:
        rows = list({r["node"]: r for r in rows}.values())
        rows.sort(key=lambda r: r["node"])
        sets = [shingles(r["text"], words) for r in rows]
        copies = np.array([r["copies"] for r in rows])
        nodes = [r["node"] for r in rows]
        i, j, last, comp, size = (rows[0][k] for k in ("i", "j", "last", "comp", "size"))
        if i == j:
            whole, like = linked(sets, None, threshold)
            each = like[np.triu(whole)]
        else:
            left, right = [k for k, r in enumerate(rows) if r["side"] == i], [k for k, r in enumerate(rows) if r["side"] == j]
            if not left or not right:
                return
            found, like = linked([sets[k] for k in left], [sets[k] for k in right], threshold)
            each = like[found]
            whole = np.zeros((len(rows), len(rows)), bool)
            whole[np.ix_(left, right)] = found
            whole |= whole.T
        if len(each):
            bins = np.bincount(np.minimum((each * BINS).astype(np.int64), BINS - 1), minlength=BINS).tolist()
            yield None, None, None, None, comp, size, bins
        for k, (links, root) in enumerate(zip((whole @ copies).tolist(), _roots(whole).tolist())):
            if links or i == j:
                yield nodes[k], links, nodes[root], last, comp, size, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []
        for b in slices(batches, "text", 4 << 20):
            for r in b.to_pylist():
                if (key := (r["part"], r["i"], r["j"])) != at:
                    out += group(held) if held else ()
                    at, held = key, []
                held.append(r)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OUT)], schema=OUT)
                out = []
        out += group(held) if held else ()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OUT)], schema=OUT)

    blocks = F.ceil(F.greatest(F.col("part_size") / F.lit(block), F.least(F.col("part_bytes") / F.lit(BLOCK_BYTES), F.col("part_size")))).cast("int")
    side = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = members.select("comp", "size", "part", "node", "copies", "text", blocks.alias("blocks"), side.alias("side"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("side", k).alias("i"), F.greatest("side", k).alias("j")))
    rows = rows.withColumn("pair", F.explode(pairs)).select("comp", "size", "part", "pair.i", "pair.j", "side", "node", "copies", "text", (F.col("blocks") == 1).alias("last"))
    # a part's pairs of blocks go to partitions in turn
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.pmod(F.shiftright(F.col("j").cast("long") * (F.col("j") + 1), 1) + F.col("i"), F.lit(n))  # its number among the part's pairs
    turn = F.pmod(F.pmod(F.xxhash64("part"), F.lit(n)) + at, F.lit(n)).cast("int")
    dealt = rows.repartitionById(n, turn).sortWithinPartitions("part", "i", "j")
    return dealt.mapInArrow(run, "node long, links long, root long, last boolean, comp long, size long, bins array<long>")


def recall_of(bins: list[int], trees: int, depth: int, threshold: float) -> float:
    """The share of all links that those found (by bins of similarity) are estimated to be; without links, that of pairs at the threshold."""
    chance = lambda s: 1 - (1 - s**depth) ** trees
    found = np.array(bins, np.float64)
    if not found.any():
        return chance(threshold)
    low = np.maximum(np.arange(BINS) / BINS, threshold)
    return float(found.sum() / (found / chance(low)).sum())


def classes(docs: DataFrame, threshold: float = 0.8, words: int = 5, trees: int = 32, depth: int = 9, recall: float = 0.999, block: int = 512, seed: int = 5) -> DataFrame:
    """doc_id, h1, h2 (of the text), class_id and n_links (other documents with an equal or similar text), for each row of docs."""
    if trees > 255:
        raise ValueError("at most 255 trees")
    ship(docs.sparkSession)
    least = depth_for(threshold, trees, depth, recall)
    n_docs = docs.count()  # of a Parquet table from its footers
    signed = _signed(docs, words, trees, depth, seed)
    nodes = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("labels").alias("labels"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", WIDE * n_docs)
    ties = forest_ties(nodes, trees, depth, least, parts=-(-n_docs * trees // LABEL_ROWS) or 1)
    ties, seen_ties = observed(ties.groupBy("u", "v").agg(F.max("shared").alias("shared")), "forest", n_docs, n=F.count("*"))
    n_ties = seen_ties["n"]
    plain = nodes.drop("labels")
    # the texts of all nodes that any depth may bring together, once
    tied = ties.select(F.col("u").alias("node")).unionByName(ties.select(F.col("v").alias("node"))).distinct()
    texts = with_text_hash(docs).select(F.col("doc_id").alias("rep"), "h1", "h2", "text")
    own = plain.join(tied, "node")
    same = [own.rep.eqNullSafe(texts.rep), own.h1 == texts.h1, own.h2 == texts.h2]
    texts = own.join(texts, same).groupBy("node", "copies").agg(F.first("text").alias("text"))
    texts = checkpointed(texts.withColumn("n_bytes", F.octet_length("text")), "texts", WIDE * n_docs)
    found, seen, size, groups = [], None, None, None
    for at in range(depth, least - 1, -1):
        # the groups of the longer prefixes, as stars, and what this depth adds
        more = ties.where(F.col("shared") >= at if groups is None else F.col("shared") == at).select("u", "v")
        groups = components(more if groups is None else more.unionByName(groups.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))), n_ties)
        sized = groups.join(texts.select("node", "n_bytes"), "node").groupBy("label").agg(F.count("*").alias("size"), F.sum("n_bytes").alias("total"))
        size = checkpointed(sized, "sizes", n_ties)
        new = size if seen is None else size.join(seen, ["label", "size"], "left_anti")  # groups only grow: with the same size they are the same
        members = groups.join(new, "label").join(texts, "node").select(F.col("label").alias("comp"), "size", F.col("total").alias("n_bytes"), "node", "copies", "text")
        exact = Fraction(str(threshold))
        found.append(checkpointed(_verified(_cut(members, words, exact, block, n_docs), words, exact, block), "verified", WIDE * n_docs))
        seen = size.select("label", "size")
        links = reduce(DataFrame.unionByName, found).join(seen.withColumnRenamed("label", "comp"), ["comp", "size"], "left_semi")
        bins = links.where("bins is not null").select(F.posexplode("bins").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
        if recall_of([dict(map(tuple, bins)).get(k, 0) for k in range(BINS)], trees, at, threshold) >= recall:
            break
    links = links.where("node is not null")
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    own = links.where("last").select("node", F.col("root").alias("label"))
    ties = links.where("not last and node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    label = own if ties.isEmpty() else own.unionByName(components(ties, n_ties))
    full = plain.join(label, "node", "left").join(sums, "node", "left")
    full = full.withColumns({"label": F.coalesce("label", "node"), "n_links": F.col("copies") - 1 + F.coalesce("links", F.lit(0))})
    ids = full.groupBy("label").agg(F.min("rep").alias("class_id"))
    full = full.join(ids, "label").select("h1", "h2", "class_id", "n_links")
    return with_text_hash(docs).drop("text").join(full, ["h1", "h2"]).select("doc_id", "h1", "h2", "class_id", "n_links")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, with one of each class: that of the least doc_id; of rows equal in doc_id and text, one."""
    kept = checkpointed(classes(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("rows")), "kept", docs.count())
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(1), text)})
    same = keyed.doc_id.eqNullSafe(kept.doc_id) & (keyed._h1 == kept.h1) & (keyed._h2 == kept.h2)
    names = docs.columns
    once = keyed.join(kept.where("rows = 1"), same, "left_semi").select(*names)
    again = kept.where("rows > 1")
    if again.isEmpty():
        return once
    same = keyed.doc_id.eqNullSafe(again.doc_id) & (keyed._h1 == again.h1) & (keyed._h2 == again.h2)
    return once.unionByName(keyed.join(again, same, "left_semi").dropDuplicates(["doc_id", "_h1", "_h2"]).select(*names))
