import random
from collections import Counter, defaultdict

from runlens.llm import near_dups
from runlens.llm.components import components
from runlens.llm.fmindex import words_of
from tests.llm.conftest import SCHEMA, prose


def brute(rows, words=5):
    """Class ids and links from all pairs."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set())
    n, links, parent = len(rows), Counter(), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            same = (rows[a][1] or "") == (rows[b][1] or "")
            common = len(sets[a] & sets[b])
            if same or (common and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common)):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for k in range(n):
        if rows[k][0] is not None:
            least[root(k)].append(rows[k][0])
    return sorted(((rows[k][0], min(least[root(k)], default=None), links[k]) for k in range(n)), key=str)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=str)


def family(rnd, n, size, base):
    text = prose(rnd, size).split(" ")
    out = []
    for k in range(n):
        t = list(text)
        for _ in range(rnd.randint(0, max(1, size // 60))):
            t[rnd.randrange(size)] = f"w{rnd.random():.6f}"
        out.append((base + k, " ".join(t)))
    return out


def test_against_all_pairs(spark, edge, edge_rows, clashing):
    rnd = random.Random(7)
    rows = [(r[0], r[1]) for r in edge_rows]
    for f in range(6):
        rows += family(rnd, 12, rnd.choice([20, 80, 200]), 100 * (f + 1))
    rows += [(1000 + k, prose(rnd, 50)) for k in range(30)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    want = brute(rows)
    assert got(near_dups.classes(docs)) == want
    # a large group is dealt over pairs of blocks
    assert got(near_dups.classes(docs, block=4)) == want
    assert got(near_dups.classes(clashing)) == brute([(r[0], r[1]) for r in edge_rows])


def test_templates_are_not_compared(spark, monkeypatch):
    """Pages with most of their words in common, but below the threshold, are one candidate group; few or none of their pairs reach verification."""
    rnd = random.Random(11)
    page = prose(rnd, 130)
    rows = [(k, page + " " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(75))) for k in range(300)] + [(1000 + k, t) for k, (_, t) in enumerate(family(rnd, 9, 120, 0))]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    verified, cut = [], near_dups._cut
    monkeypatch.setattr(near_dups, "_cut", lambda members, *a: verified.append((members.count(), (out := cut(members, *a)).count())) or out)
    assert got(near_dups.classes(docs, block=16)) == brute(rows)
    # what is left after the cut are small groups, which are compared whole
    assert max(n for n, _ in verified) >= 100 and max(n for _, n in verified) <= 60 and verified[-1][1] <= 20, verified


def test_deduplicated_keeps_one_of_each(spark, clashing, edge_rows, empty):
    kept = near_dups.deduplicated(clashing)
    assert kept.columns == clashing.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    # 2, 3 have equal (empty) texts; 4 has no words but another text; 6 is close to 5; 8 and 9 are copies
    assert ids == sorted(map(str, [1, 2, 4, 5, 7, 7, 8, None, 10, 11, 12, 13])), ids
    assert near_dups.deduplicated(empty).count() == 0 and near_dups.classes(empty).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(140)] + [(k, k + 1) for k in range(300, 340)]
    edges = [e for e in edges if e[0] != e[1]]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    rows = components(spark.createDataFrame(edges, "u long, v long"), len(edges)).collect()
    assert {r.node: r.label for r in rows} == label and len(rows) == len(label)


def test_hub(spark, monkeypatch):
    monkeypatch.setattr("runlens.llm.components.SHARE", 0.0)
    edges = [(5000 + k, 7) for k in range(3000)] + [(9000 + k, 9001 + k) for k in range(20)]
    rows = components(spark.createDataFrame(edges, "u long, v long"), len(edges)).collect()
    assert {r.node: r.label for r in rows} == {7: 7} | {5000 + k: 7 for k in range(3000)} | {9000 + k: 9000 for k in range(21)}


def test_forest_ties_are_shared_prefixes(spark):
    """Ties of d values or more join just the nodes that share a prefix of d values in some tree, however the sort is cut."""
    rnd, trees, depth = random.Random(3), 3, 4
    rows = [(k, bytes(x for _ in range(trees * depth) for x in (0, rnd.randrange(3)))) for k in range(60)] + [(100 + k, bytes(2 * trees * depth)) for k in range(9)] + [(999, None)]
    nodes = spark.createDataFrame(rows, "node long, labels binary").repartition(4)
    ties = near_dups.forest_ties(nodes, trees, depth, 1).collect()
    for d in range(1, depth + 1):
        parent = {k: k for k, _ in rows}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for t in range(trees):
            first = {}
            for k, x in rows[:-1]:
                parent[root(k)] = root(first.setdefault(x[2 * depth * t : 2 * depth * t + 2 * d], k))
        want = {frozenset(k for k in parent if root(k) == g) for g in map(root, list(parent))}
        parent = {k: k for k, _ in rows}
        for r in ties:
            if r.shared >= d:
                parent[root(r.u)] = root(r.v)
        assert {frozenset(k for k in parent if root(k) == g) for g in map(root, list(parent))} == want


def test_recall_is_estimated_from_links():
    bins = [0] * near_dups.BINS
    assert near_dups.recall_of(bins, 32, 8, 0.8) < 0.998
    bins[-1] = 100
    assert near_dups.recall_of(bins, 32, 9, 0.8) > 0.9999
    bins[int(0.8 * near_dups.BINS)] = 100
    assert near_dups.recall_of(bins, 32, 9, 0.8) < 0.999


def test_depth():
    assert near_dups.depth_for(0.8, 32, 8, 0.999) == 7 and near_dups.depth_for(0.8, 32, 8, 0.9) == 8
