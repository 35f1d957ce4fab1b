import random

import pytest

from runlens.llm.components import components


def brute(edges):
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            if u != v and label[u] != label[v]:
                label[u] = label[v] = min(label[u], label[v])
                changed = True
    return label


def star(hub, leaves):
    return [(hub, x) for x in leaves]


@pytest.mark.parametrize("edges", [
    [],
    [(5, 5)],
    [(2, 1), (1, 2), (2, 1)],
    [(k, k + 1) for k in range(300)],
    [(k, k + 1) if k % 2 else (k + 1, k) for k in range(-50, 50)],
    star(0, range(1, 200)) + star(500, range(300, 500)) + [(250, 251)],
    [(a, b) for a in range(12) for b in range(12)],
    [(random.Random(k).randrange(400), random.Random(-k).randrange(400)) for k in range(1, 300)],
    [(1 << 62, -(1 << 62)), (-(1 << 62), 7)],
], ids=["none", "loop", "repeats", "chain", "zigzag", "stars", "clique", "random", "wide"])
def test_labels_are_least_nodes(spark, edges):
    got = components(spark.createDataFrame(edges, "u long, v long"), len(edges)).collect()
    assert {r.node: r.label for r in got} == brute(edges) and len({r.node for r in got}) == len(got)
