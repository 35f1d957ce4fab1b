"""Connected components of a table of links, by randomised contraction.

A round maps each node to the first, in some order, of itself and its neighbours, and the links with it; loops and repeats go. Connected nodes stay
connected, others apart, and in each component the last node of the order goes, on average a constant share of all: a round's links are fewer by a factor, so
all rounds together move little more than the first. The first order is that of the ids, which settles stars around their least node at once; later
ones are by a hash that differs from round to round, so that no numbering makes long chains slow.

A round is a partly aggregated minimum and two equi-joins of written tables. A node with more than its share of the links is a hub; hubs are few, as
their links add up to no more than all, so their names are broadcast, and a hub's links are dealt over `SPREAD` parts of the join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import checkpointed, observed


#: Parts over which a hub's links are dealt, and the share of all links that makes a hub (there are at most its inverse of them).
SPREAD, SHARE = 64, 1e-3


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, rows: int) -> DataFrame:
    """edges: u, v (long), about `rows` of them. Returns node, label for every node with a link to another: the least node of its component."""
    links, seen = observed(_undirected(edges), "links", rows, n=F.count("*"))
    maps: list[DataFrame] = []
    while n := seen["n"]:
        # a hash of one long with a fixed seed is one-to-one: no ties
        place = lambda c: F.xxhash64(F.lit(len(maps)), c) if maps else F.col(c)
        to, got = observed(_targets(links, place, max(1000, int(2 * n * SHARE))), "targets", 2 * n, hubs=F.count_if("hub"))
        maps.append(to.select("u", "m"))
        moved = _moved(_moved(links, "u", to, got["hubs"]), "v", to, got["hubs"])
        links, seen = observed(_undirected(moved), "links", n, n=F.count("*"))
    if not maps:
        return links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    found = maps[0].select(F.col("u").alias("node"), F.col("m").alias("label"))
    if len(maps) == 1:
        return found
    for to in maps[1:]:
        found = found.join(to.withColumnRenamed("u", "label"), "label", "left").select("node", F.coalesce("m", "label").alias("label"))
    least = found.groupBy("label").agg(F.min("node").alias("least"))
    return checkpointed(found.join(least, "label").select("node", F.col("least").alias("label")), "components", rows)


def _targets(links: DataFrame, place: Callable[[str], Column], most: int) -> DataFrame:
    """u, m, hub: each node, the first by `place` of itself and its neighbours, and whether it has more than `most` links."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(place("v")).alias("at"), F.min_by("v", place("v")).alias("v"), F.count("*").alias("n"))
    return least.select("u", F.when(F.col("at") < place("u"), F.col("v")).otherwise(F.col("u")).alias("m"), (F.col("n") > most).alias("hub"))


def _moved(links: DataFrame, end: str, to: DataFrame, hubs: int) -> DataFrame:
    """The links with one end, u or v, mapped to its target."""
    other = "v" if end == "u" else "u"
    to = to.select(F.col("u").alias(end), F.col("m").alias("to"), "hub")
    if not hubs:
        moved = links.join(to, end)
    else:
        part = F.when(F.col("hub"), F.pmod(F.xxhash64(other), F.lit(SPREAD)).cast("int")).otherwise(0)
        dealt = links.join(F.broadcast(to.where("hub").select(end, "hub")), end, "left").withColumn("part", part).drop("hub")
        parts = F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
        moved = dealt.join(to.withColumn("part", F.explode(parts)), [end, "part"])
    return moved.select(F.col("to").alias(end), other)
