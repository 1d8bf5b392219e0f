"""Connected components by alternating stars: rounds of joins whose lineage is cut, never a graph in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverspark.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _told(rows: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """``rows`` with the m of their a; ``least`` has a, m and n, and its n sum up to ``most`` at most.

    Centres that have a thousandth of the rows are at most a thousand; they are sent to their rows, so no task gets all
    links of one.
    """
    hot = F.broadcast(least.filter(F.col("n") * 1000 >= most).drop("n"))
    rest = rows.join(hot.select("a"), "a", "left_anti").join(least.drop("n"), "a")
    return rows.join(hot, "a").unionByName(rest)


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node and root (the least node of its component) for every node of the edges ``a``, ``b``.

    Each round hooks every node's neighbours to its least neighbour, larger ones first and then smaller ones, until
    nothing changes; the number of rounds grows with the logarithm of the longest path.  Loops, repeated edges and
    nulls are dropped; no edges give no rows.  If ``rounds`` don't suffice an error is raised.
    """
    down = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut(edges.filter("a is not null and b is not null and a <> b").select(down.alias("e")).select("e.*").distinct())
    before = _state(edges)
    settled = not before[0]
    for _ in range(rounds):
        if settled:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = _told(both.filter("b > a"), least, 2 * before[0])
        large = cut(large.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _told(large, least, before[0]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        after = _state(edges)
        settled, before = after == before, after
    if not settled:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
