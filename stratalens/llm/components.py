"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import Workspace, rekeyed


def _minima(sym: DataFrame, lowest) -> DataFrame:
    """Each node with its neighbours' least id, summed up before the shuffle, next to each of its neighbours.

    The join has one row for a node on its right side, so Spark can split the rows of a node with many neighbours.
    """
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select(rekeyed(F.col("u")).alias("k"), lowest("m", "u").alias("m"))
    return sym.withColumn("k", rekeyed(F.col("u"))).join(least.hint("merge"), "k").select("u", "v", "m")


def connected_components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """edges (a, b long) without loops; returns (id, component), the least id of those that links reach.

    Alternates the two star operations: each node links its larger neighbours to the least node near it, then its
    smaller ones.  Rounds go with the logarithm of the longest path; each is written, which cuts the lineage.  They end
    when all edges are stars: no node has two edges down, and none that has one has another below it.  Ids that are
    null take no part; an empty table gives an empty result.
    """
    now = space.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    turn = 0
    while not _stars(now):
        turn += 1
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minima(sym, F.least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _minima(large.filter("v < u"), lambda m, w: F.col(m))
        nxt = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        nxt = space.write(nxt, f"{name}-{turn}")
        space.drop(f"{name}-{turn - 1}")
        now = nxt
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down = 1 and up = 1").isEmpty()


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the links, those that join what earlier ones left apart."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out
