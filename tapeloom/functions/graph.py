"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.storage import stored


def components(edges: DataFrame, most: int = 64) -> tuple[DataFrame, int]:
    """Edges (a, b) of any type that has an order -> (node, component: the least node reached), and the rounds it took.

    Each round links the larger neighbours of a node to the least of them and the node (large star), then the smaller ones (small star), until every
    node hangs at the least of its component. So the distance to it falls by a factor each round: a path of n nodes takes about log n. Edges of a node to itself make it a component.
    """
    alone = edges.where("a = b").select(F.col("a").alias("node"))
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark, last, rounds = (lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()), None, 0
    while (now := mark(e)) != last:
        last, rounds = now, rounds + 1
        if rounds > most:
            raise RuntimeError(f"components did not settle in {most} rounds")
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stored(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        e = stored(large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(down.select("a", F.col("m").alias("b"))).distinct())
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    return found.union(alone.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")).distinct()), rounds
