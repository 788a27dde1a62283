"""Connected components in DataFrame operations, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the smallest one: the larger ones of a node, or it and its smaller ones.

    Nodes and their minimum lie in tables of their own, so that the join's two
    sides are plain exchanges and a hub with very many edges can be split.
    """
    both = edges.union(edges.select("b", "a").toDF("a", "b")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = written(both, "edges")
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; component: the least node reached.

    Nulls and loops link nothing. Every round is written to the shared folder, so
    lost executors cost no more than the round at hand.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    mark = None
    while True:
        edges = written(_star(written(_star(edges, True), "edges"), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
