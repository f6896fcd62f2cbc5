"""Connected components by alternating stars, with joins and minima alone: no neighbourhood is ever gathered.

A node that many others point to is a hot key of both joins. So each join has a second key, a number below ``SALT`` from the
other end of the edge, which also leaves Spark free to split what is still too large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.tables import written

SALT = 8


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (a, b) with the m that ``least`` has for a."""
    salted = edges.withColumn("_s", F.pmod(F.xxhash64("b"), F.lit(SALT)))
    every = least.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return salted.join(every, ["a", "_s"]).drop("_s")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of (a, b), the component being its smallest node. Loops and repeated edges are harmless."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
        # large star: every larger neighbour of u moves to the least node that u sees
        around = _both(now)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = written(_met(around, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "cc-large")
        # small star: every smaller neighbour of u, and u, move to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _met(large, low).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        now = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(roots.join(now.select(F.col("a").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component")))
