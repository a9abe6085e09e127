"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node passes its smallest neighbour (or itself) on to its larger (large) or smaller neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if large else both.filter("b < a")
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    passed = (seen.filter("b > a") if large else seen).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:  # a node itself also hangs on its smallest neighbour
        passed = passed.unionByName(least.select("a", F.col("m").alias("b")))
    return passed.filter("a <> b").dropDuplicates()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node of each component names it.

    Rounds go on until no edge changes; their number grows with the logarithm of the longest chain. Each round
    is written to the shared folder, so lineage stays short. Hubs are split as skewed joins are.
    """
    now = settle(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).dropDuplicates(),
        "edges",
    )
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b"))).first()
        if state == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).dropDuplicates()
            )
        mark = state
        now = settle(_star(_star(now, large=True), large=False), "edges")
