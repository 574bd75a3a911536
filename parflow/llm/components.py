"""Connected components of a link table, by min-label propagation with shortcuts, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node reachable.

    Alternates large and small stars: each round links a node's larger neighbours to its smallest neighbour, then its smaller
    ones, which shortens every path and needs rounds in the order of the square of the logarithm of the size at worst. Each
    round's edges are a written table in the shared folder, so lineage stays short and an executor's loss costs one task.
    No group is gathered: the smallest neighbour is an aggregate, joined back.
    """
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialise(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        after = materialise(small, "edges")
        now = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        delete(edges, large)
        edges = after
        if now == state:
            break
        state = now
    low = edges.groupBy("a").agg(F.min("b").alias("component"))
    return low.select(F.col("a").alias("node"), "component").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
