"""Connected components of an edge table that may be of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u BIGINT, v BIGINT); root is the smallest node of its component.

    Large-star and small-star rounds in turn: a node hands its larger neighbours, then
    its smaller ones, to the smallest neighbour, until all edges point at a root. Each round is an
    aggregate and a join on rows, never a collected neighbourhood, and is written to the
    shared folder; the number of rounds grows with the logarithm of the component size.
    """
    edges = settle(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
        large = large.select("node", F.least("node", "low").alias("low"))
        hung = both.where("v > u").join(large, F.col("u") == F.col("node"))
        star = settle(hung.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct())
        small = star.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
        joined = star.join(small, F.col("u") == F.col("node"))
        moved = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            joined.select("u", F.col("low").alias("v"))
        )
        edges = settle(moved.where("u <> v").distinct())
        state = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == before:
            break
        before = state
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return settle(roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
