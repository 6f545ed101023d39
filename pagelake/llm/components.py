"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.session import remove_folder, write_through


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """Each node hands the smallest of its neighbourhood to its larger (or its smaller) neighbours.

    A node's smallest neighbour is an aggregate with map-side combine, so a hub is never gathered in one task;
    joining it back is a plain join, which the planner may split by skew.
    """
    both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    least = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).withColumn("low", F.least("node", "low"))
    joined = both.join(least, F.col("u") == F.col("node"))
    moved = joined.where(F.col("v") > F.col("u") if large else F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    if not large:
        moved = moved.unionAll(least.select(F.col("node").alias("u"), F.col("low").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label): every node that has an edge, and the smallest node it can reach. Each round is written and read."""
    spark = edges.sparkSession
    pairs = write_through(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges", folders := []
    )
    state = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == state:
            break
        state, old = now, folders
        large = write_through(_stars(pairs, True), "large-star", middle := [])
        pairs = write_through(_stars(large, False), "small-star", folders := [])
        for folder in (*old, *middle):
            remove_folder(spark, folder)
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("label")).unionAll(pairs.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
