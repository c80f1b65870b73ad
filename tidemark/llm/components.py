"""Connected components of an edge table, by alternating stars (distributed union-find)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.storage import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one orderable type); root is the least node.

    Large-star then small-star, until nothing changes: each step hangs neighbours
    on the least one with an aggregate and a join, so no task holds the neighbours
    of a node. Every step's table is written to the shared folder.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")) if not _nested(edges) else edges.where("a <> b").select(
        F.when(F.col("a") > F.col("b"), F.col("a")).otherwise(F.col("b")).alias("hi"), F.when(F.col("a") > F.col("b"), F.col("b")).otherwise(F.col("a")).alias("lo")
    )
    current = scratch.gather(ordered.distinct())
    mark = _mark(current)
    while mark[0]:
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(current.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.when(F.col("m") < F.col("u"), F.col("m")).otherwise(F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = scratch.gather(small.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct())
        new = _mark(after)
        scratch.drop(current)
        current = after
        if new == mark:
            break
        mark = new
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _nested(edges: DataFrame) -> bool:
    return edges.schema["a"].dataType.typeName() == "struct"
