"""Set comparisons and factorial checks between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def same_rows(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(only_left, only_right): rows, counted with repeats, that only one side has; nulls equal nulls."""
    side = lambda df, x: df.groupBy(*columns).agg(F.count("*").alias("__n")).select(*columns, F.lit(x).alias("__s"), "__n")
    both = side(a, 1).unionByName(side(b, -1)).groupBy(*columns).agg(F.sum(F.col("__s") * F.col("__n")).alias("__d"))
    return both.agg(F.coalesce(F.sum(F.when(F.col("__d") > 0, F.col("__d"))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.when(F.col("__d") < 0, -F.col("__d"))), F.lit(0)).alias("only_right"))


def set_difference(have: DataFrame, want: DataFrame, columns: list[str]) -> DataFrame:
    """(missing, extra): distinct combinations wanted but absent, and there but not wanted."""
    tag = lambda df, x: df.select(*columns).distinct().withColumn("s", F.lit(x))
    sides = tag(have, 1).unionByName(tag(want, 2)).groupBy(*columns).agg(F.sum("s").alias("s"))
    return sides.agg(F.count_if(F.col("s") == 2).alias("missing"), F.count_if(F.col("s") == 1).alias("extra"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def overlap(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    return a.select(*columns).distinct().join(b.select(*columns).distinct(), columns, "left_semi").agg(F.count("*").alias("shared"))


def violations(rows: DataFrame, keys: list[str], value: str, allowed: list[int]) -> DataFrame:
    """Groups whose sum of ``value`` isn't one of the allowed numbers."""
    return rows.groupBy(*keys).agg(F.sum(value).alias("total")).where(~F.col("total").isin(allowed))


def coverage(rows: DataFrame, keys: list[str], member: str, expected: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(member).alias("members")).withColumn("complete", F.col("members") == expected)
