"""Preprocessing: robust numeric statistics, bounded vocabularies, scaling and one-hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.ranks import exact_quantiles

MISSING, UNKNOWN = "__MISSING__", "__UNK__"


def robust_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, median, lo, hi, iqr, std, scale): clip bounds at .005 and .995; scale is IQR, else std, else 1."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    spread = rows.agg(*(F.stddev_pop(number(c)).alias(f"s{i}") for i, c in enumerate(columns)))
    spread = spread.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("std")) for i, c in enumerate(columns)))).alias("x")).select("x.*")
    q, s = F.col("q"), F.col("std")
    iqr = q[4] - q[3]
    scale = F.when(iqr > 1e-12, iqr).when(s > 1e-12, s).otherwise(1.0)
    joined = spread.join(exact_quantiles(rows, columns, [0.5, 0.005, 0.995, 0.25, 0.75]), "feature", "left")
    return joined.select("feature", q[0].alias("median"), q[1].alias("lo"), q[2].alias("hi"), iqr.alias("iqr"), "std", scale.alias("scale"))


def vocabulary(rows: DataFrame, column: str, most: int = 50) -> DataFrame:
    """(feature, value, idx): the commonest values (ties by value), after the missing and unknown tokens."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    counted = rows.select(value.alias("value")).where(F.col("value") != MISSING).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)
    ranked = counted.withColumn("idx", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "value")) + 1).cast("int"))
    fixed = rows.sparkSession.createDataFrame([(MISSING, 0), (UNKNOWN, 1)], "value string, idx int")
    return fixed.unionByName(ranked.select("value", "idx")).select(F.lit(column).alias("feature"), "value", "idx")


def scale_numeric(rows: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Impute by median, clip, centre and scale to float, from a one-row-per-feature table (a broadcast map)."""
    packed = stats.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("median", "lo", "hi", "scale")))).alias("__p"))
    joined = rows.crossJoin(F.broadcast(packed))
    out = {}
    for c in columns:
        p = F.col("__p")[c]
        x = F.col(c).cast("double")
        x = F.coalesce(F.when(~F.isnan(x), x), p["median"])
        out[c] = ((F.least(F.greatest(x, p["lo"]), p["hi"]) - p["median"]) / p["scale"]).cast("float")
    return joined.withColumns(out).drop("__p")


def one_hot_index(rows: DataFrame, vocab: DataFrame, column: str) -> DataFrame:
    """``<column>_idx``: the value's place in the vocabulary, the unknown token's for others (the table has at most 52 rows)."""
    held = vocab.where(F.col("feature") == column).select(F.col("value").alias("__v"), F.col("idx").alias(f"{column}_idx"))
    joined = rows.join(F.broadcast(held), F.coalesce(F.col(column).cast("string"), F.lit(MISSING)) == F.col("__v"), "left").drop("__v")
    return joined.withColumn(f"{column}_idx", F.coalesce(f"{column}_idx", F.lit(1)))


def one_hot(index: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == index).cast("float"))
