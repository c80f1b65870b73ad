"""Derived tables: trade-offs, summaries, gates, predictive values, distributions, robustness joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def mean_sd(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*(a for v in values for a in (F.avg(v).alias(f"mean_{v}"), F.stddev_samp(v).alias(f"sd_{v}"))))


def versus_full(rows: DataFrame, keys: list[str], values: list[str], cost: str, method: str = "method", full: str = "Full-Contextual") -> DataFrame:
    """Means per (keys, method, beta) beside the Full method's, and the cost reduction in percent."""
    own = rows.where(F.col(method) != full).groupBy(*keys, method, "beta").agg(*(F.avg(v).alias(v) for v in [*values, cost]))
    base = rows.where(F.col(method) == full).groupBy(*keys).agg(*(F.avg(v).alias(f"full_{v}") for v in [*values, cost]))
    return own.join(base, keys).withColumn("reduction_pct", 100 * (1 - F.col(cost) / F.col(f"full_{cost}")))


def gate_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count_if(F.col("decision") == "MET_GATE").alias("met"), F.count_if(F.col("decision") != "MET_GATE").alias("inconclusive"), F.count("*").alias("total"))


def predictive_values(rates: DataFrame, prevalences: list[float]) -> DataFrame:
    """PPV, NPV and false alerts per million benign at each prevalence, from columns tpr and fpr."""
    grid = rates.crossJoin(F.broadcast(rates.sparkSession.createDataFrame([(p,) for p in prevalences], "prevalence double")))
    p, t, f = F.col("prevalence"), F.col("tpr"), F.col("fpr")
    hit, alarm = p * t, (1 - p) * f
    miss, calm = p * (1 - t), (1 - p) * (1 - f)
    return grid.withColumns({"ppv": F.when(hit + alarm > 0, hit / (hit + alarm)), "npv": F.when(calm + miss > 0, calm / (calm + miss)), "alerts_per_million": 1e6 * f})


def quartiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select(*keys, *(F.col("q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))))


def worst_case(rows: DataFrame, keys: list[str], value: str, arg: str) -> DataFrame:
    tie = F.struct(F.col(value), F.col(arg))
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.max_by(arg, tie).alias("worst"))


def ecdf(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.select(*keys, value, F.cume_dist().over(Window.partitionBy(*keys).orderBy(value)).alias("ecdf"))


def versus_baseline(rows: DataFrame, keys: list[str], condition: str, values: list[str], prefix: str) -> DataFrame:
    """Left self-join to the rows of a baseline condition on the keys; differences as ``<prefix>_<value>``."""
    base = rows.where(condition).select(*keys, *(F.col(v).alias(f"__{v}") for v in values))
    joined = rows.join(base, keys, "left")
    return joined.withColumns({f"{prefix}_{v}": F.col(v) - F.col(f"__{v}") for v in values}).drop(*(f"__{v}" for v in values))


def mean_of_ratios(rows: DataFrame, cell: str, round_: str, part: str, flag: str) -> DataFrame:
    """Per cell, the mean over rounds of sum(part where flag) / max(1, sum(part)), and conditional means by flag."""
    by_round = rows.groupBy(cell, round_).agg((F.sum(F.when(F.col(flag) == 1, F.col(part)).otherwise(0)) / F.greatest(F.lit(1), F.sum(part))).alias("r"))
    means = rows.groupBy(cell).agg(F.avg(F.when(F.col(flag) == 1, F.col(part))).alias("flagged_mean"), F.avg(F.when(F.col(flag) == 0, F.col(part))).alias("other_mean"))
    return by_round.groupBy(cell).agg(F.avg("r").alias("mean_ratio")).join(means, cell)


def to_target_versus_full(targets: DataFrame, keys: list[str], full: str = "Full-Contextual") -> DataFrame:
    own = targets.groupBy(*keys, "method").agg(F.avg(F.col("reached").cast("int")).alias("reached_share"), F.avg(F.when(F.col("reached"), F.col("bytes"))).alias("mean_bytes"))
    base = own.where(F.col("method") == full).select(*keys, F.col("mean_bytes").alias("full_bytes"))
    return own.where(F.col("method") != full).join(base, keys, "left").withColumn("ratio", F.col("mean_bytes") / F.col("full_bytes"))
