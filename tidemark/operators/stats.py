"""Paired inference: bootstrap bounds, exact sign flips, Holm, gates, correlations."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import canonical_beta, keyed_draw
from tidemark.operators.ranks import running

#: Non-inferiority margins by endpoint.
MARGINS = {"f1": 0.02, "pr_auc": 0.02, "fpr": 0.0025}


def paired_deltas(metrics: DataFrame, method: str, comparator: str, keys: list[str], values: list[str], full: str = "Full-Contextual") -> DataFrame:
    """Method minus comparator per key; the Full method has no beta and meets every beta."""
    ours = metrics.where(F.col("method") == method).withColumn("__b", canonical_beta(F.col("beta")))
    theirs = metrics.where(F.col("method") == comparator).withColumn("__b", canonical_beta(F.col("beta"))).select(*keys, "__b", *(F.col(v).alias(f"__{v}") for v in values))
    if comparator == full:
        joined = ours.join(theirs.drop("__b"), keys)
    else:
        joined = ours.join(theirs, [*keys, "__b"])
    return joined.select(*keys, "beta", *((F.col(v) - F.col(f"__{v}")).alias(f"d_{v}") for v in values))


def bootstrap_bounds(rows: DataFrame, keys: list[str], value: str, order: str, resamples: int = 2000, seed: str = "bootstrap") -> DataFrame:
    """Percentile bootstrap of the mean per group: .025, .975, .05 and .95 quantiles of resampled means.

    Draw j of resample b takes value number (keyed draw mod n). A group is tens of values, held as an array.
    """
    held = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("v")).withColumn("n", F.size("v"))
    each = held.select(*keys, "v", "n", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b"))
    draws = F.transform(F.sequence(F.lit(1), F.col("n")), lambda j: F.element_at("v", (keyed_draw(seed, F.col("b").cast("string"), j.cast("string")) % F.col("n") + 1).cast("int")))
    means = each.withColumn("m", F.aggregate(draws, F.lit(0.0), lambda s, x: s + x) / F.col("n"))
    out = means.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975), F.lit(0.05), F.lit(0.95))).alias("q"))
    names = ("two_sided_low", "two_sided_high", "one_sided_lower_95", "one_sided_upper_95")
    return out.select(*keys, *(F.col("q")[i].alias(n) for i, n in enumerate(names)))


def sign_flip(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, raw_p): the share of all 2^n sign patterns with a mean at least the observed one.

    Patterns are rows, so more than 20 values in a group are an error.
    """
    held = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("v")).withColumn("n", F.size("v"))
    observed = held.withColumn("o", F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.col("n"))
    each = observed.select(*keys, "v", "n", "o", F.explode(F.expr("sequence(0, shiftleft(1, if(n > 20, raise_error('exact sign flips are for at most 20 values'), n)) - 1)")).alias("mask"))
    flipped = F.expr("aggregate(transform(v, (x, i) -> if((shiftright(mask, i) & 1) = 1, x, -x)), 0.0D, (s, x) -> s + x) / n")
    return each.groupBy(*keys).agg((F.count_if(flipped >= F.col("o") - 1e-15) / F.count("*")).alias("raw_p"))


def holm(rows: DataFrame, family: list[str], p: str, order: list[str], out: str = "holm_adjusted_p") -> DataFrame:
    by = Window.partitionBy(*family)
    up = by.orderBy(p, *order)
    n, rank = F.count("*").over(by), F.row_number().over(up)
    stepped = rows.withColumn("__s", (n - rank + 1) * F.col(p))
    return stepped.withColumn(out, F.least(F.lit(1.0), F.max("__s").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("__s")


def transformed(endpoint: Column, noninferiority: Column, delta: Column) -> tuple[Column, Column]:
    """(margin, transformed delta): delta + margin for non-inferiority, margin - delta for FPR safety, else delta."""
    margin = F.when(endpoint == "fpr", MARGINS["fpr"]).when(noninferiority & (endpoint == "f1"), MARGINS["f1"]).when(noninferiority & (endpoint == "pr_auc"), MARGINS["pr_auc"]).otherwise(0.0)
    return margin, F.when(endpoint == "fpr", margin - delta).otherwise(delta + margin)


def effect_sizes(rows: DataFrame, keys: list[str], delta: str) -> DataFrame:
    sd = F.stddev_samp(delta)
    return rows.groupBy(*keys).agg(
        F.avg(delta).alias("mean_delta"), F.when(sd > 0, F.avg(delta) / sd).otherwise(float("nan")).alias("paired_dz"),
        F.count_if(F.col(delta) > 1e-12).alias("wins"), F.count_if(F.col(delta) < -1e-12).alias("losses"), F.count_if(F.abs(delta) <= 1e-12).alias("ties"),
    )


def decisions(rows: DataFrame) -> DataFrame:
    """``decision`` from the confidence bound and the adjusted p-value."""
    gate = F.when(F.col("endpoint") == "fpr", F.col("one_sided_upper_95") < F.col("margin")).when(F.col("noninferiority"), F.col("one_sided_lower_95") > -F.col("margin")).otherwise(F.col("one_sided_lower_95") > 0)
    return rows.withColumn("decision", F.when(gate & (F.col("holm_adjusted_p") <= 0.05), "MET_GATE").otherwise("INCONCLUSIVE"))


def run_hypotheses(deltas: DataFrame, keys: list[str], family: list[str], resamples: int = 2000) -> DataFrame:
    """All hypotheses at once: ``deltas`` has keys, endpoint, noninferiority, seed, delta."""
    margin, shifted = transformed(F.col("endpoint"), F.col("noninferiority"), F.col("delta"))
    rows = deltas.withColumns({"margin": margin, "z": shifted})
    every = [*keys, "endpoint", "noninferiority", "margin"]
    joined = effect_sizes(rows, every, "delta").join(bootstrap_bounds(rows, every, "delta", "seed", resamples), every).join(sign_flip(rows, every, "z", "seed"), every)
    return decisions(holm(joined, family, "raw_p", every))


def average_rank(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``out``: the average rank among the keys' rows. Only distinct values are sorted, with their counts; rows get theirs by a join."""
    counts = running(rows.groupBy(*keys, value).agg(F.count("*").alias("__n")), keys, value, ["__n"])
    ranks = counts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, value])), (F.col("__n_upto") - F.col("__n") + (F.col("__n") + 1) / 2.0).alias(out))
    same = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(ranks[f"__k{i}"]) for i, k in enumerate([*keys, value])))
    return rows.join(ranks, same).drop(*(f"__k{i}" for i in range(len(keys) + 1)))


def correlations(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, pearson, spearman); null where either side is constant or fewer than two finite rows."""
    finite = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))
    ranked = average_rank(average_rank(finite, keys, x, "__rx"), keys, y, "__ry")
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.when(varies, F.corr(x, y)).alias("pearson"), F.when(varies, F.corr("__rx", "__ry")).alias("spearman"))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation by Student's t, as a pandas function over few rows (no builtin)."""
    @F.pandas_udf("double")
    def p(r_: pd.Series, n_: pd.Series) -> pd.Series:
        return pd.Series([_t_p(a, int(b)) for a, b in zip(r_, n_, strict=True)])

    return p(r.cast("double"), n.cast("double"))


def _t_p(r: float, n: int) -> float:
    from math import exp, isnan, lgamma, log

    if r is None or isnan(r) or n < 3:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    x, a, b = 1 - r * r, df / 2.0, 0.5  # p = I_x(df / 2, 1 / 2) with x = df / (df + t^2)

    def fraction(x_: float, a_: float, b_: float) -> float:
        c, d = 1.0, 1.0 - (a_ + b_) * x_ / (a_ + 1)
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 300):
            for k in (m * (b_ - m) * x_ / ((a_ + 2 * m - 1) * (a_ + 2 * m)), -(a_ + m) * (a_ + b_ + m) * x_ / ((a_ + 2 * m) * (a_ + 2 * m + 1))):
                d = 1.0 + k * d
                d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1.0 + k / c
                c = c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * fraction(x, a, b) / a
    return 1 - front * fraction(1 - x, b, a) / b
