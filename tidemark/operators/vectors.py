"""Model vectors: weighted means, norm clipping, similarities; arithmetic in double."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.columns import cosine, l2_norm


def weighted_mean(rows: DataFrame, keys: list[str], vector: str, weight: str) -> DataFrame:
    """(keys, mean): sum(w x) / sum(w) by position. Positions are aggregated, so no task holds all vectors of a key."""
    flat = rows.select(*keys, F.col(weight).cast("double").alias("w"), F.posexplode(vector).alias("i", "x"))
    by = flat.groupBy(*keys, "i").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("m"))
    return by.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def clipped_mean(rows: DataFrame, keys: list[str], vector: str, weight: str, mads: float = 2.5) -> DataFrame:
    """The weighted mean after scaling each vector to at most median + 2.5 MAD of the norms.

    A threshold of 1e-12 or less becomes max(median, 1e-12).
    """
    normed = rows.withColumn("__n", l2_norm(F.col(vector)))
    median = normed.groupBy(*keys).agg(F.percentile("__n", F.lit(0.5)).alias("__m"))
    spread = normed.join(median, keys).groupBy(*keys, "__m").agg(F.percentile(F.abs(F.col("__n") - F.col("__m")), F.lit(0.5)).alias("__mad"))
    limit = spread.withColumn("__t", F.col("__m") + mads * F.col("__mad")).withColumn("__t", F.when(F.col("__t") <= 1e-12, F.greatest("__m", F.lit(1e-12))).otherwise(F.col("__t")))
    scaled = normed.join(limit, keys).withColumn("__s", F.least(F.lit(1.0), F.col("__t") / F.greatest("__n", F.lit(1e-12))))
    out = scaled.withColumn(vector, F.transform(vector, lambda x: x.cast("double") * F.col("__s"))).drop("__n", "__m", "__mad", "__t", "__s")
    return weighted_mean(out, keys, vector, weight)


def apply_or_keep(old: DataFrame, delta: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """The old vector plus the mean delta, or the old one where nothing was selected."""
    joined = old.join(delta, keys, "left")
    return joined.select(*keys, F.when(F.col("mean").isNull(), F.transform(vector, lambda x: x.cast("double"))).otherwise(F.zip_with(vector, "mean", lambda a, b: a.cast("double") + b)).alias(vector))


def with_similarity(rows: DataFrame, reference: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``delta_l2`` and ``cosine_to_mean`` against a reference mean per key."""
    joined = rows.join(reference, keys)
    return joined.withColumns({"delta_l2": l2_norm(F.col(vector)), "cosine_to_mean": cosine(F.col(vector), F.col("mean"))}).drop("mean")


def serialized_sizes(rows: DataFrame, vector: str) -> DataFrame:
    """``wire_bytes``: a 12-byte header and the float32 values, zlib level 6, plus 64 (a codec has no built-in form)."""
    @F.pandas_udf("long")
    def size(v: pd.Series) -> pd.Series:
        import zlib

        import numpy as np

        return v.map(lambda x: len(zlib.compress(b"\0" * 12 + np.asarray(x if x is not None else [], dtype="<f4").tobytes(), 6)) + 64)

    return rows.withColumn("wire_bytes", size(F.col(vector)))
