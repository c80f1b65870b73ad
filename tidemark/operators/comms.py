"""Communication analytics over round series: running bytes, targets, interpolation on common grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.columns import WIRE_OVERHEAD, metadata_bytes


def byte_accounting(rounds: DataFrame, clients: int = 10) -> DataFrame:
    """Per round: uplink, metadata (each with its own overhead), downlinks and both end-to-end totals.

    Needs method, used_bytes, model_bytes. Full-Contextual sends no metadata.
    """
    meta = F.when(F.col("method") == "Full-Contextual", 0).otherwise(clients * (metadata_bytes(F.col("method")) + WIRE_OVERHEAD))
    down = F.col("model_bytes") + WIRE_OVERHEAD
    return rounds.withColumns({"metadata_wire": meta.cast("long"), "downlink_broadcast": down.cast("long"), "downlink_unicast": (clients * down).cast("long")}).withColumns(
        {"E2E_broadcast": F.col("used_bytes") + F.col("metadata_wire") + F.col("downlink_broadcast"), "E2E_unicast": F.col("used_bytes") + F.col("metadata_wire") + F.col("downlink_unicast")}
    )


def with_running(rounds: DataFrame, keys: list[str], column: str, out: str, order: str = "round") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rounds.withColumn(out, F.sum(column).over(w))


def final_values(rounds: DataFrame, keys: list[str], columns: list[str], order: str = "round") -> DataFrame:
    return rounds.groupBy(*keys).agg(*(F.max_by(c, order).alias(c) for c in columns))


def bytes_to_target(rounds: DataFrame, keys: list[str], reference: DataFrame, reference_keys: list[str], endpoints: list[str], fractions: list[float], order: str = "round") -> DataFrame:
    """(keys, endpoint, fraction, target, reached, round, bytes): the first round at a fraction of the reference's final value."""
    long = rounds.unpivot([*keys, order, "cum_bytes"], endpoints, "endpoint", "value")
    finals = final_values(reference, reference_keys, endpoints, order).unpivot(reference_keys, endpoints, "endpoint", "final")
    wanted = finals.crossJoin(F.broadcast(rounds.sparkSession.createDataFrame([(f,) for f in fractions], "fraction double"))).withColumn("target", F.col("fraction") * F.col("final"))
    joined = long.join(wanted, [*reference_keys, "endpoint"])
    hit = F.when(F.col("value") >= F.col("target"), F.col(order))
    return joined.groupBy(*keys, "endpoint", "fraction", "target").agg(
        F.max(F.col("value") >= F.col("target")).alias("reached"), F.min(hit).alias("round"), F.min_by("cum_bytes", hit).alias("bytes")
    )


def overlap_grid(curves: DataFrame, group: list[str], member: str, x: str, points: int = 20) -> DataFrame:
    """(group, k, g): evenly spaced points on the overlap of the members' ranges; groups without one give none."""
    ends = curves.groupBy(*group, member).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).groupBy(*group).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi")).where("hi >= lo")
    k = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")
    return ends.select(*group, "lo", "hi", k).select(*group, "k", (F.col("lo") + F.col("k") * ((F.col("hi") - F.col("lo")) / float(points - 1))).alias("g"))


def interpolate(curves: DataFrame, grid: DataFrame, group: list[str], member: str, x: str, values: list[str]) -> DataFrame:
    """Linear interpolation of each member's values at the grid, clamped at its ends.

    An as-of join by union: grid and curve points are sorted together, and each grid
    point takes the last curve point before and the first after. No range join.
    """
    members = curves.select(*group, member).distinct()
    asked = grid.join(members, group).select(*group, member, "k", F.col("g").alias("__x"), *(F.lit(None).cast("double").alias(v) for v in values), F.lit(None).cast("double").alias("__px"))
    known = curves.select(*group, member, F.lit(None).cast("int").alias("k"), F.col(x).cast("double").alias("__x"), *(F.col(v).cast("double").alias(v) for v in values), F.col(x).cast("double").alias("__px"))
    both = known.unionByName(asked)
    back = Window.partitionBy(*group, member).orderBy("__x", F.col("k").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*group, member).orderBy("__x", F.col("k").isNotNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    placed = both.withColumns({"__x0": F.last("__px", True).over(back), "__x1": F.first("__px", True).over(ahead)} | {f"__a_{v}": F.last(v, True).over(back) for v in values} | {f"__b_{v}": F.first(v, True).over(ahead) for v in values})
    share = (F.col("__x") - F.col("__x0")) / (F.col("__x1") - F.col("__x0"))

    def value(v: str):
        a, b = F.col(f"__a_{v}"), F.col(f"__b_{v}")
        return F.when(F.col("__x0").isNull(), b).when(F.col("__x1").isNull() | (F.col("__x1") == F.col("__x0")) | (F.col("__x") == F.col("__x0")), a).otherwise(a + (b - a) * share).alias(v)

    return placed.where(F.col("k").isNotNull()).select(*group, member, "k", F.col("__x").alias("g"), *(value(v) for v in values))
