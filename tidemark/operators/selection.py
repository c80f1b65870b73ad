"""Budgeted client selection: eligibility, priorities, greedy admission, exact subset search.

A candidate row: group keys, client_id, utility, wire_bytes, n_fit, n_utility,
utility_benign, utility_attack, predicted_airtime_us (nullable),
local_training_seconds (nullable). A group is one round of one cell, tens of
candidates, so a group's fold over a sorted array stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import is_finite, keyed_draw, winsorized_minmax

METHODS = ("Full-Contextual", "Random-Budget", "Cost-Only", "Utility-Only", "Utility-Cost-Ratio", "CB-Score", "Historical-DoubleCost", "Oort-Style-Adapted", "Oracle-Score-Exact")
#: Fixed values of the selection rule.
ALPHA_UTILITY, ALPHA_COST = 1.0, 0.25
FPR_PENALTY = 0.25
SUPPORT = {"n_utility": 20, "utility_benign": 5, "utility_attack": 5, "n_fit": 180}


def marginal_utility(global_f1: Column, global_fpr: Column, local_f1: Column, local_fpr: Column, penalty: float = FPR_PENALTY) -> Column:
    """J(local) - J(global) with J = F1 - penalty * FPR; NaN if any part isn't finite."""
    value = (local_f1 - penalty * local_fpr) - (global_f1 - penalty * global_fpr)
    ok = is_finite(global_f1) & is_finite(global_fpr) & is_finite(local_f1) & is_finite(local_fpr)
    return F.when(ok, value).otherwise(F.lit(float("nan")))


def round_budgets(candidates: DataFrame, keys: list[str], beta: float | None) -> DataFrame:
    """``budget``: floor(beta * all bytes of the group), or all bytes where beta is None."""
    if beta is not None and beta < 0:
        raise ValueError("the budget must not be negative")
    total = F.sum("wire_bytes").over(Window.partitionBy(*keys))
    return candidates.withColumn("budget", (total if beta is None else F.floor(F.lit(float(beta)) * total)).cast("long"))


def static_eligible(budget: Column, support: dict[str, int] | None = None) -> Column:
    support = SUPPORT if support is None else support
    ok = is_finite(F.col("utility")) & (F.col("wire_bytes") > 0) & (F.col("wire_bytes") <= budget)
    for column, least in support.items():
        ok = ok & (F.col(column) >= least)
    return F.coalesce(ok, F.lit(False))


def with_priority(candidates: DataFrame, method: str, keys: list[str], gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """``priority`` of every candidate under a method (all candidates count for the scaling, eligible or not)."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    u, cost = F.coalesce(F.col("utility").cast("double"), F.lit(float("nan"))), F.col("wire_bytes").cast("double")
    positive = F.when(F.isnan(u), u).otherwise(F.greatest(u, F.lit(0.0)))
    if method == "Cost-Only":
        return candidates.withColumn("priority", 1.0 / (cost + 1e-12))
    if method == "Utility-Only":
        return candidates.withColumn("priority", positive)
    if method == "Utility-Cost-Ratio":
        return candidates.withColumn("priority", positive / (cost + 1e-12))
    if method in ("CB-Score", "Historical-DoubleCost", "Oracle-Score-Exact"):
        scaled = winsorized_minmax(winsorized_minmax(candidates, "utility", "__u", keys), "wire_bytes", "__c", keys)
        raw = ALPHA_UTILITY * F.col("__u") - ALPHA_COST * F.col("__c")
        score = F.when(F.isnan(raw), raw).otherwise(F.greatest(raw, F.lit(0.0)))
        return scaled.withColumn("priority", score / (cost + 1e-12) if method == "Historical-DoubleCost" else score).drop("__u", "__c")
    if method == "Oort-Style-Adapted":
        duration = F.coalesce(F.col("predicted_airtime_us"), cost) + F.coalesce(F.col("local_training_seconds"), F.lit(0.0)) * 1e6
        timed = candidates.withColumn("__d", duration.cast("double"))
        timed = timed.join(timed.groupBy(*keys).agg(F.percentile("__d", F.lit(0.5)).alias("__t")), keys)
        held = F.greatest(F.col("__d"), F.lit(1e-12))
        penalty = F.when(held > F.col("__t"), F.pow(F.col("__t") / held, F.lit(gamma))).otherwise(1.0)
        return timed.withColumn("priority", positive * penalty).drop("__d", "__t")
    if method == "Random-Budget":  # a keyed order stands for the shuffle
        return candidates.withColumn("priority", 1.0 + keyed_draw("order", F.lit(seed).cast("string"), *(F.col(k).cast("string") for k in keys), F.col("client_id").cast("string")))
    return candidates.withColumn("priority", F.lit(1.0))


def select_clients(
    candidates: DataFrame, method: str, keys: list[str], beta: float | None, support: dict[str, int] | None = None, gamma: float = 1.0, seed: int = 0
) -> DataFrame:
    """One row per group: selected (ids in order of admission), used_bytes and diagnostics.

    Admission is greedy over falling priority (ties: smaller id): what doesn't fit is
    skipped and the scan goes on. Priorities of 0 or less are passed over; NaN isn't.
    Full-Contextual takes everyone and uses no budget. A group without admissions has
    an empty list and empty_round; nothing is forced in.
    """
    rows = with_priority(round_budgets(candidates, keys, None if method == "Full-Contextual" else beta), method, keys, gamma, seed)
    if method == "Full-Contextual":
        return rows.groupBy(*keys).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("client_id"))), lambda x: x["client_id"]).alias("selected"),
            F.sum("wire_bytes").alias("used_bytes"), F.sum("wire_bytes").alias("budget_bytes"), F.lit(1.0).alias("budget_utilization"),
            F.count("*").alias("static_eligible_count"), F.count("*").alias("ranking_positive_count"), F.lit(False).alias("empty_round"),
        )
    rows = rows.withColumn("eligible", static_eligible(F.col("budget"), support))
    if method == "Oracle-Score-Exact":
        return exact_subsets(rows, keys)
    rank = F.when(F.isnan("priority"), float("-inf")).otherwise(-F.col("priority"))
    entry = F.when(F.col("eligible") & ~(F.coalesce(F.col("priority"), F.lit(0.0)) <= 0), F.struct(rank.alias("r"), F.col("client_id").alias("id"), F.col("wire_bytes").alias("b")))
    grouped = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(entry)).alias("queue"), F.first("budget").alias("budget_bytes"), F.count_if("eligible").alias("static_eligible_count"), F.count_if(F.col("eligible") & (F.col("priority") > 0)).alias("ranking_positive_count")
    )
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<bigint>)").alias("ids"))
    fits = lambda acc, x: acc["used"] + x["b"] <= F.col("budget_bytes")
    fold = F.aggregate("queue", start, lambda acc, x: F.struct((acc["used"] + F.when(fits(acc, x), x["b"]).otherwise(0)).cast("long").alias("used"), F.when(fits(acc, x), F.array_append(acc["ids"], x["id"].cast("long"))).otherwise(acc["ids"]).alias("ids")))
    done = grouped.withColumn("fold", fold)
    return done.select(
        *keys, F.col("fold.ids").alias("selected"), F.col("fold.used").alias("used_bytes"), "budget_bytes",
        F.when(F.col("budget_bytes") > 0, F.col("fold.used") / F.col("budget_bytes")).otherwise(0.0).alias("budget_utilization"),
        "static_eligible_count", "ranking_positive_count", (F.size("fold.ids") == 0).alias("empty_round"),
    )


def exact_subsets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The best subset within the budget of each group's eligible, positive candidates (at most 20).

    Order: value, then utility, then fewer bytes, then ids that come first.
    """
    entry = F.when(F.col("eligible") & (F.col("priority") > 0), F.struct(F.col("client_id").cast("long").alias("id"), F.col("wire_bytes").alias("b"), F.col("priority").alias("p"), F.col("utility").alias("u")))
    grouped = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(entry)).alias("pool"), F.first("budget").alias("budget_bytes"), F.count_if("eligible").alias("static_eligible_count"), F.count_if(F.col("eligible") & (F.col("priority") > 0)).alias("ranking_positive_count")
    ).withColumn("checked", F.when(F.size("pool") > 20, F.raise_error(F.lit("exact search is for at most 20 candidates"))).otherwise(F.lit(0)).cast("int"))
    masks = grouped.select("*", F.explode(F.expr("sequence(0, shiftleft(1, size(pool)) - 1 + checked)")).alias("mask"))
    chosen = masks.withColumn("sub", F.expr("filter(pool, (x, i) -> (shiftright(mask, i) & 1) = 1)"))
    total = lambda f: F.aggregate("sub", F.lit(0.0), lambda s, x: s + x[f].cast("double"))
    valued = chosen.select(*keys, "budget_bytes", "static_eligible_count", "ranking_positive_count", total("p").alias("value"), total("u").alias("utility"), total("b").cast("long").alias("used"), F.transform("sub", lambda x: x["id"]).alias("ids"))
    best = valued.where("used <= budget_bytes").groupBy(*keys).agg(
        F.max_by(F.struct("ids", "used"), F.struct("value", "utility", -F.col("used"), F.transform("ids", lambda x: -x))).alias("best"),
        F.first("budget_bytes").alias("budget_bytes"), F.first("static_eligible_count").alias("static_eligible_count"), F.first("ranking_positive_count").alias("ranking_positive_count"),
    )
    return best.select(
        *keys, F.col("best.ids").alias("selected"), F.col("best.used").alias("used_bytes"), "budget_bytes",
        F.when(F.col("budget_bytes") > 0, F.col("best.used") / F.col("budget_bytes")).otherwise(0.0).alias("budget_utilization"),
        "static_eligible_count", "ranking_positive_count", (F.size("best.ids") == 0).alias("empty_round"),
    )
