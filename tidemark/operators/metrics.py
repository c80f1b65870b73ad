"""Detection metrics from predictions: confusion counts, AUCs, threshold grids and choices, curves.

A prediction row: cell_id, y (0 or 1), p. Everything is first aggregated to one row
per cell and distinct score, so windows run over scores, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.ranks import running

NAN = float("nan")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def score_counts(predictions: DataFrame, cell: str = "cell_id") -> DataFrame:
    """(cell, p, pos, neg) per distinct score."""
    return predictions.groupBy(cell, "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))


def metric_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    specificity = _ratio(tn, tn + fp)
    present = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    return {
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        "balanced_accuracy": _ratio(recall + specificity, present),
        "precision": precision,
        "recall": recall,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "fpr": fp / F.greatest(F.lit(1), fp + tn),
        "fp_per_10000": 10000.0 * fp / F.greatest(F.lit(1), fp + tn),
    }


def confusion_at(predictions: DataFrame, threshold, cell: str = "cell_id") -> DataFrame:
    """Counts and metrics per cell at p >= threshold (a number or a column of the rows)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, bad = F.col("p") >= t, F.col("y") == 1
    counts = predictions.groupBy(cell).agg(
        F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"), F.count_if(~hit & ~bad).alias("tn")
    )
    return counts.withColumns(metric_columns(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))))


def _from(c: str) -> Column:
    """The sum over a score and all above it, from running sums."""
    return F.col(f"{c}_all") - F.col(f"{c}_upto") + F.col(c)


def aucs(predictions: DataFrame, cell: str = "cell_id") -> DataFrame:
    """ROC-AUC (ties count half) and average precision per cell; NaN where a class is missing."""
    counts = running(score_counts(predictions, cell), [cell], "p", ["pos", "neg"])
    ranked = counts.select(cell, "pos", "neg", (F.col("neg_upto") - F.col("neg")).alias("below"), _from("pos").alias("tp"), _from("neg").alias("fp"))
    sums = ranked.groupBy(cell).agg(
        F.sum("pos").alias("n1"), F.sum("neg").alias("n0"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("u"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap")
    )
    both = (F.col("n1") > 0) & (F.col("n0") > 0)
    return sums.select(cell, F.when(both, F.col("u") / (F.col("n1") * F.col("n0"))).otherwise(NAN).alias("roc_auc"), F.when(both, F.col("ap") / F.col("n1")).otherwise(NAN).alias("pr_auc"))


def threshold_grid(predictions: DataFrame, cell: str = "cell_id") -> DataFrame:
    """91 thresholds, 0.05 to 0.95 by 0.01, with counts and metrics: scores fall into grid steps, then suffix sums."""
    spark = predictions.sparkSession
    grid = spark.range(91).select(F.round(F.lit(0.05) + F.col("id") * 0.01, 10).alias("threshold"), F.col("id").cast("int").alias("step"))
    counts = score_counts(predictions, cell)
    edges = F.array(*(F.lit(round(0.05 + 0.01 * i, 10)) for i in range(91)))
    stepped = counts.withColumn("step", F.size(F.filter(edges, lambda e: e <= F.col("p"))) - 1).groupBy(cell, "step").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cells = counts.groupBy(cell).agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))
    full = cells.crossJoin(F.broadcast(grid)).join(stepped, [cell, "step"], "left").na.fill(0, ["pos", "neg"])
    suffix = Window.partitionBy(cell).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = full.withColumns({"tp": F.sum("pos").over(suffix), "fp": F.sum("neg").over(suffix)})
    held = held.withColumns({"fn": F.col("n1") - F.col("tp"), "tn": F.col("n0") - F.col("fp")}).drop("pos", "neg", "n1", "n0", "step")
    return held.withColumns(metric_columns(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))).join(aucs(predictions, cell), cell)


def choose_threshold(grid: DataFrame, most_fpr: float = 0.05, cell: str = "cell_id") -> DataFrame:
    """Per cell: among FPR <= limit the greatest F1, PR-AUC, precision, least threshold; else least FPR, greatest F1, PR-AUC, least threshold."""
    ok = F.col("fpr") <= most_fpr + 1e-12
    rule = Window.partitionBy(cell).orderBy(
        F.desc("ok"), F.when(F.col("ok"), -F.col("f1")).otherwise(F.col("fpr")), F.when(F.col("ok"), -F.col("pr_auc")).otherwise(-F.col("f1")),
        F.when(F.col("ok"), -F.col("precision")).otherwise(-F.col("pr_auc")), "threshold",
    )
    ranked = grid.withColumn("ok", ok).withColumn("__rn", F.row_number().over(rule)).where("__rn = 1").drop("__rn")
    return ranked.withColumn("selection_rule", F.when(F.col("ok"), "FPR_FEASIBLE").otherwise("MIN_FPR")).drop("ok")


def curves(predictions: DataFrame, cell: str = "cell_id", most: int = 201, collinear: bool = True) -> DataFrame:
    """(cell, curve, i, x, y, threshold): PR (rising threshold, end point without one) and ROC, thinned to ``most`` points.

    All distinct scores are points. Without ``collinear``, ROC points go before thinning
    where the cumulative counts of both classes rise as much to the next score as from
    the one before (no second difference), unless they are the first or last score.
    Endpoints always stay.
    """
    counts = running(score_counts(predictions, cell).withColumn("one", F.lit(1)), [cell], "p", ["pos", "neg", "one"], ["pos", "neg"])
    base = counts.withColumns({"tp": _from("pos"), "fp": _from("neg"), "n1": F.col("pos_all"), "n0": F.col("neg_all")})
    base = base.withColumns({"recall": _ratio(F.col("tp"), F.col("n1")), "precision": F.col("tp") / (F.col("tp") + F.col("fp")), "fpr_": _ratio(F.col("fp"), F.col("n0"))})
    none, highest = F.lit(None).cast("double"), F.col("one_upto") == F.col("one_all")

    def points(rows: DataFrame, curve: str, x: str, y: str, i: Column) -> DataFrame:
        return rows.select(cell, F.lit(curve).alias("curve"), F.col(x).alias("x"), F.col(y).alias("y"), F.col("p").alias("threshold"), i.alias("i"), (F.col("one_all") + 1).alias("n"))

    def end(rows: DataFrame, curve: str, y: float, i: Column) -> DataFrame:  # one row a cell, by its highest score
        return rows.where(highest).select(cell, F.lit(curve).alias("curve"), F.lit(0.0).alias("x"), F.lit(y).alias("y"), none.alias("threshold"), i.alias("i"), (F.col("one_all") + 1).alias("n"))

    turns = base
    if not collinear:
        # Towards lower scores: a count rises by its own at this score, and by that of the score before in rising order at the next.
        bent = F.lit(False)
        for c in ("pos", "neg"):
            bent = bent | F.coalesce(F.col(f"{c}_before") != F.col(c), F.lit(True))
        turns = running(base.where(bent | highest).drop("one_upto", "one_all"), [cell], "p", ["one"])
    pr = points(base, "PR", "recall", "precision", F.col("one_upto") - 1).unionByName(end(base, "PR", 1.0, F.col("one_all")))
    roc = points(turns, "ROC", "fpr_", "recall", F.col("one_all") - F.col("one_upto") + 1).unionByName(end(turns, "ROC", 0.0, F.lit(0).cast("long")))
    # Point k of those that stay is number floor(k * step): whether i is such a number shows near i / step.
    last = F.least(F.lit(most), F.col("n")) - 1
    step = (F.col("n") - 1) / F.greatest(F.lit(1), last)
    stays = F.lit(False)
    for d in (-1, 0, 1):
        k = F.floor(F.col("i") / step) + d
        stays = stays | ((k >= 0) & (k <= last) & (F.floor(k * step + 1e-9) == F.col("i")))
    return pr.unionByName(roc).where(stays).select(cell, "curve", F.col("i").cast("int").alias("i"), "x", "y", "threshold")
