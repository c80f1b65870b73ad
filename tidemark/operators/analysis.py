"""Derived analyses: hypotheses by threshold analysis, complete-cell summaries, proxy validity, adequacy, gates of a design."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import canonical_beta, is_finite
from tidemark.operators.metrics import choose_threshold, confusion_at, threshold_grid
from tidemark.operators.stats import average_rank, run_hypotheses
from tidemark.sources.files import written


def hypotheses_by_analysis(deltas: DataFrame, keys: list[str], family: list[str], resamples: int = 2000, analysis: str = "threshold_analysis") -> DataFrame:
    """Every hypothesis under every threshold analysis; Holm's correction stays inside one analysis."""
    return run_hypotheses(deltas, [analysis, *keys], [analysis, *family], resamples)


def metrics_by_threshold(predictions: DataFrame, full: str = "Full-Contextual") -> DataFrame:
    """(threshold_analysis, dataset, method, beta, seed, f1, pr_auc, fpr) of every cell at three thresholds.

    ``method_specific`` is the threshold that the cell chooses, ``shared_full_threshold``
    the one that the full method chose for the same dataset and seed (cells without such
    a one have no row), ``fixed_0.5`` a half. ``predictions`` has the cell's four keys
    (a null beta is a level), y and p.
    """
    keys = ["dataset", "method", "beta", "seed"]
    cell = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys))
    keyed = predictions.withColumn("cell_id", cell)
    cells = keyed.select("cell_id", *keys).distinct()
    chosen = written(choose_threshold(threshold_grid(keyed.select("cell_id", "y", "p"))).join(cells, "cell_id"))
    shared = chosen.where(F.col("method") == full).select("dataset", "seed", F.col("threshold").alias("__t"))
    values = ("f1", "fpr")
    own = chosen.select(F.lit("method_specific").alias("threshold_analysis"), "cell_id", *values)
    common = confusion_at(keyed.join(shared, ["dataset", "seed"]), F.col("__t")).select(F.lit("shared_full_threshold").alias("threshold_analysis"), "cell_id", *values)
    half = confusion_at(keyed, 0.5).select(F.lit("fixed_0.5").alias("threshold_analysis"), "cell_id", *values)
    known = chosen.select("cell_id", *keys, "pr_auc")
    return own.unionByName(common).unionByName(half).join(known, "cell_id").select("threshold_analysis", *keys, "f1", "pr_auc", "fpr")


def manifest_deltas(metrics: DataFrame, manifest: DataFrame, ours: str = "CB-Score", full: str = "Full-Contextual") -> DataFrame:
    """The paired deltas of a manifest's hypotheses, under every threshold analysis that ``metrics`` has.

    ``manifest``: family, comparator, dataset, beta, endpoint, noninferiority. Ours meets
    the comparator on analysis, dataset and seed, and on beta but for the full method,
    which has none. A pair without both finite values is left out.
    """
    long = metrics.unpivot(["threshold_analysis", "dataset", "method", "beta", "seed"], ["f1", "pr_auc", "fpr"], "endpoint", "value").where(is_finite(F.col("value"))).withColumn("__b", canonical_beta(F.col("beta")))
    asked = F.broadcast(manifest.withColumn("__b", canonical_beta(F.col("beta"))))
    left = long.where(F.col("method") == ours).drop("method", "beta").join(asked, ["dataset", "endpoint", "__b"])
    right = long.select("threshold_analysis", "dataset", "seed", "endpoint", F.col("method").alias("comparator"), F.when(F.col("method") == full, -1).otherwise(F.col("__b")).alias("__rb"), F.col("value").alias("__theirs"))
    met = left.withColumn("__rb", F.when(F.col("comparator") == full, -1).otherwise(F.col("__b"))).join(right, ["threshold_analysis", "dataset", "seed", "endpoint", "comparator", "__rb"])
    return met.select("threshold_analysis", "family", "comparator", "dataset", "beta", "endpoint", "noninferiority", "seed", (F.col("value") - F.col("__theirs")).alias("delta"))


def manifest_results(metrics: DataFrame, manifest: DataFrame, resamples: int = 2000) -> DataFrame:
    """Every manifest row under every threshold analysis with effect, bounds, p-values and decision; Holm's families stay inside an analysis."""
    deltas = written(manifest_deltas(metrics, manifest))
    return run_hypotheses(deltas, ["threshold_analysis", "family", "comparator", "dataset", "beta"], ["threshold_analysis", "family"], resamples)


def threshold_distribution(chosen: DataFrame, cells: DataFrame, key: str = "cell_id") -> DataFrame:
    """A row a cell of the manifest: the threshold it chose on validation data, by which rule, and the metrics there."""
    return cells.join(chosen.select(key, "threshold", "selection_rule", *(F.col(v).alias(f"validation_{v}") for v in ("f1", "pr_auc", "fpr"))), key)


def complete_cells(phases: Mapping[str, DataFrame], complete: DataFrame, keys: list[str]) -> DataFrame:
    """All phases' cells in one frame with their ``phase``; only cells marked complete, phases without cells left out."""
    out = None
    for name, cells in phases.items():
        own = cells.withColumn("phase", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.join(complete.select(*keys).distinct(), keys, "left_semi")


def aggregation_gain(rounds: DataFrame, keys: list[str], order: str = "round", f1: str = "f1", fpr: str = "fpr", penalty: float = 0.25) -> DataFrame:
    """``actual_gain``: what a round's aggregation added to J = F1 - ``penalty`` FPR; null in the first round."""
    j = F.col(f1) - penalty * F.col(fpr)
    return rounds.withColumn("actual_gain", j - F.lag(j).over(Window.partitionBy(*keys).orderBy(order)))


def seed_correlations(rows: DataFrame, keys: list[str], seed: str, x: str, y: str) -> DataFrame:
    """(keys, seeds, mean_seed_pearson, mean_seed_spearman) over the seeds in which both sides vary."""
    finite = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    by = [*keys, seed]
    ranked = average_rank(average_rank(finite, by, x, "__rx"), by, y, "__ry")
    each = ranked.groupBy(*by).agg(((F.min(x) < F.max(x)) & (F.min(y) < F.max(y))).alias("__varies"), F.corr(x, y).alias("__p"), F.corr("__rx", "__ry").alias("__s"))
    return each.where("__varies").groupBy(*keys).agg(F.count("*").alias("seeds"), F.avg("__p").alias("mean_seed_pearson"), F.avg("__s").alias("mean_seed_spearman"))


def adequacy(rows: DataFrame, keys: list[str], pr_auc: str, positives: str, total: str) -> DataFrame:
    """(keys, pr_auc, prevalence, above_prevalence): a ranking without skill has a PR-AUC equal to the prevalence."""
    held = rows.groupBy(*keys).agg(F.avg(pr_auc).alias("pr_auc"), (F.sum(positives) / F.sum(total)).alias("prevalence"))
    return held.withColumn("above_prevalence", F.col("pr_auc") - F.col("prevalence"))


def rank_validity(rows: DataFrame, low: str, out: str = "rank_validity") -> DataFrame:
    """'SUPPORTED' where the lower confidence bound of the rank correlation is above 0."""
    return rows.withColumn(out, F.when(F.col(low) > 0, "SUPPORTED").otherwise("NOT_SUPPORTED"))


def equal_quotas(strata: DataFrame, total: int, available: str, key: str, group: list[str] | None = None) -> DataFrame:
    """``quota``: an equal share for each class (rounded down, never above what is there), what is left one by one in turns.

    Turns go round the classes with room in the order of their keys. That is water filling: with the level L full
    turns reach, a class has min(available, L), and the first classes with room left get one more. Classes are few
    (one row each), and a level is found among their own availabilities.
    """
    by = Window.partitionBy(*(group or [F.lit(0)]))
    up = by.orderBy(available, key)
    n = F.count("*").over(by)
    base = F.floor(F.lit(total) / n)
    # Raising the level to class i's availability costs what the smaller ones hold and that much for each of the others.
    held = strata.withColumns({"__i": F.row_number().over(up), "__n": n, "__base": base, "__below": F.coalesce(F.sum(available).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    reach = (F.lit(total) - F.col("__below")) / (F.col("__n") - F.col("__i") + 1)
    # The level is set by the first class that the water doesn't cover.
    open_ = F.when(F.floor(reach) < F.col(available), F.floor(reach))
    level = F.first(open_, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = held.withColumn("__q", F.least(F.col(available), F.coalesce(level, F.col(available)))).withColumn("__room", (F.col(available) > F.col("__q")).cast("int"))
    spare = F.lit(total) - F.sum("__q").over(by)
    turn = F.sum("__room").over(by.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    quota = F.col("__q") + F.when((F.col("__room") == 1) & (turn <= spare), 1).otherwise(0)
    return filled.withColumn("quota", quota.cast("long")).drop("__i", "__n", "__base", "__below", "__q", "__room")


def remove_features(columns: list[str], flagged: list[str], expected: int = 10) -> list[str]:
    """``columns`` without the flagged ones, of which exactly ``expected`` must be there."""
    gone = [c for c in columns if c in set(flagged)]
    if len(gone) != expected:
        raise ValueError(f"expected exactly {expected} flagged features, found {len(gone)}")
    return [c for c in columns if c not in set(gone)]


def checked_config(config: Mapping) -> Mapping:
    """A configuration whose split ratios sum to 1 and whose clients are at least 2."""
    ratios = config["split"]
    total = sum(float(ratios[k]) for k in ("train", "validation", "test"))
    if abs(total - 1.0) > 1e-9:
        raise ValueError(f"split ratios sum to {total}, not to 1")
    if int(config["clients"]) < 2:
        raise ValueError("at least two clients are needed")
    return config


def fold_design(rows: DataFrame, group: str, fold: str, target: str, values: list[str]) -> DataFrame:
    """(fold, group_overlap, train_classes, test_classes, nonfinite, valid): a design is valid before any model is fitted on it.

    No group may be on both sides, both sides need both classes, and every value must be finite.
    """
    bad: Column = F.lit(False)
    for v in values:
        bad = bad | F.col(v).isNull() | F.isnan(F.col(v).cast("double")) | (F.abs(F.col(v).cast("double")) == float("inf"))
    # Folds by group: a group's rows in and out of a fold, from one aggregate of the rows.
    by_group = rows.groupBy(group, fold, target).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    folds = by_group.select(F.col(fold).alias("__f")).distinct()
    sides = by_group.join(folds).withColumn("test", F.col(fold) == F.col("__f"))
    by_side = sides.groupBy("__f", group).agg(F.count_distinct("test").alias("sides"))
    overlap = by_side.groupBy("__f").agg(F.count_if(F.col("sides") > 1).alias("group_overlap"))
    seen = sides.groupBy("__f").agg(
        F.count_distinct(F.when(~F.col("test"), F.col(target))).alias("train_classes"), F.count_distinct(F.when(F.col("test"), F.col(target))).alias("test_classes"), F.sum("bad").alias("nonfinite")
    )
    valid = (F.col("group_overlap") == 0) & (F.col("train_classes") == 2) & (F.col("test_classes") == 2) & (F.col("nonfinite") == 0)
    return overlap.join(seen, "__f").withColumnRenamed("__f", fold).withColumn("valid", valid)


def dataset_gates(totals: DataFrame) -> DataFrame:
    """The eight checks of a dataset from one row of totals: (check, passed, severity).

    ``totals``: files_with_errors, raw_benign, raw_attack, conflicts_left, least_groups (of a split), least_class (rows
    of a split's smaller class), cross_split, least_rows (of a split), least_client, suspicious.
    """
    from tidemark.operators.integrity import checks

    c = F.col
    return checks(
        [
            ("schema_consistency", c("files_with_errors") == 0, "fail"),
            ("binary_classes_raw", (c("raw_benign") > 0) & (c("raw_attack") > 0), "fail"),
            ("conflicting_label_duplicates_excluded", c("conflicts_left") == 0, "fail"),
            ("source_group_disjoint", c("least_groups") > 0, "fail"),
            ("cohort_each_split_has_two_classes", c("least_class") > 0, "fail"),
            ("transformed_cross_split_overlap_zero", c("cross_split") == 0, "fail"),
            ("all_processed_splits_nonempty", c("least_rows") > 0, "fail"),
            ("client_partition_min_support", c("least_client") > 0, "fail"),
            ("suspicious_features_reviewed", c("suspicious") == 0, "review"),
        ],
        totals,
    )


def cell_checks(cells: DataFrame, rounds: DataFrame, key: str, expected_rounds: int, budget: str, used: str, values: list[str]) -> DataFrame:
    """(cell, rounds, overspent, unusable, status) of every cell: all rounds once, no round over its budget, all metrics in [0, 1]."""
    bad: Column = F.lit(False)
    for v in values:
        bad = bad | F.col(v).isNull() | F.isnan(v) | ~F.col(v).between(0.0, 1.0)
    seen = rounds.groupBy(key).agg(F.count_distinct("round").alias("rounds"), F.count("*").alias("__n"), F.count_if(F.col(used) > F.col(budget)).alias("overspent"), F.count_if(bad).alias("unusable"))
    joined = cells.select(key).distinct().join(seen, key, "left").na.fill(0, ["rounds", "__n", "overspent", "unusable"])
    ok = (F.col("rounds") == expected_rounds) & (F.col("__n") == expected_rounds) & (F.col("overspent") == 0) & (F.col("unusable") == 0)
    return joined.withColumn("status", F.when(ok, "PASS").otherwise("FAIL")).drop("__n")


def phase_checks(cells: DataFrame, expected: Mapping[str, int], status: str = "status") -> DataFrame:
    """(phase, cells, failed, expected, complete): every phase has the number of cells it needs, and all of them pass."""
    wanted = cells.sparkSession.createDataFrame(list(expected.items()), "phase string, expected long")
    seen = cells.groupBy("phase").agg(F.count("*").alias("cells"), F.count_if(F.col(status) != "PASS").alias("failed"))
    joined = wanted.join(seen, "phase", "left").na.fill(0, ["cells", "failed"])
    return joined.withColumn("complete", (F.col("cells") == F.col("expected")) & (F.col("failed") == 0))
