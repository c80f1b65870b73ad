"""Metadata views of selection records and attribute-inference evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import keyed_draw
from tidemark.operators.metrics import aucs
from tidemark.operators.ranks import running

RAW = ("utility", "wire_bytes", "n_fit", "eligible")


def view_raw(records: DataFrame, keys: list[str]) -> DataFrame:
    """Six exact fields: the two keys (round and client), utility, bytes, fit rows and eligibility."""
    return records.select(*keys, *RAW)


def _normal(seed: int, *keys: Column) -> Column:
    """A standard normal from two keyed draws (Box-Muller), the same in any engine."""
    u1 = (keyed_draw("n1", F.lit(seed).cast("string"), *keys) + 1) / float(1 << 32)
    u2 = keyed_draw("n2", F.lit(seed).cast("string"), *keys) / float(1 << 32)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * F.pi() * u2)


def _noisy(utility: Column, sd: float, seed: int, keys: list[str]) -> Column:
    return F.least(F.greatest(utility, F.lit(-1.0)), F.lit(1.0)) + sd * _normal(seed, *(F.col(k).cast("string") for k in keys))


def _stepped(x: Column, step: int, least: int) -> Column:
    return F.greatest(F.rint(x / float(step)) * step, F.lit(float(least))).cast("long")


def view_noisy_quantized(records: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    return records.select(*keys, _noisy(F.col("utility"), 0.1, seed, keys).alias("utility"), _stepped(F.col("wire_bytes"), 1024, 1024).alias("wire_bytes"), _stepped(F.col("n_fit"), 1000, 0).alias("n_fit"))


def view_no_size(records: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    return records.select(*keys, _noisy(F.col("utility"), 0.2, seed, keys).alias("utility"), _stepped(F.col("wire_bytes"), 4096, 4096).alias("wire_bytes"))


def tertile(df: DataFrame, column: str, order: list[str], out: str, by: list[str]) -> DataFrame:
    """0, 1 or 2 by first-appearance rank, cut at the ranks' quantiles 1/3 and 2/3 (right-closed, any number of rows)."""
    n = F.count("*").over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(column, *order))
    edge = lambda q: 1 + q * (n - 1)
    return df.withColumn(out, F.when(rank <= edge(1 / 3) + 1e-9, 0).when(rank <= edge(2 / 3) + 1e-9, 1).otherwise(2))


def view_bucketed(records: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Tertiles of utility and bytes over all records of a cell (``by`` names the cell; a cell has a few thousand records)."""
    return tertile(tertile(records, "utility", keys, "utility_bucket", by), "wire_bytes", keys, "cost_bucket", by).select(*keys, "utility_bucket", "cost_bucket")


def above_median(rows: DataFrame, by: list[str], column: str, out: str = "target") -> DataFrame:
    """1 where the value is above its group's exact median (an aggregate, joined back)."""
    median = rows.groupBy(*by).agg(F.percentile(column, F.lit(0.5)).alias("__m"))
    return rows.join(median, by).withColumn(out, (F.col(column) > F.col("__m")).cast("int")).drop("__m")


def out_of_fold(rows: DataFrame, features: list[str], target: str, fold: str, folds: int = 5, model: str = "logistic") -> DataFrame:
    """Out-of-fold probabilities ``p``: one fit per fold on the other folds (Spark ML)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    named = rows.withColumns({f"__f_{c}": F.col(c).cast("double") for c in features}).withColumn("label", F.col(target).cast("double"))
    inputs = [f"__f_{c}" for c in features]
    stages = [Imputer(inputCols=inputs, outputCols=[f"{c}_i" for c in inputs], strategy="median"), VectorAssembler(inputCols=[f"{c}_i" for c in inputs], outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True)]
    kinds = {
        "logistic": LogisticRegression(featuresCol="__x", maxIter=100),
        "forest": RandomForestClassifier(featuresCol="__x", numTrees=50, maxDepth=6, seed=7),
        "mlp": MultilayerPerceptronClassifier(featuresCol="__x", layers=[len(features), 16, 2], maxIter=100, seed=7),
    }
    out = None
    for k in range(folds):
        fitted = Pipeline(stages=[*stages, kinds[model]]).fit(named.where(F.col(fold) != k))
        scored = fitted.transform(named.where(F.col(fold) == k)).select(*rows.columns, vector_to_array("probability")[1].alias("p"))
        out = scored if out is None else out.unionByName(scored)
    return out


def fold_aucs(scored: DataFrame, target: str, fold: str) -> DataFrame:
    """(auc, mean_fold_auc) of out-of-fold probabilities."""
    base = scored.select(F.col(fold).cast("string").alias("cell_id"), F.col(target).alias("y"), "p")
    whole = aucs(base.withColumn("cell_id", F.lit("all"))).select(F.col("roc_auc").alias("auc"))
    return whole.crossJoin(aucs(base).where(~F.isnan("roc_auc")).agg(F.avg("roc_auc").alias("mean_fold_auc")))


def group_bootstrap_auc(scored: DataFrame, group: str, target: str, resamples: int = 2000, seed: str = "auc", by: list[str] | None = None) -> DataFrame:
    """(by..., low, high): percentile bounds of the AUC over resamples of whole groups, each weighted by its draws.

    With ``by``, each of its cells has bounds of its own; a resample draws the same groups in all of them.
    """
    by = by or []
    groups = scored.select(group).distinct().agg(F.array_sort(F.collect_list(group)).alias("g")).withColumn("n", F.size("g"))
    draws = groups.select(F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b"), "g", "n").select("b", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda j: F.element_at("g", (keyed_draw(seed, F.col("b").cast("string"), j.cast("string")) % F.col("n") + 1).cast("int")))).alias(group))
    weights = draws.groupBy("b", group).agg(F.count("*").alias("w"))
    # Pairs of groups won: the positives of one against the negatives of another. Resamples only weigh these few numbers.
    counts = scored.groupBy(*by, group, "p").agg(F.sum(F.col(target)).alias("pos"), F.sum(1 - F.col(target)).alias("neg"))
    others = counts.select(*by, F.col(group).alias("other")).distinct()
    values = counts.select(*by, "p").distinct()
    grid = values.join(others, by) if by else values.crossJoin(others)
    other = counts.select(*by, "p", F.col(group).alias("other"), "neg")
    up = Window.partitionBy(*by, "other").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = grid.join(other, [*by, "p", "other"], "left").na.fill(0, ["neg"]).withColumn("under", F.sum("neg").over(up) - F.col("neg") / 2.0).drop("neg")
    won = counts.where("pos > 0").select(*by, "p", group, "pos").join(below, [*by, "p"]).groupBy(*by, group, "other").agg(F.sum(F.col("pos") * F.col("under")).alias("won"))
    sizes = counts.groupBy(*by, group).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    one = weights.join(sizes, group).groupBy(*by, "b").agg(F.sum(F.col("w") * F.col("pos")).alias("pos"), F.sum(F.col("w") * F.col("neg")).alias("neg"))
    pairs = weights.join(won, group).join(weights.select("b", F.col(group).alias("other"), F.col("w").alias("w2")), ["b", "other"])
    each = pairs.groupBy(*by, "b").agg(F.sum(F.col("w") * F.col("w2") * F.col("won")).alias("won")).join(one, [*by, "b"])
    each = each.select(*by, F.when(F.col("pos") * F.col("neg") > 0, F.col("won") / F.col("pos") / F.col("neg")).alias("auc"))
    q = F.percentile("auc", F.array(F.lit(0.025), F.lit(0.975)))
    return each.where("auc is not null").groupBy(*by).agg(q.alias("q")).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def group_aucs(scored: DataFrame, by: list[str], group: str, target: str = "y", score: str = "p") -> DataFrame:
    """(by..., group, auc, positives, negatives): the AUC within each group of each attack; a group without both classes has none.

    One Mann-Whitney over all attacks and groups: scores are summed up to distinct ones first.
    """
    keys = [*by, group]
    counts = scored.groupBy(*keys, F.col(score).alias("__p")).agg(F.sum(F.col(target)).alias("__pos"), F.sum(1 - F.col(target)).alias("__neg"))
    counts = running(counts, keys, "__p", ["__neg"])
    below = F.col("__neg_upto") - F.col("__neg") / 2.0
    sums = counts.withColumn("__won", F.col("__pos") * below).groupBy(*keys).agg(F.sum("__won").alias("__won"), F.sum("__pos").alias("positives"), F.sum("__neg").alias("negatives"))
    return sums.select(*keys, F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("__won") / F.col("positives") / F.col("negatives")).alias("auc"), "positives", "negatives")


def worst_attackers(aucs_: DataFrame, attacker: str, by: list[str]) -> DataFrame:
    """(by..., auc, attacker, tied): the greatest AUC over attackers, the first attacker that has it, and how many do.

    Attackers without an AUC don't count; where none has one, neither has the result.
    """
    best = aucs_.groupBy(*by).agg(F.max("auc").alias("__best"))
    met = aucs_.join(best, by, "inner")
    return met.groupBy(*by).agg(
        F.max("__best").alias("auc"), F.min(F.when(F.col("auc") == F.col("__best"), F.col(attacker))).alias(attacker), F.count_if(F.col("auc") == F.col("__best")).alias("tied")
    )


def auc_distribution(aucs_: DataFrame, by: list[str]) -> DataFrame:
    """(by..., auc, groups, share): the empirical distribution of the groups' AUCs, a step each distinct value.

    Values are summed up first; groups without an AUC aren't in it.
    """
    steps = aucs_.where("auc IS NOT NULL").groupBy(*by, "auc").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*by)
    upto = F.sum("__n").over(whole.orderBy("auc").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return steps.select(*by, "auc", upto.alias("groups"), (upto / F.sum("__n").over(whole)).alias("share"))
