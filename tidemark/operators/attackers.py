"""Attribute inference as a grid: every view, target and attacker on folds that no group crosses.

All cells share one fold table, written once. The logistic attackers of the whole grid are
fitted together: a pass over the table sums every fit's loss, gradient and Hessian, so the
number of jobs follows the Newton steps and not the cells. Forests and networks are Spark ML's.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.privacy import group_aucs, group_bootstrap_auc
from tidemark.sources.files import shared_folder

#: The attackers' settings.
FOREST = {"numTrees": 300, "maxDepth": 8, "minInstancesPerNode": 3}
HIDDEN = (32, 16)
NETWORK_STEPS = 1000
PENALTY = 1.0
ATTACKERS = ("LogisticRegression", "RandomForest", "MLP")
#: One-hot columns a category may have: a fit's Hessian has the square of it.
MOST_CATEGORIES = 1000


def fold_table(views: dict[str, tuple[DataFrame, list[str], str | None]], targets: DataFrame, target_names: list[str], keys: list[str], group: str, folds: DataFrame) -> DataFrame:
    """One row per view, target, record and fold: view, target, fit, held, keys..., y, w, raw, scaled.

    ``views``: name -> (records, numeric fields, categorical field or None), all with ``keys``,
    one of which is ``group``; ``targets``: the keys and a 0/1 column per name; ``folds``:
    (group, fold). A record is ``held`` in its group's own fold and trains all others. ``raw``
    and ``scaled`` hold a view's numbers, then one column a training category (one only seen in
    the held fold is all zeros). Scales are the training rows' mean and population deviation
    (0: 1), and ``w`` weighs a training row so that both classes weigh the same. A number that
    is null or not finite is an error; a record without a target or fold takes no part.
    """
    spark = targets.sparkSession
    fits = sorted(r["fold"] for r in folds.select("fold").distinct().collect())
    marked = targets.select(*keys, F.explode(F.create_map(*[x for t in target_names for x in (F.lit(t), F.col(t).cast("int"))])).alias("target", "y")).where("y IS NOT NULL")

    def sound(name: str, field: str):
        v = F.col(f"`{field}`").cast("double")
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit(f"{name}: {field} is null or not finite")).cast("double")).otherwise(v)

    parts = []
    for name, (view, numeric, category) in views.items():
        kind = F.col(category).cast("string") if category else F.lit(None).cast("string")
        parts.append(view.select(F.lit(name).alias("view"), *keys, F.array(*(sound(name, c) for c in numeric)).alias("x"), kind.alias("category")))
    seen = parts[0]
    for part in parts[1:]:
        seen = seen.unionByName(part)
    rows = seen.join(folds, group).withColumn("fit", F.explode(F.array(*map(F.lit, fits)))).withColumn("held", F.col("fold") == F.col("fit"))
    train = rows.where("not held")
    # Scales by number of the field, vocabularies by fold: a few rows per view and fold.
    moments = train.select("view", "fit", F.posexplode("x").alias("i", "v")).groupBy("view", "fit", "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    scales = moments.groupBy("view", "fit").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))), lambda z: F.struct(z["m"].alias("m"), z["s"].alias("s"))).alias("scales"))
    known = train.where("category IS NOT NULL").select("view", "fit", "category").distinct()
    most = known.groupBy("view", "fit").count().agg(F.max("count")).first()[0] or 0
    if most > MOST_CATEGORIES:
        raise ValueError(f"{most} categories in a view; at most {MOST_CATEGORIES} can be columns")
    known = known.groupBy("view", "fit").agg(F.array_sort(F.collect_set("category")).alias("known"))
    hot = F.transform(F.coalesce("known", F.array().cast("array<string>")), lambda k: (k == F.col("category")).cast("double"))
    rows = rows.join(F.broadcast(scales), ["view", "fit"]).join(F.broadcast(known), ["view", "fit"], "left")
    rows = rows.withColumns({"raw": F.concat("x", hot), "scaled": F.concat(F.zip_with("x", "scales", lambda v, z: (v - z["m"]) / z["s"]), hot)})
    rows = rows.join(marked, keys)
    sizes = rows.where("not held").groupBy("view", "target", "fit").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    rows = rows.join(F.broadcast(sizes), ["view", "target", "fit"])
    weight = F.col("n") / (2.0 * F.when(F.col("y") == 1, F.col("ones")).otherwise(F.col("n") - F.col("ones")))
    path = f"{shared_folder(spark)}/folds-{uuid.uuid4().hex}"
    out = rows.select("view", "target", "fit", "held", *keys, "y", F.when(~F.col("held"), weight).alias("w"), "raw", "scaled")
    # A folder a fit, so that a fit reads its own rows only; the hint splits large fits and puts small ones in one file.
    out.hint("rebalance", *_FIT).write.partitionBy(*_FIT).parquet(path)
    return spark.read.schema(out.schema).parquet(path)


_FIT = ["view", "target", "fit"]


def _design(scaled: pd.Series) -> np.ndarray:
    x = np.stack(scaled.to_numpy())
    return np.column_stack([x, np.ones(len(x))])


def logistic_fits(table: DataFrame, passes: int = 60, tolerance: float = 1e-8) -> dict[tuple, np.ndarray]:
    """(view, target, fit) -> weights, the intercept last, of all logistic attackers at once.

    Least of w.w / 2 + C * the class-weighted log-loss, the intercept penalised as well. Each
    pass sums loss, gradient and Hessian of all fits in their partitions first; the driver
    holds a model's size per fit. A step that raises the loss is halved.
    """
    train = table.where("not held").select(*_FIT, "y", "w", "scaled")
    sizes = {tuple(r[c] for c in _FIT): r["d"] + 1 for r in train.groupBy(*_FIT).agg(F.max(F.size("scaled")).alias("d")).collect()}
    tried = {k: np.zeros(d) for k, d in sizes.items()}
    best: dict[tuple, tuple[float, np.ndarray]] = {}
    done: set[tuple] = set()
    for _ in range(passes):
        now = {k: v for k, v in tried.items() if k not in done}

        def sums(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for key, rows in batch.groupby(_FIT, sort=False):
                    if key not in now:
                        continue
                    x, s, w = _design(rows["scaled"]), 2.0 * rows["y"].to_numpy() - 1, rows["w"].to_numpy()
                    z = s * (x @ now[key])
                    q = np.exp(-np.logaddexp(0, z))
                    part = np.concatenate([[w @ np.logaddexp(0, -z)], -(w * s * q) @ x, ((x.T * (w * q * (1 - q))) @ x).ravel()])
                    total[key] = total.get(key, 0.0) + part
            for key, part in total.items():
                yield pd.DataFrame({"view": key[0], "target": key[1], "fit": key[2], "i": np.arange(len(part)), "v": part})

        summed = train.mapInPandas(sums, "view string, target string, fit int, i int, v double").groupBy(*_FIT, "i").agg(F.sum("v").alias("v"))
        found: dict[tuple, np.ndarray] = {k: np.zeros(1 + d + d * d) for k, d in sizes.items() if k in now}
        for r in summed.collect():
            found[(r["view"], r["target"], r["fit"])][r["i"]] = r["v"]
        for key, part in found.items():
            d, w = sizes[key], tried[key]
            loss = PENALTY * part[0] + w @ w / 2
            if key in best and loss > best[key][0] * (1 + 1e-12):
                tried[key] = (best[key][1] + w) / 2
                continue
            best[key] = (loss, w)
            gradient = PENALTY * part[1 : d + 1] + w
            step = np.linalg.solve(PENALTY * part[d + 1 :].reshape(d, d) + np.eye(d), gradient)
            if np.abs(step).max() < tolerance:
                done.add(key)
            tried[key] = w - step
        if len(done) == len(sizes):
            break
    return {k: w for k, (_, w) in best.items()}


def logistic_scores(table: DataFrame, keys: list[str], fits: dict[tuple, np.ndarray]) -> DataFrame:
    """(view, target, fit, keys..., y, p) of held records."""
    held = table.where("held")
    schema = held.select(*_FIT, *keys, "y").schema.add("p", "double")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, rows in batch.groupby(_FIT, sort=False):
                yield rows[[*_FIT, *keys, "y"]].assign(p=1 / (1 + np.exp(-_design(rows["scaled"]) @ fits[key])))

    return held.select(*_FIT, *keys, "y", "scaled").mapInPandas(score, schema)


def _spark_scores(table: DataFrame, keys: list[str], attacker: str, seed: int, settings: dict, parallelism: int) -> DataFrame:
    from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier

    features = "raw" if attacker == "RandomForest" else "scaled"
    ready = table.select(*_FIT, "held", *keys, "y", "w", array_to_vector(features).alias("features"), F.col("y").cast("double").alias("label"), F.size(features).alias("d"))

    def one(cell) -> DataFrame:
        mine = ready.where((F.col("view") == cell["view"]) & (F.col("target") == cell["target"]) & (F.col("fit") == cell["fit"]))
        if attacker == "RandomForest":
            model = RandomForestClassifier(weightCol="w", seed=seed + 1009 * cell["fit"], **{**FOREST, **settings})
        else:
            model = MultilayerPerceptronClassifier(layers=[cell["d"], *HIDDEN, 2], seed=seed + 1009 * cell["fit"], **{"maxIter": NETWORK_STEPS, **settings})
        fitted = model.fit(mine.where("not held"))
        p = vector_to_array("probability")
        return fitted.transform(mine.where("held")).select(*_FIT, *keys, "y", F.when(F.size(p) > 1, p[1]).otherwise(0.0).alias("p"))

    cells = ready.where("not held").groupBy(*_FIT).agg(F.max("d").alias("d")).orderBy(*_FIT).collect()
    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(one, cells))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def attack_scores(table: DataFrame, keys: list[str], attackers=ATTACKERS, seed: int = 7, settings: dict[str, dict] | None = None, parallelism: int = 4) -> DataFrame:
    """(attacker, view, target, fit, keys..., y, p): every record's out-of-fold probability by every attacker.

    Forests take unscaled numbers and class weights; networks take scaled ones, no weights, as
    their settings say (hidden units are logistic and there is no penalty: Spark ML has no other).
    ``settings`` replaces an attacker's settings by name.
    """
    out = None
    for attacker in attackers:
        if attacker == "LogisticRegression":
            part = logistic_scores(table, keys, logistic_fits(table))
        else:
            part = _spark_scores(table, keys, attacker, seed, (settings or {}).get(attacker, {}), parallelism)
        part = part.withColumn("attacker", F.lit(attacker))
        out = part if out is None else out.unionByName(part)
    path = f"{shared_folder(table.sparkSession)}/scores-{uuid.uuid4().hex}"
    out.write.parquet(path)
    return table.sparkSession.read.schema(out.schema).parquet(path)


def attack_grid(scores: DataFrame, group: str, resamples: int = 2000) -> DataFrame:
    """(attacker, view, target, observations, groups, class_balance, auc, fold_mean_auc, low, high) per cell.

    ``auc`` is over all out-of-fold records, ``fold_mean_auc`` the mean of the folds that hold
    both classes, the bounds are percentiles over resamples of whole groups.
    """
    by = ["attacker", "view", "target"]
    sizes = scores.groupBy(*by).agg(F.count("*").alias("observations"), F.count_distinct(group).alias("groups"), F.avg("y").alias("class_balance"))
    whole = group_aucs(scores.withColumn("__all", F.lit(1)), by, "__all").select(*by, "auc")
    folds = group_aucs(scores, by, "fit").groupBy(*by).agg(F.avg("auc").alias("fold_mean_auc"))
    bounds = group_bootstrap_auc(scores, group, "y", resamples, by=by)
    return sizes.join(whole, by).join(folds, by).join(bounds, by, "left")
