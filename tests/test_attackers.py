"""The attack grid against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import attackers, privacy

_KEYS = ["round", "client_id"]


def _records():
    draw = random.Random(3)
    return [(r, c, draw.gauss(c % 3, 1.0), float(100 * c + draw.randrange(90)), int(c % 4 > 1 if draw.random() < 0.8 else draw.random() < 0.5)) for r in range(12) for c in range(8)]


def _table(spark, records):
    df = spark.createDataFrame(records, "round int, client_id int, utility double, wire_bytes double, y1 int").withColumn("flat", F.lit(2.0))
    folds = spark.createDataFrame([(c, c % 4) for c in range(8)], "client_id int, fold int")
    targets = df.select(*_KEYS, "y1", (F.col("utility") > 1).cast("int").alias("y2"))
    views = {"full": (df, ["round", "utility", "wire_bytes", "flat"], "client_id"), "few": (df, ["utility"], None)}
    return attackers.fold_table(views, targets, ["y1", "y2"], _KEYS, "client_id", folds)


def _plain(x, y, weights):
    """Gradient descent with a line search on the same objective."""
    s = 2.0 * y - 1
    f = lambda w: w @ w / 2 + weights @ np.logaddexp(0, -s * (x @ w))
    w = np.zeros(x.shape[1])
    for _ in range(4000):
        g = w - (weights * s / (1 + np.exp(s * (x @ w)))) @ x
        rate = 1.0
        while f(w - rate * g) > f(w) - 0.5 * rate * (g @ g) and rate > 1e-12:
            rate /= 2
        w = w - rate * g
        if np.abs(g).max() < 1e-8:
            break
    return w


def test_logistic_attackers_equal_a_plain_fit(spark):
    records = _records()
    table = _table(spark, records)
    fits = attackers.logistic_fits(table)
    assert set(fits) == {(v, t, k) for v in ("full", "few") for t in ("y1", "y2") for k in range(4)}
    scores = {(r.view, r.target, r["round"], r.client_id): (r.fit, r.p) for r in attackers.logistic_scores(table, _KEYS, fits).collect()}
    assert len(scores) == 4 * len(records)
    for view, target, k in [("full", "y1", 0), ("few", "y2", 3), ("full", "y2", 1)]:
        label = [r[4] if target == "y1" else int(r[2] > 1) for r in records]
        numbers = np.array([[r[0], r[2], r[3], 2.0] if view == "full" else [r[2]] for r in records], dtype=float)
        trains = np.array([r[1] % 4 != k for r in records])
        spread = numbers[trains].std(axis=0)
        x = (numbers - numbers[trains].mean(axis=0)) / np.where(spread > 0, spread, 1)
        if view == "full":
            known = sorted({str(r[1]) for r in records if r[1] % 4 != k})
            x = np.column_stack([x, [[float(str(r[1]) == c) for c in known] for r in records]])
        x, y = np.column_stack([x, np.ones(len(x))]), np.array(label)
        n, ones = trains.sum(), y[trains].sum()
        weights = np.where(y == 1, n / (2 * ones), n / (2 * (n - ones)))
        w = _plain(x[trains], y[trains], weights[trains])
        for i, r in enumerate(records):
            if not trains[i]:
                fit, p = scores[view, target, r[0], r[1]]
                assert fit == k and p == pytest.approx(1 / (1 + math.exp(-x[i] @ w)), abs=1e-5)


def test_grid_has_every_cell_and_its_aucs(spark):
    records = _records()
    table = _table(spark, records)
    short = {"RandomForest": {"numTrees": 5}, "MLP": {"maxIter": 20}}
    scores = attackers.attack_scores(table.where("target = 'y1'"), _KEYS, settings=short)
    found = {(r.attacker, r.view, r.target): r for r in attackers.attack_grid(scores, "client_id", 50).collect()}
    assert set(found) == {(a, v, "y1") for a in attackers.ATTACKERS for v in ("full", "few")}
    rows = scores.collect()
    for (attacker, view, _), r in found.items():
        mine = [(x.fit, x.y, x.p) for x in rows if (x.attacker, x.view) == (attacker, view)]
        assert len(mine) == r.observations == len(records) and r.groups == 8

        def auc(part):
            pos, neg = [p for _, y, p in part if y], [p for _, y, p in part if not y]
            return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg) if pos and neg else None

        each = [a for k in range(4) if (a := auc([x for x in mine if x[0] == k])) is not None]
        assert r.auc == pytest.approx(auc(mine)) and r.fold_mean_auc == pytest.approx(sum(each) / len(each))
        one = privacy.group_bootstrap_auc(scores.where((F.col("attacker") == attacker) & (F.col("view") == view)), "client_id", "y", 50).first()
        assert (r.low, r.high) == pytest.approx((one.low, one.high)) and r.low <= r.high


def test_a_number_that_is_not_finite_is_an_error(spark):
    records = _records()
    records[5] = (*records[5][:2], float("nan"), *records[5][3:])
    with pytest.raises(Exception, match="not finite"):
        _table(spark, records)
