"""Queries: confusion metrics, AUCs, threshold grids and choices, curves, shared thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics as m
from tidemark.plans.base import PREDICTIONS, predictions, query, r6

_Z = "CASE WHEN {b} = 0 THEN 0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


_METRICS = ", ".join(
    [
        r6(_ratio("tp + tn", "tp + fp + fn + tn"), "accuracy"),
        r6(f"({_ratio('tp', 'tp + fn')} + {_ratio('tn', 'tn + fp')}) / greatest(1, CAST(tp + fn > 0 AS INT) + CAST(tn + fp > 0 AS INT))", "balanced_accuracy"),
        r6(_ratio("tp", "tp + fp"), "precision"),
        r6(_ratio("tp", "tp + fn"), "recall"),
        r6(_ratio("2 * tp", "2 * tp + fp + fn"), "f1"),
        r6("fp / CAST(greatest(1, fp + tn) AS DOUBLE)", "fpr"),
        r6("10000.0 * fp / CAST(greatest(1, fp + tn) AS DOUBLE)", "fp_per_10000"),
    ]
)


def _counts(t: str) -> str:
    return f"count(*) FILTER (WHERE p >= {t} AND y = 1) AS tp, count(*) FILTER (WHERE p >= {t} AND y = 0) AS fp, count(*) FILTER (WHERE p < {t} AND y = 1) AS fn, count(*) FILTER (WHERE p < {t} AND y = 0) AS tn"


query("confusion_fixed_half", f"SELECT cell_id, tp, fp, fn, tn, {_METRICS} FROM (SELECT cell_id, {_counts('0.5::DOUBLE')} FROM ({PREDICTIONS}) GROUP BY cell_id)")(
    lambda spark, sf: m.confusion_at(predictions(spark, sf), 0.5)
)
query("confusion_at_tie", f"SELECT cell_id, tp, fp, fn, tn, {_METRICS} FROM (SELECT cell_id, {_counts('0.1::DOUBLE')} FROM ({PREDICTIONS}) GROUP BY cell_id)")(
    lambda spark, sf: m.confusion_at(predictions(spark, sf), 0.1)
)

_SCORES = f"SELECT cell_id, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM ({PREDICTIONS}) GROUP BY cell_id, p"
_AUC = f"""SELECT cell_id, CAST(sum(pos * (below + neg / 2.0::DOUBLE)) AS DOUBLE) / (sum(pos) * sum(neg)) AS roc_auc, sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) / sum(pos) AS pr_auc FROM
 (SELECT cell_id, pos, neg, sum(neg) OVER (PARTITION BY cell_id ORDER BY p) - neg AS below, sum(pos) OVER (PARTITION BY cell_id ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY cell_id ORDER BY p DESC) AS fp FROM ({_SCORES})) GROUP BY cell_id"""

query("roc_pr_auc", f"SELECT cell_id, {r6('roc_auc', 'roc_auc')}, {r6('pr_auc', 'pr_auc')} FROM ({_AUC})")(lambda spark, sf: m.aucs(predictions(spark, sf)))

_GRID = f"SELECT cell_id, t.threshold AS threshold, {_counts('t.threshold')} FROM ({PREDICTIONS}), (SELECT round(0.05::DOUBLE + k * 0.01::DOUBLE, 10) AS threshold FROM range(0, 91) r(k)) t GROUP BY cell_id, t.threshold"
_GRID_M = f"SELECT cell_id, threshold, tp, fp, fn, tn, {_METRICS}, {r6('roc_auc', 'roc_auc')}, {r6('pr_auc', 'pr_auc')} FROM ({_GRID}) JOIN ({_AUC}) USING (cell_id)"
query("threshold_grid", _GRID_M)(lambda spark, sf: m.threshold_grid(predictions(spark, sf)))

_CHOICE = f"""SELECT * EXCLUDE (rn, ok), CASE WHEN ok THEN 'FPR_FEASIBLE' ELSE 'MIN_FPR' END AS selection_rule FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY ok DESC, CASE WHEN ok THEN -f1 ELSE fpr END,
 CASE WHEN ok THEN -pr_auc ELSE -f1 END, CASE WHEN ok THEN -precision ELSE -pr_auc END, threshold) AS rn FROM (SELECT *, fpr <= 0.05::DOUBLE + 1e-12 AS ok FROM ({_GRID_M}))) WHERE rn = 1"""
query("threshold_choice", _CHOICE)(lambda spark, sf: m.choose_threshold(m.threshold_grid(predictions(spark, sf))))


def _shared(spark, sf):
    p = predictions(spark, sf)
    full = m.choose_threshold(m.threshold_grid(p)).where("cell_id = 0").select(F.col("threshold").alias("t"))
    return m.confusion_at(p.crossJoin(F.broadcast(full)), F.col("t"))


query("shared_threshold", f"WITH c AS ({_CHOICE}) SELECT cell_id, tp, fp, fn, tn, {_METRICS} FROM (SELECT p.cell_id AS cell_id, {_counts('t')} FROM ({PREDICTIONS}) p, (SELECT threshold AS t FROM c WHERE cell_id = 0) GROUP BY p.cell_id)")(_shared)

_BASE = f"""SELECT cell_id, p, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER a AS n1, sum(neg) OVER a AS n0 FROM ({_SCORES}) WINDOW d AS (PARTITION BY cell_id ORDER BY p DESC), a AS (PARTITION BY cell_id)"""
_CURVES = f"""WITH b AS ({_BASE}), q AS (SELECT cell_id, 'PR' AS curve, CAST(tp AS DOUBLE) / n1 AS x, CAST(tp AS DOUBLE) / (tp + fp) AS y, p AS threshold FROM b UNION ALL SELECT DISTINCT cell_id, 'PR', 0.0::DOUBLE, 1.0::DOUBLE, NULL::DOUBLE FROM b
 UNION ALL SELECT cell_id, 'ROC', CAST(fp AS DOUBLE) / n0, CAST(tp AS DOUBLE) / n1, p FROM b UNION ALL SELECT DISTINCT cell_id, 'ROC', 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY cell_id, curve ORDER BY CASE WHEN curve = 'PR' THEN coalesce(threshold, 'inf'::DOUBLE) ELSE -coalesce(threshold, 'inf'::DOUBLE) END) - 1 AS i, count(*) OVER (PARTITION BY cell_id, curve) AS n FROM q),
k AS (SELECT DISTINCT cell_id, curve, CAST(floor(s * ((n - 1) / CAST(greatest(1, least(201, n) - 1) AS DOUBLE)) + 1e-9) AS BIGINT) AS i FROM (SELECT DISTINCT cell_id, curve, n FROM o), range(0, 201) r(s) WHERE s < least(201, n))
SELECT o.cell_id AS cell_id, o.curve AS curve, o.i AS i, {r6('x', 'x')}, {r6('y', 'y')}, {r6('threshold', 'threshold')} FROM o JOIN k ON o.cell_id = k.cell_id AND o.curve = k.curve AND o.i = k.i"""
query("pr_roc_curves", _CURVES)(lambda spark, sf: m.curves(predictions(spark, sf)))
_BENT = " OR ".join(f"coalesce(lead({c}) OVER s + lag({c}) OVER s <> 2 * {c}, true)" for c in ("tp", "fp"))
_BENT_CURVES = _CURVES.replace("WITH b AS", f"WITH t AS (SELECT * FROM (SELECT *, {_BENT} AS bent FROM ({_BASE}) WINDOW s AS (PARTITION BY cell_id ORDER BY p DESC)) WHERE bent), b AS", 1).replace("CAST(tp AS DOUBLE) / n1, p FROM b", "CAST(tp AS DOUBLE) / n1, p FROM t")
query("bent_roc_curves", _BENT_CURVES)(lambda spark, sf: m.curves(predictions(spark, sf), collinear=False))

query("class_weights", f"SELECT {r6('count(*) / (2.0::DOUBLE * greatest(1, count(*) FILTER (WHERE y = 0)))', 'w_benign')}, {r6('count(*) / (2.0::DOUBLE * greatest(1, count(*) FILTER (WHERE y = 1)))', 'w_attack')} FROM ({PREDICTIONS})")(
    lambda spark, sf: predictions(spark, sf).agg(*((F.count("*") / (2.0 * F.greatest(F.lit(1), F.count_if(F.col("y") == v)))).alias(n) for v, n in ((0, "w_benign"), (1, "w_attack"))))
)
