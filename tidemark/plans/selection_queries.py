"""Queries: eligibility, priorities, greedy and exact admission, byte accounting, targets, interpolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import airtime_us, is_finite
from tidemark.operators import comms, selection
from tidemark.plans.base import CANDIDATES, RATES, ROUNDS, candidates, draw, query, r6, rounds

BETA = 0.4
_BUDGET = f"SELECT *, CAST(floor({BETA}::DOUBLE * sum(wire_bytes) OVER (PARTITION BY round)) AS BIGINT) AS budget FROM c"
_ELIGIBLE = "isfinite(utility) AND wire_bytes > 0 AND wire_bytes <= budget AND n_utility >= 20 AND utility_benign >= 5 AND utility_attack >= 5 AND n_fit >= 180"
_SCALE = """SELECT b.*, u0, u1, c0, c1, greatest(umin, u0) AS ulo, least(umax, u1) AS uhi, greatest(cmin, c0) AS clo, least(cmax, c1) AS chi, td FROM b JOIN
 (SELECT round, quantile_cont(utility, 0.05) u0, quantile_cont(utility, 0.95) u1, min(utility) umin, max(utility) umax,
 quantile_cont(CAST(wire_bytes AS DOUBLE), 0.05) c0, quantile_cont(CAST(wire_bytes AS DOUBLE), 0.95) c1, CAST(min(wire_bytes) AS DOUBLE) cmin, CAST(max(wire_bytes) AS DOUBLE) cmax,
 quantile_cont(predicted_airtime_us + local_training_seconds * 1e6, 0.5) td FROM b GROUP BY round) USING (round)"""
_CB = """greatest((CASE WHEN uhi - ulo <= 1e-12 THEN 0 ELSE (least(greatest(utility, u0), u1) - ulo) / (uhi - ulo) END)
 - 0.25::DOUBLE * (CASE WHEN chi - clo <= 1e-12 THEN 0 ELSE (least(greatest(CAST(wire_bytes AS DOUBLE), c0), c1) - clo) / (chi - clo) END), 0)"""
_PRIORITY = {
    "Cost-Only": "1.0::DOUBLE / (wire_bytes + 1e-12::DOUBLE)",
    "Utility-Only": "greatest(utility, 0)",
    "Utility-Cost-Ratio": "greatest(utility, 0) / (wire_bytes + 1e-12::DOUBLE)",
    "CB-Score": _CB,
    "Historical-DoubleCost": f"({_CB}) / (wire_bytes + 1e-12::DOUBLE)",
    "Oort-Style-Adapted": "greatest(utility, 0) * CASE WHEN predicted_airtime_us + local_training_seconds * 1e6 > td THEN pow(td / (predicted_airtime_us + local_training_seconds * 1e6), 1) ELSE 1 END",
}
_OUT = "round, selected, used_bytes, budget_bytes, {u}, static_eligible_count, ranking_positive_count, empty_round"


def _head(method: str) -> str:
    return f"c AS ({CANDIDATES}), b AS ({_BUDGET}), s AS ({_SCALE}), p AS (SELECT *, {_PRIORITY[method]} AS priority, ({_ELIGIBLE}) AS eligible FROM s)"


def _greedy_sql(method: str) -> str:
    return f"""WITH RECURSIVE {_head(method)},
q AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY priority DESC, client_id) AS rn FROM p WHERE eligible AND priority > 0),
w AS (SELECT round, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, CAST('' AS VARCHAR) AS sel FROM (SELECT DISTINCT round FROM b)
 UNION ALL SELECT w.round, w.rn + 1, w.used + CASE WHEN w.used + q.wire_bytes <= q.budget THEN q.wire_bytes ELSE 0 END,
 CASE WHEN w.used + q.wire_bytes <= q.budget THEN w.sel || ',' || CAST(q.client_id AS VARCHAR) ELSE w.sel END FROM w JOIN q ON q.round = w.round AND q.rn = w.rn + 1),
f AS (SELECT round, arg_max(sel, rn) AS sel, max(used) AS used FROM w GROUP BY round),
d AS (SELECT round, max(budget) AS budget, count(*) FILTER (WHERE eligible) AS e, count(*) FILTER (WHERE eligible AND priority > 0) AS r FROM p GROUP BY round)
SELECT round, substr(sel, 2) AS selected, used AS used_bytes, budget AS budget_bytes, {r6('CASE WHEN budget > 0 THEN CAST(used AS DOUBLE) / budget ELSE 0 END', 'budget_utilization')}, e AS static_eligible_count, r AS ranking_positive_count, sel = '' AS empty_round FROM f JOIN d USING (round)"""


for _method in _PRIORITY:
    query(f"select_{_method.lower().replace('-', '_')}", _greedy_sql(_method))(lambda spark, sf, m=_method: selection.select_clients(candidates(spark, sf), m, ["round"], BETA))

query(
    "select_full",
    f"""SELECT round, string_agg(CAST(client_id AS VARCHAR), ',' ORDER BY client_id) AS selected, CAST(sum(wire_bytes) AS BIGINT) AS used_bytes, CAST(sum(wire_bytes) AS BIGINT) AS budget_bytes, 1.0::DOUBLE AS budget_utilization,
 count(*) AS static_eligible_count, count(*) AS ranking_positive_count, false AS empty_round FROM ({CANDIDATES}) GROUP BY round""",
)(lambda spark, sf: selection.select_clients(candidates(spark, sf), "Full-Contextual", ["round"], None))

query(
    "select_oracle_exact",
    f"""WITH {_head('CB-Score')}, k AS (SELECT round, list({{'id': client_id, 'b': wire_bytes, 'p': priority, 'u': utility}} ORDER BY client_id) FILTER (WHERE eligible AND priority > 0) AS pool, max(budget) AS budget,
 count(*) FILTER (WHERE eligible) AS e, count(*) FILTER (WHERE eligible AND priority > 0) AS r FROM p GROUP BY round),
m AS (SELECT *, unnest(range(0, CAST(pow(2, r) AS BIGINT))) AS mask FROM k),
i AS (SELECT round, budget, e, r, mask, unnest(range(1, greatest(r, 1) + 1)) AS j, pool FROM m),
v AS (SELECT round, budget, e, r, mask, sum(CASE WHEN (mask >> (j - 1)) & 1 = 1 THEN pool[j].p ELSE 0 END) AS value, sum(CASE WHEN (mask >> (j - 1)) & 1 = 1 THEN pool[j].u ELSE 0 END) AS utility,
 CAST(sum(CASE WHEN (mask >> (j - 1)) & 1 = 1 THEN pool[j].b ELSE 0 END) AS BIGINT) AS used, coalesce(string_agg(CASE WHEN (mask >> (j - 1)) & 1 = 1 THEN CAST(pool[j].id AS VARCHAR) END, ',' ORDER BY j), '') AS ids FROM i GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY value DESC, utility DESC, used, ids) AS rn FROM v WHERE used <= budget)
SELECT round, ids AS selected, used AS used_bytes, budget AS budget_bytes, {r6('CAST(used AS DOUBLE) / budget', 'budget_utilization')}, e AS static_eligible_count, r AS ranking_positive_count, ids = '' AS empty_round FROM z WHERE rn = 1""",
)(lambda spark, sf: selection.select_clients(candidates(spark, sf), "Oracle-Score-Exact", ["round"], BETA))

_PRIORITY["Random-Budget"] = f"1.0::DOUBLE + {draw(chr(39) + 'order' + chr(39), chr(39) + '42' + chr(39), 'CAST(round AS VARCHAR)', 'CAST(client_id AS VARCHAR)')}"
query("select_random_budget", _greedy_sql("Random-Budget"))(lambda spark, sf: selection.select_clients(candidates(spark, sf), "Random-Budget", ["round"], BETA, seed=42))

query("eligibility", f"WITH c AS ({CANDIDATES}), b AS ({_BUDGET}) SELECT round, client_id, wire_bytes, budget, ({_ELIGIBLE}) AS eligible FROM b")(
    lambda spark, sf: selection.round_budgets(candidates(spark, sf), ["round"], BETA).select("round", "client_id", "wire_bytes", "budget", selection.static_eligible(F.col("budget")).alias("eligible"))
)

query("marginal_utility", f"SELECT round, client_id, {r6('(utility - 0.25 * (utility_attack / CAST(n_utility AS DOUBLE))) - (0.1 - 0.25 * 0.2)', 'gain')} FROM ({CANDIDATES})")(
    lambda spark, sf: candidates(spark, sf).select("round", "client_id", selection.marginal_utility(F.lit(0.1), F.lit(0.2), F.col("utility"), F.col("utility_attack") / F.col("n_utility")).alias("gain"))
)

query("airtime_bytes", f"SELECT round, client_id, predicted_airtime_us, wire_bytes FROM ({CANDIDATES}) WHERE isfinite(predicted_airtime_us)")(
    lambda spark, sf: candidates(spark, sf).where(is_finite(F.col("predicted_airtime_us"))).select("round", "client_id", airtime_us(F.col("wire_bytes"), F.col("client_id")).alias("predicted_airtime_us"), "wire_bytes")
)

_META = "CASE method WHEN 'Full-Contextual' THEN 0 WHEN 'Random-Budget' THEN 10 * (13 + 64) ELSE 10 * (21 + 64) END"
_BYTES = f"SELECT *, CAST({_META} AS BIGINT) AS metadata_wire, CAST(1064 AS BIGINT) AS downlink_broadcast, CAST(10640 AS BIGINT) AS downlink_unicast, CAST(used_bytes + {_META} + 1064 AS BIGINT) AS E2E_broadcast, CAST(used_bytes + {_META} + 10640 AS BIGINT) AS E2E_unicast FROM ({ROUNDS})"


def _accounted(spark, sf):
    return comms.byte_accounting(rounds(spark, sf).withColumn("model_bytes", F.lit(1000)))


query("byte_accounting", f"SELECT method, round, used_bytes, metadata_wire, downlink_broadcast, downlink_unicast, E2E_broadcast, E2E_unicast FROM ({_BYTES})")(
    lambda spark, sf: _accounted(spark, sf).select("method", "round", "used_bytes", "metadata_wire", "downlink_broadcast", "downlink_unicast", "E2E_broadcast", "E2E_unicast")
)

_CUM = f"SELECT *, CAST(sum(E2E_broadcast) OVER (PARTITION BY method ORDER BY round) AS BIGINT) AS cum_bytes FROM ({_BYTES})"


def _cumulated(spark, sf):
    return comms.with_running(_accounted(spark, sf), ["method"], "E2E_broadcast", "cum_bytes")


query("running_bytes", f"SELECT method, round, cum_bytes FROM ({_CUM})")(lambda spark, sf: _cumulated(spark, sf).select("method", "round", "cum_bytes"))

query("final_round_values", f"SELECT method, {r6('arg_max(validation_f1, round)', 'validation_f1')}, {r6('arg_max(validation_pr_auc, round)', 'validation_pr_auc')} FROM ({ROUNDS}) GROUP BY method")(
    lambda spark, sf: comms.final_values(rounds(spark, sf), ["method"], ["validation_f1", "validation_pr_auc"])
)

_TARGETS = f"""WITH r AS ({_CUM}), l AS (SELECT method, round, cum_bytes, 'validation_f1' AS endpoint, validation_f1 AS value FROM r UNION ALL SELECT method, round, cum_bytes, 'validation_pr_auc', validation_pr_auc FROM r),
f AS (SELECT endpoint, arg_max(value, round) AS final FROM l WHERE method = 'Full-Contextual' GROUP BY endpoint), t AS (SELECT endpoint, fraction, fraction * final AS target FROM f, (VALUES (0.9::DOUBLE), (0.95::DOUBLE)) v(fraction))
SELECT method, l.endpoint AS endpoint, fraction, {r6('target', 'target')}, bool_or(value >= target) AS reached, min(round) FILTER (WHERE value >= target) AS round, arg_min(cum_bytes, round) FILTER (WHERE value >= target) AS bytes
FROM l JOIN t ON l.endpoint = t.endpoint GROUP BY method, l.endpoint, fraction, target"""


def _targets(spark, sf):
    r = _cumulated(spark, sf).withColumn("one", F.lit(1))
    full = r.where("method = 'Full-Contextual'")
    return comms.bytes_to_target(r, ["method", "one"], full, ["one"], ["validation_f1", "validation_pr_auc"], [0.9, 0.95]).drop("one")


query("bytes_to_target", _TARGETS)(_targets)

_GRID = f"""r AS ({_CUM}), e AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT method, min(cum_bytes) lo, max(cum_bytes) hi FROM r GROUP BY method)),
g AS (SELECT k, lo + k * ((hi - lo) / 19.0::DOUBLE) AS g FROM e, range(0, 20) t(k) WHERE hi >= lo)"""

query("overlap_grid", f"WITH {_GRID} SELECT CAST(k AS BIGINT) AS k, {r6('g', 'g')} FROM g")(
    lambda spark, sf: comms.overlap_grid(_cumulated(spark, sf).withColumn("one", F.lit(1)), ["one"], "method", "cum_bytes").drop("one")
)

query(
    "interpolated_curves",
    f"""WITH {_GRID}, x AS (SELECT g.k, g.g, m.method, (SELECT max(cum_bytes) FROM r WHERE r.method = m.method AND r.cum_bytes <= g.g) AS x0, (SELECT min(cum_bytes) FROM r WHERE r.method = m.method AND r.cum_bytes >= g.g) AS x1 FROM g, (SELECT DISTINCT method FROM r) m),
y AS (SELECT x.*, a.validation_f1 AS a1, b.validation_f1 AS b1, a.validation_pr_auc AS a2, b.validation_pr_auc AS b2 FROM x LEFT JOIN r a ON a.method = x.method AND a.cum_bytes = x0 LEFT JOIN r b ON b.method = x.method AND b.cum_bytes = x1)
SELECT method, CAST(k AS BIGINT) AS k, {r6('g', 'g')}, {r6('CASE WHEN x0 IS NULL THEN b1 WHEN x1 IS NULL OR x1 = x0 THEN a1 ELSE a1 + (b1 - a1) * ((g - x0) / CAST(x1 - x0 AS DOUBLE)) END', 'validation_f1')},
 {r6('CASE WHEN x0 IS NULL THEN b2 WHEN x1 IS NULL OR x1 = x0 THEN a2 ELSE a2 + (b2 - a2) * ((g - x0) / CAST(x1 - x0 AS DOUBLE)) END', 'validation_pr_auc')} FROM y""",
)(
    lambda spark, sf: (
        lambda r: comms.interpolate(r, comms.overlap_grid(r, ["one"], "method", "cum_bytes"), ["one"], "method", "cum_bytes", ["validation_f1", "validation_pr_auc"]).drop("one")
    )(_cumulated(spark, sf).withColumn("one", F.lit(1)))
)
