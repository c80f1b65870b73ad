"""Queries: sensitivity of hypotheses, threshold distribution, summaries of complete cells, proxy validity, quotas, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import analysis, cohort, comms, metrics as m, privacy, reports
from tidemark.plans import stat_queries as st
from tidemark.plans.base import CANDIDATES, METRICS, PREDICTIONS, ROUNDS, candidates, metrics, predictions, query, r6, read, rounds
from tidemark.plans.metric_queries import _AUC, _CHOICE, _counts

#: Threshold analyses stand for what counts as an alarm: the value above which a row is one.
ANALYSES = {"method_specific": 80, "shared_full_threshold": 75, "fixed_0.5": 90}


def _by_analysis(sql: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS threshold_analysis, * FROM ({sql.replace('value > 80', f'value > {t}')})" for name, t in ANALYSES.items())


def _sensitivity(spark, sf):
    out = None
    for name, t in ANALYSES.items():
        own = st._long(spark, sf, t).withColumn("threshold_analysis", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return analysis.hypotheses_by_analysis(out, ["comparator", "dataset", "beta"], ["comparator", "endpoint"], st._B)


query("hypothesis_sensitivity", f"SELECT threshold_analysis, {st._K}, {r6('raw_p', 'raw_p')}, {r6('holm_adjusted_p', 'holm_adjusted_p')}, decision FROM ({_by_analysis(st._DECISION)})")(
    lambda spark, sf: _sensitivity(spark, sf).select("threshold_analysis", *st._KEYS, "raw_p", "holm_adjusted_p", "decision")
)

_MANIFEST = f"SELECT cell_id, 'D' || CAST(cell_id % 2 AS VARCHAR) AS dataset, cell_id // 2 AS seed FROM (SELECT DISTINCT cell_id FROM ({PREDICTIONS}))"


def _manifest(spark, sf):
    cells = predictions(spark, sf).select("cell_id").distinct()
    return cells.select("cell_id", F.concat(F.lit("D"), (F.col("cell_id") % 2).cast("string")).alias("dataset"), F.expr("cell_id div 2").alias("seed"))


query("threshold_distribution", f"SELECT cell_id, dataset, seed, {r6('threshold', 'threshold')}, selection_rule, {r6('f1', 'validation_f1')}, {r6('pr_auc', 'validation_pr_auc')}, {r6('fpr', 'validation_fpr')} FROM ({_MANIFEST}) JOIN ({_CHOICE}) USING (cell_id)")(
    lambda spark, sf: analysis.threshold_distribution(m.choose_threshold(m.threshold_grid(predictions(spark, sf))), _manifest(spark, sf))
)

#: The six phases.
PHASES = ("primary", "heterogeneity", "natural_partition", "ood_stress", "feature_sensitivity", "robustness")
_CELL = ["dataset", "method", "beta", "seed"]


def _summary(spark, sf):
    cells = metrics(spark, sf)
    return analysis.complete_cells({p: cells.where(F.col("seed") % len(PHASES) == i) for i, p in enumerate(PHASES)}, cells.where("n >= 3 and beta is not null"), _CELL)


query("all_cell_summary", f"SELECT list_value({', '.join(repr(p) for p in PHASES)})[seed % {len(PHASES)} + 1] AS phase, dataset, method, beta, seed, {r6('f1', 'f1')}, {r6('pr_auc', 'pr_auc')}, {r6('fpr', 'fpr')}, cost FROM ({METRICS}) WHERE n >= 3 AND beta IS NOT NULL")(
    lambda spark, sf: _summary(spark, sf).select("phase", *_CELL, "f1", "pr_auc", "fpr", "cost")
)

# A client of a round as a seed's round: its utility is the proxy, J before and after give the gain.
_J = "CAST(utility_benign AS DOUBLE) / n_utility - 0.25::DOUBLE * (CAST(utility_attack AS DOUBLE) / n_utility)"
_GAIN = f"SELECT round, client_id AS seed, round % 2 AS protocol, utility AS proxy, ({_J}) - lag({_J}) OVER (PARTITION BY client_id ORDER BY round) AS actual_gain FROM ({CANDIDATES})"


def _gains(spark, sf):
    own = candidates(spark, sf).select("round", F.col("client_id").alias("seed"), (F.col("round") % 2).alias("protocol"), F.col("utility").alias("proxy"), (F.col("utility_benign") / F.col("n_utility")).alias("f1"), (F.col("utility_attack") / F.col("n_utility")).alias("fpr"))
    return analysis.aggregation_gain(own, ["seed"]).select("round", "seed", "protocol", "proxy", "actual_gain")


# Thirds, for the values themselves can end on a rounding tie.
query("aggregation_gain", f"SELECT round, seed, {r6('proxy / 3', 'proxy_third')}, {r6('actual_gain / 3', 'gain_third')} FROM ({_GAIN})")(
    lambda spark, sf: _gains(spark, sf).select("round", "seed", (F.col("proxy") / 3).alias("proxy_third"), (F.col("actual_gain") / 3).alias("gain_third"))
)
_SEEDED = f"""SELECT protocol, seed, corr(proxy, actual_gain) AS p, corr(rx, ry) AS s FROM (SELECT *, rank() OVER (PARTITION BY protocol, seed ORDER BY proxy) + (count(*) OVER (PARTITION BY protocol, seed, proxy) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY protocol, seed ORDER BY actual_gain) + (count(*) OVER (PARTITION BY protocol, seed, actual_gain) - 1) / 2.0::DOUBLE AS ry FROM ({_GAIN}) WHERE actual_gain IS NOT NULL) GROUP BY protocol, seed HAVING min(proxy) < max(proxy) AND min(actual_gain) < max(actual_gain)"""
query("seed_correlations", f"SELECT protocol, count(*) AS seeds, {r6('avg(p)', 'mean_seed_pearson')}, {r6('avg(s)', 'mean_seed_spearman')}, CASE WHEN avg(s) - stddev_samp(s) > 0 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS rank_validity FROM ({_SEEDED}) GROUP BY protocol")(
    lambda spark, sf: _validity(spark, sf)
)


def _validity(spark, sf):
    gains = _gains(spark, sf)
    mean = analysis.seed_correlations(gains, ["protocol"], "seed", "proxy", "actual_gain")
    each = analysis.seed_correlations(gains.withColumn("own", F.col("seed")), ["protocol", "own"], "seed", "proxy", "actual_gain")
    low = each.groupBy("protocol").agg((F.avg("mean_seed_spearman") - F.stddev_samp("mean_seed_spearman")).alias("low"))
    return analysis.rank_validity(mean.join(low, "protocol"), "low").drop("low")


_HONEST = f"SELECT dataset, method, seed, f1, pr_auc, fpr FROM ({METRICS}) WHERE beta = 0.2"
query("honest_deltas", "SELECT m.dataset AS dataset, m.method AS method, m.seed AS seed, m.beta AS beta, " + ", ".join(f"{r6(f'm.{v} - h.{v}', f'forged_minus_honest_{v}')}" for v in st.VALUES) + f" FROM ({METRICS}) m LEFT JOIN ({_HONEST}) h ON m.dataset = h.dataset AND m.method = h.method AND m.seed = h.seed")(
    lambda spark, sf: reports.versus_baseline(metrics(spark, sf), ["dataset", "method", "seed"], "beta = 0.2", st.VALUES, "forged_minus_honest").select("dataset", "method", "seed", "beta", *(f"forged_minus_honest_{v}" for v in st.VALUES))
)
query("absolute_adequacy", f"SELECT dataset, method, {r6('avg(pr_auc)', 'pr_auc')}, {r6('CAST(sum(cost) AS DOUBLE) / sum(1000 * n)', 'prevalence')}, {r6('avg(pr_auc) - CAST(sum(cost) AS DOUBLE) / sum(1000 * n)', 'above_prevalence')} FROM ({METRICS}) GROUP BY dataset, method")(
    lambda spark, sf: analysis.adequacy(metrics(spark, sf).withColumn("rows", 1000 * F.col("n")), ["dataset", "method"], "pr_auc", "cost", "rows")
)

_CUM = f"SELECT *, sum(used_bytes) OVER (PARTITION BY method ORDER BY round) AS cum_bytes FROM ({ROUNDS})"
_TARGET = f"""SELECT method, fraction, max(v >= fraction * final) AS reached, min(cum_bytes) FILTER (WHERE v >= fraction * final) AS bytes FROM
 (SELECT method, round, cum_bytes, validation_f1 AS v, fraction, (SELECT arg_max(validation_f1, round) FROM ({ROUNDS}) WHERE method = 'Full-Contextual') AS final FROM ({_CUM}), (VALUES (0.9::DOUBLE), (0.95::DOUBLE)) f(fraction)) GROUP BY method, fraction"""


def _targets(spark, sf):
    own = comms.with_running(rounds(spark, sf), ["method"], "used_bytes", "cum_bytes").withColumn("all", F.lit(1))
    full = own.where("method = 'Full-Contextual'")
    return reports.to_target_versus_full(comms.bytes_to_target(own, ["all", "method"], full, ["all"], ["validation_f1"], [0.9, 0.95]), ["fraction"])


query("target_versus_full", f"WITH t AS ({_TARGET}), g AS (SELECT fraction, method, avg(CAST(reached AS INT)) AS share, avg(CASE WHEN reached THEN bytes END) AS b FROM t GROUP BY ALL) SELECT o.fraction AS fraction, o.method AS method, {r6('o.share', 'reached_share')}, {r6('o.b', 'mean_bytes')}, {r6('f.b', 'full_bytes')}, {r6('o.b / f.b', 'ratio')} FROM g o LEFT JOIN g f ON f.method = 'Full-Contextual' AND o.fraction = f.fraction WHERE o.method <> 'Full-Contextual'")(_targets)

# Classes of a label as market segments: an equal quota for each, what is left in turns.
_SEGMENTS = "SELECT c_mktsegment AS source_class, CASE WHEN c_mktsegment < 'C' THEN count(*) // 9 ELSE count(*) END AS available FROM customer GROUP BY 1"


def _segments(spark, sf):
    n = F.count("*")
    return read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("source_class")).agg(F.when(F.col("c_mktsegment") < "C", F.floor(n / 9)).otherwise(n).cast("long").alias("available"))


_TOTAL = 503
query(
    "equal_quotas",
    f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (ORDER BY source_class) AS i, count(*) OVER () AS n FROM ({_SEGMENTS})),
s AS (SELECT 0 AS turn, list(least(available, {_TOTAL} // n) ORDER BY i) AS q, list(available ORDER BY i) AS a FROM c
 UNION ALL SELECT turn + 1, list_transform(q, lambda x, j: x + CASE WHEN x < a[j] AND {_TOTAL} - list_sum(q) >= 1 + len(list_filter(range(1, j), lambda k: q[k] < a[k])) THEN 1 ELSE 0 END), a FROM s WHERE list_sum(q) < least({_TOTAL}, list_sum(a)))
SELECT source_class, CAST(available AS BIGINT) AS available, CAST((SELECT arg_max(q, turn) FROM s)[i] AS BIGINT) AS quota FROM c""",
)(lambda spark, sf: analysis.equal_quotas(_segments(spark, sf), _TOTAL, "available", "source_class"))


def _folded(spark, sf):
    rows = privacy.above_median(candidates(spark, sf), ["round"], "wire_bytes")
    return rows.join(cohort.group_folds(rows, "client_id", 5, 7), "client_id")


_FOLD_DRAW = st.draw("'fold'", "'7'", "CAST(client_id AS VARCHAR)")
_FOLDED = f"SELECT c.*, CAST(wire_bytes > quantile_cont(CAST(wire_bytes AS DOUBLE), 0.5) OVER (PARTITION BY round) AS BIGINT) AS target, fold FROM ({CANDIDATES}) c JOIN (SELECT client_id, (row_number() OVER (ORDER BY {_FOLD_DRAW}, client_id) - 1) % 5 AS fold FROM (SELECT DISTINCT client_id FROM ({CANDIDATES}))) USING (client_id)"
query(
    "fold_design",
    f"""WITH r AS ({_FOLDED}), f AS (SELECT DISTINCT fold AS f FROM r), g AS (SELECT f, client_id, count(DISTINCT fold = f) AS sides FROM r, f GROUP BY ALL)
SELECT CAST(f.f AS BIGINT) AS fold, (SELECT count(*) FROM g WHERE g.f = f.f AND sides > 1) AS group_overlap, count(DISTINCT target) FILTER (WHERE fold <> f.f) AS train_classes, count(DISTINCT target) FILTER (WHERE fold = f.f) AS test_classes,
 CAST(sum(CAST(utility IS NULL OR NOT isfinite(utility) OR wire_bytes IS NULL AS INT)) AS BIGINT) AS nonfinite, (SELECT count(*) FROM g WHERE g.f = f.f AND sides > 1) = 0 AND count(DISTINCT target) FILTER (WHERE fold <> f.f) = 2 AND count(DISTINCT target) FILTER (WHERE fold = f.f) = 2
 AND sum(CAST(utility IS NULL OR NOT isfinite(utility) OR wire_bytes IS NULL AS INT)) = 0 AS valid FROM r, f GROUP BY f.f""",
)(lambda spark, sf: analysis.fold_design(_folded(spark, sf), "client_id", "fold", "target", ["utility", "wire_bytes"]))

# Rounds of a method as a cell: its bytes against a budget, its metrics in range.
_CAP = 10**7
query("cell_checks", f"SELECT method, count(DISTINCT round) AS rounds, count(*) FILTER (WHERE used_bytes > {_CAP}) AS overspent, count(*) FILTER (WHERE NOT validation_f1 BETWEEN 0 AND 1 OR NOT validation_pr_auc BETWEEN 0 AND 1) AS unusable, CASE WHEN count(DISTINCT round) = 30 AND count(*) = 30 AND count(*) FILTER (WHERE used_bytes > {_CAP}) = 0 AND count(*) FILTER (WHERE NOT validation_f1 BETWEEN 0 AND 1 OR NOT validation_pr_auc BETWEEN 0 AND 1) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({ROUNDS}) GROUP BY method")(
    lambda spark, sf: analysis.cell_checks(rounds(spark, sf), rounds(spark, sf).withColumn("budget", F.lit(_CAP)), "method", 30, "budget", "used_bytes", ["validation_f1", "validation_pr_auc"])
)
_EXPECTED = dict.fromkeys(PHASES, 5)
query("phase_checks", "SELECT p.phase AS phase, CAST(5 AS BIGINT) AS expected, count(c.seed) AS cells, count(*) FILTER (WHERE c.n < 3) AS failed, count(c.seed) = 5 AND count(*) FILTER (WHERE c.n < 3) = 0 AS complete FROM (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(PHASES)) + f") p(i, phase) LEFT JOIN ({METRICS}) c ON c.seed % {len(PHASES)} = p.i GROUP BY p.phase")(
    lambda spark, sf: analysis.phase_checks(metrics(spark, sf).withColumns({"phase": F.element_at(F.array(*map(F.lit, PHASES)), (F.col("seed") % len(PHASES) + 1).cast("int")), "status": F.when(F.col("n") < 3, "FAIL").otherwise("PASS")}), _EXPECTED)
)
_TOTALS = f"""SELECT 0 AS files_with_errors, count(*) FILTER (WHERE y = 0) AS raw_benign, count(*) FILTER (WHERE y = 1) AS raw_attack, 0 AS conflicts_left, 1 AS least_groups, (SELECT least(min(b), min(a)) FROM (SELECT cell_id, count(*) FILTER (WHERE y = 0) AS b, count(*) FILTER (WHERE y = 1) AS a FROM ({PREDICTIONS}) GROUP BY cell_id)) AS least_class,
 (SELECT count(*) FROM (SELECT user_id FROM ({PREDICTIONS}) GROUP BY user_id HAVING count(DISTINCT cell_id) > 1)) AS cross_split, (SELECT min(n) FROM (SELECT count(*) AS n FROM ({PREDICTIONS}) GROUP BY cell_id)) AS least_rows, (SELECT min(n) FROM (SELECT count(*) AS n FROM ({PREDICTIONS}) GROUP BY user_id)) AS least_client, 1 AS suspicious FROM ({PREDICTIONS})"""


def _totals(spark, sf):
    p = predictions(spark, sf)
    cells = p.groupBy("cell_id").agg(F.count_if(F.col("y") == 0).alias("b"), F.count_if(F.col("y") == 1).alias("a"), F.count("*").alias("n"))
    users = p.groupBy("user_id").agg(F.count_distinct("cell_id").alias("cells"), F.count("*").alias("n"))
    by_cell = cells.agg(F.sum("b").alias("raw_benign"), F.sum("a").alias("raw_attack"), F.min(F.least("a", "b")).alias("least_class"), F.min("n").alias("least_rows"))
    by_user = users.agg(F.count_if(F.col("cells") > 1).alias("cross_split"), F.min("n").alias("least_client"))
    fixed = {"files_with_errors": F.lit(0), "conflicts_left": F.lit(0), "least_groups": F.lit(1), "suspicious": F.lit(1)}
    return by_cell.join(by_user).withColumns(fixed)


query(
    "dataset_gates",
    f"""SELECT unnest([{{'check': 'schema_consistency', 'passed': files_with_errors = 0, 'severity': 'fail'}}, {{'check': 'binary_classes_raw', 'passed': raw_benign > 0 AND raw_attack > 0, 'severity': 'fail'}}, {{'check': 'conflicting_label_duplicates_excluded', 'passed': conflicts_left = 0, 'severity': 'fail'}},
 {{'check': 'source_group_disjoint', 'passed': least_groups > 0, 'severity': 'fail'}}, {{'check': 'cohort_each_split_has_two_classes', 'passed': least_class > 0, 'severity': 'fail'}}, {{'check': 'transformed_cross_split_overlap_zero', 'passed': cross_split = 0, 'severity': 'fail'}},
 {{'check': 'all_processed_splits_nonempty', 'passed': least_rows > 0, 'severity': 'fail'}}, {{'check': 'client_partition_min_support', 'passed': least_client > 0, 'severity': 'fail'}}, {{'check': 'suspicious_features_reviewed', 'passed': suspicious = 0, 'severity': 'review'}}], recursive := true) FROM ({_TOTALS})""",
)(lambda spark, sf: analysis.dataset_gates(_totals(spark, sf)))

# The manifest's hypotheses at the real thresholds: events are predictions of 100 cells (two datasets, five methods with their betas, ten seeds).
_CELLS = [("Full-Contextual", None), ("CB-Score", 0.2), ("CB-Score", 0.4), ("Utility-Only", 0.2), ("Utility-Only", 0.4)]
_CELL_OF = " ".join(f"WHEN {i} THEN {{'m': '{m}', 'b': {'NULL' if b is None else b}::DOUBLE}}" for i, (m, b) in enumerate(_CELLS))
_CELL_P = f"""SELECT dataset, c.m AS method, c.b AS beta, seed, y, p, concat_ws('|', dataset, c.m, coalesce(CAST(c.b AS VARCHAR), '-'), CAST(seed AS VARCHAR)) AS cell_id FROM
 (SELECT 'D' || CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) % 2 AS VARCHAR) AS dataset, user_id % 10 AS seed, CASE event_id % 5 {_CELL_OF} END AS c, CAST(event_type = 'error' AS INT) AS y, value / 500 AS p FROM events)"""
_MANIFEST = [
    (f"{family}_CB_vs_Full", "Full-Contextual", d, b, endpoint, endpoint != "fpr") for family, endpoint in (("F1_NI", "f1"), ("PRAUC_NI", "pr_auc"), ("FPR_SAFETY", "fpr")) for d in ("D0", "D1") for b in (0.2, 0.4)
] + [("SAME_BUDGET_F1", "Utility-Only", d, b, "f1", False) for d in ("D0", "D1") for b in (0.2, 0.4)]


def _cell_predictions(spark, sf):
    cell = F.element_at(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(b).cast("double").alias("b")) for m, b in _CELLS)), (F.col("event_id") % 5 + 1).cast("int"))
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    rows = read(spark, sf, "events").select(F.concat(F.lit("D"), (day % 2).cast("string")).alias("dataset"), (F.col("user_id") % 10).alias("seed"), cell.alias("c"), (F.col("event_type") == "error").cast("int").alias("y"), (F.col("value") / 500).alias("p"))
    return rows.select("dataset", F.col("c.m").alias("method"), F.col("c.b").alias("beta"), "seed", "y", "p")


def _manifest_results(spark, sf):
    manifest = spark.createDataFrame(_MANIFEST, "family string, comparator string, dataset string, beta double, endpoint string, noninferiority boolean")
    return analysis.manifest_results(analysis.metrics_by_threshold(_cell_predictions(spark, sf)), manifest, st._B)


def _at(t: str, source: str) -> str:
    return f"SELECT cell_id, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1, fp / CAST(greatest(1, fp + tn) AS DOUBLE) AS fpr FROM (SELECT cell_id, {_counts(t)} FROM {source} GROUP BY cell_id)"


_CHOSEN = _CHOICE.replace(PREDICTIONS, "SELECT * FROM cp")
_M_LONG = f"""WITH cp AS MATERIALIZED ({_CELL_P}), cells AS (SELECT DISTINCT cell_id, dataset, method, beta, seed FROM cp), ch AS MATERIALIZED ({_CHOSEN}), pick AS (SELECT ch.*, dataset, method, beta, seed FROM ch JOIN cells USING (cell_id)),
full_ AS (SELECT dataset, seed, threshold AS t FROM pick WHERE method = 'Full-Contextual'), met AS (SELECT 'method_specific' AS threshold_analysis, v.cell_id, v.f1, v.fpr FROM ({_at('t', '(SELECT cp.*, ch.threshold AS t FROM cp JOIN ch USING (cell_id))')}) v
 UNION ALL SELECT 'shared_full_threshold', * FROM ({_at('t', '(SELECT cp.*, t FROM cp JOIN full_ USING (dataset, seed))')}) UNION ALL SELECT 'fixed_0.5', * FROM ({_at('0.5::DOUBLE', 'cp')})),
au AS ({_AUC.replace(PREDICTIONS, 'SELECT * FROM cp')}), m AS MATERIALIZED (SELECT threshold_analysis, dataset, method, beta, seed, f1, pr_auc, fpr FROM met JOIN cells USING (cell_id) JOIN au USING (cell_id)),
l AS (SELECT * FROM (SELECT threshold_analysis, dataset, method, beta, seed, unnest(['f1', 'pr_auc', 'fpr']) AS endpoint, unnest([f1, pr_auc, fpr]) AS v FROM m) WHERE v IS NOT NULL AND NOT isnan(v)),
man(family, comparator, dataset, beta, endpoint, noninferiority) AS (VALUES {', '.join(f"('{f}', '{c}', '{d}', {b}::DOUBLE, '{e}', {str(n).lower()})" for f, c, d, b, e, n in _MANIFEST)}),
deltas AS MATERIALIZED (SELECT a.threshold_analysis, family, comparator, man.dataset AS dataset, man.beta AS beta, a.seed AS seed, man.endpoint AS endpoint, noninferiority, a.v - b.v AS delta FROM man JOIN l a ON a.dataset = man.dataset AND a.endpoint = man.endpoint AND a.method = 'CB-Score' AND a.beta = man.beta
 JOIN l b ON b.threshold_analysis = a.threshold_analysis AND b.dataset = a.dataset AND b.endpoint = a.endpoint AND b.seed = a.seed AND b.method = comparator AND (comparator = 'Full-Contextual' OR b.beta = man.beta))"""
_M_DECISION = st._DECISION.replace(st._LONG, "SELECT * FROM deltas").replace("PARTITION BY comparator, endpoint", "PARTITION BY threshold_analysis, family").replace(st._K, f"threshold_analysis, family, {st._K}").replace("e.comparator = ", "e.threshold_analysis = {0}.threshold_analysis AND e.family = {0}.family AND e.comparator = ")
_M_DECISION = _M_DECISION.replace("{0}", "h", 2).replace("{0}", "q")
_M_COLUMNS = ["threshold_analysis", "family", *st._KEYS, "mean_delta", "paired_dz", "wins", "losses", "ties", "raw_p", "holm_adjusted_p", "decision"]
query("manifest_hypotheses", f"{_M_LONG} SELECT {', '.join(r6(c, c) if c in ('mean_delta', 'paired_dz', 'raw_p', 'holm_adjusted_p') else c for c in _M_COLUMNS)} FROM ({_M_DECISION})")(lambda spark, sf: _manifest_results(spark, sf).select(*_M_COLUMNS))
