"""Queries: paired inference, correlations, reports and robustness joins, privacy views, model vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import privacy, reports, stats, vectors
from tidemark.operators.selection import round_budgets, static_eligible
from tidemark.plans.base import CANDIDATES, METRICS, PREDICTIONS, ROUNDS, candidates, draw, metrics, predictions, query, r6, read, rounds

VALUES = ["f1", "pr_auc", "fpr"]


def _delta_sql(comparator: str) -> str:
    on = "" if comparator == "Full-Contextual" else " AND a.beta = b.beta"
    return f"SELECT a.dataset AS dataset, a.seed AS seed, a.beta AS beta, a.f1 - b.f1 AS d_f1, a.pr_auc - b.pr_auc AS d_pr_auc, a.fpr - b.fpr AS d_fpr FROM ({METRICS}) a JOIN ({METRICS}) b ON a.dataset = b.dataset AND a.seed = b.seed{on} WHERE a.method = 'CB-Score' AND b.method = '{comparator}'"


def _deltas(spark, sf, comparator, alarm=80):
    return stats.paired_deltas(metrics(spark, sf, alarm), "CB-Score", comparator, ["dataset", "seed"], VALUES)


for _name, _comparator in (("full", "Full-Contextual"), ("random", "Random-Budget")):
    query(f"paired_deltas_{_name}", f"SELECT dataset, seed, beta, {r6('d_f1', 'd_f1')}, {r6('d_pr_auc', 'd_pr_auc')}, {r6('d_fpr', 'd_fpr')} FROM ({_delta_sql(_comparator)})")(lambda spark, sf, c=_comparator: _deltas(spark, sf, c))

#: Long form: a hypothesis per dataset, beta and endpoint against Full (non-inferiority or safety) and Random (superiority).
_LONG = " UNION ALL ".join(
    f"SELECT '{name}' AS comparator, dataset, beta, seed, '{v}' AS endpoint, {str(name == 'full' and v != 'fpr').lower()} AS noninferiority, d_{v} AS delta FROM ({_delta_sql(c)})" for name, c in (("full", "Full-Contextual"), ("random", "Random-Budget")) for v in VALUES
)
_MARGIN = "CASE WHEN endpoint = 'fpr' THEN 0.0025::DOUBLE WHEN noninferiority AND endpoint IN ('f1', 'pr_auc') THEN 0.02::DOUBLE ELSE 0::DOUBLE END"
_Z = f"SELECT *, {_MARGIN} AS margin, CASE WHEN endpoint = 'fpr' THEN ({_MARGIN}) - delta ELSE delta + ({_MARGIN}) END AS z FROM ({_LONG})"
_KEYS = ["comparator", "dataset", "beta", "endpoint", "noninferiority"]
_K = ", ".join(_KEYS)


def _long(spark, sf, alarm=80):
    out = None
    for name, c in (("full", "Full-Contextual"), ("random", "Random-Budget")):
        own = _deltas(spark, sf, c, alarm).unpivot(["dataset", "beta", "seed"], [f"d_{v}" for v in VALUES], "endpoint", "delta").withColumn("endpoint", F.substring("endpoint", 3, 10))
        own = own.withColumns({"comparator": F.lit(name), "noninferiority": F.lit(name == "full") & (F.col("endpoint") != "fpr")})
        out = own if out is None else out.unionByName(own)
    return out


def _shifted(spark, sf):
    margin, z = stats.transformed(F.col("endpoint"), F.col("noninferiority"), F.col("delta"))
    return _long(spark, sf).withColumns({"margin": margin, "z": z})


query("margin_transforms", f"SELECT {_K}, seed, {r6('margin', 'margin')}, {r6('z', 'z')} FROM ({_Z})")(lambda spark, sf: _shifted(spark, sf).select(*_KEYS, "seed", "margin", "z"))

_V = f"SELECT {_K}, margin, list(delta ORDER BY seed) AS v, list(z ORDER BY seed) AS zz, count(*) AS n FROM ({_Z}) GROUP BY {_K}, margin"
_FLIP = f"""SELECT {_K}, CAST(count(*) FILTER (WHERE s / n >= o - 1e-15) AS DOUBLE) / count(*) AS raw_p FROM (SELECT {_K}, n, list_sum(zz) / n AS o, list_reduce(list_transform(range(1, n + 1), lambda i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN zz[i] ELSE -zz[i] END), lambda a, b: a + b) AS s
 FROM (SELECT *, unnest(range(0, 1 << CAST(n AS INT))) AS mask FROM ({_V}))) GROUP BY {_K}"""
query("exact_sign_flip", f"SELECT {_K}, {r6('raw_p', 'raw_p')} FROM ({_FLIP})")(lambda spark, sf: stats.sign_flip(_shifted(spark, sf), _KEYS, "z", "seed"))

_B = 2000
_DRAW = draw("'bootstrap'", "CAST(b AS VARCHAR)", "CAST(j AS VARCHAR)")
_BOOT = f"""SELECT {_K}, quantile_cont(m, 0.025) AS two_sided_low, quantile_cont(m, 0.975) AS two_sided_high, quantile_cont(m, 0.05) AS one_sided_lower_95, quantile_cont(m, 0.95) AS one_sided_upper_95 FROM
 (SELECT {_K}, b, sum(v[CAST({_DRAW} % n AS INT) + 1]) / any_value(n) AS m FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM (SELECT *, unnest(range(1, {_B} + 1)) AS b FROM ({_V}))) GROUP BY {_K}, b) GROUP BY {_K}"""
_BOUNDS = ["two_sided_low", "two_sided_high", "one_sided_lower_95", "one_sided_upper_95"]
query("bootstrap_bounds", f"SELECT {_K}, {', '.join(r6(b, b) for b in _BOUNDS)} FROM ({_BOOT})")(lambda spark, sf: stats.bootstrap_bounds(_long(spark, sf), _KEYS, "delta", "seed", _B))

_EFFECT = f"""SELECT {_K}, avg(delta) AS mean_delta, CASE WHEN stddev_samp(delta) > 0 THEN avg(delta) / stddev_samp(delta) END AS paired_dz, count(*) FILTER (WHERE delta > 1e-12) AS wins, count(*) FILTER (WHERE delta < -1e-12) AS losses,
 count(*) FILTER (WHERE abs(delta) <= 1e-12) AS ties FROM ({_LONG}) GROUP BY {_K}"""
query("effect_sizes", f"SELECT {_K}, {r6('mean_delta', 'mean_delta')}, {r6('paired_dz', 'paired_dz')}, wins, losses, ties FROM ({_EFFECT})")(lambda spark, sf: stats.effect_sizes(_long(spark, sf), _KEYS, "delta"))

_HOLM = f"""SELECT *, least(1.0, max(s) OVER (PARTITION BY comparator, endpoint ORDER BY raw_p, {_K} ROWS UNBOUNDED PRECEDING)) AS holm_adjusted_p FROM (SELECT *, (count(*) OVER (PARTITION BY comparator, endpoint) - row_number() OVER (PARTITION BY comparator, endpoint ORDER BY raw_p, {_K}) + 1) * raw_p AS s FROM ({_FLIP}))"""
query("holm_adjusted", f"SELECT {_K}, {r6('raw_p', 'raw_p')}, {r6('holm_adjusted_p', 'holm_adjusted_p')} FROM ({_HOLM})")(
    lambda spark, sf: stats.holm(stats.sign_flip(_shifted(spark, sf), _KEYS, "z", "seed"), ["comparator", "endpoint"], "raw_p", _KEYS)
)

_DECISION = f"""SELECT e.*, h.raw_p AS raw_p, h.holm_adjusted_p AS holm_adjusted_p, {', '.join('q.' + b + ' AS ' + b for b in _BOUNDS)}, CASE WHEN (CASE WHEN e.endpoint = 'fpr' THEN q.one_sided_upper_95 < 0.0025 WHEN e.noninferiority THEN q.one_sided_lower_95 > -0.02 ELSE q.one_sided_lower_95 > 0 END)
 AND h.holm_adjusted_p <= 0.05 THEN 'MET_GATE' ELSE 'INCONCLUSIVE' END AS decision FROM ({_EFFECT}) e JOIN ({_HOLM}) h ON {' AND '.join(f'e.{k} = h.{k}' for k in _KEYS)} JOIN ({_BOOT}) q ON {' AND '.join(f'e.{k} = q.{k}' for k in _KEYS)}"""


def _decided(spark, sf):
    return stats.run_hypotheses(_long(spark, sf), ["comparator", "dataset", "beta"], ["comparator", "endpoint"], _B)


query("hypothesis_decisions", f"SELECT {_K}, {r6('raw_p', 'raw_p')}, {r6('holm_adjusted_p', 'holm_adjusted_p')}, decision FROM ({_DECISION})")(lambda spark, sf: _decided(spark, sf).select(*_KEYS, "raw_p", "holm_adjusted_p", "decision"))
query("gate_counts", f"SELECT comparator, endpoint, count(*) FILTER (WHERE decision = 'MET_GATE') AS met, count(*) FILTER (WHERE decision <> 'MET_GATE') AS inconclusive, count(*) AS total FROM ({_DECISION}) GROUP BY comparator, endpoint")(
    lambda spark, sf: reports.gate_counts(_decided(spark, sf), ["comparator", "endpoint"])
)

_RANKED = f"SELECT event_type, x, y, rank() OVER (PARTITION BY event_type ORDER BY x) + (count(*) OVER (PARTITION BY event_type, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY event_type ORDER BY y) + (count(*) OVER (PARTITION BY event_type, y) - 1) / 2.0::DOUBLE AS ry FROM (SELECT event_type, value AS x, CAST(length(props) AS DOUBLE) AS y FROM events)"
query("correlations", f"SELECT event_type, count(*) AS n, {r6('corr(x, y)', 'pearson')}, {r6('corr(rx, ry)', 'spearman')} FROM ({_RANKED}) GROUP BY event_type")(
    lambda spark, sf: stats.correlations(read(spark, sf, "events").select("event_type", F.col("value").alias("x"), F.length("props").cast("double").alias("y")), ["event_type"], "x", "y")
)


def _with_p(spark, sf):
    c = stats.correlations(read(spark, sf, "events").select("event_type", F.col("value").alias("x"), F.length("props").cast("double").alias("y")), ["event_type"], "x", "y")
    return c.withColumns({"pearson_p": stats.correlation_p(F.col("pearson"), F.col("n")), "spearman_p": stats.correlation_p(F.col("spearman"), F.col("n"))})


query("correlation_p_values")(_with_p)

query("mean_sd_summary", "SELECT method, beta, " + ", ".join(f"{r6(f'avg({v})', f'mean_{v}')}, {r6(f'stddev_samp({v})', f'sd_{v}')}" for v in VALUES) + f" FROM ({METRICS}) GROUP BY method, beta")(
    lambda spark, sf: reports.mean_sd(metrics(spark, sf), ["method", "beta"], VALUES)
)
query(
    "versus_full_tradeoff",
    f"""WITH m AS ({METRICS}), o AS (SELECT dataset, method, beta, avg(f1) AS f1, avg(cost) AS cost FROM m WHERE method <> 'Full-Contextual' GROUP BY ALL), b AS (SELECT dataset, avg(f1) AS full_f1, avg(cost) AS full_cost FROM m WHERE method = 'Full-Contextual' GROUP BY ALL)
SELECT dataset, method, beta, {r6('f1', 'f1')}, {r6('cost', 'cost')}, {r6('full_f1', 'full_f1')}, {r6('full_cost', 'full_cost')}, {r6('100 * (1 - cost / full_cost)', 'reduction_pct')} FROM o JOIN b USING (dataset)""",
)(lambda spark, sf: reports.versus_full(metrics(spark, sf), ["dataset"], ["f1"], "cost"))
query("worst_case_by_method", f"SELECT method, {r6('avg(f1)', 'mean')}, {r6('max(f1)', 'max')}, {r6('min(f1)', 'min')}, arg_max(seed, f1) AS worst FROM (SELECT method, seed, max(f1) AS f1 FROM ({METRICS}) GROUP BY ALL) GROUP BY method")(
    lambda spark, sf: reports.worst_case(metrics(spark, sf).groupBy("method", "seed").agg(F.max("f1").alias("f1")), ["method"], "f1", "seed")
)
query("quartiles_by_method", f"SELECT method, {r6('quantile_cont(fpr, 0.25)', 'q25')}, {r6('quantile_cont(fpr, 0.5)', 'median')}, {r6('quantile_cont(fpr, 0.75)', 'q75')} FROM ({METRICS}) GROUP BY method")(
    lambda spark, sf: reports.quartiles(metrics(spark, sf), ["method"], "fpr")
)
query("ecdf_by_method", f"SELECT method, {r6('f1', 'f1')}, {r6('cume_dist() OVER (PARTITION BY method ORDER BY f1)', 'ecdf')} FROM ({METRICS})")(lambda spark, sf: reports.ecdf(metrics(spark, sf).select("method", "f1"), ["method"], "f1"))
_RATES = f"SELECT method, avg(pr_auc) AS tpr, avg(fpr) AS fpr FROM ({METRICS}) GROUP BY method"
query(
    "predictive_values",
    f"SELECT method, {r6('tpr', 'tpr')}, {r6('fpr', 'fpr')}, {r6('p', 'prevalence')}, {r6('CASE WHEN p * tpr + (1 - p) * fpr > 0 THEN p * tpr / (p * tpr + (1 - p) * fpr) END', 'ppv')}, {r6('(1 - p) * (1 - fpr) / ((1 - p) * (1 - fpr) + p * (1 - tpr))', 'npv')}, {r6('1e6 * fpr', 'alerts_per_million')} FROM ({_RATES}), (VALUES (0.001::DOUBLE), (0.01::DOUBLE), (0.05::DOUBLE)) v(p)",
)(lambda spark, sf: reports.predictive_values(metrics(spark, sf).groupBy("method").agg(F.avg("pr_auc").alias("tpr"), F.avg("fpr").alias("fpr")), [0.001, 0.01, 0.05]))
_PPV = "0.01::DOUBLE * pr_auc / (0.01::DOUBLE * pr_auc + 0.99::DOUBLE * fpr)"
query("predictive_values_seedwise", f"SELECT method, {r6('quantile_cont(ppv, 0.25)', 'q25')}, {r6('quantile_cont(ppv, 0.5)', 'median')}, {r6('quantile_cont(ppv, 0.75)', 'q75')} FROM (SELECT method, {_PPV} AS ppv FROM ({METRICS}) WHERE pr_auc + fpr > 0) GROUP BY method")(
    lambda spark, sf: reports.quartiles(reports.predictive_values(metrics(spark, sf).where("pr_auc + fpr > 0").withColumn("tpr", F.col("pr_auc")), [0.01]), ["method"], "ppv")
)
query(
    "robustness_deltas",
    f"WITH m AS ({METRICS}) SELECT m.dataset AS dataset, m.method AS method, m.seed AS seed, m.beta AS beta, {r6('m.f1 - b.f1', 'delta_f1')}, {r6('m.fpr - b.fpr', 'delta_fpr')} FROM m LEFT JOIN (SELECT dataset, seed, f1, fpr FROM m WHERE method = 'Full-Contextual') b ON m.dataset = b.dataset AND m.seed = b.seed",
)(lambda spark, sf: reports.versus_baseline(metrics(spark, sf), ["dataset", "seed"], "method = 'Full-Contextual'", ["f1", "fpr"], "delta").select("dataset", "method", "seed", "beta", "delta_f1", "delta_fpr"))
query(
    "flagged_ratios",
    f"""WITH c AS (SELECT *, CAST(client_id < 3 AS INT) AS flag, 'cell' AS cell FROM ({CANDIDATES})), r AS (SELECT cell, round, CAST(sum(CASE WHEN flag = 1 THEN wire_bytes ELSE 0 END) AS DOUBLE) / greatest(1, sum(wire_bytes)) AS r FROM c GROUP BY ALL)
SELECT r.cell AS cell, {r6('avg(r.r)', 'mean_ratio')}, (SELECT {r6('avg(wire_bytes) FILTER (WHERE flag = 1)', 'x')} FROM c) AS flagged_mean, (SELECT {r6('avg(wire_bytes) FILTER (WHERE flag = 0)', 'x')} FROM c) AS other_mean FROM r GROUP BY r.cell""",
)(lambda spark, sf: reports.mean_of_ratios(candidates(spark, sf).withColumns({"flag": (F.col("client_id") < 3).cast("int"), "cell": F.lit("cell")}), "cell", "round", "wire_bytes", "flag"))
query("cumulative_totals", f"SELECT method, CAST(sum(used_bytes) AS BIGINT) AS total_bytes, count(*) AS rounds, count(*) FILTER (WHERE used_bytes < 1000) AS light_rounds FROM ({ROUNDS}) GROUP BY method")(
    lambda spark, sf: rounds(spark, sf).groupBy("method").agg(F.sum("used_bytes").alias("total_bytes"), F.count("*").alias("rounds"), F.count_if(F.col("used_bytes") < 1000).alias("light_rounds"))
)

# Privacy views over the candidates of every round.
_PK = ["round", "client_id"]
_ELIGIBLE = "isfinite(utility) AND wire_bytes > 0 AND wire_bytes <= budget AND n_utility >= 20 AND utility_benign >= 5 AND utility_attack >= 5 AND n_fit >= 180"


def _records(spark, sf):
    return round_budgets(candidates(spark, sf), ["round"], 0.4).withColumn("eligible", static_eligible(F.col("budget")).cast("int"))


query("view_raw", f"SELECT round, client_id, {r6('utility * 1000', 'utility')}, wire_bytes, n_fit, CAST({_ELIGIBLE} AS BIGINT) AS eligible FROM (SELECT *, CAST(floor(0.4::DOUBLE * sum(wire_bytes) OVER (PARTITION BY round)) AS BIGINT) AS budget FROM ({CANDIDATES}))")(
    lambda spark, sf: privacy.view_raw(_records(spark, sf), _PK).withColumn("utility", F.col("utility") * 1000)
)


def _normal_sql(seed: int) -> str:
    keys = ("CAST(round AS VARCHAR)", "CAST(client_id AS VARCHAR)")
    u1, u2 = draw("'n1'", f"'{seed}'", *keys), draw("'n2'", f"'{seed}'", *keys)
    return f"sqrt(-2.0::DOUBLE * ln(({u1} + 1) / 4294967296.0::DOUBLE)) * cos(2.0::DOUBLE * pi() * ({u2} / 4294967296.0::DOUBLE))"


_CLIP = "least(greatest(utility, -1.0::DOUBLE), 1.0::DOUBLE)"
query("view_noisy_quantized", f"SELECT round, client_id, {r6(f'{_CLIP} + 0.1::DOUBLE * ({_normal_sql(0)})', 'utility')}, CAST(greatest(round_even(wire_bytes / 1024.0::DOUBLE, 0) * 1024, 1024) AS BIGINT) AS wire_bytes, CAST(greatest(round_even(n_fit / 1000.0::DOUBLE, 0) * 1000, 0) AS BIGINT) AS n_fit FROM ({CANDIDATES})")(
    lambda spark, sf: privacy.view_noisy_quantized(candidates(spark, sf), _PK)
)
query("view_no_size", f"SELECT round, client_id, {r6(f'{_CLIP} + 0.2::DOUBLE * ({_normal_sql(0)})', 'utility')}, CAST(greatest(round_even(wire_bytes / 4096.0::DOUBLE, 0) * 4096, 4096) AS BIGINT) AS wire_bytes FROM ({CANDIDATES})")(
    lambda spark, sf: privacy.view_no_size(candidates(spark, sf), _PK)
)


def _tertile_sql(column: str) -> str:
    rank = f"row_number() OVER (ORDER BY {column}, round, client_id)"
    n = "count(*) OVER ()"
    return f"CAST(CASE WHEN {rank} <= 1 + (1.0::DOUBLE / 3) * ({n} - 1) + 1e-9 THEN 0 WHEN {rank} <= 1 + (2.0::DOUBLE / 3) * ({n} - 1) + 1e-9 THEN 1 ELSE 2 END AS BIGINT)"


query("view_bucketed", f"SELECT round, client_id, {_tertile_sql('utility')} AS utility_bucket, {_tertile_sql('wire_bytes')} AS cost_bucket FROM ({CANDIDATES})")(
    lambda spark, sf: privacy.view_bucketed(candidates(spark, sf).withColumn("cell", F.lit(0)), _PK, ["cell"])
)
query("above_median_target", f"SELECT round, client_id, CAST(wire_bytes > quantile_cont(CAST(wire_bytes AS DOUBLE), 0.5) OVER (PARTITION BY round) AS BIGINT) AS target FROM ({CANDIDATES})")(
    lambda spark, sf: privacy.above_median(candidates(spark, sf), ["round"], "wire_bytes").select("round", "client_id", "target")
)


def _attack(spark, sf):
    from tidemark.operators.cohort import group_folds

    rows = privacy.above_median(candidates(spark, sf), ["round"], "wire_bytes")
    rows = rows.join(F.broadcast(group_folds(rows, "client_id", 5, 7)), "client_id")
    return privacy.fold_aucs(privacy.out_of_fold(rows.select("round", "client_id", "utility", "n_fit", "target", "fold"), ["utility", "n_fit"], "target", "fold"), "target", "fold")


query("attribute_inference_auc")(_attack)


def _attack_grid(spark, sf):
    """Every view and target by the logistic attacker: the larger half of a round's candidates by rows and by share of errors.

    Forests and networks are some forty fits of Spark ML each, minutes on a small machine; ``attack_scores`` runs them.
    """
    from tidemark.operators import attackers
    from tidemark.operators.cohort import group_folds

    rows = _records(spark, sf)
    share = rows.withColumn("share", F.col("utility_attack") / F.col("n_utility"))
    sized = privacy.above_median(rows, ["round"], "n_fit", "larger").select(*_PK, "larger")
    targets = privacy.above_median(share, ["round"], "share", "attacked").select(*_PK, "attacked").join(sized, _PK)
    views = {
        "Raw": (privacy.view_raw(rows, _PK), ["round", "utility", "wire_bytes", "n_fit", "eligible"], "client_id"),
        "Noisy-Quantized": (privacy.view_noisy_quantized(rows, _PK), ["utility", "wire_bytes", "n_fit"], None),
        "No-Size": (privacy.view_no_size(rows, _PK), ["utility", "wire_bytes"], None),
        "Minimal-Bucketed": (privacy.view_bucketed(rows.withColumn("cell", F.lit(0)), _PK, ["cell"]), ["utility_bucket", "cost_bucket"], None),
    }
    table = attackers.fold_table(views, targets, ["larger", "attacked"], _PK, "client_id", group_folds(rows, "client_id", 5, 7))
    return attackers.attack_grid(attackers.attack_scores(table, _PK, ("LogisticRegression",)), "client_id")


query("attack_grid")(_attack_grid)

_GB = 2000
_GB_DRAW = draw("'auc'", "CAST(b AS VARCHAR)", "CAST(j AS VARCHAR)")
query(
    "group_bootstrap_auc",
    f"""WITH g AS (SELECT list(cell_id ORDER BY cell_id) AS g, count(*) AS n FROM (SELECT DISTINCT cell_id FROM ({PREDICTIONS}))), d AS (SELECT b, g[CAST({_GB_DRAW} % n AS INT) + 1] AS cell_id FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM (SELECT *, unnest(range(1, {_GB} + 1)) AS b FROM g))),
w AS (SELECT b, cell_id, count(*) AS w FROM d GROUP BY ALL), c AS (SELECT cell_id, p, sum(y) AS pos, sum(1 - y) AS neg FROM ({PREDICTIONS}) GROUP BY ALL), m AS (SELECT b, p, sum(w * pos) AS pos, sum(w * neg) AS neg FROM w JOIN c USING (cell_id) GROUP BY ALL),
a AS (SELECT b, CAST(sum(pos * (below + neg / 2.0::DOUBLE)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM (SELECT *, sum(neg) OVER (PARTITION BY b ORDER BY p) - neg AS below FROM m) GROUP BY b)
SELECT {r6('quantile_cont(auc, 0.025)', 'low')}, {r6('quantile_cont(auc, 0.975)', 'high')} FROM a""",
)(lambda spark, sf: privacy.group_bootstrap_auc(predictions(spark, sf), "cell_id", "y", _GB))

# Model vectors: embeddings are deltas, labels clients, ids modulo 7 sample counts.
_VEC = "SELECT label AS client, CAST(vec_id % 7 + 1 AS DOUBLE) AS w, embedding AS v FROM embeddings"


def _vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("label").cast("long").alias("client"), (F.col("vec_id") % 7 + 1).cast("double").alias("w"), F.col("embedding").alias("v"))


_MEAN = "SELECT client, i, sum(w * CAST(v[i] AS DOUBLE)) / sum(w) AS m FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM ({})) GROUP BY client, i"


def _exploded(df):
    return df.select("client", F.posexplode("mean").alias("i", "m")).select(F.col("client").cast("long").alias("client"), (F.col("i") + 1).alias("i"), "m")


query("fedavg_mean", f"SELECT CAST(client AS BIGINT) AS client, CAST(i AS BIGINT) AS i, {r6('m', 'm')} FROM ({_MEAN.format(_VEC)})")(lambda spark, sf: _exploded(vectors.weighted_mean(_vectors(spark, sf), ["client"], "v", "w")))
_NORM = f"SELECT *, sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM ({_VEC})"
_LIMIT = f"SELECT client, med + 2.5::DOUBLE * quantile_cont(abs(n - med), 0.5) AS t FROM (SELECT *, quantile_cont(n, 0.5) OVER (PARTITION BY client) AS med FROM ({_NORM})) GROUP BY client, med"
_CLIPPED = f"SELECT client, w, list_transform(v, lambda x: CAST(x AS DOUBLE) * s) AS v FROM (SELECT *, least(1.0::DOUBLE, t / greatest(n, 1e-12)) AS s FROM ({_NORM}) JOIN ({_LIMIT}) USING (client))"
query("norm_clipped_mean", f"SELECT CAST(client AS BIGINT) AS client, CAST(i AS BIGINT) AS i, {r6('m', 'm')} FROM ({_MEAN.format(_CLIPPED)})")(lambda spark, sf: _exploded(vectors.clipped_mean(_vectors(spark, sf), ["client"], "v", "w")))
query(
    "cosine_to_mean",
    f"""WITH m AS (SELECT client, list(m ORDER BY i) AS mean FROM ({_MEAN.format(_VEC)}) GROUP BY client), n AS (SELECT e.vec_id AS vec_id, e.embedding AS v, mean FROM embeddings e JOIN m ON m.client = e.label)
SELECT vec_id, {r6('sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))', 'delta_l2')}, {r6('list_sum(list_transform(range(1, len(v) + 1), lambda i: CAST(v[i] AS DOUBLE) * mean[i])) / (greatest(sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 1e-12) * greatest(sqrt(list_sum(list_transform(mean, lambda x: x * x))), 1e-12))', 'cosine_to_mean')} FROM n""",
)(
    lambda spark, sf: vectors.with_similarity(
        read(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("client"), F.col("embedding").alias("v")), vectors.weighted_mean(_vectors(spark, sf), ["client"], "v", "w"), ["client"], "v"
    ).select("vec_id", "delta_l2", "cosine_to_mean")
)
query("serialized_sizes")(lambda spark, sf: vectors.serialized_sizes(read(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "wire_bytes"))


def _kept(spark, sf):
    old = _vectors(spark, sf).groupBy("client").agg(F.first(F.transform("v", lambda _: F.lit(1.0))).alias("vector"))
    mean = vectors.weighted_mean(_vectors(spark, sf).where("client < 5"), ["client"], "v", "w")
    return vectors.apply_or_keep(old, mean, ["client"]).select("client", F.posexplode("vector").alias("i", "x"))


query("empty_selection_keeps_model", f"SELECT CAST(c.client AS BIGINT) AS client, CAST(i - 1 AS BIGINT) AS i, {r6('1.0 + coalesce(m, 0)', 'x')} FROM (SELECT DISTINCT client, unnest(range(1, len(v) + 1)) AS i FROM ({_VEC})) c LEFT JOIN (SELECT client, i, m FROM ({_MEAN.format(_VEC)}) WHERE client < 5) USING (client, i)")(_kept)
