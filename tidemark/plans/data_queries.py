"""Queries: audit, deduplication, cohorts, partitions, preprocessing, set checks, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions.columns import binary_label, finite_or_null, folder_label, keyed_draw, stable_seed, to_number
from tidemark.operators import checks, cohort, integrity as audit, prep
from tidemark.plans.base import CANDIDATES, EVENTS, FLOWS, candidates, draw, events, flows, query, r6, read

# Audit and deduplication: line items as flows.
_INDEX = f"SELECT row_hash, arg_min(label, (source, row_no)) AS label, arg_min(source, (source, row_no)) AS source, arg_min(row_no, (source, row_no)) AS row_no, count(*) - 1 AS duplicate_count, CAST(min(label) <> max(label) AS BIGINT) AS conflict FROM ({FLOWS}) GROUP BY row_hash"


def _index(spark, sf):
    return audit.dedup_index(flows(spark, sf), "row_hash", ["source", "row_no"], "label", ["source", "row_no"])


query("dedup_index", f"SELECT row_hash, CAST(label AS BIGINT) AS label, source, row_no, duplicate_count, conflict FROM ({_INDEX})")(_index)
query("audit_totals", f"SELECT count(*) AS unique_rows, count(*) FILTER (WHERE duplicate_count > 0) AS repeated_hashes, CAST(sum(duplicate_count) AS BIGINT) AS repeated_rows, count(*) FILTER (WHERE conflict = 1) AS conflicts, count(*) FILTER (WHERE conflict = 0) AS non_conflicts FROM ({_INDEX})")(
    lambda spark, sf: audit.audit_totals(_index(spark, sf))
)
query("raw_label_counts", f"SELECT source, CAST(label AS BIGINT) AS label, count(*) AS n FROM ({FLOWS}) GROUP BY source, label")(lambda spark, sf: flows(spark, sf).groupBy("source", "label").agg(F.count("*").alias("n")))
query("group_label_pivot", f"SELECT source, count(*) FILTER (WHERE label = 0) AS n_0, count(*) FILTER (WHERE label = 1) AS n_1 FROM ({FLOWS}) GROUP BY source")(lambda spark, sf: audit.counts_pivoted(flows(spark, sf), "source", "label", [0, 1]))
_MISSING = ["doc_id", "quality", "toxic"]
query(
    "missing_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS missing, {r6(f'count(*) FILTER (WHERE {c} IS NULL) / CAST(greatest(count(*), 1) AS DOUBLE)', 'ratio')} FROM (SELECT d.doc_id AS doc_id, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))" for c in _MISSING),
)(lambda spark, sf: audit.missing_counts(read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left"), _MISSING))
query("availability", f"SELECT source, l_linestatus, CAST(label AS BIGINT) AS label, count(DISTINCT row_hash) AS hashes, count(*) AS n FROM ({FLOWS}) GROUP BY ALL")(
    lambda spark, sf: flows(spark, sf).groupBy("source", "l_linestatus", "label").agg(F.count_distinct("row_hash").alias("hashes"), F.count("*").alias("n"))
)
query("cohort_rollup", f"SELECT source, CAST(label AS BIGINT) AS label, count(*) AS n FROM ({FLOWS}) GROUP BY ROLLUP (source, label)")(lambda spark, sf: flows(spark, sf).rollup("source", "label").agg(F.count("*").alias("n")))


def _purity_sql(c: str) -> str:
    return f"SELECT '{c}' AS feature, count(*) AS n_unique, {r6('CAST(sum(m) AS DOUBLE) / sum(n)', 'purity')}, count(*) BETWEEN 2 AND 100 AND CAST(sum(m) AS DOUBLE) / sum(n) >= 0.999 AS suspicious FROM (SELECT {c}, max(k) AS m, sum(k) AS n FROM (SELECT {c}, l_returnflag, count(*) AS k FROM lineitem WHERE {c} IS NOT NULL GROUP BY ALL) GROUP BY {c})"


query("label_purity", " UNION ALL ".join(map(_purity_sql, ["l_linestatus", "l_linenumber", "l_suppkey"])))(
    lambda spark, sf: audit.purity(read(spark, sf, "lineitem"), "l_linestatus", "l_returnflag").unionByName(audit.purity(read(spark, sf, "lineitem"), "l_linenumber", "l_returnflag")).unionByName(audit.purity(read(spark, sf, "lineitem"), "l_suppkey", "l_returnflag"))
)
_PROFILED = ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]
query(
    "column_profile",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct, {r6(f'avg(CAST({c} IS NULL AS INT))', 'missing_ratio')}, {r6(f'coalesce(avg(CAST(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NOT NULL AS INT)) FILTER (WHERE {c} IS NOT NULL), 0)', 'numeric_ratio')}, coalesce(avg(CAST(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NOT NULL AS INT)) FILTER (WHERE {c} IS NOT NULL), 0) >= 0.98 AS is_numeric FROM orders" for c in _PROFILED),
)(lambda spark, sf: audit.profile(read(spark, sf, "orders"), _PROFILED))

_SPLIT = f"SELECT *, CASE CAST({draw(chr(39) + 'split' + chr(39), 'CAST(row_no AS VARCHAR)')} % 10 AS INT) WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM ({FLOWS})"


def _split(spark, sf):
    d = keyed_draw("split", F.col("row_no").cast("string")) % 10
    return flows(spark, sf).withColumn("split", F.when(d == 0, "test").when(d == 1, "validation").otherwise("train"))


query(
    "transformed_repeats",
    f"""WITH s AS ({_SPLIT}), f AS (SELECT row_hash, count(*) AS n, arg_min(split, (source, row_no)) AS first FROM s GROUP BY row_hash HAVING count(*) > 1)
SELECT CAST(coalesce(sum(w), 0) AS BIGINT) AS within_split, CAST(coalesce(sum(a), 0) AS BIGINT) AS across_splits FROM (SELECT row_hash, count(*) FILTER (WHERE split = first) - 1 AS w, count(*) FILTER (WHERE split <> first) AS a FROM s JOIN f USING (row_hash) GROUP BY row_hash)""",
)(lambda spark, sf: audit.transformed_repeats(_split(spark, sf), "row_hash", "split", ["source", "row_no"]))
query("collision_removal", f"SELECT split, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY row_hash) AS k FROM ({_SPLIT})) WHERE k = 1 GROUP BY split")(
    lambda spark, sf: audit.remove_collisions(_split(spark, sf), "row_hash").groupBy("split").agg(F.count("*").alias("n"))
)
query("split_row_counts", f"SELECT split, count(*) AS n, count(*) FILTER (WHERE label = 1) AS attack FROM ({_SPLIT}) GROUP BY split")(lambda spark, sf: _split(spark, sf).groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("attack")))

# Eight-stage flow closure, from counts of the audit: raw, unique, non-conflicting.
_STAGES = f"""SELECT 'lineitem' AS dataset, 1 AS stage, (SELECT count(*) FROM lineitem) AS rows, CAST(sum(duplicate_count) AS BIGINT) AS removed FROM ({_INDEX}) UNION ALL SELECT 'lineitem', 2, count(*), count(*) FILTER (WHERE conflict = 1) FROM ({_INDEX}) UNION ALL SELECT 'lineitem', 3, count(*) FILTER (WHERE conflict = 0), 0 FROM ({_INDEX})"""


def _stages(spark, sf):
    t = audit.audit_totals(_index(spark, sf))
    s = t.select(F.explode(F.array(*(F.struct(F.lit(i).alias("stage"), r.cast("long").alias("rows"), d.cast("long").alias("removed")) for i, r, d in ((1, F.col("unique_rows") + F.col("repeated_rows"), F.col("repeated_rows")), (2, F.col("unique_rows"), F.col("conflicts")), (3, F.col("non_conflicts"), F.lit(0)))))).alias("s"))
    return s.select(F.lit("lineitem").alias("dataset"), "s.*")


query("flow_closure", f"SELECT dataset, CAST(stage AS BIGINT) AS stage, rows, removed, rows - removed AS expected_next, coalesce(lead(rows) OVER (PARTITION BY dataset ORDER BY stage) = rows - removed, true) AS closed FROM ({_STAGES})")(lambda spark, sf: audit.flow_closure(_stages(spark, sf)))
query("prevalence_retention", f"SELECT {r6('100.0 * count(*) FILTER (WHERE label = 0) / count(*)', 'benign_pct')}, {r6('100.0 * count(*) FILTER (WHERE conflict = 0) / count(*)', 'retained_pct')} FROM ({_INDEX})")(
    lambda spark, sf: _index(spark, sf).agg((100.0 * F.count_if(F.col("label") == 0) / F.count("*")).alias("benign_pct"), (100.0 * F.count_if(F.col("conflict") == 0) / F.count("*")).alias("retained_pct"))
)
query("dataset_gate", f"SELECT CASE WHEN u = 0 THEN 'FAIL' WHEN c > 0 THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS status, CAST(u = 0 AS BIGINT) AS failed, CAST(c > 0 AS BIGINT) AS doubtful FROM (SELECT count(*) AS u, count(*) FILTER (WHERE conflict = 1) AS c FROM ({_INDEX}))")(
    lambda spark, sf: audit.verdict(audit.checks([("rows", F.col("unique_rows") > 0, "fail"), ("conflicts", F.col("conflicts") == 0, "review")], audit.audit_totals(_index(spark, sf))))
)

# Labels, folders, coercion, projections.
query("binary_labels", "SELECT o_orderkey, CAST(lower(trim(coalesce(o_orderstatus, '<NA>'))) NOT IN ('f', 'p') AS BIGINT) AS label FROM orders")(lambda spark, sf: read(spark, sf, "orders").select("o_orderkey", binary_label(F.col("o_orderstatus"), ["F", "p"]).alias("label")))
query("folder_labels", "SELECT doc_id, CAST(NOT (contains(lower(source), 'src1') OR contains(lower(source), 'src3')) AS BIGINT) AS label FROM documents")(lambda spark, sf: read(spark, sf, "documents").select("doc_id", folder_label(F.col("source"), ["src1", "SRC3"]).alias("label")))
query("coerced_numbers", "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS level, TRY_CAST(o_orderstatus AS DOUBLE) AS status FROM orders")(
    lambda spark, sf: read(spark, sf, "orders").select("o_orderkey", to_number(F.substring("o_orderpriority", 1, 1)).alias("level"), to_number(F.col("o_orderstatus")).alias("status"))
)
query("reindexed_projection", "SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS extra FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")(
    lambda spark, sf: read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).unionByName(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("extra")), allowMissingColumns=True)
)
query("finite_guard", "SELECT user_id, count(*) AS n FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 'inf'::DOUBLE ELSE value END AS v FROM events) WHERE isfinite(v) GROUP BY user_id")(
    lambda spark, sf: read(spark, sf, "events").withColumn("v", finite_or_null(F.when(F.col("event_type") == "error", float("inf")).otherwise(F.col("value")))).where("v is not null").groupBy("user_id").agg(F.count("*").alias("n"))
)
query("json_projection", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS metric_k FROM events")(lambda spark, sf: read(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("metric_k")))
query("stable_seeds", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST('0x' || substr(sha256('[\"cell\",\"' || n_name || '\",7]'), 1, 8) AS BIGINT) AS seed FROM nation")(
    lambda spark, sf: read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), stable_seed("cell", F.col("n_name"), 7).alias("seed"))
)

# Quotas, cohorts, samples.
_STRATA = f"SELECT source, CAST(label AS BIGINT) AS label, count(*) AS n, count(*) // 2 AS available FROM ({FLOWS}) GROUP BY source, label"
_QUOTA = f"""SELECT source, label, n, available, capped + greatest(0, least(room, spare - coalesce(sum(room) OVER (ORDER BY source, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM (SELECT *, least(q, available) AS capped, available - least(q, available) AS room, sum(q - least(q, available)) OVER () AS spare FROM
 (SELECT *, base + CAST(row_number() OVER (ORDER BY rest DESC, source, label) <= short AS INT) AS q FROM (SELECT *, 1000 - sum(base) OVER () AS short FROM (SELECT *, CAST(floor(share) AS BIGINT) AS base, share - floor(share) AS rest FROM (SELECT *, CAST(n AS DOUBLE) * 1000 / sum(n) OVER () AS share FROM ({_STRATA}))))))"""


def _quotas(spark, sf):
    strata = flows(spark, sf).groupBy("source", "label").agg(F.count("*").alias("n")).withColumn("available", F.floor(F.col("n") / 2))
    return cohort.largest_remainder(strata, 1000, "n", "available", ["source", "label"])


query("largest_remainder_quotas", f"SELECT source, label, n, available, CAST(quota AS BIGINT) AS quota FROM ({_QUOTA})")(_quotas)
query(
    "stratified_cohort",
    f"SELECT f.source AS source, CAST(f.label AS BIGINT) AS label, row_no FROM (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY md5('v' || CAST(row_no AS VARCHAR)), row_no) AS rn FROM ({FLOWS})) f JOIN ({_QUOTA}) q ON f.source = q.source AND f.label = q.label WHERE rn <= quota",
)(lambda spark, sf: cohort.stratified_top(flows(spark, sf).withColumn("h", F.md5(F.concat(F.lit("v"), F.col("row_no").cast("string")))), ["source", "label"], _quotas(spark, sf), ["h", "row_no"]).select("source", "label", "row_no"))
query("hash_reservoir", f"SELECT row_no FROM (SELECT row_no, md5('v' || CAST(row_no AS VARCHAR)) AS h FROM ({FLOWS})) ORDER BY substr(h, 1, 16), h LIMIT 500")(
    lambda spark, sf: cohort.bottom_k(flows(spark, sf).withColumn("h", F.md5(F.concat(F.lit("v"), F.col("row_no").cast("string")))), "h", 500).select("row_no")
)
query("head_sample", f"SELECT source, row_no FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY row_no) AS rn FROM ({FLOWS})) WHERE rn <= 50 ORDER BY source, rn LIMIT 300")(lambda spark, sf: cohort.head_sample(flows(spark, sf), "source", ["row_no"], 50, 300).select("source", "row_no"))

_GROUPS = f"SELECT source AS group_id, count(*) FILTER (WHERE label = 0) AS benign, count(*) FILTER (WHERE label = 1) AS attack FROM ({FLOWS}) GROUP BY source"


def _groups(spark, sf):
    return flows(spark, sf).groupBy(F.col("source").alias("group_id")).agg(F.count_if(F.col("label") == 0).alias("benign"), F.count_if(F.col("label") == 1).alias("attack"))


_TERM = "pow(({x}) - {r}::DOUBLE * {t}, 2) / pow(greatest(1.0::DOUBLE, {r}::DOUBLE * {t}), 2)"


def _score_sql(r: str) -> str:
    return " + ".join(_TERM.format(x=x, r=r, t=t) for x, t in (("b", "tb"), ("a", "ta"), ("b + a", "(tb + ta)")))


query(
    "split_objective",
    f"""WITH g AS ({_GROUPS}), t AS (SELECT sum(benign) AS tb, sum(attack) AS ta FROM g), s AS (SELECT CASE WHEN CAST(group_id AS INT) % 7 = 0 THEN 'test' WHEN CAST(group_id AS INT) % 7 = 1 THEN 'validation' ELSE 'train' END AS split, sum(benign) AS b, sum(attack) AS a, count(*) AS n FROM g GROUP BY 1)
SELECT {r6('sum(pow((b) - ratio * tb, 2) / pow(greatest(1, ratio * tb), 2) + pow((a) - ratio * ta, 2) / pow(greatest(1, ratio * ta), 2) + pow((b + a) - ratio * (tb + ta), 2) / pow(greatest(1, ratio * (tb + ta)), 2) + CASE WHEN b = 0 OR a = 0 THEN 1000 ELSE 0 END + CASE WHEN n = 0 THEN 1000 ELSE 0 END)', 'objective')}
FROM (SELECT r.split, ratio, coalesce(b, 0) AS b, coalesce(a, 0) AS a, coalesce(n, 0) AS n, CAST(tb AS DOUBLE) AS tb, CAST(ta AS DOUBLE) AS ta FROM (VALUES ('train', 0.7::DOUBLE), ('validation', 0.15::DOUBLE), ('test', 0.15::DOUBLE)) r(split, ratio) LEFT JOIN s ON r.split = s.split, t)""",
)(
    lambda spark, sf: cohort.split_objective(
        _groups(spark, sf),
        _groups(spark, sf).select("group_id", F.when(F.col("group_id").cast("int") % 7 == 0, "test").when(F.col("group_id").cast("int") % 7 == 1, "validation").otherwise("train").alias("split")),
        {"train": 0.7, "validation": 0.15, "test": 0.15},
    )
)
query(
    "exhaustive_split",
    f"""WITH g AS (SELECT *, row_number() OVER (ORDER BY group_id) - 1 AS i FROM ({_GROUPS})), n AS (SELECT count(*) AS n, CAST(sum(benign) AS DOUBLE) AS tb, CAST(sum(attack) AS DOUBLE) AS ta FROM g), c AS (SELECT unnest(range(0, CAST(pow(3, n) AS BIGINT))) AS code, tb, ta FROM n),
p AS (SELECT code, tb, ta, group_id, benign, attack, (code // CAST(pow(3, i) AS BIGINT)) % 3 AS split FROM c, g), s AS (SELECT code, tb, ta, split, sum(benign) AS b, sum(attack) AS a FROM p GROUP BY ALL),
o AS (SELECT code, round(sum(CASE split WHEN 0 THEN {_score_sql('0.7')} ELSE {_score_sql('0.15')} END), 9) AS objective FROM s GROUP BY code HAVING count(*) = 3 AND min(b) >= 1 AND min(a) >= 1), z AS (SELECT * FROM o ORDER BY objective, code LIMIT 1)
SELECT group_id, CAST(split AS BIGINT) AS split, {r6('objective', 'objective')} FROM p JOIN z USING (code)""",
)(lambda spark, sf: cohort.exhaustive_split(_groups(spark, sf), (0.7, 0.15, 0.15)))
query(
    "least_loaded_packing",
    f"""WITH RECURSIVE g AS (SELECT group_id, benign + attack AS n, row_number() OVER (ORDER BY benign + attack DESC, group_id) AS rn FROM ({_GROUPS})),
w AS (SELECT CAST(0 AS BIGINT) AS rn, [0::HUGEINT, 0::HUGEINT, 0::HUGEINT] AS load, CAST('' AS VARCHAR) AS id, CAST(0 AS BIGINT) AS client UNION ALL
SELECT w.rn + 1, list_transform([1, 2, 3], lambda i: w.load[i] + CASE WHEN i = list_position(w.load, list_min(w.load)) THEN g.n ELSE 0 END), g.group_id, CAST(list_position(w.load, list_min(w.load)) - 1 AS BIGINT) FROM w JOIN g ON g.rn = w.rn + 1)
SELECT id AS group_id, client AS client_id FROM w WHERE rn > 0""",
)(lambda spark, sf: cohort.least_loaded(_groups(spark, sf).withColumn("n", F.col("benign") + F.col("attack")), 3))
_FU = draw("'fit'", "'0'", "CAST(event_id AS VARCHAR)")
query("fit_utility_split", f"SELECT event_id, client_id, CASE WHEN rn <= least(greatest(least(ceil(n / 10.0), 4096), 1), n - 1) THEN 'utility' ELSE 'fit' END AS part FROM (SELECT event_id, client_id, count(*) OVER (PARTITION BY client_id) AS n, row_number() OVER (PARTITION BY client_id ORDER BY {_FU}, event_id) AS rn FROM ({EVENTS}))")(
    lambda spark, sf: cohort.fit_utility_split(events(spark, sf), "client_id", "event_id").select("event_id", "client_id", "part")
)
_MAL = draw("'malicious'", "'11'", "CAST(client_id AS VARCHAR)")
query("malicious_clients", f"SELECT client_id, CAST(row_number() OVER (ORDER BY {_MAL}, client_id) <= CAST(floor(0.3 * n) AS INT) AS BIGINT) AS malicious_flag FROM (SELECT client_id, count(*) OVER () AS n FROM (SELECT DISTINCT client_id FROM ({EVENTS})))")(
    lambda spark, sf: cohort.malicious_clients(events(spark, sf).select("client_id").distinct(), 11)
)
_FOLD = draw("'fold'", "'7'", "CAST(client_id AS VARCHAR)")
query("group_folds", f"SELECT client_id, CAST((row_number() OVER (ORDER BY {_FOLD}, client_id) - 1) % 5 AS BIGINT) AS fold FROM (SELECT DISTINCT client_id FROM ({EVENTS}))")(lambda spark, sf: cohort.group_folds(events(spark, sf), "client_id", 5, 7))
_SUMMARY = f"SELECT client_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS benign, count(*) FILTER (WHERE event_type = 'error') AS attack FROM ({EVENTS}) GROUP BY client_id"


def _summary(spark, sf):
    return events(spark, sf).groupBy("client_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("benign"), F.count_if(F.col("event_type") == "error").alias("attack"))


query("client_summary", f"SELECT client_id, n, benign, attack, {r6('attack / CAST(n AS DOUBLE)', 'attack_ratio')}, benign = 0 OR attack = 0 AS single_class FROM ({_SUMMARY})")(
    lambda spark, sf: _summary(spark, sf).withColumns({"attack_ratio": F.col("attack") / F.col("n"), "single_class": (F.col("benign") == 0) | (F.col("attack") == 0)})
)
query("partition_summary", f"SELECT min(n) AS min_rows, max(n) AS max_rows, count(*) FILTER (WHERE benign = 0 OR attack = 0) AS single_class, {r6('min(attack / CAST(n AS DOUBLE))', 'min_ratio')}, {r6('max(attack / CAST(n AS DOUBLE))', 'max_ratio')} FROM ({_SUMMARY})")(
    lambda spark, sf: _summary(spark, sf).agg(F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.count_if((F.col("benign") == 0) | (F.col("attack") == 0)).alias("single_class"), F.min(F.col("attack") / F.col("n")).alias("min_ratio"), F.max(F.col("attack") / F.col("n")).alias("max_ratio"))
)

# Preprocessing.
_NUM = ["l_quantity", "l_extendedprice", "l_discount"]


def _stats_sql(c: str) -> str:
    return f"SELECT '{c}' AS feature, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.005) AS lo, quantile_cont({c}, 0.995) AS hi, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, stddev_pop({c}) AS std, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) > 1e-12 THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1 END AS scale FROM lineitem"


_STATS = " UNION ALL ".join(map(_stats_sql, _NUM))
query("robust_stats", f"SELECT feature, {', '.join(r6(c, c) for c in ('median', 'lo', 'hi', 'iqr', 'std', 'scale'))} FROM ({_STATS})")(lambda spark, sf: prep.robust_stats(read(spark, sf, "lineitem"), _NUM))
query("scaled_features", f"WITH s AS ({_STATS}) SELECT l_orderkey * 10 + l_linenumber AS row_no, " + ", ".join(r6(f"CAST((least(greatest({c}, (SELECT lo FROM s WHERE feature = '{c}')), (SELECT hi FROM s WHERE feature = '{c}')) - (SELECT median FROM s WHERE feature = '{c}')) / (SELECT scale FROM s WHERE feature = '{c}') AS FLOAT)", c) for c in ("l_quantity", "l_discount")) + " FROM lineitem")(
    lambda spark, sf: prep.scale_numeric(read(spark, sf, "lineitem"), prep.robust_stats(read(spark, sf, "lineitem"), ["l_quantity", "l_discount"]), ["l_quantity", "l_discount"]).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"), "l_quantity", "l_discount")
)
_VOCAB = "SELECT '__MISSING__' AS value, 0 AS idx UNION ALL SELECT '__UNK__', 1 UNION ALL SELECT value, CAST(row_number() OVER (ORDER BY n DESC, value) + 1 AS INT) FROM (SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10)"
query("vocabulary_top_n", f"SELECT 'p_brand' AS feature, value, CAST(idx AS BIGINT) AS idx FROM ({_VOCAB})")(lambda spark, sf: prep.vocabulary(read(spark, sf, "part"), "p_brand", 10))
query("one_hot_index", f"SELECT p_partkey, CAST(coalesce(idx, 1) AS BIGINT) AS p_brand_idx FROM part LEFT JOIN ({_VOCAB}) ON coalesce(p_brand, '__MISSING__') = value")(
    lambda spark, sf: prep.one_hot_index(read(spark, sf, "part"), prep.vocabulary(read(spark, sf, "part"), "p_brand", 10), "p_brand").select("p_partkey", "p_brand_idx")
)
query("one_hot_vectors", f"SELECT p_partkey, array_to_string(list_transform(range(0, 12), lambda i: CASE WHEN i = coalesce(idx, 1) THEN '1.0' ELSE '0.0' END), ',') AS v FROM part LEFT JOIN ({_VOCAB}) ON coalesce(p_brand, '__MISSING__') = value")(
    lambda spark, sf: prep.one_hot_index(read(spark, sf, "part"), prep.vocabulary(read(spark, sf, "part"), "p_brand", 10), "p_brand").select("p_partkey", prep.one_hot(F.col("p_brand_idx"), 12).alias("v"))
)

# Sets, keys, factorials.
_OS = "SELECT o_orderstatus AS a, o_orderpriority AS b FROM orders"
query("distinct_pairs", f"SELECT DISTINCT a, b FROM ({_OS})")(lambda spark, sf: read(spark, sf, "orders").select(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")).distinct())
query("frame_equality", "SELECT CAST(coalesce(sum(d) FILTER (WHERE d > 0), 0) AS BIGINT) AS only_left, CAST(coalesce(-sum(d) FILTER (WHERE d < 0), 0) AS BIGINT) AS only_right FROM (SELECT n, sum(s) AS d FROM (SELECT c_nationkey AS n, 1 AS s FROM customer UNION ALL SELECT s_nationkey, -1 FROM supplier) GROUP BY n)")(
    lambda spark, sf: checks.same_rows(read(spark, sf, "customer").select(F.col("c_nationkey").alias("n")), read(spark, sf, "supplier").select(F.col("s_nationkey").alias("n")), ["n"])
)
query("set_difference", "SELECT count(*) FILTER (WHERE s = 2) AS missing, count(*) FILTER (WHERE s = 1) AS extra FROM (SELECT n, sum(s) AS s FROM (SELECT DISTINCT s_nationkey AS n, 1 AS s FROM supplier UNION ALL SELECT DISTINCT n_nationkey, 2 FROM nation) GROUP BY n)")(
    lambda spark, sf: checks.set_difference(read(spark, sf, "supplier").select(F.col("s_nationkey").alias("n")), read(spark, sf, "nation").select(F.col("n_nationkey").alias("n")), ["n"])
)
query("group_overlap", "SELECT count(*) AS shared FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer))")(
    lambda spark, sf: checks.overlap(read(spark, sf, "supplier").select(F.col("s_nationkey").alias("n")), read(spark, sf, "customer").select(F.col("c_nationkey").alias("n")), ["n"])
)
query("repeated_keys", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")(lambda spark, sf: checks.repeated_keys(read(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"]))
query("sum_violations", f"SELECT round, CAST(sum(utility_attack) AS BIGINT) AS total FROM ({CANDIDATES}) GROUP BY round HAVING sum(utility_attack) NOT IN (60, 70)")(lambda spark, sf: checks.violations(candidates(spark, sf), ["round"], "utility_attack", [60, 70]))
query("round_coverage", f"SELECT round, count(*) AS n, count(DISTINCT client_id) AS members, count(DISTINCT client_id) = 10 AS complete FROM ({CANDIDATES}) GROUP BY round")(lambda spark, sf: checks.coverage(candidates(spark, sf), ["round"], "client_id", 10))
_METHODS = ["Random-Budget", "Cost-Only", "Utility-Only", "Utility-Cost-Ratio", "CB-Score", "Historical-DoubleCost", "Oort-Style-Adapted", "Oracle-Score-Exact"]
_BETAS, _SETS = [0.1, 0.2, 0.4, 0.6, 0.8, 1.0], ["flows_a", "flows_b"]


def _primary(spark, sf):
    some = cohort.factorial(spark, dataset=_SETS, method=_METHODS, beta=_BETAS, seed=list(range(10)))
    return some.unionByName(
        cohort.factorial(spark, dataset=_SETS, method=["Full-Contextual"], seed=list(range(10))).withColumn("beta", F.lit(None).cast("double"))
    )


def _lit(xs) -> str:
    return ", ".join(f"('{x}')" if isinstance(x, str) else f"({x}::DOUBLE)" for x in xs)


query("primary_factorial", f"SELECT dataset, method, beta, seed FROM (VALUES {_lit(_SETS)}) d(dataset), (VALUES {_lit(_METHODS)}) m(method), (VALUES {_lit(_BETAS)}) b(beta), range(0, 10) s(seed) UNION ALL SELECT dataset, 'Full-Contextual', NULL, seed FROM (VALUES {_lit(_SETS)}) d(dataset), range(0, 10) s(seed)")(_primary)
query(
    "factorial_counts", "SELECT 'Full-Contextual' AS method, 20::BIGINT AS n UNION ALL SELECT method, 120 FROM (VALUES " + _lit(_METHODS) + ") m(method)"
)(lambda spark, sf: _primary(spark, sf).groupBy("method").agg(F.count("*").alias("n")))
query("cell_lookup", f"SELECT e.round AS round, count(*) AS n FROM (SELECT round, 'CB-Score' AS method, CASE WHEN client_id < 5 THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END AS beta FROM ({CANDIDATES})) e WHERE e.beta IN ({', '.join(map(str, _BETAS))}) GROUP BY e.round")(
    lambda spark, sf: candidates(spark, sf).select("round", F.lit("CB-Score").alias("method"), F.round(F.when(F.col("client_id") < 5, 0.2).otherwise(0.4) * 100).cast("int").alias("b"))
    .join(F.broadcast(_primary(spark, sf).select("method", F.round(F.col("beta") * 100).cast("int").alias("b")).distinct()), ["method", "b"]).groupBy("round").agg(F.count("*").alias("n"))
)
query("membership_semi_join", f"SELECT round, client_id FROM ({CANDIDATES}) WHERE (round, client_id) IN (SELECT (round, min(client_id)) FROM ({CANDIDATES}) WHERE utility > 0 GROUP BY round)")(
    lambda spark, sf: candidates(spark, sf).join(candidates(spark, sf).where("utility > 0").groupBy("round").agg(F.min("client_id").alias("client_id")), ["round", "client_id"], "left_semi").select("round", "client_id")
)
query("anti_join_folds", "SELECT count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")(
    lambda spark, sf: read(spark, sf, "customer").join(read(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey")).distinct(), "c_nationkey", "left_anti").agg(F.count("*").alias("n"))
)
query("first_occurrence_rows", f"SELECT f.row_no AS row_no, f.l_quantity AS l_quantity FROM ({FLOWS}) f JOIN ({_INDEX}) i ON f.row_hash = i.row_hash AND f.source = i.source AND f.row_no = i.row_no WHERE i.conflict = 0 AND i.duplicate_count > 0")(
    lambda spark, sf: flows(spark, sf).join(_index(spark, sf).where("conflict = 0 and duplicate_count > 0").select("row_hash", "source", "row_no"), ["row_hash", "source", "row_no"], "left_semi").select("row_no", "l_quantity")
)
query("group_median_indicator", "SELECT c_custkey, CAST(c_acctbal > quantile_cont(c_acctbal, 0.5) OVER (PARTITION BY c_mktsegment) AS BIGINT) AS above FROM customer")(
    lambda spark, sf: read(spark, sf, "customer").withColumn("m", F.percentile("c_acctbal", F.lit(0.5)).over(Window.partitionBy("c_mktsegment"))).select("c_custkey", (F.col("c_acctbal") > F.col("m")).cast("int").alias("above"))
)
