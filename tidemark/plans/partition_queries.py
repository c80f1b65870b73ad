"""Queries: client partitions by rows, the audit on CSV files, AUCs of client groups, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.columns import row_hash
from tidemark.operators import integrity, partition, privacy
from tidemark.plans.base import FLOWS, draw, flows, query, r6, read
from tidemark.sources.csv_rows import read_csv_rows
from tidemark.sources.files import shared_folder

_CLIENTS, _ALPHA, _SEED = 10, 0.5, 42


def _gamma(keys: str, rows: str) -> str:
    """SQL: (keys, g) of gamma variates of shape 1/2; ``rows`` has the keys as text in k."""
    unit = lambda *parts: f"(({draw('k', *parts)}) + 1) / 4294967296.0::DOUBLE"
    d = "(1.5::DOUBLE - 1.0::DOUBLE / 3)"
    tries = f"SELECT *, {unit('i', chr(39) + 'a' + chr(39))} AS u1, {unit('i', chr(39) + 'b' + chr(39))} AS u2, {unit('i', chr(39) + 'c' + chr(39))} AS u3 FROM (SELECT *, unnest(range(20)) AS i FROM ({rows}))"
    cubed = f"SELECT *, sqrt(-2.0::DOUBLE * ln(u1)) * cos(2.0::DOUBLE * pi() * u2) AS x, pow(1 + x / sqrt(9 * {d}), 3) AS v FROM ({tries})"
    taken = f"SELECT * FROM ({cubed}) WHERE v > 0 AND ln(u3) < 0.5::DOUBLE * x * x + {d} - {d} * v + {d} * ln(CASE WHEN v > 0 THEN v END) QUALIFY row_number() OVER (PARTITION BY k ORDER BY i) = 1"
    boost = unit("'boost'")
    return f"SELECT {keys}, {d} * v * pow({boost}, 2) AS g FROM ({taken})"


_ROWS = f"SELECT row_no, label, {draw(chr(39) + 'deal' + chr(39), chr(39) + str(_SEED) + chr(39), 'CAST(row_no AS VARCHAR)')} AS d FROM ({FLOWS})"


def _least(n: str) -> str:
    """A twentieth of the rows: half of an equal share."""
    return f"CAST(floor({n} / 20.0) AS BIGINT)"


_KEYED = f"SELECT label, client, concat_ws('|', 'dirichlet', '{_SEED}', CAST(label AS VARCHAR), CAST(client AS VARCHAR)) AS k FROM (SELECT DISTINCT label FROM ({FLOWS})), range({_CLIENTS}) r(client)"
_QUOTA_SQL = f"""WITH RECURSIVE n AS (SELECT label, count(*) AS n FROM ({FLOWS}) GROUP BY label), s AS (SELECT label, client, n * (g / sum(g) OVER (PARTITION BY label)) AS raw, n FROM ({_gamma('label, client', _KEYED)}) JOIN n USING (label)),
q AS (SELECT label, client, floor(raw) + CASE WHEN row_number() OVER (PARTITION BY label ORDER BY floor(raw) - raw, client) <= n - sum(floor(raw)) OVER (PARTITION BY label) THEN 1 ELSE 0 END AS quota FROM s),
upto AS (SELECT label, client, sum(quota) OVER (PARTITION BY label ORDER BY client) AS upto, quota FROM q),
c AS (SELECT list(n ORDER BY client) AS c FROM (SELECT client, CAST(sum(quota) AS BIGINT) AS n FROM q GROUP BY client)), least_ AS (SELECT {_least('sum(n)')} AS m FROM n),
m AS (SELECT 0 AS step, c, list_transform(c, lambda x: 0::BIGINT) AS given, -1 AS donor, -1 AS receiver, 0::BIGINT AS a, 0::BIGINT AS b FROM c UNION ALL
SELECT step + 1, list_transform(range(1, {_CLIENTS} + 1), lambda i: CASE WHEN i = r THEN m ELSE c[i] - CASE WHEN i = d THEN need ELSE 0 END END), list_transform(range(1, {_CLIENTS} + 1), lambda i: given[i] + CASE WHEN i = d THEN need ELSE 0 END), d - 1, r - 1, given[d], given[d] + need
FROM (SELECT *, list_position(c, list_min(c)) AS r, list_position(c, list_max(c)) AS d, m - list_min(c) AS need FROM m, least_ WHERE list_min(c) < m)),
dealt AS (SELECT row_no, label, rn, (SELECT min(client) FROM upto u WHERE u.label = x.label AND u.upto >= rn) AS client FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, row_no) AS rn FROM ({_ROWS})) x),
own AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY label, rn) - 1 AS place FROM dealt)
SELECT row_no, label, CAST(coalesce(m.receiver, own.client) AS BIGINT) AS client_id FROM own LEFT JOIN m ON m.step > 0 AND m.donor = own.client AND own.place >= m.a AND own.place < m.b"""


def _quota(spark, sf):
    rows = flows(spark, sf).select("row_no", "label")
    return partition.quota_partition(rows, "label", "row_no", _CLIENTS, _ALPHA, _SEED, rows.count() // 20).select("row_no", "label", "client_id")


query("quota_partition", _QUOTA_SQL)(_quota)

_TRIES = 40
_TRIED = f"SELECT t, label, client, concat_ws('|', 'dirichlet', '{_SEED}', CAST(t AS VARCHAR), CAST(label AS VARCHAR), CAST(client AS VARCHAR)) AS k FROM (SELECT DISTINCT label FROM ({FLOWS})), range({_CLIENTS}) r(client), range({_TRIES}) a(t)"
_U = draw("'client'", f"'{_SEED}'", "CAST(row_no AS VARCHAR)")
_MULTINOMIAL_SQL = f"""WITH s AS (SELECT t, label, client, least(1.0, sum(g / total) OVER (PARTITION BY t, label ORDER BY client)) AS b FROM (SELECT *, sum(g) OVER (PARTITION BY t, label) AS total FROM ({_gamma('t, label, client', _TRIED)}))),
b AS (SELECT t, label, list(b ORDER BY client) AS b FROM s GROUP BY t, label),
r AS (SELECT t, label, least(len(list_filter(b, lambda x: x <= u)), {_CLIENTS - 1}) AS client_id FROM (SELECT label, {_U} / 4294967296.0::DOUBLE AS u FROM ({FLOWS})) JOIN b USING (label)),
c AS (SELECT t, client_id, count(*) AS n, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS attack FROM r GROUP BY t, client_id),
good AS (SELECT min(t) AS t FROM (SELECT t FROM c GROUP BY t HAVING count(*) = {_CLIENTS} AND min(n) >= (SELECT count(*) // 50 FROM ({FLOWS}))))
SELECT CAST(client_id AS BIGINT) AS client_id, n, benign, attack FROM c JOIN good USING (t)"""


def _multinomial(spark, sf):
    rows = flows(spark, sf).select("row_no", "label")
    dealt = partition.multinomial_partition(rows, "label", "row_no", _CLIENTS, _ALPHA, _SEED, rows.count() // 50, _TRIES)
    return dealt.groupBy("client_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("benign"), F.count_if(F.col("label") == 1).alias("attack"))


query("dirichlet_partition", _MULTINOMIAL_SQL)(_multinomial)


# The audit on files: line items as CSV, a file a month, with line breaks and quotes inside fields.
_FILED = f"SELECT * EXCLUDE (source, row_no), strftime(l_shipdate, '%Y-%m') AS source, row_number() OVER (PARTITION BY strftime(l_shipdate, '%Y-%m') ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS row_no FROM ({FLOWS})"
_CSV_INDEX = f"SELECT row_hash, CAST(arg_min(label, (source, row_no)) AS BIGINT) AS label, arg_min(source, (source, row_no)) AS source, arg_min(row_no, (source, row_no)) AS row_no, count(*) - 1 AS duplicate_count, CAST(min(label) <> max(label) AS BIGINT) AS conflict FROM ({_FILED}) GROUP BY row_hash"


def _csv_index(spark, sf):
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    note = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit('said "no",\nand '), F.col("l_linestatus"))).otherwise(F.col("l_linestatus"))
    items = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", note.alias("note"), F.date_format("l_shipdate", "yyyy-MM").alias("source"))
    ordered = items.repartition("source").sortWithinPartitions("source", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").drop("l_orderkey", "l_linenumber")
    ordered.write.partitionBy("source").option("header", "true").option("escape", '"').csv(path)
    rows = read_csv_rows(spark, path, "l_partkey long, l_suppkey long, l_returnflag string, note string")
    rows = rows.withColumns({"row_hash": row_hash(["l_partkey", "l_suppkey"]), "label": (F.col("l_returnflag") == "R").cast("int"), "source": F.regexp_extract("source_file", "source=([^/]+)", 1)})
    return integrity.dedup_index(rows, "row_hash", ["source", "row_no"], "label", ["source", "row_no"])


query("csv_dedup_index", _CSV_INDEX)(_csv_index)

# Attacks on users' groups: whether an event is an error, told from its value or from its properties, on two views (days).
_ATTACKS = """SELECT 'V' || CAST(day(ts) % 2 AS VARCHAR) AS view, user_id % 50 AS client_id, CAST(event_type = 'error' AS BIGINT) AS y, attacker, CASE attacker WHEN 'value' THEN value / 500 ELSE CAST(length(props) % 7 AS DOUBLE) / 7 END AS p
 FROM events, (VALUES ('value'), ('props')) a(attacker)"""
_GROUP_AUC = f"""SELECT view, attacker, client_id, sum(pos) AS positives, sum(neg) AS negatives, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN CAST(sum(pos * (below - neg / 2.0::DOUBLE)) AS DOUBLE) / sum(pos) / sum(neg) END AS auc FROM
 (SELECT *, sum(neg) OVER (PARTITION BY view, attacker, client_id ORDER BY p) AS below FROM (SELECT view, attacker, client_id, p, sum(y) AS pos, sum(1 - y) AS neg FROM ({_ATTACKS}) GROUP BY ALL)) GROUP BY ALL"""


def _group_aucs(spark, sf):
    events = read(spark, sf, "events")
    attackers = F.explode(F.array(F.struct(F.lit("value").alias("attacker"), (F.col("value") / 500).alias("p")), F.struct(F.lit("props").alias("attacker"), ((F.length("props") % 7).cast("double") / 7).alias("p"))))
    rows = events.select(F.concat(F.lit("V"), (F.dayofmonth("ts") % 2).cast("string")).alias("view"), (F.col("user_id") % 50).alias("client_id"), (F.col("event_type") == "error").cast("long").alias("y"), attackers.alias("a"))
    return privacy.group_aucs(rows.select("view", "client_id", "y", "a.attacker", "a.p"), ["view", "attacker"], "client_id")


query("client_group_auc", f"SELECT view, attacker, client_id, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives, {r6('auc', 'auc')} FROM ({_GROUP_AUC})")(_group_aucs)
_WORST = f"SELECT view, client_id, max(best) AS auc, min(attacker) FILTER (auc = best) AS attacker, count(*) FILTER (auc = best) AS tied FROM (SELECT *, max(auc) OVER (PARTITION BY view, client_id) AS best FROM ({_GROUP_AUC})) GROUP BY view, client_id"
query("worst_attackers", f"SELECT view, client_id, {r6('auc', 'auc')}, attacker, tied FROM ({_WORST})")(lambda spark, sf: privacy.worst_attackers(_group_aucs(spark, sf), "attacker", ["view", "client_id"]))
query(
    "worst_attacker_ecdf",
    f"SELECT view, {r6('auc', 'auc')}, CAST(groups AS BIGINT) AS groups, {r6('CAST(groups AS DOUBLE) / total', 'share')} FROM (SELECT view, auc, sum(n) OVER (PARTITION BY view ORDER BY auc) AS groups, sum(n) OVER (PARTITION BY view) AS total FROM (SELECT view, auc, count(*) AS n FROM ({_WORST}) WHERE auc IS NOT NULL GROUP BY ALL))",
)(lambda spark, sf: privacy.auc_distribution(privacy.worst_attackers(_group_aucs(spark, sf), "attacker", ["view", "client_id"]), ["view"]))
