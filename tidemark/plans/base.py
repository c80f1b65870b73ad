"""Bindings of the driver's tables to the operators' inputs, each as a DataFrame and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.columns import UPLINK_RATES, airtime_us

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, its doubles rounded to six digits on both sides, and its SQL if there is one."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return wrap


def tidy(df: DataFrame) -> DataFrame:
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), F.round(c.cast("double"), 6) + 0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
        out.append(c.alias(field.name))
    return df.select(out)


def r6(x: str, alias: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS {alias}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Events as rounds (days) of clients (users by last digit).
EVENTS = "SELECT *, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS round, user_id % 10 AS client_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumns(
        {"round": F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long"), "client_id": F.col("user_id") % 10, "cents": F.round(F.col("value") * 100).cast("long")}
    )


RATES = "[" + ", ".join(f"{r}::DOUBLE" for r in UPLINK_RATES) + "]"
CANDIDATES = f"""SELECT round, client_id, CAST(sum(cents) AS DOUBLE) / count(*) / 10000 - 0.5::DOUBLE AS utility,
 CAST(sum(length(props)) + 64 AS BIGINT) AS wire_bytes, 6 * count(*) AS n_fit, count(*) AS n_utility,
 count(*) FILTER (WHERE event_type <> 'error') AS utility_benign, count(*) FILTER (WHERE event_type = 'error') AS utility_attack,
 ceil(8.0::DOUBLE * (sum(length(props)) + 64) / {RATES}[CAST(client_id AS INT) + 1]) AS predicted_airtime_us,
 CAST(count(*) AS DOUBLE) / 1000 AS local_training_seconds
 FROM ({EVENTS}) GROUP BY round, client_id"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    out = events(spark, sf_dir).groupBy("round", "client_id").agg(
        (F.sum("cents").cast("double") / F.count("*") / 10000 - 0.5).alias("utility"), (F.sum(F.length("props")) + 64).cast("long").alias("wire_bytes"), (6 * F.count("*")).alias("n_fit"),
        F.count("*").alias("n_utility"), F.count_if(~error).alias("utility_benign"), F.count_if(error).alias("utility_attack"), (F.count("*").cast("double") / 1000).alias("local_training_seconds"),
    )
    return out.withColumn("predicted_airtime_us", airtime_us(F.col("wire_bytes"), F.col("client_id")))


PREDICTIONS = "SELECT event_id, user_id, user_id % 10 AS cell_id, CAST(event_type = 'error' AS INT) AS y, value / 500 AS p FROM events"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", (F.col("user_id") % 10).alias("cell_id"), (F.col("event_type") == "error").cast("int").alias("y"), (F.col("value") / 500).alias("p"))


METHOD_OF = {"click": "Full-Contextual", "view": "CB-Score", "purchase": "Random-Budget", "signup": "Cost-Only", "error": "Utility-Only"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METHOD_OF.items()) + " END"
METRICS = f"""SELECT 'D' || CAST(round % 2 AS VARCHAR) AS dataset, {_CASE} AS method,
 CASE WHEN event_type = 'click' THEN NULL WHEN (user_id // 10) % 2 = 0 THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END AS beta, user_id % 10 AS seed,
 CAST(sum(cents) AS DOUBLE) / count(*) / 50000 AS f1, max(value) / 500 AS pr_auc, CAST(count(*) FILTER (WHERE value > 80) AS DOUBLE) / count(*) AS fpr,
 CAST(sum(length(props)) + 64 AS BIGINT) AS cost, count(*) AS n FROM ({EVENTS}) GROUP BY ALL"""


def metrics(spark: SparkSession, sf_dir: str, alarm: float = 80) -> DataFrame:
    method = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in METHOD_OF.items()))
    beta = F.when(F.col("event_type") == "click", F.lit(None).cast("double")).when(F.floor(F.col("user_id") / 10) % 2 == 0, 0.2).otherwise(0.4)
    keyed = events(spark, sf_dir).withColumns({"dataset": F.concat(F.lit("D"), (F.col("round") % 2).cast("string")), "method": method, "beta": beta, "seed": F.col("user_id") % 10})
    return keyed.groupBy("dataset", "method", "beta", "seed").agg(
        (F.sum("cents").cast("double") / F.count("*") / 50000).alias("f1"), (F.max("value") / 500).alias("pr_auc"), (F.count_if(F.col("value") > alarm).cast("double") / F.count("*")).alias("fpr"),
        (F.sum(F.length("props")) + 64).cast("long").alias("cost"), F.count("*").alias("n"),
    )


ROUNDS = f"""SELECT {_CASE} AS method, round, CAST(sum(cents) AS DOUBLE) / count(*) / 50000 + round * 0.01::DOUBLE AS validation_f1, max(value) / 500 + round * 0.005::DOUBLE AS validation_pr_auc,
 CAST(sum(length(props)) + 64 AS BIGINT) AS used_bytes FROM ({EVENTS}) GROUP BY 1, 2"""


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in METHOD_OF.items()))
    return events(spark, sf_dir).withColumn("method", method).groupBy("method", "round").agg(
        (F.sum("cents").cast("double") / F.count("*") / 50000 + F.col("round") * 0.01).alias("validation_f1"), (F.max("value") / 500 + F.col("round") * 0.005).alias("validation_pr_auc"), (F.sum(F.length("props")) + 64).cast("long").alias("used_bytes")
    )


# Line items as flows: a key of part and supplier, a label, a file (the ship year) and a place in it.
FLOWS = """SELECT *, concat_ws('|', 'v' || length(CAST(l_partkey AS VARCHAR)) || ':' || CAST(l_partkey AS VARCHAR), 'v' || length(CAST(l_suppkey AS VARCHAR)) || ':' || CAST(l_suppkey AS VARCHAR)) AS flow_text,
 md5(concat_ws('|', 'v' || length(CAST(l_partkey AS VARCHAR)) || ':' || CAST(l_partkey AS VARCHAR), 'v' || length(CAST(l_suppkey AS VARCHAR)) || ':' || CAST(l_suppkey AS VARCHAR))) AS row_hash,
 CAST(l_returnflag = 'R' AS INT) AS label, CAST(year(l_shipdate) AS VARCHAR) AS source, l_orderkey * 10 + l_linenumber AS row_no FROM lineitem"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.columns import row_hash

    return read(spark, sf_dir, "lineitem").withColumns(
        {"row_hash": row_hash(["l_partkey", "l_suppkey"]), "label": (F.col("l_returnflag") == "R").cast("int"), "source": F.year("l_shipdate").cast("string"), "row_no": F.col("l_orderkey") * 10 + F.col("l_linenumber")}
    )


def draw(*parts: str) -> str:
    """SQL of a keyed draw: an unsigned integer below 2^32."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"
