"""Integrity audit: duplicate index, conflicts, counts, leakage and type checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import folded, to_number


def dedup_index(rows: DataFrame, hash_col: str, order: list[str], label: str, payload: list[str]) -> DataFrame:
    """One row per hash: the first row's payload and label, how often it repeats, and whether labels differ."""
    first = F.min_by(F.struct(label, *payload), F.struct(*order))
    grouped = rows.groupBy(hash_col).agg(first.alias("f"), (F.count("*") - 1).alias("duplicate_count"), (F.min(label) != F.max(label)).cast("int").alias("conflict"))
    return grouped.select(hash_col, "f.*", "duplicate_count", "conflict")


def audit_totals(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count("*").alias("unique_rows"), F.count_if(F.col("duplicate_count") > 0).alias("repeated_hashes"), F.sum("duplicate_count").alias("repeated_rows"),
        F.count_if(F.col("conflict") == 1).alias("conflicts"), F.count_if(F.col("conflict") == 0).alias("non_conflicts"),
    )


def missing_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, missing, ratio), one scan and one aggregate for all columns."""
    one = rows.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return one.unpivot(["n"], columns, "feature", "missing").select("feature", "missing", (F.col("missing") / F.greatest("n", F.lit(1))).alias("ratio"))


def counts_pivoted(rows: DataFrame, key: str, label: str, values: list) -> DataFrame:
    out = rows.groupBy(key).pivot(label, values).count().na.fill(0)
    return out.withColumnsRenamed({str(v): f"n_{v}" for v in values})


def purity(rows: DataFrame, column: str, label: str) -> DataFrame:
    """(feature, n_unique, purity, suspicious): rows that have their value's commonest label, over all rows."""
    pairs = rows.where(F.col(column).isNotNull()).groupBy(column, label).agg(F.count("*").alias("n"))
    best = pairs.groupBy(column).agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    out = best.agg(F.count("*").alias("n_unique"), (F.sum("m") / F.sum("n")).alias("purity"))
    return out.select(F.lit(column).alias("feature"), "n_unique", "purity", (F.col("n_unique").between(2, 100) & (F.col("purity") >= 0.999)).alias("suspicious"))


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n_distinct, missing_ratio, numeric_ratio, is_numeric): numeric if at least 98 % parse."""
    aggs: list[Column] = []
    for c in columns:
        parsed = F.avg(F.when(F.col(c).isNotNull(), to_number(F.col(c).cast("string")).isNotNull().cast("int")))
        aggs.append(F.struct(F.lit(c).alias("feature"), F.count_distinct(c).alias("n_distinct"), F.avg(F.col(c).isNull().cast("int")).alias("missing_ratio"), F.coalesce(parsed, F.lit(0.0)).alias("numeric_ratio")).alias(f"s_{c}"))
    out = rows.agg(*aggs).select(F.explode(F.array(*(f"s_{c}" for c in columns))).alias("s")).select("s.*")
    return out.withColumn("is_numeric", F.col("numeric_ratio") >= 0.98)


def transformed_repeats(rows: DataFrame, hash_col: str, split_col: str, order: list[str]) -> DataFrame:
    """Repeats of transformed rows inside the split that had them first, and in others."""
    first = F.min_by(split_col, F.struct(*order))
    seen = rows.groupBy(hash_col).agg(F.count("*").alias("n"), first.alias("first_split"))
    placed = rows.join(seen.where("n > 1"), hash_col)
    same = F.col(split_col) == F.col("first_split")
    by_hash = placed.groupBy(hash_col).agg((F.count_if(same) - 1).alias("within"), F.count_if(~same).alias("across"))
    return by_hash.agg(F.coalesce(F.sum("within"), F.lit(0)).alias("within_split"), F.coalesce(F.sum("across"), F.lit(0)).alias("across_splits"))


def remove_collisions(rows: DataFrame, hash_col: str) -> DataFrame:
    """Only rows whose hash occurs once in the whole table; hashes are counted before rows meet."""
    repeated = rows.groupBy(hash_col).agg(F.count("*").alias("__n")).where("__n > 1").select(hash_col)
    return rows.join(repeated, hash_col, "left_anti")


def flow_closure(stages: DataFrame, order: str = "stage") -> DataFrame:
    """stage, rows, removed, expected_next, closed: rows - removed must be the next stage's rows."""
    nxt = F.lead("rows").over(Window.partitionBy("dataset").orderBy(order))
    return stages.withColumn("expected_next", F.col("rows") - F.col("removed")).withColumn("closed", nxt.isNull() | (nxt == F.col("rows") - F.col("removed")))


def auto_drop(columns: list[str], preserve: set[str], exact: set[str], keywords: list[str], label: str | None = None) -> dict[str, str]:
    """Columns to drop as leakage and why: the label and preserved ones never, then exact names, then keywords inside names.

    Preserved and exact names are folded on both sides (white space, case, dashes as
    underscores); keywords are looked up in the trimmed, lower-cased name as it stands.
    """
    kept, named = {folded(x) for x in preserve}, {folded(x) for x in exact}
    out = {}
    for c in columns:
        if c == label or folded(c) in kept:
            continue
        if folded(c) in named:
            out[c] = "exact"
        elif hit := next((k for k in keywords if k.strip().lower() in c.strip().lower()), None):
            out[c] = f"keyword:{hit}"
    return out


def label_column(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate that a column's folded name equals."""
    by_name = {folded(c): c for c in reversed(columns)}
    return next((by_name[folded(x)] for x in candidates if folded(x) in by_name), None)


def checks(conditions: list[tuple[str, Column, str]], totals: DataFrame) -> DataFrame:
    """(check, passed, severity) rows from one row of totals, and nothing collected."""
    items = F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed"), F.lit(s).alias("severity")) for n, c, s in conditions))
    return totals.select(F.explode(items).alias("x")).select("x.*")


def verdict(checked: DataFrame) -> DataFrame:
    bad = F.count_if(~F.col("passed") & (F.col("severity") == "fail"))
    doubtful = F.count_if(~F.col("passed") & (F.col("severity") == "review"))
    return checked.agg(F.when(bad > 0, "FAIL").when(doubtful > 0, "REVIEW_REQUIRED").otherwise("PASS").alias("status"), bad.alias("failed"), doubtful.alias("doubtful"))
