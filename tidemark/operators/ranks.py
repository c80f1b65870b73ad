"""Running sums, first rows and exact quantiles without a window over a whole group.

A group of more than ``BIN_ROWS`` rows is cut at sampled values into ordered bins. The
sample is picked by a hash of group and value, so a task that runs again picks the same.
Bins are summed up, the few sums of a group are added one after the other, and only rows
of one bin are ordered in a task. Smaller groups are one bin.

Values that are equal lie in one bin, so rows are summed up to distinct values first, or
ordered by something that ends in a key. Nulls come first and NaN last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a group that are ordered together, about.
BIN_ROWS = 50_000
#: Bins of a group at the most, about; a value's bin is found in two steps of ``STEP``.
MOST_BINS, STEP = 1024, 32


def _group(by: list[str]) -> Column:
    """The group as one value that is never null, so that nulls of the keys are a group and windows and joins share their shuffle."""
    return F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("all"))


def in_bins(rows: DataFrame, by: list[str], value: Column, bin_rows: int | None = None) -> DataFrame:
    """``__group`` and ``__bin``: the ordered stretch of its group, from 0, that a row's value lies in."""
    bin_rows = bin_rows or BIN_ROWS
    keyed = rows.withColumn("__group", _group(by))
    plain = rows.select(_group(by).alias("__group"), value.alias("__v"))
    large = plain.groupBy("__group").agg(F.count("*").alias("__n")).where(F.col("__n") > bin_rows)
    share = F.least(F.col("__n") / bin_rows, F.lit(MOST_BINS)) / F.col("__n")
    picked = F.pmod(F.xxhash64("__group", "__v"), F.lit(1 << 40)) < share * float(1 << 40)
    cuts = plain.where("__v is not null").join(large, "__group").where(picked).groupBy("__group").agg(F.array_sort(F.collect_set("__v")).alias("__cuts"))
    heads = F.transform(F.sequence(F.lit(0), F.floor((F.size("__cuts") - 1) / STEP).cast("int")), lambda i: F.get("__cuts", i * STEP))
    joined = keyed.join(cuts.withColumn("__heads", heads), "__group", "left")
    upto = lambda some: F.size(F.filter(some, lambda e: e <= value))
    head = upto(F.col("__heads"))
    fine = (head - 1) * STEP + upto(F.slice("__cuts", (head - 1) * STEP + 1, F.lit(STEP)))
    place = F.when(F.col("__cuts").isNull() | (head < 1), 0).otherwise(fine)
    return joined.withColumn("__bin", place.cast("long")).drop("__cuts", "__heads")


def running(rows: DataFrame, by: list[str], value: str, sums: list[str], before: list[str] | None = None, bin_rows: int | None = None) -> DataFrame:
    """``<c>_upto`` and ``<c>_all`` for each of ``sums``: its sum over the group's rows up to and with this one in the order of ``value``, and over all.

    ``<c>_before`` for each of ``before``: what the row before has there, null for a
    group's first. Both kinds of columns hold no nulls. An empty table stays empty.
    """
    before = before or []
    binned = in_bins(rows, by, F.col(value), bin_rows)
    last = [F.max_by(c, value).alias(f"__last_{c}") for c in before]
    bins = binned.groupBy("__group", "__bin").agg(*(F.sum(c).alias(f"__in_{c}") for c in sums), *last)
    whole = Window.partitionBy("__group")
    order = whole.orderBy("__bin")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    held = bins.select(
        "__group",
        "__bin",
        *(F.coalesce(F.sum(f"__in_{c}").over(earlier), F.lit(0)).alias(f"__offset_{c}") for c in sums),
        *(F.sum(f"__in_{c}").over(whole).alias(f"{c}_all") for c in sums),
        *(F.lag(f"__last_{c}").over(order).alias(f"__lag_{c}") for c in before),
    )
    inner = Window.partitionBy("__group", "__bin").orderBy(value)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = binned.select("*", *(F.sum(c).over(upto).alias(f"__upto_{c}") for c in sums), *(F.lag(c).over(inner).alias(f"__own_{c}") for c in before))
    return own.join(held, ["__group", "__bin"]).select(
        *rows.columns,
        *(x for c in sums for x in ((F.col(f"__offset_{c}") + F.col(f"__upto_{c}")).alias(f"{c}_upto"), F.col(f"{c}_all"))),
        *(F.coalesce(f"__own_{c}", f"__lag_{c}").alias(f"{c}_before") for c in before),
    )


def first_rows(rows: DataFrame, by: list[str], order: list[str], quotas: DataFrame, quota: str = "quota", bin_rows: int | None = None) -> DataFrame:
    """The first ``quota`` rows of each group by ``order``; groups without a quota, or with a null key, give none.

    Bins behind the one in which a quota ends are dropped before anything is ordered.
    """
    met = rows.join(quotas.select(*by, F.col(quota).alias("__quota")), by)
    binned = in_bins(met, by, F.struct(*order), bin_rows)
    bins = binned.groupBy("__group", "__bin").agg(F.count("*").alias("__in"), F.max("__quota").alias("__most"))
    earlier = Window.partitionBy("__group").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    wanted = bins.select("__group", "__bin", "__most", F.coalesce(F.sum("__in").over(earlier), F.lit(0)).alias("__offset")).where("__offset < __most").drop("__most")
    place = F.col("__offset") + F.row_number().over(Window.partitionBy("__group", "__bin").orderBy(*order))
    return binned.join(wanted, ["__group", "__bin"]).withColumn("__place", place).where("__place <= __quota").select(*rows.columns)


def exact_quantiles(rows: DataFrame, columns: list[str], quantiles: list[float], bin_rows: int | None = None) -> DataFrame:
    """(feature, q): each column's quantiles, linear between neighbours; nulls and NaN don't count, a column without values has no row.

    Values are summed up to distinct ones; a quantile is met where running counts pass its place.
    """
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), number(c).alias("x")) for c in columns))).alias("f")).select("f.*").where("x is not null")
    placed = running(long.groupBy("feature", "x").agg(F.count("*").alias("n")), ["feature"], "x", ["n"], bin_rows=bin_rows)
    at = [(F.col("n_all") - 1) * F.lit(float(q)) for q in quantiles]
    here = lambda place: F.max(F.when((F.col("n_upto") - F.col("n") <= place) & (place < F.col("n_upto")), F.col("x")))
    met = placed.groupBy("feature").agg(F.max("n_all").alias("n_all"), *(x for i, h in enumerate(at) for x in (here(F.floor(h)).alias(f"low{i}"), here(F.ceil(h)).alias(f"high{i}"))))
    between = []
    for i, h in enumerate(at):
        low, high = F.col(f"low{i}"), F.col(f"high{i}")
        between.append(F.when(low == high, low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high))
    return met.select("feature", F.array(*between).alias("q"))
