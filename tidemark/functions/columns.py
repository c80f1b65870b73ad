"""Column expressions: text, hashes, keyed draws, guards, winsorised scaling, wire bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Link rates in Mbit/s, by (client + seed) mod 10; one Mbit/s is one bit a microsecond.
UPLINK_RATES = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 10.0, 15.0, 20.0)
WIRE_OVERHEAD = 64


def normalized(name: str) -> str:
    """A column name with its white space trimmed and collapsed."""
    return " ".join(str(name).split())


def folded(name: str) -> str:
    """A name for lookups: normalised, lower-cased, dashes as underscores."""
    return normalized(name).lower().replace("-", "_")


def is_finite(x: Column) -> Column:
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite_or_null(x: Column) -> Column:
    return F.when(is_finite(x), x)


def binary_label(x: Column, benign: list[str]) -> Column:
    """0 for a benign token (trimmed, any case), else 1; a null label isn't benign."""
    return (~F.lower(F.trim(F.coalesce(x.cast("string"), F.lit("<NA>")))).isin([b.lower() for b in benign])).cast("int")


def folder_label(folder: Column, benign: list[str]) -> Column:
    """0 where a benign token is the folder's name or stands in it."""
    return F.when(reduce(lambda a, b: a | b, (F.contains(F.lower(folder), F.lit(t.lower())) for t in benign)), 0).otherwise(1)


def to_number(x: Column) -> Column:
    return x.try_cast("double")


def row_hash(columns: list[str]) -> Column:
    """32 hex digits of a row: every value as text with its length before it, nulls told from values, order fixed.

    The lengths keep rows apart whose values hold the separator.
    """
    return F.md5(F.concat_ws("|", *_parts(columns)))


def _parts(columns: list[str]) -> list[Column]:
    texts = [F.col(c).cast("string") for c in columns]
    return [F.coalesce(F.concat(F.lit("v"), F.char_length(x).cast("string"), F.lit(":"), x), F.lit("n")) for x in texts]


def row_hash_128(columns: list[str]) -> Column:
    """The same from two seeded 64-bit hashes: cheaper, for Spark alone."""
    parts = _parts(columns)
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(F.lit(1), *parts)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(2), *parts)), 16, "0")))


def keyed_draw(*keys) -> Column:
    """A uniform integer below 2^32 for the keys: the first eight digits of an md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(k if isinstance(k, Column) else F.lit(str(k)) for k in keys))), 1, 8), 16, 10).cast("long")


def stable_seed(*parts) -> Column:
    """The first four bytes of a SHA-256 over the parts as a compact JSON list."""
    text = F.concat(F.lit("["), F.concat_ws(",", *(F.concat(F.lit('"'), p.cast("string"), F.lit('"')) if isinstance(p, Column) else F.lit(f'"{p}"' if isinstance(p, str) else str(p)) for p in parts)), F.lit("]"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def winsorized_minmax(df: DataFrame, column: str, out: str, keys: list[str], lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """Clip to two quantiles of the group and scale to 0..1; 0 for all where the span is at most 1e-12.

    One NaN in a group makes the whole group NaN, as array arithmetic would; nulls count as NaN.
    """
    x = F.coalesce(F.col(column).cast("double"), F.lit(float("nan")))
    own = df.withColumn("__x", x)
    stats = own.groupBy(*keys).agg(
        F.percentile("__x", F.array(F.lit(lower), F.lit(upper))).alias("__q"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.max(F.isnan("__x").cast("int")).alias("__nan")
    )
    joined = own.join(stats, keys)
    q0, q1 = F.col("__q")[0], F.col("__q")[1]
    low, high = F.greatest("__lo", q0), F.least("__hi", q1)
    low, high = F.least(low, q1), F.greatest(high, q0)
    scaled = (F.least(F.greatest(F.col("__x"), q0), q1) - low) / (high - low)
    value = F.when(F.col("__nan") == 1, F.lit(float("nan"))).when(high - low <= 1e-12, F.lit(0.0)).otherwise(scaled)
    return joined.withColumn(out, value).drop("__x", "__q", "__lo", "__hi", "__nan")


def airtime_us(wire_bytes: Column, client: Column, seed: int = 0) -> Column:
    rates = F.array(*(F.lit(r) for r in UPLINK_RATES))
    return F.ceil(8.0 * wire_bytes / F.element_at(rates, (F.pmod(client + F.lit(seed), F.lit(10)) + 1).cast("int"))).cast("double")


def metadata_bytes(method: Column) -> Column:
    """Bytes of one client's metadata: none for Full-Contextual, 13 for Random-Budget, else 21."""
    return F.when(method == "Full-Contextual", 0).when(method == "Random-Budget", 13).otherwise(21)


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(array_dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with each norm floored at 1e-12."""
    return array_dot(a, b) / (F.greatest(l2_norm(a), F.lit(1e-12)) * F.greatest(l2_norm(b), F.lit(1e-12)))


def canonical_beta(beta: Column) -> Column:
    """A join key for a fraction: null stays null, else hundredths as an integer."""
    return F.round(beta * 100).cast("int")
