"""Client partitions by rows: exact distributed ranks, Dirichlet quotas, repair to a least size.

A row's rank among its class is exact and made without a window over the class: a keyed
draw is uniform, so its leading part cuts a class into bins of some ``BIN_ROWS`` rows;
bins are counted, their counts summed up, and only rows of one bin are ordered in a
task. Quotas and moves are intervals of ranks: a few numbers a class and client, which
the driver may hold; no row goes there.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import keyed_draw

#: Rows of a class that are ordered together, about.
BIN_ROWS = 50_000
#: Tries of one gamma draw; each is accepted with a probability of over 0.95.
TRIES = 20


def keyed_unit(*keys) -> float:
    """The keyed draw of ``functions.columns`` as a number in (0, 1]."""
    return (int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:8], 16) + 1) / (1 << 32)


def keyed_gamma(alpha: float, *keys) -> float:
    """A gamma variate of shape ``alpha`` from keyed draws (squeeze method on a cubed normal, boosted below shape 1)."""
    shape = alpha + 1 if alpha < 1 else alpha
    d = shape - 1 / 3
    c = 1 / math.sqrt(9 * d)
    for i in range(TRIES):
        u1, u2, u3 = (keyed_unit(*keys, i, k) for k in ("a", "b", "c"))
        x = math.sqrt(-2 * math.log(u1)) * math.cos(2 * math.pi * u2)
        v = (1 + c * x) ** 3
        if v > 0 and math.log(u3) < 0.5 * x * x + d - d * v + d * math.log(v):
            return d * v * (keyed_unit(*keys, "boost") ** (1 / alpha) if alpha < 1 else 1)
    return d


def dirichlet_shares(alpha: float, clients: int, *keys) -> list[float]:
    """Proportions of the clients that sum to 1."""
    drawn = [keyed_gamma(alpha, *keys, k) for k in range(clients)]
    total = sum(drawn)
    return [x / total for x in drawn] if total > 0 else [1 / clients] * clients


def largest_remainder(shares: list[float], n: int) -> list[int]:
    """Whole counts that sum to ``n``: rounded down, then one more for the largest remainders, lowest client first on ties."""
    raw = [x * n for x in shares]
    counts = [math.floor(x) for x in raw]
    for k in sorted(range(len(raw)), key=lambda k: (counts[k] - raw[k], k))[: n - sum(counts)]:
        counts[k] += 1
    return counts


def repair_moves(counts: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """(donor, receiver, from, to): which of a donor's rows, in its own order, go to a client that has too few.

    The smallest client gets what it lacks from the largest, until none has fewer than
    ``least``. A client that received has exactly ``least`` and never gives, so a
    donor's rows go one after the other. It is an error if a donor would fall below.
    """
    counts, given, moves = list(counts), [0] * len(counts), []
    while counts and min(counts) < least:
        receiver, donor = counts.index(min(counts)), counts.index(max(counts))
        need = least - counts[receiver]
        if counts[donor] - need < least:
            raise ValueError(f"clients cannot all have {least} rows")
        moves.append((donor, receiver, given[donor], given[donor] + need))
        given[donor] += need
        counts[receiver], counts[donor] = least, counts[donor] - need
    return moves


def rank_within(rows: DataFrame, by: str, row_key: str, draw: Column, out: str = "rank", bin_rows: int = BIN_ROWS) -> DataFrame:
    """``out``: the place from 0 of each row among those of equal ``by``, by (draw, row_key), ``draw`` being a whole number below 2^32.

    Nulls of ``by`` are a class. The classes must be few: one row each is broadcast.
    """
    sizes = rows.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n"))
    bins = F.broadcast(sizes.select("__by", F.ceil(F.col("__n") / bin_rows).cast("long").alias("__bins")))
    binned = rows.withColumn("__draw", draw).join(bins, F.col(by).eqNullSafe(F.col("__by"))).withColumn("__bin", F.shiftright(F.col("__draw") * F.col("__bins"), 32))
    # one row a bin: a class of a billion rows has some twenty thousand
    filled = binned.groupBy("__by", "__bin").agg(F.count("*").alias("__in"))
    before = Window.partitionBy("__by").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.select(F.col("__by").alias("__by2"), F.col("__bin").alias("__bin2"), F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__offset"))
    inner = F.row_number().over(Window.partitionBy("__by", "__bin").orderBy("__draw", row_key)) - 1
    placed = binned.withColumn("__inner", inner).join(offsets, F.col("__by").eqNullSafe(F.col("__by2")) & (F.col("__bin") == F.col("__bin2")))
    return placed.withColumn(out, F.col("__offset") + F.col("__inner")).drop("__by", "__bins", "__draw", "__bin", "__inner", "__by2", "__bin2", "__offset")


def _by_interval(ranked: DataFrame, label: str, rank: str, intervals: dict) -> DataFrame:
    """``client_id`` of each row: whose interval of its class holds its rank. intervals: class -> [(from, client)], from 0 on."""
    spark = ranked.sparkSession
    kind = ranked.schema[label].dataType.simpleString()
    table = spark.createDataFrame([(y, [a for a, _ in own], [c for _, c in own]) for y, own in intervals.items()], f"__y {kind}, __from array<long>, __client array<int>")
    joined = ranked.join(F.broadcast(table), F.col(label).eqNullSafe(F.col("__y")))
    place = F.size(F.filter("__from", lambda a: a <= F.col(rank)))
    return joined.withColumn("client_id", F.element_at("__client", place)).drop("__y", "__from", "__client")


def quota_partition(rows: DataFrame, label: str, row_key: str, clients: int, alpha: float, seed: int, least: int = 200) -> DataFrame:
    """``client_id`` for every row: Dirichlet quotas per class by largest remainder, repaired until every client has ``least`` rows.

    A class's rows are dealt in the order of a keyed draw. A donor gives the first of
    its rows by class (nulls first) and rank. It is an error if not all clients can
    have ``least`` rows; an empty table has no clients and stays empty.
    """
    sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    order = sorted(sizes, key=lambda y: (y is not None, y))
    held: list[list[tuple]] = [[] for _ in range(clients)]  # of each client: (class, from, to), in its order
    for y in order:
        at = 0
        for k, n in enumerate(largest_remainder(dirichlet_shares(alpha, clients, "dirichlet", seed, y), sizes[y])):
            if n:
                held[k].append((y, at, at + n))
            at += n
    moves = repair_moves([sum(b - a for _, a, b in own) for own in held], least) if sizes else []
    owner = {(y, a): k for k, own in enumerate(held) for y, a, _ in own}
    for donor, receiver, start, stop in moves:
        at = 0
        for y, a, b in held[donor]:
            lo, hi = max(start, at), min(stop, at + b - a)
            if lo < hi:
                left, right = a + lo - at, a + hi - at
                owner[y, left] = receiver
                if right < b:
                    owner[y, right] = donor
            at += b - a
    intervals = {y: sorted((a, k) for (c, a), k in owner.items() if c == y) for y in order}
    ranked = rank_within(rows, label, row_key, keyed_draw("deal", F.lit(str(seed)), F.col(row_key).cast("string")), "__rank")
    return _by_interval(ranked, label, "__rank", intervals).drop("__rank")


def multinomial_partition(rows: DataFrame, label: str, row_key: str, clients: int, alpha: float, seed: int, least: int = 1, attempts: int = 1000, at_once: int = 8) -> DataFrame:
    """``client_id`` for every row: each row draws its client by its class's Dirichlet proportions, so counts are multinomial.

    Proportions are drawn anew until every client has ``least`` rows; it is an error if
    ``attempts`` draws don't give that. What is counted are the rows that clients would
    have, for ``at_once`` draws in one reading.
    """
    classes = [r[0] for r in rows.select(label).distinct().collect()]
    if not classes:
        return rows.withColumn("client_id", F.lit(None).cast("int"))
    kind = rows.schema[label].dataType.simpleString()
    drawn = rows.withColumn("__u", keyed_draw("client", F.lit(str(seed)), F.col(row_key).cast("string")) / float(1 << 32))
    client = lambda bounds: F.least(F.size(F.filter(bounds, lambda b: b <= F.col("__u"))), F.lit(clients - 1)).cast("int")
    for start in range(0, attempts, at_once):
        tries = range(start, min(start + at_once, attempts))
        bounds = [(y, [_cumulative(dirichlet_shares(alpha, clients, "dirichlet", seed, t, y)) for t in tries]) for y in classes]
        table = rows.sparkSession.createDataFrame(bounds, f"__y {kind}, __bounds array<array<double>>")
        met = drawn.join(F.broadcast(table), F.col(label).eqNullSafe(F.col("__y")))
        counted = met.select(F.posexplode(F.transform("__bounds", client)).alias("t", "client")).groupBy("t", "client").count()
        good = counted.where(F.col("count") >= least).groupBy("t").count().where(F.col("count") == clients).agg(F.min("t")).first()[0]
        if good is not None or least <= 0:
            return met.withColumn("client_id", client(F.col("__bounds")[good or 0])).drop("__u", "__y", "__bounds")
    raise ValueError(f"{attempts} draws gave no partition with {least} rows for every client")


def _cumulative(shares: list[float]) -> list[float]:
    out, total = [], 0.0
    for x in shares:
        total += x
        out.append(min(total, 1.0))
    return out
