"""Cohorts, quotas, splits and client partitions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.columns import keyed_draw
from tidemark.operators.ranks import first_rows, running


def largest_remainder(strata: DataFrame, total: int, weight: str, available: str, keys: list[str], group: list[str] | None = None) -> DataFrame:
    """``quota`` per stratum: shares of ``total`` by weight, rounded by largest remainder, never above what is there.

    What caps leave over goes to strata with room, in order of the keys. Strata are few (one row each).
    """
    by = Window.partitionBy(*(group or [F.lit(0)]))
    share = F.col(weight) * total / F.sum(weight).over(by)
    base = strata.withColumn("__base", F.floor(share).cast("long")).withColumn("__left", share - F.floor(share))
    base = base.withColumn("__short", F.lit(total) - F.sum("__base").over(by))
    order = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc("__left"), *keys)
    base = base.withColumn("__q", F.col("__base") + (F.row_number().over(order) <= F.col("__short")).cast("int"))
    base = base.withColumn("__capped", F.least("__q", available)).withColumn("__room", F.col(available) - F.col("__capped"))
    spare = F.sum(F.col("__q") - F.col("__capped")).over(by)
    filled = F.coalesce(F.sum("__room").over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("__room"), spare - filled))
    return base.withColumn("quota", (F.col("__capped") + extra).cast("long")).drop("__base", "__left", "__short", "__q", "__capped", "__room")


def stratified_top(rows: DataFrame, strata: list[str], quotas: DataFrame, order: list[str]) -> DataFrame:
    """The first ``quota`` rows of each stratum by ``order``; strata without a quota give none."""
    return first_rows(rows, strata, order, quotas)


def bottom_k(rows: DataFrame, hash_col: str, k: int) -> DataFrame:
    """A reservoir: the k rows with the least first 16 hex digits (a top-k, not a sort)."""
    return rows.orderBy(F.substring(hash_col, 1, 16), hash_col).limit(k)


def head_sample(rows: DataFrame, group: str, order: list[str], per_group: int, total: int) -> DataFrame:
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__rn") <= per_group)
    return ranked.orderBy(group, "__rn").limit(total).drop("__rn")


def split_objective(groups: DataFrame, assignment: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """One row: the squared relative distance of each split's benign, attack and total rows from their targets.

    1000 is added once for a split that lacks either class, and again for one without groups.
    """
    totals = groups.agg(F.sum("benign").alias("tb"), F.sum("attack").alias("ta"))
    got = groups.join(assignment, "group_id").groupBy("split").agg(F.sum("benign").alias("b"), F.sum("attack").alias("a"), F.count("*").alias("g"))
    splits = groups.sparkSession.createDataFrame(list(ratios.items()), "split string, ratio double")
    scored = splits.join(got, "split", "left").na.fill(0, ["b", "a", "g"]).crossJoin(F.broadcast(totals))
    term = lambda x, t: F.pow((x - t) / F.greatest(F.lit(1.0), t), 2)
    tb, ta = F.col("ratio") * F.col("tb"), F.col("ratio") * F.col("ta")
    penalty = F.when((F.col("b") == 0) | (F.col("a") == 0), 1000).otherwise(0) + F.when(F.col("g") == 0, 1000).otherwise(0)
    return scored.agg(F.sum(term(F.col("b"), tb) + term(F.col("a"), ta) + term(F.col("b") + F.col("a"), tb + ta) + penalty).alias("objective"))


def exhaustive_split(groups: DataFrame, ratios: tuple[float, float, float], least_benign: int = 1, least_attack: int = 1) -> DataFrame:
    """The best of all 3^G assignments of groups to train, validation and test; more than 12 groups are an error.

    Assignments are numbered in base 3 and scored as rows; the least objective wins, ties to the smaller number.
    """
    items = groups.agg(F.array_sort(F.collect_list(F.struct("group_id", "benign", "attack"))).alias("g")).withColumn("n", F.expr("if(size(g) > 12, raise_error('exhaustive search is for at most 12 groups'), size(g))"))
    each = items.select("g", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(3.0), F.col("n")).cast("long") - 1)).alias("code"))
    placed = each.select("code", F.posexplode("g").alias("i", "x")).select("code", "x.*", (F.floor(F.col("code") / F.pow(F.lit(3.0), F.col("i"))).cast("long") % 3).cast("int").alias("split"))
    sums = placed.groupBy("code").agg(*(F.sum(F.when(F.col("split") == s, F.col(c)).otherwise(0)).alias(f"{c}{s}") for s in range(3) for c in ("benign", "attack")))
    tb, ta = sum(F.col(f"benign{s}") for s in range(3)), sum(F.col(f"attack{s}") for s in range(3))
    term = lambda x, t: F.pow((x - t) / F.greatest(F.lit(1.0), t), 2)
    score = sum((term(F.col(f"benign{s}"), r * tb) + term(F.col(f"attack{s}"), r * ta) + term(F.col(f"benign{s}") + F.col(f"attack{s}"), r * (tb + ta)) for s, r in enumerate(ratios)), F.lit(0.0))
    ok = [(F.col(f"benign{s}") >= least_benign) & (F.col(f"attack{s}") >= least_attack) for s in range(3)]
    best = sums.where(ok[0] & ok[1] & ok[2]).withColumn("objective", F.round(score, 9)).orderBy("objective", "code").limit(1)
    return placed.join(F.broadcast(best.select("code", "objective")), "code").select("group_id", "split", "objective")


def greedy_split(stats: list[tuple[str, int, int]], ratios: dict[str, float], starts: int = 2000, seed: int = 0) -> dict[str, str]:
    """Group-disjoint splits for tens of groups: greedy from the largest group down, groups of one size in random order.

    At least ``starts`` (and 200 a group) orders are tried and the least objective wins; equally good splits go by
    the order of ``ratios``. Driver-side.
    """
    import random

    draw = random.Random(seed)
    tb, ta = sum(s[1] for s in stats), sum(s[2] for s in stats)
    targets = {k: (r * tb, r * ta) for k, r in ratios.items()}

    def cost(have: dict[str, list[float]]) -> float:
        total = 0.0
        for k, (b, a) in targets.items():
            x, y, g = have[k]
            for got, want in ((x, b), (y, a), (x + y, a + b)):
                total += ((got - want) / max(1.0, want)) ** 2
            total += 1000.0 * ((x == 0 or y == 0) + (g == 0))
        return total

    best, best_cost = {}, float("inf")
    for _ in range(max(starts, 200 * len(stats))):
        order = sorted(sorted(stats), key=lambda s: (-(s[1] + s[2]), draw.random()))
        have = {k: [0.0, 0.0, 0] for k in targets}
        chosen = {}
        for name, b, a in order:
            options = []
            for place, k in enumerate(targets):
                have[k][0] += b
                have[k][1] += a
                have[k][2] += 1
                options.append((cost(have), place, k))
                have[k][0] -= b
                have[k][1] -= a
                have[k][2] -= 1
            k = min(options)[2]
            chosen[name] = k
            have[k] = [have[k][0] + b, have[k][1] + a, have[k][2] + 1]
        if (c := cost(have)) < best_cost:
            best, best_cost = chosen, c
    return best


def least_loaded(groups: DataFrame, clients: int, size: str = "n", key: str = "group_id") -> DataFrame:
    """Source-preserving packing: largest group first onto the least loaded client, lowest id on ties.

    Groups are sources (tens to hundreds): one fold over a sorted array that carries the loads.
    """
    queue = groups.agg(F.array_sort(F.collect_list(F.struct((-F.col(size)).alias("r"), F.col(key).alias("id")))).alias("q"))
    start = f"named_struct('load', transform(sequence(1, {clients}), i -> 0L), 'out', cast(array() as array<struct<id: string, client_id: int>>))"
    step = (
        "(acc, x) -> named_struct("
        "'load', transform(acc.load, (l, i) -> if(i = array_position(acc.load, array_min(acc.load)) - 1, l - x.r, l)), "
        "'out', array_append(acc.out, named_struct('id', cast(x.id as string), 'client_id', cast(array_position(acc.load, array_min(acc.load)) - 1 as int))))"
    )
    folded = queue.select(F.expr(f"aggregate(q, {start}, {step})").alias("f"))
    return folded.select(F.explode("f.out").alias("x")).select(F.col("x.id").alias(key), "x.client_id")


def fit_utility_split(rows: DataFrame, client: str, row_key: str, seed: int = 0, most: int = 4096) -> DataFrame:
    """``part``: 'utility' for min(ceil(n/10), most) rows of each client (at least 1, at most n - 1), else 'fit'."""
    draw = keyed_draw("fit", F.lit(seed).cast("string"), F.col(row_key).cast("string"))
    ranked = running(rows.withColumns({"__order": F.struct(draw.alias("draw"), F.col(row_key).alias("key")), "__one": F.lit(1)}), [client], "__order", ["__one"])
    n = F.col("__one_all")
    take = F.least(F.greatest(F.least(F.ceil(n / 10), F.lit(most)), F.lit(1)), n - 1)
    return ranked.select(*rows.columns, F.when(F.col("__one_upto") <= take, "utility").otherwise("fit").alias("part"))


def malicious_clients(clients: DataFrame, seed: int, share: float = 0.3, key: str = "client_id") -> DataFrame:
    """The share of clients with the least keyed draws, as a flag (clients are few)."""
    n = clients.count()
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(keyed_draw("malicious", F.lit(seed).cast("string"), F.col(key).cast("string")), key))
    return clients.withColumn("malicious_flag", (rank <= int(share * n)).cast("int"))


def group_folds(groups: DataFrame, key: str, folds: int, seed: int) -> DataFrame:
    """Disjoint folds of groups by the rank of a keyed draw."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(keyed_draw("fold", F.lit(seed).cast("string"), F.col(key).cast("string")), key))
    return groups.select(key).distinct().withColumn("fold", ((rank - 1) % folds).cast("int"))


def factorial(spark, **levels: list) -> DataFrame:
    """All combinations of the levels, one column each (small by construction)."""
    names = list(levels)
    return spark.createDataFrame([tuple(x) for x in product(*levels.values())], names)
