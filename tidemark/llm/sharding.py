"""Shards of nearly equal bytes by best-fit-decreasing bin packing of groups.

Rows with equal texts form an indivisible group. Groups are packed by size,
largest first, each into the bin with the least remaining room that still holds
it, found in a balanced tree. Only a histogram (group size, how many groups) goes
to the driver: groups of one size are interchangeable, so a run of them is placed
bin by bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.storage import Scratch

#: Distinct sizes whose places may be broadcast (some 100 bytes each).
BROADCAST_SIZES = 100_000
#: Groups of one size, and rows of one shard, that one task may rank.
RANKED = 100_000


class BalancedTree:
    """Ordered set of (room, bin) in leaves of bounded width: a two-level B-tree."""

    WIDTH = 512

    def __init__(self, items=()):
        items = sorted(items)
        self.leaves = [items[i : i + self.WIDTH // 2] for i in range(0, len(items), self.WIDTH // 2)] or [[]]
        self.heads = [x[0] for x in self.leaves if x]

    def _leaf(self, item) -> int:
        return max(0, bisect_left(self.heads, item) - (bisect_left(self.heads, item) == len(self.heads) or self.heads[bisect_left(self.heads, item)] != item))

    def add(self, item) -> None:
        if not self.heads:
            self.leaves, self.heads = [[item]], [item]
            return
        i = self._leaf(item)
        insort(self.leaves[i], item)
        self.heads[i] = self.leaves[i][0]
        if len(self.leaves[i]) > self.WIDTH:
            half = self.leaves[i][self.WIDTH // 2 :]
            del self.leaves[i][self.WIDTH // 2 :]
            self.leaves.insert(i + 1, half)
            self.heads.insert(i + 1, half[0])

    def remove(self, item) -> None:
        i = self._leaf(item)
        leaf = self.leaves[i]
        del leaf[bisect_left(leaf, item)]
        if leaf:
            self.heads[i] = leaf[0]
        else:
            del self.leaves[i], self.heads[i]

    def ceiling(self, item):
        """The least element not below ``item``, or None."""
        if not self.heads:
            return None
        i = self._leaf(item)
        at = bisect_left(self.leaves[i], item)
        if at < len(self.leaves[i]):
            return self.leaves[i][at]
        return self.leaves[i + 1][0] if i + 1 < len(self.leaves) else None


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, most: int | None = None):
    """Place ``count`` groups of each ``size``; the tightest bin that holds a group takes it.

    Returns (bins used, runs), a run being (size, first group, bin, groups): the
    groups of a size are numbered from 0. None once more than ``most`` bins are needed.
    """
    tree, used, runs = BalancedTree(), 0, []
    for size, count in sorted(histogram, reverse=True):
        placed = 0
        while placed < count:
            found = tree.ceiling((size, -1))
            if found is None:
                if most is not None and used >= most or size > capacity:
                    return None
                found, used = (capacity, used), used + 1
            else:
                tree.remove(found)
            room, where = found
            n = min(count - placed, room // size) if size else count - placed
            runs.append((size, placed, where, n))
            placed += n
            tree.add((room - n * size, where))
    return used, runs


def near_equal_shards(histogram: list[tuple[int, int]], shards: int):
    """Runs that put all groups into at most ``shards`` bins of the least capacity found.

    A group larger than an even share of the rest has a shard to itself, so that
    it doesn't leave others empty; the rest is packed at the smallest capacity
    (bisected to a byte) at which best-fit-decreasing needs no more bins than left.
    """
    rest, alone, left = sorted(histogram, reverse=True), [], shards
    total = sum(s * n for s, n in rest)
    while rest and left > 1 and rest[0][0] * left > total:
        size, count = rest[0]
        alone.append((size, sum(1 for a in alone if a[0] == size), shards - left, 1))
        rest = ([(size, count - 1)] if count > 1 else []) + rest[1:]
        total, left = total - size, left - 1
    low, high = max(-(-total // left), rest[0][0] if rest else 1, 1), max(2 * (-(-total // left)) + (rest[0][0] if rest else 0), 1)
    while low < high:
        middle = (low + high) // 2
        if best_fit_decreasing(rest, middle, left) is None:
            low = middle + 1
        else:
            high = middle
    _, runs = best_fit_decreasing(rest, low, left) if rest else (0, [])
    shift = {s: sum(1 for a in alone if a[0] == s) for s, _ in rest}
    return alone + [(size, first + shift[size], where + shards - left, n) for size, first, where, n in runs]


def shard_by_bytes(documents: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Every row with its shard and its place there: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size: UTF-8 bytes of the text (null: none) plus ``overhead``; null texts have a
    null checksum and form one group, empty texts another. Repeated rows are rows
    of one group. Slots run from 0 without gaps, in no stated order. An empty table gives no rows. Columns other than the two named are
    ignored, so their names cannot clash.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text")).select(
        "doc_id",
        (F.coalesce(F.octet_length("__text"), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32("__text").alias("text_crc32"),
        F.coalesce(F.md5("__text"), F.lit("-")).alias("__key"),
    )
    groups = rows.groupBy("__key").agg(F.sum("size").alias("__class"), F.count("*").alias("__rows"))
    # One row a distinct size, never more than the square root of twice the table's bytes.
    histogram = groups.groupBy("__class").agg(F.count("*").alias("n"), F.sum("__rows").alias("rows")).collect()
    runs = near_equal_shards([(r["__class"], r["n"]) for r in histogram], shards)
    small = F.broadcast if len(histogram) <= BROADCAST_SIZES else lambda df: df

    spark = documents.sparkSession
    # Groups of a size are numbered inside salts of a bounded number of groups; the offsets come from counts.
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / RANKED)).cast("long")
    classes = spark.createDataFrame([(r["__class"], r["n"]) for r in histogram], "__class long, n long").select("__class", salts.alias("__salts"))
    placed = groups.join(small(classes), "__class").withColumn("__salt", F.pmod(F.xxhash64("__key"), F.col("__salts")))
    counts = placed.groupBy("__class", "__salt").agg(F.count("*").alias("n"))
    offsets = counts.select("__class", "__salt", (F.sum("n").over(Window.partitionBy("__class").orderBy("__salt")) - F.col("n")).alias("__before"))
    ranked = placed.withColumn("__rank", F.row_number().over(Window.partitionBy("__class", "__salt").orderBy("__key")) - 1)
    ranked = ranked.join(offsets, ["__class", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    # The run of a group: runs of a class are few and sorted, so an array of their firsts is searched.
    by_class: dict[int, list[tuple[int, int]]] = {}
    for size, first, where, _ in runs:
        by_class.setdefault(size, []).append((first, where))
    plan = spark.createDataFrame([(k, sorted(v)) for k, v in by_class.items()], "__class long, __runs array<struct<first: long, shard: int>>")
    shard = F.element_at(F.filter("__runs", lambda x: x["first"] <= F.col("__rank")), -1)["shard"]
    assigned = ranked.join(small(plan), "__class").select("__key", shard.alias("shard"))

    out = rows.withColumn("__number", F.monotonically_increasing_id()).join(assigned, "__key").drop("__key")
    # Slots: rows of a shard are numbered inside parts of bounded size, after the parts before them. Rows go to parts
    # by a number of their own, so that equal rows part too; they are written with it, for it is read twice.
    parts = max(1, -(-sum(r["rows"] for r in histogram) // RANKED))
    out = out.withColumn("__part", F.pmod(F.xxhash64("__number"), F.lit(parts)))
    out = Scratch(spark).put(out)
    sizes = out.groupBy("shard", "__part").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "__part", (F.sum("n").over(Window.partitionBy("shard").orderBy("__part")) - F.col("n")).alias("__before"))
    out = out.withColumn("__row", F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__number")))
    return out.join(F.broadcast(before) if parts * shards < 100_000 else before, ["shard", "__part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("__row") - 1 + F.col("__before")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
