"""Interval overlap join of sales with click sessions, by nested containment lists.

A session is a run of one client's clicks without a gap of more than ``gap_us``; a
sale runs from its time of sale to the last shipping of its lines. Both are floored
to slots of ``slot_us`` and meet if they share a slot. What is returned are counts
and sums by relation, so no pair is ever a row.

What is bounded, and by what: clicks are first summed up by half-hour cells, and
intervals with equal slots of one client by their slots. A client then has at most
one cell a gap's length of the time that the data spans, at most three session
intervals a slot (closed sessions are disjoint, so one crosses each slot's edge),
and, in a shard of ``SHARD_SLOTS`` starting slots, sale intervals bounded likewise.
None of these follows the number of rows, so a client that holds a third of all
rows is no longer than any other. Sales meet their interval's sums by an equi-join
that adaptive execution splits where one interval has most of the rows.

Nested containment list: entries sorted by start, then by falling end; an entry goes
below the last entry before it that ends later. In each list starts and ends rise
together, so one binary search gives the entries that share a slot, and each relation
is a run of them, summed by prefix sums. Open sessions have no end: equal ends don't
nest, so they are one outermost list and contain the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.storage import Scratch

GAP_US = 30 * 60 * 1_000_000
SLOT_US = 6 * 60 * 60 * 1_000_000
#: Starting slots of one client's sales that one probing row holds (128 days of 6 hours).
SHARD_SLOTS = 512
#: The end slot of what is open; later than any timestamp's.
OPEN = 1 << 52
#: (query, list) pairs that are looked up at a time.
FRONTIER = 1 << 20
#: Sale intervals that are looked up at a time.
QUERIES = 1 << 17

#: Relations of the sale to the session, by its start (earlier, equal, later) and end (earlier, equal, later).
RELATIONS = ("overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by")


def micros(df: DataFrame, name: str) -> Column:
    """Whole microseconds since 1970: of the wall clock for a timestamp without a zone, of the instant for one with."""
    c = F.col(f"`{name}`")
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    seconds = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def _floored(name: str, width: int) -> Column:
    """Floor of a long column by a width, exactly (also below zero)."""
    return F.expr(f"({name} - pmod({name}, {width}L)) div {width}L")


def click_sessions(clicks: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """(client_id, first, last, open) of every session, in microseconds; clicks without client or time are left out.

    Clicks of one cell of a gap's length are never apart by more than the gap, so cells
    are summed up first, in the mappers, and only they are ordered by client.
    """
    rows = clicks.select("client_id", micros(clicks, "ts").alias("t"), F.coalesce(F.col("kind") == "error", F.lit(False)).alias("error")).where("client_id IS NOT NULL AND t IS NOT NULL")
    cells = rows.groupBy("client_id", _floored("t", gap_us).alias("cell")).agg(F.min("t").alias("first"), F.max(F.struct("t", "error")).alias("last"))
    ordered = Window.partitionBy("client_id").orderBy("cell")
    begins = F.coalesce(F.col("first") - F.lag("last.t").over(ordered) > gap_us, F.lit(True)).cast("long")
    numbered = cells.withColumn("begins", begins).withColumn("session", F.sum("begins").over(ordered))
    return numbered.groupBy("client_id", "session").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("client_id", "first", F.col("last.t").alias("last"), F.col("last.error").alias("open"))


def sale_intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """(sale_id, client_id, first, last, open); sales without client or time are left out, repeated rows are one.

    Rows of one ``sale_id`` that differ in client, time or being open are intervals of their own.
    """
    rows = sales.select("sale_id", "client_id", micros(sales, "sold_at").alias("first"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("open")).where("client_id IS NOT NULL AND first IS NOT NULL").distinct()
    shipped = lines.select("sale_id", micros(lines, "shipped_at").alias("t")).where("sale_id IS NOT NULL AND t IS NOT NULL").groupBy("sale_id").agg(F.max("t").alias("shipped"))
    return rows.join(shipped, "sale_id", "left").select("sale_id", "client_id", "first", F.greatest("first", "shipped").alias("last"), "open")


def slotted(intervals: DataFrame, slot_us: int = SLOT_US) -> DataFrame:
    """Start and end as slots ``s`` and ``e``, both inclusive; an open end is ``OPEN``."""
    return intervals.withColumns({"s": _floored("first", slot_us), "e": F.when(F.col("open"), F.lit(OPEN)).otherwise(_floored("last", slot_us))})


class Containment:
    """Nested containment lists of many owners: one set of arrays a level.

    Entries must be sorted by (owner, start, falling end). On a level, ``lists`` names
    the list of each entry: its owner on level 0, else the entry above it.
    """

    def __init__(self, owner: np.ndarray, s: np.ndarray, e: np.ndarray, n: np.ndarray, crc: np.ndarray, big: int):
        """Slots are from 0 to ``big - 2``; an open end is ``big - 1``."""
        self.big, self.levels = big, []
        segment, rest = owner, np.arange(len(owner))
        while len(rest):
            reach = segment * big + e[rest]
            top = reach == np.maximum.accumulate(reach)
            at = rest[top]
            self.levels.append(self._level(segment[top], s[at], e[at], n[at], crc[at]))
            segment = (np.cumsum(top) - 1)[~top]
            rest = rest[~top]

    def _level(self, lists, s, e, n, crc):
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (n, np.where(e == self.big - 1, 0, e) * n, s * n, crc)]
        return lists * self.big + s, lists * self.big + e, np.unique(lists), sums

    def probe(self, owner: np.ndarray, qs: np.ndarray, qe: np.ndarray) -> np.ndarray:
        """totals[relation, (pairs, overlap, crc), query]"""
        out = np.zeros((9, 3, len(owner)), dtype=np.int64)
        todo = [(0, np.arange(len(owner)), owner)]
        while todo:
            level, q, at = todo.pop()
            if level == len(self.levels) or not len(q):
                continue
            starts, ends, _, sums = self.levels[level]
            key, s, e = at * self.big, qs[q], qe[q]
            lo, hi = np.searchsorted(ends, key + s), np.searchsorted(starts, key + e, side="right")
            hi = np.maximum(hi, lo)
            by_start = [np.clip(x, lo, hi) for x in (np.searchsorted(starts, key + s), np.searchsorted(starts, key + s, side="right"))]
            by_end = [np.clip(x, lo, hi) for x in (np.searchsorted(ends, key + e), np.searchsorted(ends, key + e, side="right"))]
            # of the sessions: start later, equal, earlier; end later, equal, earlier
            start_runs = ((by_start[1], hi), (by_start[0], by_start[1]), (lo, by_start[0]))
            end_runs = ((by_end[1], hi), (by_end[0], by_end[1]), (lo, by_end[0]))
            for i, (a0, a1) in enumerate(start_runs):
                for j, (b0, b1) in enumerate(end_runs):
                    left = np.maximum(a0, b0)
                    right = np.maximum(np.minimum(a1, b1), left)
                    n, ending, starting, crc = (x[right] - x[left] for x in sums)
                    overlap = (ending if j == 2 else n * e) - (n * s if i == 2 else starting) + n
                    for k, x in enumerate((n, overlap, crc)):
                        np.add.at(out[3 * i + j, k], q, x)
            if level + 1 == len(self.levels):
                continue
            below = self.levels[level + 1][2]
            first, last = np.searchsorted(below, lo), np.searchsorted(below, hi)
            many = last - first
            total = np.cumsum(many)
            cut = 0
            while cut < len(q):
                to = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + FRONTIER, side="right")))
                each = many[cut:to]
                if each.any():
                    offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    todo.append((level + 1, np.repeat(q[cut:to], each), below[np.repeat(first[cut:to], each) + offset]))
                cut = to
        return out


RESULT = "client_id long, s long, e long, relation string, n_pairs long, overlap_slots long, sessions_crc long"


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = np.array(RELATIONS, dtype=object)
    for batch in batches:
        if not batch.num_rows:
            continue
        asked, there = batch.column("asked"), batch.column("there")
        row_q, row_t = (np.repeat(np.arange(batch.num_rows), x.value_lengths().to_numpy(zero_copy_only=False)) for x in (asked, there))
        qs, qe = (asked.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("s", "e"))
        s, e, n, crc = (there.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("s", "e", "n", "crc"))
        base = int(min(qs.min(), s.min()))
        closed = [x[x != OPEN] for x in (qs, qe, s, e)]
        big = int(max(x.max() for x in closed if len(x))) - base + 2
        shift = lambda x: np.where(x == OPEN, big - 1, x - base)
        qs0, qe0, s0, e0 = (shift(x) for x in (qs, qe, s, e))
        order = np.lexsort((-e0, s0, row_t))
        lists = Containment(row_t[order], s0[order], e0[order], n[order], crc[order], big)
        clients = batch.column("client_id").to_numpy(zero_copy_only=False)
        for cut in range(0, len(row_q), QUERIES):
            part = slice(cut, cut + QUERIES)
            totals = lists.probe(row_q[part], qs0[part], qe0[part])
            relation, query = np.nonzero(totals[:, 0])
            pairs, overlap, sums = (totals[relation, k, query] for k in range(3))
            query += cut
            both_open = (relation % 3 == 1) & (qe[query] == OPEN)
            yield pa.RecordBatch.from_arrays(
                [pa.array(clients[row_q[query]]), pa.array(qs[query]), pa.array(qe[query]), pa.array(names[relation], type=pa.string()), pa.array(pairs), pa.array(overlap, mask=both_open), pa.array(sums)],
                ["client_id", "s", "e", "relation", "n_pairs", "overlap_slots", "sessions_crc"],
            )


def interval_relations(intervals: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sums by relation for every distinct (client_id, s, e) of ``intervals`` against the sessions (client_id, s, e, first).

    A null client meets nothing.
    """
    entries = sessions.where("client_id IS NOT NULL").select(F.col("client_id").cast("long").alias("client_id"), "s", "e", F.crc32(F.col("first").cast("string")).alias("crc"))
    entries = entries.groupBy("client_id", "s", "e").agg(F.count("*").alias("n"), F.sum("crc").alias("crc"))
    index = entries.groupBy("client_id").agg(F.collect_list(F.struct("s", "e", "n", "crc")).alias("there"))
    asked = intervals.where("client_id IS NOT NULL").select(F.col("client_id").cast("long").alias("client_id"), "s", "e").distinct()
    shards = asked.groupBy("client_id", F.floor(F.col("s") / SHARD_SLOTS).alias("shard")).agg(F.collect_list(F.struct("s", "e")).alias("asked"))
    return shards.join(index, "client_id").select("client_id", "asked", "there").mapInArrow(_probe, RESULT)


def sales_by_sessions(sales: DataFrame, lines: DataFrame, clicks: DataFrame) -> DataFrame:
    """(sale_id, relation, n_pairs, overlap_slots, sessions_crc) for all sales that share a slot with a session of their client.

    ``relation`` is the sale's to the session. ``overlap_slots`` is the sum of shared
    slots, null where both ends are open; ``sessions_crc`` the sum of CRC-32 of the
    sessions' first times (microseconds, decimal text). Rows without client or time take
    no part, nor do a sale's lines without a shipping time; a null status or kind isn't
    open. Empty tables give no rows; other columns of the tables are not looked at.
    """
    scratch = Scratch(sales.sparkSession)
    own = scratch.put(slotted(sale_intervals(sales, lines)).select("sale_id", F.col("client_id").cast("long").alias("client_id"), "s", "e"))
    found = interval_relations(own, slotted(click_sessions(clicks)))
    return own.join(found, ["client_id", "s", "e"]).select("sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc")
