"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers and stored by slices: for each component and
bit, a bitmap over the rows of a block. A query's score is a weighted sum of the
components: each bit of a weight adds the component's slices, shifted, and all
these bitmaps are summed column by column with carry-save adders (ANDs and XORs of
whole bitmaps), which gives the score's own slices. The top rows are selected from
the most significant slice downward; at the last slice, rows that tie on the
boundary are resolved by the smaller id. Negative values are offset per component
and negative weights use the complement, both of which shift all scores alike.

Blocks hold a bounded number of rows; queries are broadcast in blocks of bounded
size; each block returns at most k rows a query, and those meet in one aggregate.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.storage import Scratch

#: Rows of one bitmap block, and queries of one broadcast.
BLOCK_ROWS = 1 << 16
QUERY_BYTES = 16 << 20


class BitSlicedBlock:
    """Slices of one block of integer vectors, sorted by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.n = len(ids)
        self.low = self.vectors.min(axis=0) if self.n else np.zeros(vectors.shape[1], dtype=np.int64)
        self.high = self.vectors.max(axis=0) if self.n else self.low
        # Differences modulo 2^64 are exact, for none is as large.
        plain, low, high = (x.astype(np.int64).view(np.uint64) for x in (self.vectors, self.low, self.high))
        with np.errstate(over="ignore"):
            self.slices = [self._slices(plain[:, d] - low[d], int(self.high[d]) - int(self.low[d])) for d in range(vectors.shape[1])]
            self.flipped = [self._slices(high[d] - plain[:, d], int(self.high[d]) - int(self.low[d])) for d in range(vectors.shape[1])]
        self.all = self._pack(np.ones(self.n, dtype=bool))

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits, bitorder="little")
        return np.concatenate([packed, np.zeros(-len(packed) % 8, dtype=np.uint8)]).view(np.uint64)

    def _slices(self, values: np.ndarray, most: int) -> list[np.ndarray]:
        return [self._pack((values >> np.uint64(b)) & np.uint64(1) == 1) for b in range(most.bit_length())]

    def score_slices(self, weights: list[int]) -> list[np.ndarray]:
        """Slices of the (shifted) scores, least significant first."""
        columns: list[list[np.ndarray]] = []
        for d, w in enumerate(weights):
            source = self.slices[d] if w > 0 else self.flipped[d]
            w, shift = abs(w), 0
            while w:
                if w & 1:
                    while len(columns) < shift + len(source):
                        columns.append([])
                    for b, bitmap in enumerate(source):
                        columns[shift + b].append(bitmap)
                w, shift = w >> 1, shift + 1
        out = []
        i = 0
        while i < len(columns):
            column = columns[i]
            if i + 1 == len(columns) and len(column) > 1:
                columns.append([])
            while len(column) > 2:  # full adder: three bitmaps of one weight become two
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.insert(0, half ^ c)
                columns[i + 1].append((a & b) | (half & c))
            if len(column) == 2:
                a, b = column
                columns[i + 1].append(a & b)
                column[:] = [a ^ b]
            out.append(column[0] if column else np.zeros_like(self.all))
            i += 1
        return out

    def top(self, weights: list[int], k: int, skip: int | None) -> np.ndarray:
        """Rows of the k greatest scores, ties to smaller ids; ``skip`` is a row that doesn't count."""
        candidates = self.all.copy()
        if skip is not None:
            candidates[skip >> 6] &= ~(np.uint64(1) << np.uint64(skip & 63))
        sure = np.zeros_like(candidates)
        for bitmap in reversed(self.score_slices(weights)):
            with_bit = candidates & bitmap
            n = int(np.bitwise_count(with_bit).sum()) + int(np.bitwise_count(sure).sum())
            if n > k:
                candidates = with_bit
            else:
                sure = sure | with_bit
                candidates = candidates & ~bitmap
                if n == k:
                    candidates = np.zeros_like(candidates)
                    break
        rows = self._rows(sure)
        return np.concatenate([rows, self._rows(candidates)[: k - len(rows)]])

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(words) else np.zeros((0, 64), dtype=np.uint8)
        w, b = np.nonzero(bits)
        return words[w] * 64 + b


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): each component x as floor(scale * x); rows that can't take part are left out."""
    x = F.col(vector_col)
    return vectors.select(F.col(id_col).alias("vec_id"), x.cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ).select("vec_id", F.transform("v", lambda c: F.floor(c * float(scale))).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``width``."""
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = np.asarray(column.flatten()).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    for i, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
        out[i, :n] = flat[a : a + n]
    return out


def top_k(vectors: DataFrame, queries_where, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each query's k best rows by integer inner product: query_id, rank, vec_id, score.

    ``queries_where``: a condition on ``vec_id`` that makes a row a query. All other
    rows are its candidates; rows of the query's own id are not. Null ids, and
    vectors that are null or hold null or non-finite components, take no part.
    Vectors of several lengths are padded with zeros. Ties go to the smaller id,
    and repeated rows count each for itself as candidates but once as a query
    (the row with the greatest vector). Sums have as many slices as they need, so
    ranks are exact whatever the size; a score that no long holds is shown as the
    nearest long.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = quantised(vectors, id_col, vector_col, scale)
    asked = rows.where(queries_where).groupBy("vec_id").agg(F.max("v").alias("v"))
    count, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    overall = rows.agg(F.max(F.size("v"))).first()
    schema = "query_id long, vec_id long, score long"
    found = spark.createDataFrame([], schema)
    if count:
        width = max(int(overall[0]), 1)
        passes = -(-count * (width + 1) * 8 // QUERY_BYTES)
        for n in range(passes):
            part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == n)
            held = spark.sparkContext.broadcast([(r["vec_id"], list(r["v"]) + [0] * (width - len(r["v"]))) for r in part.toLocalIterator()])

            def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                ids: list[np.ndarray] = []
                parts: list[np.ndarray] = []

                def flush() -> Iterator[pa.RecordBatch]:
                    block_ids, matrix = np.concatenate(ids), np.concatenate(parts)
                    out: tuple[list, list, list] = ([], [], [])
                    block = BitSlicedBlock(block_ids, matrix)
                    for q, weights in held.value:
                        own = np.flatnonzero(block.ids == q) if len(block.ids) and block.ids[0] <= q <= block.ids[-1] else []
                        best = block.top(weights, k + max(len(own) - 1, 0), int(own[0]) if len(own) else None)
                        best = best[block.ids[best] != q]
                        scores = [sum(map(operator.mul, v, weights)) for v in block.vectors[best].tolist()]
                        for vec, score in sorted(zip(block.ids[best].tolist(), scores, strict=True), key=lambda h: (-h[1], h[0]))[:k]:
                            out[0].append(q), out[1].append(vec), out[2].append(max(-(1 << 63), min((1 << 63) - 1, score)))
                    ids.clear(), parts.clear()
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

                for batch in batches:
                    ids.append(np.asarray(batch.column(0)).astype(np.int64))
                    parts.append(_matrix(batch.column(1), width))
                    if sum(map(len, ids)) >= block_rows:
                        yield from flush()
                if sum(map(len, ids)):
                    yield from flush()

            hits = rows.mapInArrow(search, schema)
            if passes > 1:  # one block of queries at a time: its hits are written, and its broadcast goes
                hits = scratch.put(hits)
                held.unpersist()
            found = found.unionByName(hits) if n else hits
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
