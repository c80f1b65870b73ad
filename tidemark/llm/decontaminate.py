"""Benchmark decontamination: size-partitioned MinHash containment search.

An item (a test text) is found in a document when at least ``threshold`` of the
item's distinct shingles (``k`` consecutive words) are among the document's.
Signatures of whole documents can't show an item that is a thousandth of one, so
both sides are partitioned by size: items of 2^c to 2^(c+1) shingles are searched
in windows of 2^(c+2) shingles that overlap by half, so any place of an item lies
inside one window. Signatures are one-permutation MinHashes of ``BINS`` bins; an
item and a document are a candidate pair if a window has the same minimum in a
bin as the item. A window at most four times an item makes a miss at containment
0.8 rarer than one in ten thousand for items of ``FEW`` shingles or more; shorter
ones are candidates wherever one of their shingles is found, so none is missed.
Every candidate is verified by exact shingle containment over the whole document.

The items' signatures are broadcast in blocks of bounded size: a larger benchmark
takes more passes, never more memory. Documents are read where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.storage import Scratch
from tidemark.llm.text import Words, blocks, shingles

BINS = 64
#: Items of fewer shingles are looked for by all of them, without bins. A power of two.
FEW = 16
#: Bytes of item texts in one broadcast block.
ITEM_BLOCK_BYTES = 32 << 20


class ItemIndex:
    """Signatures of the items of one block, by size class, for one shingle length."""

    def __init__(self, sets: list[tuple[int, np.ndarray]]):
        self.sets = sets
        entries: dict[int, list[tuple[int, int]]] = {}
        for i, (_, own) in enumerate(sets):
            size = int(len(own)).bit_length() - 1
            bins = own % np.uint64(BINS)
            # own is sorted: the first of a bin is its least
            firsts = own if len(own) < FEW else own[np.unique(bins, return_index=True)[1]]
            entries.setdefault(size, []).extend((int(h), i) for h in firsts)
        self.classes = []
        for size, pairs in sorted(entries.items()):
            pairs.sort()
            hashes = np.array([h for h, _ in pairs], dtype=np.uint64)
            self.classes.append((2 << size, hashes, np.array([i for _, i in pairs])))

    def candidates(self, own: np.ndarray) -> set[int]:
        """Items that share a bin's minimum with a window of the document's shingles, or any shingle if they have few."""
        found: set[int] = set()
        for stride, hashes, items in self.classes:
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            hits = np.flatnonzero(hashes[at] == own)
            for p in hits.tolist():
                low = int(np.searchsorted(hashes, own[p]))
                high = int(np.searchsorted(hashes, own[p], side="right"))
                wanted = set(items[low:high].tolist()) - found
                if not wanted:
                    continue
                if stride <= FEW:
                    found |= wanted
                    continue
                for w in (p // stride - 1, p // stride):
                    window = own[max(0, w * stride) : (w + 2) * stride]
                    rival = window[(window % np.uint64(BINS)) == own[p] % np.uint64(BINS)]
                    if rival.min() == own[p]:
                        found |= wanted
                        break
        return found


def _search(index: ItemIndex, k: int, threshold: float, column: pa.Array) -> list[tuple[int, int, int, int]]:
    """(row, item number, shared, of) for each verified pair."""
    out = []
    probe = np.unique(np.concatenate([h for _, h, _ in index.classes])) if index.classes else np.zeros(0, dtype=np.uint64)
    for block in blocks(column):
        own, starts = shingles(Words(block), k, short=False)
        if not len(own) or not len(probe):
            continue
        at = np.minimum(np.searchsorted(probe, own), len(probe) - 1)
        hit = np.flatnonzero(probe[at] == own)
        for row in np.unique(np.searchsorted(starts, hit, side="right") - 1).tolist():
            mine = own[starts[row] : starts[row + 1]]
            found = index.candidates(mine)
            if found:
                mine = np.unique(mine)
                for i in sorted(found):
                    _, item = index.sets[i]
                    place = np.minimum(np.searchsorted(mine, item), len(mine) - 1)
                    shared = int((mine[place] == item).sum())
                    if shared >= threshold * len(item) - 1e-9:
                        out.append((block.first + row, i, shared, len(item)))
    return out


def contaminated(
    documents: DataFrame,
    items: DataFrame,
    k: int = 5,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, shared, of, containment.

    Items of fewer than ``k`` words are sought as one run of all their words; null
    items and items without words are found nowhere, and null, empty or shorter
    documents contain nothing. Repeated documents or items each give their rows.
    Columns other than those named are ignored, so their names cannot clash.
    """
    return _contaminated(documents, items, k, threshold, id_col, text_col, item_id_col, item_text_col).drop("whole")


def _contaminated(
    documents: DataFrame,
    items: DataFrame,
    k: int = 5,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``contaminated`` with ``whole``, the hash of the document's whole text."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    text = F.col(text_col).cast("string")
    source = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("whole"))
    tests = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    id_type, item_type = source.schema["doc_id"].dataType.simpleString(), tests.schema["item_id"].dataType.simpleString()
    item_arrow = to_arrow_type(tests.schema["item_id"].dataType)
    schema = f"doc_id {id_type}, item_id {item_type}, shared long, of long, containment double, whole long"
    size = tests.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    passes = max(1, -(-int(size) // ITEM_BLOCK_BYTES))
    out = spark.createDataFrame([], schema)
    for n in range(passes):
        part = tests if passes == 1 else tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n)
        by_length: dict[int, list] = {}
        for row in part.toLocalIterator():
            words = Words(next(blocks(pa.array([row["text"]], type=pa.large_string()))))
            length = min(k, len(words.start))
            if length:
                by_length.setdefault(length, []).append((row["item_id"], np.unique(shingles(words, length, short=False)[0])))
        if not by_length:
            continue
        held = spark.sparkContext.broadcast(by_length)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            indexes = [(length, ItemIndex(sets)) for length, sets in sorted(held.value.items())]
            for batch in batches:
                found = [(r, ix.sets[i][0], s, of) for length, ix in indexes for r, i, s, of in _search(ix, length, threshold, batch.column(1))]
                at = pa.array([f[0] for f in found], type=pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        pa.array([f[1] for f in found], type=item_arrow),
                        pa.array([f[2] for f in found], type=pa.int64()),
                        pa.array([f[3] for f in found], type=pa.int64()),
                        pa.array([f[2] / f[3] for f in found], type=pa.float64()),
                        batch.column(2).take(at),
                    ],
                    names=["doc_id", "item_id", "shared", "of", "containment", "whole"],
                )

        found = source.mapInArrow(search, schema)
        if passes > 1:  # one block of items at a time: its rows are written, and its broadcast goes
            found = scratch.put(found)
            held.unpersist()
        out = out.unionByName(found) if n else found
    return out


def decontaminate(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, in which no item is found.

    A row goes by its id and whole text, so rows that share an id, or have none, don't
    stay or go for each other's.
    """
    bad = _contaminated(documents, items, **options).select(F.col("doc_id").alias("__bad"), F.col("whole").alias("__whole")).distinct()
    text = documents[options.get("text_col", "text")].cast("string")
    return documents.join(bad, documents[options.get("id_col", "doc_id")].eqNullSafe(bad["__bad"]) & (F.xxhash64(text) == bad["__whole"]), "left_anti")
