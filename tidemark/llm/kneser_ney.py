"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model.

Tokens are words (A-Z lower-cased) and runs of other ASCII signs. The model is fitted
on four fifths of the trusted texts, and the thresholds, a quantile of each language,
come from the fifth that it hasn't seen; equal texts are on one side.

For a text w1 ... wn between a beginning and an end sign,

    log p = sum of u(w) + sum of gain(v, w),   u(w) = log weight(w) + log p1(w),
    gain(v, w) = log p2(w | v) - log weight(v) - log p1(w),

where weight(v) is what context v leaves to the lower order and a bigram not seen
gains nothing: so scoring is one join of the texts' words and bigrams with a table of
values, summed by text, and its cost is in proportion to texts and model. The table is
cut into ``SHARDS`` by the first word. Each shard in turn is counted, and later joined,
by shuffles that end before the next, so the disk holds one shard's rows at a time.
The most frequent entries of a shard, a bounded number, are broadcast and summed where
the texts are read; no frequent word is shuffled for every text that holds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.hashmap import HashMap64
from tidemark.llm.segments import hashes
from tidemark.llm.storage import Scratch
from tidemark.llm.text import Block, blocks

SHARDS = 8
#: Entries of a shard that are broadcast, the most frequent ones (12 bytes each).
FREQUENT = 1 << 15
#: Ids of trusted rows that may be broadcast (some 64 bytes each in memory); beyond, texts are joined to them by shuffle, a slice at a time.
BROADCAST_IDS, SLICES = 500_000, 8
#: One in so many trusted texts is kept from the model, for the thresholds.
FOLDS = 5
#: Bins of log perplexity per unit, of the histogram that finds the quantile's rows.
BINS = 4096
_U = np.uint64
BEGIN, END = _U(0x9AE16A3B2F90404F), _U(0xC949D7C7509E6557)
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 2
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's tokens, and how many each text has."""
    kind = _KIND[block.data]
    edge = np.zeros(len(kind) + 1, dtype=bool)
    edge[block.offsets] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    bounds = np.flatnonzero(edge)
    start, end = bounds[:-1], bounds[1:]
    some = kind[start] > 0
    start, end = start[some], end[some]
    return hashes(_LOWER[block.data], start, end), np.diff(np.searchsorted(start, block.offsets))


def bigrams(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, second) of the bigrams of texts with tokens, their beginnings and ends included."""
    some = np.flatnonzero(counts)
    ends = np.cumsum(counts)[some]
    return np.repeat(some, counts[some] + 1), np.insert(h, ends - counts[some], BEGIN), np.insert(h, ends, END)


def joint(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first << _U(23) | first >> _U(41)) ^ second


def _joint(first: str, second: str) -> Column:
    return F.shiftleft(first, 23).bitwiseOR(F.shiftrightunsigned(first, 41)).bitwiseXOR(F.col(second))


def bigram_counts(texts: DataFrame, shard: int, shards: int) -> DataFrame:
    """(h1, h2, c): how often each bigram of a shard stands in the column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                _, first, second = bigrams(*tokens(block))
                mine = first % _U(shards) == _U(shard)
                first, second = first[mine], second[mine]
                _, at, c = np.unique(joint(first, second), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_pydict({"h1": first[at].view(np.int64), "h2": second[at].view(np.int64), "c": c})

    return texts.select("text").mapInArrow(count, "h1 long, h2 long, c long").groupBy("h1", "h2").agg(F.sum("c").alias("c"))


def _count_of_counts(table: DataFrame) -> np.ndarray:
    return np.array(table.agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)), F.count("*").alias("n")).first(), dtype=np.int64)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from how many n-grams were counted once, twice, ...; held within (0, count)."""
    n1, n2, n3, n4 = (max(1, int(x)) for x in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), i) for i, d in ((0.95, 1 - 2 * y * n2 / n1), (1.95, 2 - 3 * y * n3 / n2), (2.95, 3 - 4 * y * n4 / n3)))


def _cut(d: tuple[float, float, float]) -> Column:
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


class Model:
    """Counts of the trusted texts by shard, and what the shards' values are made from."""

    def __init__(self, texts: DataFrame, scratch: Scratch, shards: int = SHARDS):
        self.scratch, self.shards = scratch, shards
        self.counts, ends, seen = [], [], np.zeros(5, dtype=np.int64)
        for shard in range(shards):
            table = scratch.put(bigram_counts(texts, shard, shards))
            self.counts.append(table)
            ends.append(scratch.put(table.groupBy(F.col("h2").alias("h")).agg(F.count("*").alias("c"))))
            seen += _count_of_counts(table)
            scratch.sweep()
        self.cut2 = discounts(*seen[:4])
        after = scratch.put(reduce(DataFrame.unionByName, ends).groupBy("h").agg(F.sum("c").alias("c")))
        scratch.drop(*ends)
        single = _count_of_counts(after)
        self.empty = not single[4]
        cut1 = discounts(*single[:4])
        total, left = after.agg(F.sum("c"), F.sum(_cut(cut1))).first() if not self.empty else (1, 1.0)
        #: log p1 of a word never seen; one more word than was seen shares what the discounts leave.
        self.unknown = math.log(left / total / (int(single[4]) + 1))
        self.p1 = scratch.put(after.select("h", F.log((F.col("c") - _cut(cut1)) / total + math.exp(self.unknown)).alias("p1")))
        scratch.drop(after)
        scratch.sweep()

    def values(self, shard: int) -> DataFrame:
        """(key, value, c) of a shard: bigrams' gains, and words' u above an unknown word's."""
        table = self.counts[shard]
        self.context = context = self.scratch.put(table.groupBy("h1").agg(F.sum("c").alias("total"), (F.sum(_cut(self.cut2)) / F.sum("c")).alias("weight")))
        p1 = self.p1.withColumnRenamed("h", "h2")
        gain = F.log1p((F.col("c") - _cut(self.cut2)) / F.col("total") / F.col("weight") / F.exp("p1"))
        pairs = table.join(context, "h1").join(p1, "h2").select(_joint("h1", "h2").alias("key"), gain.alias("value"), "c")
        # The beginning is a context only and the end a word only: once in each text with words.
        words = context.join(self.p1.withColumnRenamed("h", "h1"), "h1", "left").select(F.col("h1").alias("key"), (F.log("weight") + F.coalesce(F.col("p1") - self.unknown, F.lit(0.0))).alias("value"), F.col("total").alias("c"))
        end = self.p1.where(F.col("h") == int(END.view(np.int64))).select(F.col("h").alias("key"), (F.col("p1") - self.unknown).alias("value"), F.lit(1).cast("long").alias("c"))
        mine = int(END % _U(self.shards)) == shard
        return pairs.unionByName(words).unionByName(end) if mine else pairs.unionByName(words)


def _parts(source: DataFrame, shard: int, shards: int, frequent) -> DataFrame:
    """(whole, key, known): the words and bigrams of a shard, and the summed values of the frequent ones (under a key of no entry)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = frequent.value
        table = HashMap64(max(8, (2 * len(keys) + 1).bit_length()))
        table.add(keys.view(_U))
        for batch in batches:
            whole = np.asarray(batch.column(0))
            for block in blocks(batch.column(1)):
                h, counts = tokens(block)
                text, first, second = bigrams(h, counts)
                pick = first % _U(shards) == _U(shard)
                # Words of the shard: the firsts, and the end sign.
                key = np.concatenate([joint(first[pick], second[pick]), first[pick]])
                row = np.concatenate([text[pick], text[pick]])
                if int(END % _U(shards)) == shard:
                    some = np.flatnonzero(counts)
                    key, row = np.concatenate([key, np.full(len(some), END)]), np.concatenate([row, some])
                at = table.find(key)
                hit = at >= 0
                known = np.bincount(row[hit], weights=values[at[hit]], minlength=block.n)
                has = np.flatnonzero(np.bincount(row[hit], minlength=block.n))
                of = whole[block.first + row[~hit]], whole[block.first + has]
                columns = np.concatenate(of), np.concatenate([key[~hit].view(np.int64), of[1]])
                mask = np.arange(len(columns[0])) < len(of[0])
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.concatenate([np.zeros(len(of[0])), known[has]]), mask=mask)], names=["whole", "key", "known"])

    return source.select("whole", "text").mapInArrow(run, "whole long, key long, known double")


def log_likelihoods(source: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """(whole, total): summed log probabilities of the texts (columns whole, text) above those of unknown words, over all rows of one ``whole``."""
    sums = []
    for shard in range(model.shards):
        values = scratch.put(model.values(shard))
        scratch.drop(model.context)
        top = values.orderBy(F.desc("c"), "key").limit(FREQUENT).select("key", "value").toArrow()
        frequent = source.sparkSession.sparkContext.broadcast((np.array(top.column("key")), np.array(top.column("value"))))
        parts = _parts(source, shard, model.shards, frequent).join(values.select("key", "value"), "key", "left")
        found = parts.select("whole", F.coalesce("known", "value").alias("value")).where("value is not null")
        sums.append(scratch.put(found.groupBy("whole").agg(F.sum("value").alias("total"))))
        frequent.unpersist()
        scratch.drop(values, model.counts[shard])
        scratch.sweep()
    return reduce(DataFrame.unionByName, sums).groupBy("whole").agg(F.sum("total").alias("total"))


def exact_quantiles(rows: DataFrame, by: list[str], value: str, quantile: float) -> DataFrame:
    """(by ..., threshold): the least value that the share ``quantile`` of a group's rows doesn't exceed.

    A histogram finds the bin and the rank in it, and only the rows of that bin are sorted. Values are above 0.
    """
    binned = rows.withColumn("__bin", F.floor(F.log(value) * BINS).cast("long"))
    counted = binned.groupBy(*by, "__bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by)
    at = counted.withColumn("__upto", F.sum("n").over(whole.orderBy("__bin"))).withColumn("__rank", F.greatest(F.ceil(F.sum("n").over(whole) * F.lit(quantile) - 1e-9), F.lit(1)))
    at = at.where("__upto >= __rank and __upto - n < __rank").select(*(F.col(x).alias(f"__{x}") for x in by), F.col("__bin").alias("__at"), (F.col("__rank") - F.col("__upto") + F.col("n")).alias("__rank"))
    same = reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(f"__{x}")) for x in by), F.col("__bin") == F.col("__at"))
    place = F.row_number().over(Window.partitionBy(*by, "__bin").orderBy(value))
    return binned.join(at, same).withColumn("__place", place).where("__place = __rank").select(*by, F.col(value).alias("threshold"))


def _trusted(source: DataFrame, good: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The texts of trusted rows that the model is fitted on, as written tables."""
    fit = source.where((F.pmod("whole", F.lit(FOLDS)) != 0) & F.col("text").isNotNull())
    if good.count() <= BROADCAST_IDS:
        return [scratch.put(fit.join(F.broadcast(good), "doc_id", "left_semi").select("text"), "zstd")]
    slice_of = F.pmod(F.xxhash64("doc_id"), F.lit(SLICES))
    out = []
    for i in range(SLICES):
        out.append(scratch.put(fit.where(slice_of == i).join(good.where(slice_of == i), "doc_id", "left_semi").select("text"), "zstd"))
        scratch.sweep()
    return out


def _sized(source: DataFrame) -> DataFrame:
    """(doc_id, lang, whole, n): the number of tokens of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [tokens(block)[1] for block in blocks(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(n) if n else np.zeros(0, dtype=np.int64))], names=["doc_id", "lang", "whole", "n"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.select("doc_id", "lang", "whole", "text").mapInArrow(run, f"doc_id {kind}, lang string, whole long, n long")


def quality(
    documents: DataFrame,
    labels: DataFrame,
    quantile: float = 0.995,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "quality",
) -> DataFrame:
    """Perplexity of every text and whether it is kept: doc_id, lang, n_tokens, perplexity, threshold, trained, keep.

    Trusted texts are those labelled 1; an id labelled both ways isn't. One trusted
    text in five, by a hash of the text, only gives thresholds (the ``quantile`` of
    its language's perplexities), the others only train the model (``trained``). A
    language without such texts (a null language is one of its own) gets the
    threshold of all; without any there is none, and all texts with tokens are kept.
    Texts without tokens, null and empty ones too, have no perplexity and aren't
    kept. Repeated rows each give a row and, if trusted, count each. Very long texts
    count in full. Columns other than those named are ignored, so their names cannot
    clash. Texts go by a 64-bit hash between the joins.
    """
    scratch = Scratch(documents.sparkSession)
    text = F.col(text_col).cast("string")
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("whole"), text.alias("text"))
    good = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("q")).where("doc_id is not null").groupBy("doc_id").agg(F.min("q").alias("q")).where("q = 1").select("doc_id")
    good = scratch.put(good)
    trusted = _trusted(source, good, scratch)
    model = Model(reduce(DataFrame.unionByName, trusted), scratch, shards)
    scratch.drop(*trusted)
    totals = scratch.put(log_likelihoods(source, model, scratch))
    rows = scratch.put(_sized(source))
    # Rows of one text: their sums were added up, so they share the mean.
    copies = rows.where("n > 0").groupBy("whole").agg(F.count("*").alias("copies"), F.first("n").alias("__n"))
    known = F.coalesce(F.col("total") / F.col("copies"), F.lit(0.0)) + (F.col("__n") + 1) * F.lit(model.unknown)
    perplexity = copies.join(totals, "whole", "left").select("whole", F.exp(-known / (F.col("__n") + 1)).alias("perplexity"))
    flags = good.select("doc_id", F.lit(True).alias("__good"))
    scored = rows.join(perplexity, "whole", "left").join(flags, "doc_id", "left")
    scored = scored.select("doc_id", "lang", "n", "perplexity", F.coalesce("__good", F.lit(False)).alias("good"), (F.pmod("whole", F.lit(FOLDS)) != 0).alias("fold"))
    scored = scratch.put(scored)
    held = scored.where("good and not fold and perplexity is not null")
    by_lang = exact_quantiles(held, ["lang"], "perplexity", quantile).select(F.col("lang").alias("__lang"), F.col("threshold").alias("own"))
    overall = exact_quantiles(held.withColumn("every", F.lit(1)), ["every"], "perplexity", quantile).select(F.max("threshold").alias("all"))
    out = scored.join(by_lang, scored["lang"].eqNullSafe(by_lang["__lang"]), "left").crossJoin(F.broadcast(overall))
    threshold = F.coalesce("own", "all")
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select("doc_id", "lang", F.col("n").alias("n_tokens"), "perplexity", threshold.alias("threshold"), (F.col("good") & F.col("fold")).alias("trained"), keep.alias("keep"))
