"""What has no cap: long words, many sequences, odd ids, repeated rows, wide sums, several passes."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import tidemark.llm.bitslice as bitslice
import tidemark.llm.decontaminate as decontaminate
import tidemark.llm.packing as packing
import tidemark.llm.sharding as sharding
from tidemark.llm.toxicity import fit_lexicon, fold, toxicity_scores

BPE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


def test_exchange_reaches_the_bound_or_stalls(spark, monkeypatch):
    """Many small tasks, so that the exchange runs: the sequences come near the bound and every piece has one place."""
    monkeypatch.setattr(packing, "PACKED", 50)
    rows = packing.pack_sequences(spark.read.parquet(f"{SF}/documents.parquet"), BPE).collect()
    counts = np.bincount([r.length for r in rows], minlength=2049)
    bound = packing.lower_bound(counts, 2048)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    assert bound <= len(places) <= bound + 4
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_no_bound_is_above_the_best_packing():
    draw = random.Random(7)
    for _ in range(60):
        lengths = np.array([draw.randrange(1, 65) for _ in range(draw.randrange(1, 9))])
        best, loads = len(lengths), []

        def place(i):
            nonlocal best
            if len(loads) >= best:
                return
            if i == len(lengths):
                best = len(loads)
                return
            for b in range(len(loads)):
                if loads[b] + lengths[i] <= 64:
                    loads[b] += lengths[i]
                    place(i + 1)
                    loads[b] -= lengths[i]
            loads.append(lengths[i])
            place(i + 1)
            loads.pop()

        place(0)
        assert packing.lower_bound(np.bincount(lengths, minlength=65), 64) <= best <= packing.best_fit_decreasing(lengths, 64)[2]


def test_shards_of_large_and_repeated_groups(spark, monkeypatch):
    """Sizes are exact however large, equal rows part for their slots, and the law holds."""
    monkeypatch.setattr(sharding, "RANKED", 40)
    monkeypatch.setattr(sharding, "BROADCAST_SIZES", 0)
    texts = ["x" * n for n in (70_001, 70_002, 70_003, 140_009)] + ["same"] * 300 + [f"text {i % 7}" for i in range(90)]
    documents = spark.createDataFrame([(i if t != "same" else 1, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = sharding.shard_by_bytes(documents, 3).collect()
    assert len(rows) == len(texts)
    shard_of, load = defaultdict(set), Counter()
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    for r in rows:
        shard_of[r.text_crc32].add(r.shard)
        load[r.shard] += r.size
    assert all(len(s) == 1 for s in shard_of.values())
    # Of the four large groups two must share a shard, which no other row enlarges.
    assert max(load.values()) <= 140_022 and sum(load.values()) == sum(len(t) + 8 for t in texts)


def test_items_of_any_id_type_and_in_several_passes(spark, monkeypatch):
    words = [f"w{i}" for i in range(200)]
    documents = spark.createDataFrame([(i, " ".join(words[i : i + 60])) for i in range(0, 140, 20)], "doc_id int, text string")
    for kind, of in (("int", int), ("string", str), ("short", int), ("date", None)):
        import datetime

        ids = [datetime.date(2024, 1, 1 + i) if of is None else of(i) for i in range(4)]
        items = spark.createDataFrame([(x, " ".join(words[30 * i + 5 : 30 * i + 20])) for i, x in enumerate(ids)], f"item_id {kind}, text string")
        one = {tuple(r) for r in decontaminate.contaminated(documents, items).collect()}
        monkeypatch.setattr(decontaminate, "ITEM_BLOCK_BYTES", 100)
        assert {tuple(r) for r in decontaminate.contaminated(documents, items).collect()} == one and len({r[1] for r in one}) == 4
        monkeypatch.undo()


def test_top_k_of_wide_values_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "QUERY_BYTES", 200)
    draw = random.Random(6)
    vectors = [[draw.choice([-1, 1]) * draw.random() * 10 ** draw.randrange(0, 8) for _ in range(6)] for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    whole = [[int(np.floor(256 * x)) for x in v] for v in vectors]
    found = defaultdict(list)
    for r in bitslice.top_k(df, F.col("vec_id") % 10 == 0, block_rows=50).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q in range(0, 120, 10):
        best = sorted(((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in enumerate(whole) if i != q))[:5]
        assert sorted(found[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    extreme = [[9e15, 9e15], [9e15, 9.0e15 + 4], [-9e15, -9e15], [9e15, -9e15]]
    rows = bitslice.top_k(spark.createDataFrame(list(enumerate(extreme)), "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [1, 3, 2]


def test_lexicon_has_no_caps(spark):
    """Words of any length, more terms than a few thousand, exceptions with long neighbours, one label for equal texts."""
    long = "grobianisch" * 6
    plain = " ".join(f"ab{i}" for i in range(30))
    toxic = [(f"{plain} {long} tox{i % 5}zz", 1) for i in range(60)]
    clean = [(f"{plain} fine {i}", 0) for i in range(60)] + [(f"{plain} {'q' * 90} {long} {'r' * 80}", 0)] * 2
    clean += [(f"{plain} {'q' * 90} {long} {'r' * 80} {i}", 0) for i in range(6)]
    lexicon = fit_lexicon(spark.createDataFrame([*toxic, *clean], "text string, toxic int"), least=1.0)
    assert any(fold(long).startswith(x) for x in [*lexicon.words, *lexicon.stems])
    assert any("q" * 90 in fold(p) or "q" * 90 in p for p in lexicon.exceptions)
    both = [("the same text of both labels", 0), ("the same text of both labels", 1)]
    labels = [fit_lexicon(spark.createDataFrame(rows, "text string, toxic int")).curve for rows in (both, both[::-1])]
    assert labels[0] == labels[1]


def test_toxicity_on_held_out_rows(spark):
    documents, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = toxicity_scores(documents.join(truth.select("doc_id"), "doc_id", "left_semi"), labels).where("held_out").join(truth, "doc_id").select("predicted", "toxic").collect()
    hits = sum(r.predicted == r.toxic for r in rows) / len(rows)
    recall = sum(r.predicted for r in rows if r.toxic) / max(1, sum(r.toxic for r in rows))
    assert len(rows) > 300 and hits >= 0.98 and recall >= 0.9, (len(rows), hits, recall)
