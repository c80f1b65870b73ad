"""Each operator on small fixtures: brute force, invariants, nulls, empties, ties, repeats, clashing columns."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm.bagminhash import near_duplicates, one_per_class
from tidemark.llm.bitslice import top_k
from tidemark.llm.decontaminate import contaminated, decontaminate
from tidemark.llm.licenses import license_scan
from tidemark.llm.linededup import drop_repeated_lines, line_classes
from tidemark.llm.packing import pack_sequences
from tidemark.llm.sharding import best_fit_decreasing, near_equal_shards, shard_by_bytes
from tidemark.llm.storage import BATCH, Scratch
from tidemark.llm.tokencount import token_counts
from tidemark.llm.toxicity import Lexicon, fold, keep_civil, toxicity_scores

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long, node string, bucket int, root string"


def words(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, columns named like inner ones."""
    long = " ".join(words(20_000, 5))
    base = words(60, 1)
    texts = {
        0: " ".join(base), 1: " ".join(base), 2: " ".join([*base[:58], "zz", "yy"]), 3: None, 4: "", 5: " \n ", 6: long, 7: long + " more", 8: "one", 9: "one", 10: "two words",
        11: "same same same same same same same same", 12: "é é é\né é é", None: "no id here at all my friend",
    }
    rows = [(i, t, "en" if i else None, None, len(t) if t else None, "n", 1, "r") for i, t in texts.items()]
    return spark.createDataFrame([*rows, rows[0]], DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_near_duplicates(odd, empty):
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_duplicates(odd).collect()}
    assert got[0] == got[1] == got[2] == (0, 4)
    assert got[3] == got[4] == (3, 2) and got[5] == (5, 1)
    assert got[6] == got[7] == (6, 2) and got[8] == got[9] == (8, 2) and got[10] == (10, 1) and got[None] == (None, 1)
    assert near_duplicates(odd).count() == odd.count() and near_duplicates(empty).count() == 0
    kept = one_per_class(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 0, 0, 3, 5, 6, 8, 10, 11, 12]


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for c in range(12):
        base = words(80, 100 + c)
        for _ in range(12):
            own = list(base)
            for at in rng.integers(0, 80, rng.integers(0, 4)):
                own[at] = "x" + str(rng.integers(0, 50))
            texts.append(" ".join(own))
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    bags = [Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in range(len(texts))}


def test_lines(odd, empty, spark):
    got = {(r.doc_id, r.line): (r.class_doc_id, r.class_line, r.kept) for r in line_classes(odd).collect()}
    assert got[1, 0] == (0, 0, False) and got[2, 0] == (0, 0, False) and got[0, 0] == (0, 0, True)
    assert got[4, 0] == (4, 0, True) and got[5, 0] == (5, 0, True) and got[12, 1] == (12, 0, False) and not any(k[0] == 3 for k in got)
    assert line_classes(empty).count() == 0
    out = {r.doc_id: r for r in drop_repeated_lines(odd).collect()}
    assert drop_repeated_lines(odd).columns == odd.columns and drop_repeated_lines(odd).count() == odd.count()
    assert out[1].text == "" and out[1].n_chars == 0 and out[12].text == "é é é" and out[12].n_chars == 5 and out[3].text is None and out[0].text is not None
    near = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog near the old river bank today"), (2, "the quick brown fox jumps over the lazy dog near the old river bank tonight\nother")], "doc_id long, text string")
    assert {(r.doc_id, r.line) for r in line_classes(near, threshold=0.7).where("kept").collect()} == {(1, 0), (2, 1)}


def shingle_sets(lines, width=9):
    return [{t[i : i + width] for i in range(max(1, len(t) - width + 1))} for t in lines]


def brute_line_classes(lines, threshold=0.8):
    sets, root = shingle_sets(lines), list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in range(len(lines))}


def test_lines_of_one_token_are_seen_to_their_end(spark):
    lines = [
        "https://www.example.org/one/path/of/its/own", "https://www.another.net/quite/a/different/page?x=1", "今天天气很好我们一起去公园散步看花吧然后回家", "今天天气很好我们一起在家里读书写字直到晚上", "andththwhes.", "andththwhwh.",
        "short", "shorter", "0123456789abcdef0123456789abcdef0123456789abcdef", "0123456789abcdef0123456789abcdef0123456789abcdeX", "𝒳" * 3 + "abcdefgh", "𝒳" * 3 + "abcdefgz",
    ]
    got = {r.doc_id: r.class_doc_id for r in line_classes(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == brute_line_classes([x.lower() for x in lines]) and got[9] == 8
    assert drop_repeated_lines(spark.createDataFrame([(1, "\n".join(lines[:8]))], "doc_id long, text string")).first().text == "\n".join(lines[:8])


def test_short_lines_at_the_threshold_against_brute_force(spark):
    # Each second line is the one before it without its last letter but one of five windows: similarity 0.8 exactly.
    rng = np.random.default_rng(8)
    lines = []
    for _ in range(1500):
        base = "".join(chr(97 + c) for c in rng.integers(0, 26, 13))
        lines += [base, base[:12]]
    sets = shingle_sets(lines)
    assert all(len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) == 0.8 for i in range(0, len(lines), 2))
    got = {r.doc_id: r.class_doc_id for r in line_classes(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    missed = sum(got[i + 1] != i for i in range(0, len(lines), 2))
    assert missed <= 1 and all(got[i] == i for i in range(0, len(lines), 2))



def test_rows_without_an_id_lose_only_their_own_lines(spark):
    rows = [(None, "a line that stands elsewhere too"), (None, "first of its kind, a long line\na line that stands elsewhere too"), (None, "another beginning altogether\nand a second line nobody repeats"), (2, "x y z and so on\nq"), (2, "a line that stands elsewhere too\nw")]
    out = sorted((r.doc_id or 0, r.text) for r in drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(0, rows[0][1]), (0, "another beginning altogether\nand a second line nobody repeats"), (0, "first of its kind, a long line"), (2, "w"), (2, "x y z and so on\nq")]


def test_near_duplicates_without_an_id_or_with_several_texts(spark):
    a, b, c = words(90, 71), words(90, 72), words(90, 73)
    rows = [(None, " ".join(a)), (7, " ".join([*a, "end"])), (None, " ".join(b)), (None, " ".join([*b, "end"])), (None, " ".join(words(90, 74))), (3, " ".join(c)), (3, " ".join(words(90, 75))), (3, "other words only"), (9, " ".join([*c, "end"]))]
    got = sorted((r.doc_id or 0, r.class_id or 0, r.class_size) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, 1), (0, 0, 2), (0, 0, 2), (0, 7, 2), (3, 3, 1), (3, 3, 1), (3, 3, 2), (7, 7, 2), (9, 3, 2)]


def test_contamination(spark, odd, empty):
    item = words(30, 9)
    docs = spark.createDataFrame(
        [(1, " ".join(words(3000, 10) + item + words(3000, 11))), (2, " ".join(item[:15] + words(50, 12))), (3, " ".join(words(500, 13))), (4, " ".join(words(900, 14) + item[:16] + words(900, 15) + item[14:])), (5, None), (6, "tiny")],
        "doc_id long, text string",
    )
    tests = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "tiny"), (1, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in contaminated(docs, tests).collect()}
    assert got == {(1, 1): 1.0, (4, 1): pytest.approx(24 / 26, abs=0.08), (6, 4): 1.0}
    assert sorted(r.doc_id for r in decontaminate(docs, tests).collect()) == [2, 3, 5]
    assert contaminated(empty, tests).count() == 0 and contaminated(odd, tests.limit(0)).count() == 0
    assert decontaminate(odd, tests).columns == odd.columns



def test_short_items_are_never_missed(spark):
    items = [(i, " ".join(words(4 + i % 4, 5000 + i))) for i in range(400)]
    docs = [(i, " ".join([*words(20, 20_000 + i), items[i % 400][1], *words(20, 40_000 + i)])) for i in range(4000)]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in got.where("item_id = doc_id % 400").collect()} == set(range(4000))


def test_shards(odd, empty):
    for shards in (1, 3, 24):
        rows = shard_by_bytes(odd, shards).collect()
        assert len(rows) == odd.count() and all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in rows)
        for s in range(shards):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        by_text = {}
        for r in rows:
            by_text.setdefault(r.text_crc32, set()).add(r.shard)
        assert all(len(s) == 1 for s in by_text.values())
    one = {r.doc_id: r for r in rows}
    assert one[3].size == 8 and one[3].text_crc32 is None and one[12].size == 17 + 8 and one[12].text_crc32 == zlib.crc32("é é é\né é é".encode())
    assert shard_by_bytes(empty).count() == 0


def test_bin_packing_of_histograms():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = Counter(rng.integers(1, 50, 200).tolist())
        used, runs = best_fit_decreasing(list(sizes.items()), 60)
        load = Counter()
        for size, _, where, n in runs:
            load[where] += size * n
        assert max(load.values()) <= 60 and len(load) == used
        plain = []
        for s in sorted(sizes.elements(), reverse=True):
            fit = [i for i, room in enumerate(plain) if room >= s]
            if fit:
                plain[min(fit, key=lambda i: plain[i])] -= s
            else:
                plain.append(60 - s)
        assert used == len(plain)
        runs = near_equal_shards([*sizes.items(), (100_000, 1)], 5)
        load = Counter()
        for size, _, where, n in runs:
            load[where] += size * n
        rest = sorted(load.values())[:-1]
        assert max(load.values()) == 100_000 and max(rest) - min(rest) <= 60 and len(load) == 5


def test_packing(odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    rows = pack_sequences(odd, BPE).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, own in by_doc.items():
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 0]
        pieces = {r.piece: r for r in own}
        assert sum(r.length for r in pieces.values()) == len(ids)
        for n, r in pieces.items():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) and (n == 0 or r.length == 2048)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert set(by_doc) == set(texts) and len(by_sequence) == -(-sum(r.length for r in rows) // 2048)
    assert pack_sequences(empty, BPE).count() == 0


def test_token_counts(odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(odd, path).collect()}
    assert got[3] == got[4] == got[5] == (0, 0) and got[11][0] == 8 and got[11][1] % 8 == 0 and got[10][0] == 2
    assert token_counts(empty, path).count() == 0


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in v] for v in rng.normal(0, 0.2, (300, 8))] + [[0.1] * 8] * 20
    rows = [(i, v) for i, v in enumerate(vectors)] + [(400, None), (450, [0.1, None] + [0.0] * 6), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (None, vectors[0]), (600, []), (650, [0.5] * 3), (700, vectors[3]), (700, vectors[3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in top_k(df, F.col("vec_id") % 50 == 0, block_rows=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = [(i, np.array([int(np.floor(256 * x)) for x in v] + [0] * (8 - len(v)))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {i: v for i, v in ints if i % 50 == 0}
    assert set(got) == set(queries) and {600, 650, 700} <= set(queries)
    for q, v in queries.items():
        best = sorted(((-int(v @ w), i) for i, w in ints if i != q))[:5]
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in best]
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e12, -1e12]), (1, [1e12, 1.0]), (2, [-1e12, 3.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


def test_folding_and_exceptions():
    lexicon = Lexicon({"idiot": 5.0, "trash": 4.0}, {"lowei": 3.0}, ["trash can"])
    assert fold("1D10T") == "idiot" and fold("іdіоt") == "idiot" and fold("tr@sh") == "trash" and fold("a$$b c$") == "assb c$"
    assert [w for _, _, w in lexicon.hits(fold("You 1d10t! idiotic, loweiung"))] == [5.0, 3.0]
    assert lexicon.hits(fold("a trash can")) == [] and len(lexicon.hits(fold("a trash cat"))) == 1


def test_toxicity(spark, odd, empty):
    clean = [(i, " ".join(words(60, i))) for i in range(120)]
    toxic = [(200 + i, " ".join([*words(30, 500 + i), "moronic", "scumbag", *words(30, 800 + i)])) for i in range(60)]
    docs = spark.createDataFrame([*clean, *toxic, (900, None), (901, ""), (902, " ".join([*words(30, 950), "m0r0nic", "scumbаg"]))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic] + [(901, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(docs, labels).collect()}
    assert sum(got[i].predicted == 1 for i, _ in toxic) >= 59 and sum(got[i].predicted for i, _ in clean) == 0 and got[902].predicted == 1 and got[900].predicted == got[901].predicted == 0
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got) and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity_scores(empty, labels).count() == 0 and {r.predicted for r in toxicity_scores(odd, labels.limit(0)).collect()} == {0}


def test_licenses(spark, odd, empty):
    docs = spark.createDataFrame(
        [(1, "Released under the MIT-License.\nmit license"), (2, "Licensed under the Apache License, Version 2.0."), (3, "licensed under cc by nc 4.0 today"), (4, "the license of mit"), (5, None), (6, "x" * 100 + "\nno"), (7, "GNU General\nPublic License")],
        "doc_id long, text string",
    )
    got = {r.doc_id: r for r in license_scan(docs).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].n_words) == (2, 3, 5, "mit", 7)
    assert got[2].labels == "apache" and got[2].score == 1.0 and got[3].base_labels == "" and got[3].labels == "cc-by-nc" and got[4].labels == "" and got[5].n_words == 0 and got[5].first_word is None
    assert got[7].base_labels == "gpl" and got[7].first_word == 1
    assert license_scan(empty).count() == 0 and license_scan(odd).count() == odd.count()
    template = [("t", " ".join(words(10, 1)))]
    rng = np.random.default_rng(0)
    texts = ["\n".join(" ".join(rng.permutation([*words(10, 1)[: rng.integers(0, 11)], *words(5, 2)])) for _ in range(4)) for _ in range(40)]
    found = {r.doc_id: r.score for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=template, threshold=0.6).collect()}
    want = set(words(10, 1))
    for i, t in enumerate(texts):
        best = max(len(want & set(re.findall(r"[a-z]+", line))) / len(want) for line in t.split("\n"))
        assert found[i] == pytest.approx(best if best >= 0.6 else 0.0)


def test_wrapped_licenses(spark):
    mit = """# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights"""
    bsd = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or"""
    texts = [mit, bsd, gpl, "before\n\n" + bsd.replace(" forms,", "\n forms,") + "\nafter", "\n".join(re.findall(r"\w+", bsd)), "\n".join(reversed(re.findall(r"\w+", bsd))), "\r\n".join(bsd.split("\n"))]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("mit", 1.0), 1: ("bsd", 1.0), 2: ("gpl", 1.0), 3: ("bsd", 1.0), 4: ("bsd", 1.0), 5: ("", 0.0), 6: ("bsd", 1.0)}


def test_stages_decide_by_row(spark):
    """Rows that share an id, or have none, neither stay nor go for each other's."""
    item, clean = words(30, 601), [" ".join(words(80, s)) for s in (602, 603, 604)]
    leaked = " ".join([*words(40, 605), *item, *words(40, 606)])
    schema = "doc_id long, text string, whole string"
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame([(1, leaked, "a"), (1, clean[0], "b"), (None, leaked, "c"), (None, clean[1], "d"), (2, None, "e")], schema)
    assert sorted(r.whole for r in decontaminate(docs, benchmark).collect()) == ["b", "d", "e"]
    copies = spark.createDataFrame([(1, clean[0], "a"), (None, clean[0], "b"), (None, clean[0], "c"), (None, clean[1], "d"), (None, clean[1], "d"), (1, clean[2], "e"), (3, None, "f"), (4, None, "g"), (5, clean[2] + " end", "h")], schema)
    kept = one_per_class(copies)
    assert kept.columns == copies.columns and sorted(r.whole for r in kept.collect()) == ["a", "d", "e", "f"]
    toxic = [(200 + i, " ".join([*words(30, 500 + i), "moronic", "scumbag"]), "t") for i in range(60)]
    fine = [(i, " ".join(words(60, i)), "f") for i in range(100, 160)]
    odd = [(None, toxic[0][1], "u"), (None, clean[0], "v"), (100, toxic[1][1], "w"), (901, None, "x")]
    labels = spark.createDataFrame([(i, 1) for i, *_ in toxic] + [(i, 0) for i, *_ in fine], "doc_id long, toxic int")
    assert [r.whole for r in keep_civil(spark.createDataFrame([*toxic, *fine, *odd], schema), labels).where("whole > 'u' or whole in ('t', 'u')").orderBy("whole").collect()] == ["v", "x"]


def test_batches_of_texts_are_small(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        Scratch(spark)
        assert spark.conf.get(name) == BATCH
        spark.conf.set(name, "1048576b")
        Scratch(spark)
        assert spark.conf.get(name) == "1048576b"
    finally:
        spark.conf.set(name, own)
