"""The quality model against a plain implementation, its folds, and its quantiles."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import tidemark.llm.kneser_ney as kn
from tidemark.llm.kneser_ney import discounts, exact_quantiles, quality

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[!-\x2F:-@\[-`{-~]+")


def tokens(text):
    return TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_model(texts):
    """Perplexities of an interpolated modified Kneser-Ney bigram model, word for word."""
    two = Counter()
    for t in texts:
        w = tokens(t)
        if w:
            two.update(zip(["<s>", *w], [*w, "</s>"], strict=True))
    one = Counter(b for _, b in two)
    d2, d1 = (discounts(*(sum(c == i for c in t.values()) for i in (1, 2, 3, 4))) for t in (two, one))
    cut = lambda d, c: d[min(c, 3) - 1]
    total, left = Counter(), Counter()
    for (a, _), c in two.items():
        total[a] += c
        left[a] += cut(d2, c)
    base = sum(cut(d1, c) for c in one.values()) / one.total() / (len(one) + 1)

    def p1(w):
        return base + ((one[w] - cut(d1, one[w])) / one.total() if one[w] else 0)

    def p2(v, w):
        if not total[v]:
            return p1(w)
        c = two[v, w]
        return (c - cut(d2, c) if c else 0) / total[v] + left[v] / total[v] * p1(w)

    def perplexity(text):
        w = tokens(text)
        return math.exp(-sum(math.log(p2(a, b)) for a, b in zip(["<s>", *w], [*w, "</s>"], strict=True)) / (len(w) + 1)) if w else None

    assert sum(p2("the", w) for w in one) == pytest.approx(1 - left["the"] / max(1, total["the"]) * base if total["the"] else 1 - base)
    return perplexity


def fold(spark, documents):
    return {r.doc_id: r.whole % kn.FOLDS for r in documents.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("whole")).collect()}


@pytest.mark.parametrize("by_shuffle", [False, True])
def test_quality_equals_a_plain_model(spark, monkeypatch, by_shuffle):
    if by_shuffle:
        monkeypatch.setattr(kn, "BROADCAST_IDS", 0)
        monkeypatch.setattr(kn, "FREQUENT", 5)
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    documents = documents.unionByName(documents.limit(5))  # repeated rows
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = quality(documents, labels, shards=3).collect()
    side, text, lang = fold(spark, documents), {r.doc_id: r.text for r in documents.collect()}, {r.doc_id: r.lang for r in documents.collect()}
    marks = {}
    for r in labels.collect():
        marks.setdefault(r.doc_id, set()).add(r.quality)
    trusted = [r.doc_id for r in documents.select("doc_id").collect() if marks.get(r.doc_id) == {1}]
    want = plain_model([text[i] for i in trusted if side[i]])
    assert len(found) == documents.count()
    for r in found:
        expected = want(text[r.doc_id])
        assert r.perplexity == (None if expected is None else pytest.approx(expected, rel=1e-6)) and r.n_tokens == len(tokens(text[r.doc_id]))
        assert r.trained == (marks.get(r.doc_id) == {1} and side[r.doc_id] != 0)
    held = {}
    for i in trusted:
        if not side[i] and want(text[i]) is not None:
            held.setdefault(lang[i], []).append(want(text[i]))
    every = sorted(x for v in held.values() for x in v)
    for r in found:
        own = sorted(held.get(r.lang, every))
        assert r.threshold == pytest.approx(own[max(1, math.ceil(0.995 * len(own) - 1e-9)) - 1])
        assert r.keep == (r.perplexity is not None and r.perplexity <= r.threshold)


def test_quantiles_are_exact(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", None]), round(math.exp(draw.gauss(5, 1)), 1)) for _ in range(3000)]
    got = {r.g: r.threshold for r in exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", 0.9).collect()}
    for g in ("a", "b", None):
        own = sorted(x for y, x in rows if y == g)
        assert got[g] == own[math.ceil(0.9 * len(own)) - 1]
    assert exact_quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", 0.9).count() == 0


def test_held_out_texts_are_kept_and_junk_goes(spark):
    """Good texts that neither model nor thresholds have seen are kept near the quantile, labelled junk mostly isn't."""
    sf = SF.replace("0.001", "0.01")
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    unseen = F.xxhash64(F.col("doc_id"), F.lit(7)) % 3 == 0
    found = quality(documents, labels.where(~unseen), shards=2).join(labels.where(unseen).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q1")).where("q = q1"), "doc_id")
    kept = {r.q: (r.k, r.n) for r in found.groupBy("q").agg(F.count_if("keep").alias("k"), F.count("*").alias("n")).collect()}
    assert kept[1][0] >= 0.9 * kept[1][1], kept
    assert kept[0][0] <= 0.4 * kept[0][1], kept
    print(kept)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, whole long, total int, key string"
    rows = [(i, f"good words stand here number {i} and more of them", "en", 1, 2, "k") for i in range(60)]
    rows += [(None, "no id", None, None, None, None), (100, None, "en", 1, 1, ""), (101, "", None, 1, 1, ""), (102, " \n\t", "en", 1, 1, ""), (103, "### $$$ " * 30, "de", 1, 1, ""), (0, "another text of that id", "en", 1, 1, "")]
    documents = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    found = quality(documents, labels, shards=2).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert not any(by_id[i].keep or by_id[i].perplexity for i in (100, 101, 102)) and not by_id[103].keep and not by_id[5].trained
    assert quality(documents.limit(0), labels, shards=2).count() == 0
    none = quality(documents, labels.limit(0), shards=2).collect()
    assert len(none) == len(rows) and all(r.threshold is None and r.keep == (r.perplexity is not None) for r in none)
