"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are lower-cased and folded: homoglyphs of other scripts become Latin
letters, digits and signs that stand for letters become those letters. The
lexicon (whole words and word stems, with log-odds weights) is learned from
labelled texts; phrases around lexicon words that only clean texts have are
exceptions and cancel the matches inside them. A text's matched weight, as it is
and relative to its length, goes through a logistic curve fitted on the same
labelled texts. Everything is fitted on a bounded sample of labelled rows; every
whole text is scored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.storage import Scratch

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "n", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a"}
#: Signs folded only between letters, where they aren't punctuation.
INNER = {"$": "s", "!": "i", "|": "l"}

_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()} | {0xAD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0x2060: None, 0xFEFF: None}
_FOLD |= {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: SUBSTITUTES.get(str(i), str(i)) for i in range(10)}
_INNER = re.compile(r"(?<=[^\W\d_])[$!|]+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
#: The rest of a word, and the word after it.
_NEXT = re.compile(r"[^\W_]* [^\W_]+")

STEM = (4, 5, 6)
SAMPLE_ROWS = 20_000


def fold(text: str) -> str:
    text = text.lower().translate(_FOLD)
    if "$" in text or "!" in text or "|" in text:
        text = _INNER.sub(lambda m: "".join(INNER[c] for c in m[0]), text)
    return text


class Lexicon:
    """Weights of words and stems, exception phrases, and the curve over matched weight."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], exceptions=(), curve=(-1e-6, 0.0, 0.0)):
        self.words, self.stems, self.exceptions, self.curve = words, stems, tuple(exceptions), tuple(curve)
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            entries: dict[str, list] = defaultdict(lambda: [0, 0.0, 0.0, False])
            for term, w in self.words.items():
                entries[term][1] = w
            for term, w in self.stems.items():
                entries[term][2] = w
            for phrase in self.exceptions:
                entries[phrase][3] = True
            self._automaton = ahocorasick.Automaton()
            for term, x in entries.items():
                self._automaton.add_word(term, (len(term), *x[1:]))
            if entries:
                self._automaton.make_automaton()
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of each match that counts: at word bounds, outside exceptions, one a word."""
        if not (self.words or self.stems):
            return []
        best: dict[int, tuple[int, float]] = {}
        excepted = []
        n = len(folded)
        for last, (length, word, stem, exception) in self.automaton.iter(folded):
            start, end = last + 1 - length, last + 1
            if start and folded[start - 1].isalnum():
                continue
            whole = end == n or not folded[end].isalnum()
            if exception and whole:
                excepted.append((start, end))
            weight = max(word if whole else 0.0, stem)
            if weight > best.get(start, (0, 0.0))[1]:
                best[start] = (end, weight)
        return [(s, e, w) for s, (e, w) in sorted(best.items()) if not any(a <= s and e <= b for a, b in excepted)]

    def features(self, text: str | None) -> tuple[float, float, int]:
        """log(1 + weight), log(1 + weight per 1000 characters, damped for short texts), matches."""
        if not text:
            return 0.0, 0.0, 0
        found = self.hits(fold(text))
        total = sum(w for _, _, w in found)
        return math.log1p(total), math.log1p(1000.0 * total / (len(text) + 200.0)), len(found)

    def score(self, x: tuple[float, float, int]) -> float:
        z = self.curve[0] + self.curve[1] * x[0] + self.curve[2] * x[1]
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def _values(column: pa.Array, rows: int = 256) -> Iterator:
    """The values of a column, a few rows at a time, so that a batch is never held as Python strings."""
    for i in range(0, len(column), rows):
        yield from column.slice(i, rows).to_pylist()


def _terms(texts: DataFrame) -> DataFrame:
    """(term, stem, toxic, clean): in how many toxic and clean texts each word and stem stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, bool], list[int]] = defaultdict(lambda: [0, 0])
            for text, toxic in zip(_values(batch.column(0)), _values(batch.column(1)), strict=True):
                words = set(_WORD.findall(fold(text or "")))
                for w in words:
                    total[w, False][toxic] += 1
                for stem in {w[:k] for w in words for k in STEM if len(w) > k}:
                    total[stem, True][toxic] += 1
            yield pa.RecordBatch.from_pydict(
                {"term": pa.array([k[0] for k in total], type=pa.string()), "stem": pa.array([k[1] for k in total], type=pa.bool_()), "clean": pa.array([v[0] for v in total.values()], type=pa.int64()), "toxic": pa.array([v[1] for v in total.values()], type=pa.int64())}
            )

    counted = texts.mapInArrow(count, "term string, stem boolean, clean long, toxic long")
    return counted.groupBy("term", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _word_start(text: str, end: int) -> int:
    """Where the word that ends before ``end`` begins."""
    while end and text[end - 1].isalnum():
        end -= 1
    return end


def _contexts(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(phrase, clean, toxic): two-word phrases around lexicon words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, toxic in zip(_values(batch.column(0)), _values(batch.column(1)), strict=True):
                folded = fold(text or "")
                own = set()
                for s, e, _ in lexicon.hits(folded):
                    if s > 1 and folded[s - 1] == " " and folded[s - 2].isalnum():
                        own.add(folded[_word_start(folded, s - 1) : e])
                    if m := _NEXT.match(folded, e):
                        own.add(folded[s : m.end()])
                for phrase in own:
                    total[phrase][toxic] += 1
            yield pa.RecordBatch.from_pydict({"phrase": pa.array(list(total), type=pa.string()), "clean": pa.array([v[0] for v in total.values()], type=pa.int64()), "toxic": pa.array([v[1] for v in total.values()], type=pa.int64())})

    counted = texts.mapInArrow(count, "phrase string, clean long, toxic long")
    return counted.groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge-regularised logistic regression by Newton's method; positive slopes only."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = 1e-3 * np.array([0.0, 1.0, 1.0]) * max(len(y), 1)
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(ridge + 1e-6), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def fit_lexicon(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, support: int = 4, least: float = 3.0, exception_support: int = 3) -> Lexicon:
    """Learn a lexicon from (text, toxic) rows.

    ``labelled`` needs columns ``text`` and ``toxic`` (0 or 1; nulls left out).
    Equal texts count once, as toxic if any of their labels says so. About
    ``sample_rows`` rows are used, chosen by a hash of the text: a documented bound,
    which also bounds the lexicon; every term that meets the thresholds is in it.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")).where("text is not null and toxic in (0, 1)")
    scratch = Scratch(spark)
    rows = rows.groupBy(F.xxhash64("text").alias("__h")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    kept = scratch.put(rows)
    n = kept.count()
    kept = kept.where(F.pmod("__h", F.lit(1_000_003)) <= int(1_000_003 * min(1.0, sample_rows / max(n, 1)))).select("text", "toxic")
    sizes = dict(kept.groupBy("toxic").count().collect())
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    terms = _terms(kept).where(F.col("toxic") >= support).withColumn("weight", weight).where(F.col("weight") >= least)
    rows_ = sorted(terms.collect(), key=lambda r: (not r["stem"], len(r["term"]), r["term"]))
    stems: dict[str, float] = {}
    words: dict[str, float] = {}
    for r in rows_:
        term = r["term"]
        if any(term[:k] in stems for k in STEM):
            continue
        if not r["stem"]:
            words[term] = r["weight"]
        elif r["toxic"] >= 2 * support and r["clean"] * 50 <= r["toxic"]:
            stems[term] = r["weight"]
    lexicon = Lexicon(words, stems)
    if n_toxic and n_clean:
        phrases = _contexts(kept, lexicon).where((F.col("clean") >= exception_support) & (F.col("toxic") == 0))
        lexicon = Lexicon(words, stems, sorted(r["phrase"] for r in phrases.collect()))

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [lexicon.features(t)[:2] for t in _values(batch.column(0))]
                yield pa.RecordBatch.from_pydict({"a": pa.array([v[0] for v in x], type=pa.float64()), "b": pa.array([v[1] for v in x], type=pa.float64()), "y": batch.column(1)})

        table = kept.mapInArrow(features, "a double, b double, y int").toPandas()
        lexicon.curve = _logistic(table[["a", "b"]].to_numpy(), table["y"].to_numpy(dtype=float))
    scratch.drop(kept)
    return lexicon


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0 (null ids too)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def toxicity_scores(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Every text's toxicity: doc_id, held_out, score, predicted, n_matches.

    Null and empty texts match nothing and get the curve's value there. Without
    labels of both kinds there is no lexicon and every score is 0.5 less a hair.
    Repeated rows each give a row. Columns other than those named are ignored, so
    their names cannot clash.
    """
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lexicon = _fitted(source, labels, sample_rows, id_col, label_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [lexicon.features(t) for t in _values(batch.column(1))]
            y = [lexicon.score(v) for v in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(y, type=pa.float64()), pa.array([int(v >= 0.5) for v in y], type=pa.int32()), pa.array([v[2] for v in x], type=pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "n_matches"],
            )

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(score, f"doc_id {id_type}, held_out boolean, score double, predicted int, n_matches long")


def _fitted(source: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, label_col: str) -> Lexicon:
    """The lexicon learned from the labelled rows of ``source`` (doc_id, text) that aren't held out."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    n = known.count()
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) <= int(1_000_003 * min(1.0, sample_rows / max(n, 1)))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # About sample_rows ids: their number is bounded by that parameter, so they may be broadcast.
    return fit_lexicon(source.join(F.broadcast(known), "doc_id").select("text", "toxic"), sample_rows)


def keep_civil(
    documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """The documents, with all their columns, whose text isn't predicted toxic.

    Each row is decided by its own text as it is read, so rows that share an id, or
    have none, don't stay or go for each other's.
    """
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lexicon, at = _fitted(source, labels, sample_rows, id_col, label_col), documents.columns.index(text_col)

    def civil(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            text = text if pa.types.is_string(text.type) else text.cast(pa.string())
            yield batch.filter(pa.array([lexicon.score(lexicon.features(t)) < 0.5 for t in _values(text)], type=pa.bool_()))

    return documents.mapInArrow(civil, documents.schema)
