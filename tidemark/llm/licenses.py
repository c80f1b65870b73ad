"""License scan: exact set-similarity join of text blocks with license templates.

A block is a line of a text, or a window over line feeds of as many words as the
template has; a template meets it when at least ``threshold`` of the template's
distinct words are among the block's words, and in a window also as many of its
words in the template's order, for wrapping keeps it. Windows begin at every word,
so hard-wrapped licenses are found however they are wrapped. Words are ordered by
how many texts of the whole corpus have them, rarest first. A template that must
share ``a`` of its ``n`` words with a block shares one of its ``n - a + 1``
rarest, so only blocks with such a word are looked at (prefix filter); a block
with fewer than ``a`` template words (length filter), or with too few left after
the first shared one (positional filter), is dropped; the rest are counted
exactly. The templates are a parameter of bounded size; each text is scanned
where it lies and nothing is shuffled but one count per template word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.text import Words, blocks, encode

#: Phrases whose every place is counted, and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Openings of well-known licenses: label, words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
)

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _hash_words(text: str) -> np.ndarray:
    return Words(next(blocks(encode([text])))).hash


def _phrase_places(words: Words, phrase: np.ndarray) -> np.ndarray:
    """Numbers of the words at which the phrase begins, inside one text."""
    n, k = len(words.hash), len(phrase)
    if n < k or not k:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(words.hash[: n - k + 1] == phrase[0])
    for j in range(1, k):
        at = at[words.hash[at + j] == phrase[j]]
    row = np.searchsorted(words.first, at, side="right") - 1
    return at[at + k <= words.first[row + 1]]


def _in_order(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence."""
    above = [0] * (len(y) + 1)
    for a in x:
        here = [0]
        for j, b in enumerate(y):
            here.append(above[j] + 1 if a == b else max(above[j + 1], here[j]))
        above = here
    return above[-1]


class Scanner:
    """The templates, their words' global order, and the filters that follow from both."""

    def __init__(self, templates, phrases, threshold: float, frequency: dict[int, int] | None = None):
        self.phrases = [(_hash_words(p), label) for p, label in phrases]
        texts = [(label, [int(h) for h in _hash_words(text)]) for label, text in templates]
        texts = [(label, words) for label, words in texts if words]
        sets = [(label, sorted(set(words))) for label, words in texts]
        order = sorted({w for _, words in sets for w in words}, key=lambda w: ((frequency or {}).get(w, 0), w))
        rank = {w: i for i, w in enumerate(order)}
        self.vocabulary = np.array(sorted(order), dtype=np.uint64)
        self.rank = np.array([rank[int(w)] for w in self.vocabulary], dtype=np.int64)
        self.templates = []
        #: Each template as it reads: the ranks of its words in order, and how many of them a window must have in that order.
        self.readings = [([rank[w] for w in words], max(1, math.ceil(threshold * len(words) - 1e-9))) for _, words in texts]
        opening: dict[int, list[tuple[int, int]]] = {}
        for i, (label, words) in enumerate(sets):
            ranks = np.array(sorted(rank[w] for w in words))
            need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            self.templates.append((label, ranks, need))
            for position, r in enumerate(ranks[: len(ranks) - need + 1].tolist()):
                opening.setdefault(r, []).append((i, position))
        self.opening = opening
        self.is_opening = np.zeros(len(order) + 1, dtype=bool)
        self.is_opening[list(opening)] = True

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each word, or one past the last for words of no template."""
        at = np.searchsorted(self.vocabulary, hashes)
        out = np.full(len(hashes), len(self.vocabulary), dtype=np.int64)
        if len(self.vocabulary):
            at = np.minimum(at, len(self.vocabulary) - 1)
            known = self.vocabulary[at] == hashes
            out[known] = self.rank[at[known]]
        return out

    def matches(self, ranks: np.ndarray) -> dict[str, float]:
        """Label and containment of each template that a block of these ranks meets."""
        have = np.unique(ranks[ranks < len(self.vocabulary)])
        seen: set[int] = set()
        found: dict[str, float] = {}
        for place, r in enumerate(have.tolist()):
            for i, position in self.opening.get(r, ()):
                if i in seen:
                    continue
                seen.add(i)
                label, own, need = self.templates[i]
                if len(have) < need or 1 + min(len(own) - position - 1, len(have) - place - 1) < need:
                    continue
                shared = len(np.intersect1d(own, have, assume_unique=True))
                if shared >= need:
                    found[label] = max(found.get(label, 0.0), shared / len(own))
        return found

    def wrapped(self, ranks: np.ndarray, line: np.ndarray, hits: np.ndarray, found: dict[str, float]) -> None:
        """Add to ``found`` what windows over line feeds of one text meet; ``line`` is the line of each word, ``hits`` are its words that open templates."""
        reach: dict[int, list[list[int]]] = {}
        for h in hits.tolist():
            for i, _ in self.opening[int(ranks[h])]:
                n = len(self.readings[i][0])
                low, high = max(0, h - n + 1), min(len(ranks), h + n)
                if line[low] == line[high - 1]:
                    continue
                spans = reach.setdefault(i, [])
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = high
                else:
                    spans.append([low, high])
        for i, spans in reach.items():
            label, own, need = self.templates[i]
            reading, in_order = self.readings[i]
            for low, high in spans:
                at = low + np.flatnonzero(np.isin(ranks[low:high], own))
                ends = np.searchsorted(at, at + len(reading))
                for a, b in enumerate(ends.tolist()):
                    if b - a < need or line[at[a]] == line[at[b - 1]]:
                        continue
                    window = ranks[at[a:b]].tolist()
                    score = len(set(window)) / len(own)
                    if len(set(window)) >= need and score > found.get(label, 0.0) and _in_order(reading, window) >= in_order:
                        found[label] = score

    def scan(self, column: pa.Array) -> dict[str, list]:
        out: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")}
        for block in blocks(column):
            words = Words(block)
            n = block.n
            base: dict[int, tuple[list[int], set[str]]] = {}
            for phrase, label in self.phrases:
                for at in _phrase_places(words, phrase).tolist():
                    row = int(np.searchsorted(words.first, at, side="right")) - 1
                    places, labels = base.setdefault(row, ([], set()))
                    places.append(at - int(words.first[row]))
                    labels.add(label)
            ranks = self.ranks(words.hash)
            hits = np.flatnonzero(self.is_opening[ranks])
            own: dict[int, dict[str, float]] = {}
            if len(hits):
                breaks = np.union1d(np.flatnonzero(block.data == 10), block.offsets)
                line = np.searchsorted(breaks, words.start[hits], side="right")
                for i in np.unique(line).tolist():
                    low, high = np.searchsorted(words.start, (breaks[i - 1], breaks[i] if i < len(breaks) else len(block.data)))
                    found = self.matches(ranks[low:high])
                    if found:
                        row = int(np.searchsorted(block.offsets, breaks[i - 1], side="right")) - 1
                        best = own.setdefault(row, {})
                        for label, x in found.items():
                            best[label] = max(best.get(label, 0.0), x)
                for row in np.unique(np.searchsorted(words.first, hits, side="right") - 1).tolist():
                    low, high = words.first[row], words.first[row + 1]
                    mine = hits[slice(*np.searchsorted(hits, (low, high)))] - low
                    found = own.get(row, {})
                    self.wrapped(ranks[low:high], np.searchsorted(breaks, words.start[low:high], side="right"), mine, found)
                    if found:
                        own[row] = found
            out["n_words"] += words.counts().tolist()
            for row in range(n):
                places, labels = base.get(row, ([], set()))
                found = own.get(row, {})
                out["n_base"].append(len(places))
                out["first_word"].append(min(places, default=None))
                out["last_word"].append(max(places, default=None))
                out["base_labels"].append(",".join(sorted(labels)))
                out["labels"].append(",".join(sorted(labels | set(found))))
                out["score"].append(max(found.values(), default=0.0))
        return out


def word_frequencies(documents: DataFrame, templates) -> dict[int, int]:
    """In how many texts of the whole corpus each template word stands (at most one row per word)."""
    probe = Scanner(templates, (), 1.0)
    vocabulary = probe.vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, dtype=np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                words = Words(block)
                at = np.minimum(np.searchsorted(vocabulary, words.hash), max(len(vocabulary) - 1, 0))
                known = np.flatnonzero(vocabulary[at] == words.hash) if len(vocabulary) else np.zeros(0, dtype=int)
                row = np.searchsorted(words.first, known, side="right")
                pairs = np.unique(row * np.int64(len(vocabulary) + 1) + at[known])
                total += np.bincount(pairs % (len(vocabulary) + 1), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"word": some.astype(np.int64), "n": total[some]})

    counted = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word long, n long")
    return {int(vocabulary[r.word]): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def license_scan(
    documents: DataFrame,
    templates=TEMPLATES,
    phrases=BASE_PHRASES,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Labels, phrase places and best template containment of every text.

    Null and empty texts have no words, no label and score 0. Repeated rows each
    give a row. Columns other than ``id_col`` and ``text_col`` are ignored, so
    their names cannot clash. Score: the greatest containment among the blocks
    that meet the threshold, else 0.
    """
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanner = Scanner(templates, phrases, threshold, word_frequencies(source, templates))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scanner.scan(batch.column(1))
            types = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, type=types.get(k, pa.int64())) for k, v in found.items())],
                names=["doc_id", *found],
            )

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(scan, f"doc_id {id_type}, {SCHEMA}")
