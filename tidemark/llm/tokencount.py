"""Token counts of whole texts under a unigram tokenizer, by count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic
programming carries, per position, the best score and the number of pieces, and
no path. Ties follow the tokenizer: candidates of one end position are compared
from the earliest start, and only a greater score replaces one; a character that
no single-character piece covers costs the least score minus 10, and a run of
such characters is one unknown piece. Pieces never cross white space (the
tokenizer cuts there and marks each word's begin), so a word's count is worked
out once per worker and then looked up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.hashmap import HashMap64
from tidemark.llm.segments import Points, hashes, white_words
from tidemark.llm.text import blocks

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 1 << 20


@lru_cache(maxsize=2)
def unigram_vocabulary(model_path: str) -> tuple[tuple[str, float], ...]:
    """(piece, score) from a sentencepiece model's ordinary pieces, the unknown piece first.

    The public models of this kind hold merge ranks, not log probabilities; a piece
    of rank r gets log(1 / (r + 10)), Zipf's law, so that scores order as ranks do.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return (("<unk>", 0.0), *((model.id_to_piece(i), -math.log(r + 10)) for r, i in enumerate(kept)))


class CountOnlyViterbi:
    """Piece counts of single words (given with their mark)."""

    def __init__(self, vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if i and piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY

    def count(self, word: str) -> int:
        n = len(word)
        score, pieces, ends_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(word):  # of one end, longest first: earliest start first
            matches[end + 1].append(match)
        for end in range(1, n + 1):
            best = count = None
            single = unknown = False
            for length, own in matches[end]:
                start = end - length
                single |= length == 1
                x = own + score[start]
                if best is None or x > best:
                    best, count, unknown = x, pieces[start] + 1, False
            if not single:
                x = self.unknown + score[end - 1]
                if best is None or x > best:
                    best, unknown = x, True
                    count = pieces[end - 1] + (not ends_unknown[end - 1])
            score[end], pieces[end], ends_unknown[end] = best, count, unknown
        return pieces[n]


class Counter:
    """Counts of all words of a block, remembered by word."""

    def __init__(self, vocabulary):
        self.viterbi = CountOnlyViterbi(vocabulary)
        self.map, self.pieces = HashMap64(16), np.zeros(1 << 16, dtype=np.int64)

    def word(self, word: str) -> int:
        """Pieces of a word; a mark inside it begins a word of its own, as in the tokenizer."""
        if MARK not in word:
            return self.viterbi.count(MARK + word)
        head, *rest = word.split(MARK)
        return sum(self.viterbi.count(MARK + x) for x in ([head] if head else []) + rest)

    def block(self, block) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        begin, end, first = white_words(Points(block))
        keys = np.maximum(hashes(block.data, begin, end), np.uint64(1))
        if self.map.n > REMEMBERED:
            self.map, self.pieces = HashMap64(16), np.zeros(1 << 16, dtype=np.int64)
        numbers = self.map.find(keys)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            distinct, at = np.unique(keys[new], return_index=True)
            raw = block.data.tobytes()
            counts = [self.word(raw[begin[i] : end[i]].decode("utf-8")) for i in new[at].tolist()]
            while self.map.n + len(counts) > len(self.pieces):
                self.pieces = np.concatenate([self.pieces, np.zeros_like(self.pieces)])
            self.pieces[self.map.n : self.map.n + len(counts)] = counts
            self.map.add(distinct)
            numbers[new] = self.map.find(keys[new])
        total = np.concatenate([[0], np.cumsum(self.pieces[numbers])])
        return np.diff(first), np.diff(total[first])


def token_counts(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words and tokens of every text: doc_id, n_words, n_tokens.

    Null, empty and blank texts have 0 of both. Repeated rows each give a row.
    Columns other than the two named are ignored, so their names cannot clash.
    """
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(unigram_vocabulary(model_path))
        for batch in batches:
            found = [counter.block(block) for block in blocks(batch.column(1))]
            words, tokens = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.astype(np.int64)), pa.array(tokens.astype(np.int64))], names=["doc_id", "n_words", "n_tokens"])

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(count, f"doc_id {id_type}, n_words long, n_tokens long")
