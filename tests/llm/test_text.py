"""The vectorised kernels against plain Python."""

import random
import re

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm.bagminhash import signatures
from tidemark.llm.hashmap import HashMap64
from tidemark.llm.packing import WordIds, best_fit_decreasing, lower_bound
from tidemark.llm.text import Words, blocks, encode, mix, shingles
from tidemark.llm.tokencount import Counter as TokenCounter, unigram_vocabulary

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def some_texts(seed, n=400, alphabet="abC 'sdé中😀\n\r\t.,<|!9\x85▁"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", None, "a", " ", "x" * 5000]


@pytest.mark.parametrize("limit", [1, 64, 1 << 20])
def test_words_match_the_pattern(limit):
    texts = some_texts(1)
    got = []
    for block in blocks(encode(texts), limit):
        words = Words(block)
        for i in range(block.n):
            got.append([words.text(j).decode() for j in range(words.first[i], words.first[i + 1])])
    assert got == [re.findall(WORD, lower(t or "")) for t in texts]


def test_shingles_are_equal_iff_words_are():
    texts = ["a b c d e f", "A, b c-d e", "b c d e f", "a b", "a b", "b a", ""]
    block = next(blocks(encode(texts)))
    hashes, starts = shingles(Words(block), 5, short=True)
    sets = [set(hashes[starts[i] : starts[i + 1]].tolist()) for i in range(len(texts))]
    assert len(sets[0]) == 2 and sets[1] < sets[0] and sets[2] < sets[0] and sets[1] != sets[2]
    assert sets[3] == sets[4] != sets[5] and not sets[6]
    assert np.diff(shingles(Words(block), 5, short=False)[1]).tolist() == [2, 1, 1, 0, 0, 0, 0]


def test_hash_map_against_a_dict():
    rng = np.random.default_rng(0)
    table, plain = HashMap64(4), {}
    for _ in range(20):
        keys = np.unique(rng.integers(1, 5000, 300).astype(np.uint64))
        keys = keys[table.find(keys) < 0]
        for k in keys.tolist():
            plain[k] = len(plain)
        table.add(keys)
    asked = np.arange(1, 6000, dtype=np.uint64)
    assert table.find(asked).tolist() == [plain.get(k, -1) for k in asked.tolist()]


def test_ids_are_the_tokenizers():
    words = WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for t in some_texts(2, 3000)] + ["it's we're l'eau he'll 'd''s 's", "<|endoftext|> a", "tail  \n\n "]
    want = [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for b in blocks(encode(texts), 512) for i in words.block(b)] == want


def test_counts_are_the_unigram_tokenizers():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = unigram_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    tokenizer = Tokenizer(models.Unigram(list(vocabulary), unk_id=0, byte_fallback=False))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    texts = [t or "" for t in some_texts(3, 2000)]
    counter = TokenCounter(vocabulary)
    assert [n for b in blocks(encode(texts), 512) for n in counter.block(b)[1].tolist()] == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = {i: int(w) for i, w in enumerate(rng.integers(1, 40, 60))}
    b = {i: (w if rng.random() < 0.7 else int(rng.integers(1, 40))) for i, w in a.items()} | {1000: 3}
    elements = mix(np.array([*a, *b], dtype=np.uint64) + np.uint64(7))
    rows = np.array([0] * len(a) + [1] * len(b))
    signature = signatures(rows, elements, np.array([*a.values(), *b.values()]), 3, 8192)
    keys = set(a) | set(b)
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    assert abs((signature[0] == signature[1]).mean() - true) < 0.02
    assert np.isinf(signature[2]).all() and np.isfinite(signature[:2]).all()


def test_best_fit_decreasing_is_valid_and_bounded():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(1, 100, rng.integers(1, 300))
        bins, offsets, used = best_fit_decreasing(lengths, 100)
        fill = np.bincount(bins, weights=lengths, minlength=used)
        assert fill.max() <= 100 and len(set(bins.tolist())) == used >= lower_bound(np.bincount(lengths, minlength=101), 100) >= -(-lengths.sum() // 100)
        for b in range(used):
            own = np.argsort(offsets[bins == b])
            spans = sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist()))
            assert [s for s, _ in spans] == np.concatenate([[0], np.cumsum([n for _, n in spans])[:-1]]).tolist() and len(own)


def test_lower_bound_never_exceeds_the_optimum():
    def optimum(sizes, capacity):
        best = len(sizes)

        def place(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(sizes):
                best = len(rooms)
                return
            for j in range(len(rooms)):
                if rooms[j] >= sizes[i]:
                    rooms[j] -= sizes[i]
                    place(i + 1, rooms)
                    rooms[j] += sizes[i]
            place(i + 1, [*rooms, capacity - sizes[i]])

        place(0, [])
        return best

    rng = random.Random(4)
    for _ in range(40):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        assert lower_bound(np.bincount(sizes, minlength=21), 20) <= optimum(sizes, 20)


