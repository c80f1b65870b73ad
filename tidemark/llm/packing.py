"""Sequences of at most 2048 tokens by bound-certified best-fit-decreasing packing.

Texts are tokenised where they lie (a word's ids are looked up once per worker:
byte-level BPE never joins pre-tokens, so ids of equal pre-tokens are equal), and
cut into pieces. Pieces of full length are sequences. The rest is dealt to
partitions of bounded size, each packed best-fit-decreasing; dual feasible
functions give a lower bound that certifies a partition's bin count. Partitions
with a gap give their bins that aren't full, and certified ones their least full
bin, to an exchange, whose documents are dealt anew and packed again, until one
partition is left or a round saves nothing.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.hashmap import HashMap64
from tidemark.llm.segments import Points, byte_level_bounds, hashes
from tidemark.llm.storage import Scratch
from tidemark.llm.text import Block, blocks

CAPACITY = 2048
#: Pieces that one task packs.
PACKED = 40_000
#: Distinct pre-tokens that a worker remembers.
REMEMBERED = 1 << 20
#: Deals in a row that may save nothing before the packing is left as it is.
STALLS = 3


def rank_encoder(path: str):
    """Byte-pair merging of one pre-token, faster than through whole encodings.

    Reads the same file. None unless it is a byte-level BPE whose merges stand in
    the order of the ids they make, for then merging by least id is merging by rank.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    if model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or made != sorted(set(made)) or -1 in made:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    wanted = set(made) | {model["vocab"].get(c, -1) for c in byte_of}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if i in wanted}
    if -1 in wanted or max(model["vocab"][c] for c in byte_of) > min(made, default=256):
        return None
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class WordIds:
    """Token ids of whole texts, exactly as the tokenizer gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_rank = rank_encoder(path)
        self._forget()

    def _forget(self) -> None:
        self.map, self.size = HashMap64(16), 0
        self.ids, self.start, self.count = np.zeros(1 << 16, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        found = [self.by_rank(x) for x in texts] if self.by_rank else self._whole(texts)
        count = np.array([len(x) for x in found], dtype=np.int64)
        flat = np.fromiter((i for x in found for i in x), dtype=np.uint32, count=int(count.sum()))
        while self.size + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.size : self.size + len(flat)] = flat
        self.start = np.concatenate([self.start, self.size + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.size += len(flat)
        self.map.add(keys)

    def block(self, block: Block) -> Iterator[np.ndarray]:
        """The ids of each text of a block."""
        data = block.data
        begin, end, first, unsure = byte_level_bounds(Points(block))
        keys = np.maximum(hashes(data, begin, end), np.uint64(1))
        if self.map.n > REMEMBERED:
            self._forget()
        numbers = self.map.find(keys)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            distinct, at = np.unique(keys[new], return_index=True)
            raw = data.tobytes()
            self._learn(distinct, [raw[begin[i] : end[i]].decode("utf-8") for i in new[at].tolist()])
            numbers[new] = self.map.find(keys[new])
        count = self.count[numbers]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.start[numbers] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.concatenate([[0], ends])[first]
        for i in range(block.n):
            if unsure[i]:
                yield np.array(self._whole([data[block.offsets[i] : block.offsets[i + 1]].tobytes().decode("utf-8")])[0], dtype=np.uint32)
            else:
                yield ids[cut[i] : cut[i + 1]]


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces of every text: doc_id, piece, start, length, ids_crc32.

    A text is its ids and then ``end_id``; null texts are empty. Texts longer than
    ``capacity`` are cut into pieces of that length, all but perhaps the first.
    """
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for block in blocks(batch.column(1)):
                for i, ids in enumerate(words.block(block)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    n = len(ids)
                    at, k = 0, (n - 1) % capacity + 1
                    number = 0
                    while at < n:
                        row.append(block.first + i), piece.append(number), start.append(at), length.append(k)
                        crc.append(zlib.crc32(ids[at : at + k]))
                        at, k, number = at + k, capacity, number + 1
            arrays = [batch.column(0).take(pa.array(row, type=pa.int64())), pa.array(piece, type=pa.int32()), *(pa.array(x, type=pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def _sequences(packed: DataFrame) -> int:
    return packed.select("sequence_id").distinct().count()


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions; ``counts``: how many pieces there are of each length.

    f_a (0 <= a <= C/2): C above C - a, 0 below a, else the size; and u_k: the size
    where size * (k + 1) is a multiple of C, else floor(size * (k + 1) / C) / k of C.
    """
    sizes = np.arange(capacity + 1, dtype=np.int64)
    number, total = np.cumsum(counts), np.cumsum(counts * sizes)
    best = 0
    for a in range(0, capacity // 2 + 1):
        large = number[-1] - number[capacity - a]
        middle = total[capacity - a] - (total[a - 1] if a else 0)
        best = max(best, int(large + -(-middle // capacity)))
    for k in range(1, 64):
        scaled = np.where(sizes * (k + 1) % capacity == 0, sizes * k, sizes * (k + 1) // capacity * capacity)
        best = max(best, int(-(-(scaled * counts).sum() // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin and the offset of each length; bins by room are found through a bit set."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            where = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, where, used = capacity, used, used + 1
        bins[i], offsets[i] = where, capacity - room
        room -= size
        if room:
            by_room[room].append(where)
            rooms |= 1 << room
    return bins, offsets, used


def _pack_parts(pool: DataFrame, parts: int, round_: int, capacity: int) -> DataFrame:
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame["length"].to_numpy()
        where, offset, used = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(where, weights=lengths, minlength=used).astype(np.int64)
        part = int(frame["part"].iloc[0])
        # A certified part only gives the room it can't close by itself: its emptiest bins, one in eight. Others give all that aren't full.
        gap = used > lower_bound(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)
        open_ = fill < capacity
        if not gap:
            open_ = np.argsort(np.argsort(fill, kind="stable"), kind="stable") < -(-used // 8)
        return pd.DataFrame({"uid": frame["uid"], "length": lengths, "sequence_id": (round_ << 56) + (part << 24) + where, "offset": offset, "open": open_[where] & (fill < capacity)[where]})

    dealt = pool.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, "uid long, length long, sequence_id long, offset long, open boolean")


def pack_sequences(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece with its sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the one id 0. Repeated rows are packed each for itself.
    An empty table gives no rows. Columns other than the two named are ignored, so
    their names cannot clash. Offsets within a sequence have no gaps. The count is
    certified as least only where it reaches the bound: the exchange also ends after
    ``STALLS`` deals that save nothing, and one part is packed once, as another deal
    of it is the same.
    """
    scratch = Scratch(documents.sparkSession)
    cut = scratch.put(pieces(documents, tokenizer_path, capacity, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()))
    pool = cut.where(F.col("length") < capacity).select("uid", "length")
    histogram = pool.groupBy("length").agg(F.count("*").alias("n")).toPandas()  # at most one row a length
    bound = lower_bound(np.bincount(histogram["length"], weights=histogram["n"], minlength=capacity + 1).astype(np.int64), capacity)
    n, round_, stalls = int(histogram["n"].sum()), 0, 0
    parts = max(1, -(-n // PACKED))
    settled, closed = [], 0
    packed = scratch.put(_pack_parts(pool, parts, round_, capacity))
    used = _sequences(packed)
    # Until the bound certifies the whole, or several deals in a row save nothing.
    while parts > 1 and closed + used > bound and stalls < STALLS:
        still = packed.where("open")
        waiting = _sequences(still)
        pool = scratch.put(still.select("uid", "length"))
        n, round_ = pool.count(), round_ + 1
        if not n:
            break
        again = scratch.put(_pack_parts(pool, max(1, -(-n // PACKED)), round_, capacity))
        needs = _sequences(again)
        if needs >= waiting:
            stalls += 1
            if n <= PACKED:  # one task had them all: another deal is the same
                break
            continue
        stalls = 0
        settled.append(packed.where("not open"))
        closed, used, packed = closed + used - waiting, needs, again
        parts = max(1, -(-n // PACKED))
    settled.append(packed)
    placed = settled[0]
    for more in settled[1:]:
        placed = placed.unionByName(more)
    full = cut.where(F.col("length") == capacity).select("*", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < capacity).join(placed.select("uid", "sequence_id", "offset"), "uid")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return rest.select(columns).unionByName(full.select(columns))
