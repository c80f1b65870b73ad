"""Classes of similar nodes from shared buckets, without a large bucket's all pairs.

A node is a set of tokens, and its sketch holds in each bit whether an odd number of
its tokens fell there. The bits in which two sketches differ are never more than the
tokens in one of the two sets only, so a pair whose sketches differ in too many is
below the threshold for certain. Each node meets its best hub first (the node of its
buckets that shares most buckets with others), then buckets of at most ``TOGETHER`` nodes give
all pairs that pass this and are still in two classes: few pairs need their tokens.

Larger buckets follow, with the classes found so far. Every group of their nodes (first: the
buckets that share a hub, the node that shares most buckets with others) is compared with its hub, one
pair a member. What the hub does not link is then told apart by what it does not
share with the hub: with D(A) = A xor hub, |A xor B| = |D(A) xor D(B)|, and

    jaccard(A, B) >= t   if and only if   |A xor B| <= c (|A| + |B|),  c = (1 - t) / (1 + t),

so A and B must share (v(A) + v(B)) / 2 tokens of their differences, v(A) = |D(A)| - c |A|.
A member that the hub doesn't link has v > c |hub|, so that is above 0 unless the hub
links both. Hence two members that belong together share a token among the first
|D| - s + 1 of each, in an order common to the group, rarest first, where s is what a
member must share with any partner (groups of a few members are compared without that). Nor can they share more than either has tokens
which others of the group have as well. The members that open with one token are cut
down by these bounds; where few are left of one of the two kinds, pairs that meet the
bounds are compared, else they become a group with a hub of its own, and so on until
no group holds two classes. Each group lacks its parent's hub, so this ends. Rows grow
with the members, whatever the sizes of the groups: copies that are merely akin (a
large group just below the threshold) differ from their hub each in their own way and
meet nobody. No pair at or above the threshold is lost.

What is stored and shuffled of a node is its content, a text as it stands; its tokens, several times as
large, are made in the task that compares it. The comparisons with best hubs take the nodes by
a hash of the hub, a part at a time, so that a part of the contents is shuffled at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.storage import ONE_TASK, Scratch
from tidemark.llm.text import mix

#: Shared buckets that may be broadcast to pick their members (some 64 bytes each in memory, 32 MB in all); beyond, members are shuffled to them.
BROADCAST_BUCKETS = 500_000
#: Pairs of nodes that may be broadcast to fetch their tokens (some 100 bytes each in memory); beyond, tokens are shuffled to them.
BROADCAST_PAIRS = 300_000
#: Members that a group may have to be compared pair by pair, and partners that a member may meet by one token; larger groups get a hub.
FEW, PARTNERS = 8, 32
#: Nodes that a bucket may have to give all its pairs whose sketches allow it; larger buckets get a hub.
TOGETHER = 512
#: Longs of a node's sketch.
SKETCH = 16
#: Rows of shared buckets that are worked on at once; more are taken table by table.
AT_ONCE = 1_000_000
#: Nodes whose contents are shuffled at a time to meet their hubs, and parts that nodes or pairs are cut into at most (a part then grows with the input).
TOGETHER_NODES, PARTS = 200_000, 16
#: Rows whose tokens a task holds at a time.
ROWS_AT_ONCE = 1000
#: Tokens of each of some contents.
Sets = Callable[[pa.Array], list[np.ndarray]]
_U = np.uint64


class _Classes:
    """The classes so far, as (node, root) of the nodes in classes of two or more."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.roots = scratch, None

    def of(self, df: DataFrame, node: str, out: str) -> DataFrame:
        if self.roots is None:
            return df.withColumn(out, F.col(node))
        label = self.roots.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        return df.join(label, df[node] == label["__n"], "left").withColumn(out, F.coalesce("__r", node)).drop("__n", "__r")

    def link(self, edges: DataFrame) -> None:
        """Unite the classes of ``edges`` (a, b)."""
        joined = self.of(self.of(edges, "a", "__a"), "b", "__b").select(F.col("__a").alias("a"), F.col("__b").alias("b")).where("a <> b")
        found = connected_components(joined, self.scratch)
        if self.roots is None:
            self.roots = self.scratch.gather(found)
            return
        moved = self.scratch.gather(found)
        step = moved.select(F.col("node").alias("root"), F.col("root").alias("__to"))
        relabelled = self.roots.join(step, "root", "left").select("node", F.coalesce("__to", "root").alias("root"))
        before, self.roots = self.roots, self.scratch.gather(relabelled.unionByName(moved.join(self.roots.select("node"), "node", "left_anti")))
        self.scratch.drop(before, moved)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Of each set of distinct tokens the parities of how many fall on each bit, as sets x ``SKETCH`` longs."""
    bits = 64 * SKETCH
    out = np.zeros((len(sets), SKETCH), dtype=np.int64)
    for i in range(0, len(sets), 256):
        some = sets[i : i + 256]
        row = np.repeat(np.arange(len(some)), [len(x) for x in some])
        bit = (mix(np.concatenate(some).astype(np.int64, copy=False).view(_U)) % _U(bits)).astype(np.int64)
        odd = (np.bincount(row * bits + bit, minlength=len(some) * bits) & 1).astype(np.uint8).reshape(len(some), bits)
        out[i : i + 256] = np.packbits(odd, axis=1).view(np.int64)
    return out


def listed(column: pa.Array) -> list[np.ndarray]:
    """The tokens of contents that are lists of them."""
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    return np.split(np.asarray(column.flatten()), np.cumsum(sizes)[:-1]) if len(sizes) else []


def _sets(column: pa.Array, sets: Sets) -> list[np.ndarray]:
    """``sets`` of a column, once for contents that stand there again."""
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        return sets(column)
    coded = column.dictionary_encode()
    found = sets(coded.dictionary)
    return [found[i] for i in coded.indices.to_pylist()]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(i, ROWS_AT_ONCE)


NODE = "struct<h1: bigint, h2: bigint>"


def _sketched(found: DataFrame, sets: Sets) -> DataFrame:
    """(node, hub, size, sketch, content) of (node, hub, content): the number of tokens, and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            tokens = _sets(batch.column(2), sets)
            flat = sketches(tokens).reshape(-1)
            offsets = pa.array(np.arange(0, len(flat) + 1, SKETCH, dtype=np.int32))
            columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in tokens], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat)), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "hub", "size", "sketch", "content"])

    kind = found.schema["content"].dataType.simpleString()
    return found.select("node", "hub", "content").mapInArrow(run, f"node {NODE}, hub {NODE}, size int, sketch array<bigint>, content {kind}")


def _compared(faced: DataFrame, sets: Sets) -> DataFrame:
    """(hub, node, nh, nn, d) of (hub, node, x, y): the sizes, and how many tokens stand in one of the two contents only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            xs, ys = _sets(batch.column(2), sets), _sets(batch.column(3), sets)
            nh, nn = (np.array([len(x) for x in side], dtype=np.int32) for side in (xs, ys))
            same = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(xs, ys, strict=True)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nh), pa.array(nn), pa.array(nh + nn - 2 * same)], names=["hub", "node", "nh", "nn", "d"])

    return faced.select("hub", "node", "x", "y").mapInArrow(run, f"hub {NODE}, node {NODE}, nh int, nn int, d int")


def _different(faced: DataFrame, sets: Sets) -> DataFrame:
    """(of, m, long, t) of (of, m, long, x, y): a row for each token that stands in one of the two contents only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            apart = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(_sets(batch.column(3), sets), _sets(batch.column(4), sets), strict=True)]
            at = pa.array(np.repeat(np.arange(len(apart)), [len(x) for x in apart]))
            tokens = np.concatenate(apart).view(np.int64) if apart else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(tokens)], names=["of", "m", "long", "t"])

    return faced.select("of", "m", "long", "x", "y").mapInArrow(run, "of bigint, m bigint, long bigint, t bigint")


def _at_least(x: Column) -> Column:
    """The least count of shared tokens that ``x`` asks for, one at the least."""
    return F.greatest(F.ceil(x - 1e-6), F.lit(1)).cast("long")


def _bounded(rows: DataFrame, key: list[str], kind: str, partner: str, out: str) -> DataFrame:
    """``rows`` with ``out``: of the kind, and within the bounds of the partners that open with the same token."""
    other = rows.where(partner).groupBy(*key, "t").agg(F.min("v").alias("__v"), F.max("most").alias("__most"))
    fits = F.col(kind) & (F.col("most") >= F.col("__v")) & (F.col("v") <= F.col("__most"))
    return rows.join(other, [*key, "t"], "left").withColumn(out, F.coalesce(fits, F.lit(False))).drop("__v", "__most")


def similar_classes(members: Iterable[DataFrame], fetch: Callable[[DataFrame, int], DataFrame | Iterable[DataFrame]], threshold: float, scratch: Scratch, sets: Sets | None = None) -> DataFrame:
    """(node, root) of the nodes in classes of two or more.

    ``members``: bucket, h1, h2, from written tables, for they are read twice; a node is
    the struct of h1 and h2. Tables are taken one by one, so the disk holds one's rows
    at a time; no bucket is in two. ``fetch`` gets the nodes that share a bucket with their best hubs
    (node, hub), and how many they are, and gives (node, hub, content), as one table or as several, which
    are written one by one. It is called once. ``sets`` makes the tokens of contents, distinct
    longs whose Jaccard similarity links nodes; without it, fetch's third column has them.
    """
    parts = []
    for part in members:
        sizes = scratch.put(part.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
        few = sizes.count() <= BROADCAST_BUCKETS
        scratch.sweep()
        parts.append(scratch.put(part.join(F.broadcast(sizes) if few else sizes, "bucket").select("bucket", F.struct("h1", "h2").alias("node"), "n")))
        scratch.drop(sizes)
        scratch.sweep()
    shared = reduce(DataFrame.unionByName, parts)
    degree = scratch.gather(shared.groupBy("node").agg(F.sum("n").alias("degree")))
    spokes = []
    for some in [shared] if shared.count() <= AT_ONCE else parts:
        hubs = some.select("bucket", "node").join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("top"))
        met = some.select("bucket", "node", (F.col("n") > TOGETHER).alias("large")).join(hubs, "bucket").where("node <> top.node")
        spokes.append(scratch.put(met.groupBy("node", "top").agg(F.max("large").alias("large"))))
        scratch.sweep()
    every = reduce(DataFrame.unionByName, spokes)
    best = every.groupBy("node").agg(F.max("top").alias("top")).select("node", F.col("top.node").alias("hub"))
    wanted = scratch.gather(degree.select("node").join(best, "node", "left"))
    groups = scratch.gather(every.where("large").select(F.lit(0).cast("long").alias("g"), F.col("top.node").alias("hub"), "node").distinct())
    scratch.drop(degree, *spokes)
    nodes = wanted.count()
    scratch.sweep()
    found = fetch(wanted, nodes)
    texts = []
    for one in [found] if isinstance(found, DataFrame) else found:
        own = "tokens" if sets is None else "content"
        texts.append(scratch.put(_sketched(one.withColumnRenamed(own, "content"), sets or listed), compression="zstd"))
        scratch.sweep()
    contents = reduce(DataFrame.unionByName, texts)
    sets = sets or listed
    sketch_of = contents.select("node", "size", "sketch")
    t = threshold - 1e-9
    c = (1 - t) / (1 + t)
    classes = _Classes(scratch)

    def cut(df: DataFrame, by: str, part: int, of: int) -> DataFrame:
        return df if of == 1 else df.where(F.pmod(F.xxhash64(by), F.lit(of)) == part)

    def in_parts(of: int, make: Callable[[int], DataFrame]) -> DataFrame:
        """What ``make`` gives for each part, as one table; the shuffled rows of one part go before the next."""
        if of == 1:
            return scratch.gather(make(0))
        made = []
        for part in range(of):
            made.append(scratch.put(make(part)))
            scratch.sweep()
        out = scratch.gather(reduce(DataFrame.unionByName, made))
        scratch.drop(*made)
        return out

    def facing(pairs: DataFrame, n: int) -> DataFrame:
        """About ``n`` pairs, from a written table, with the contents of hub (x) and node (y)."""
        hub, node = contents.select(F.col("node").alias("hub"), F.col("content").alias("x")), contents.select("node", F.col("content").alias("y"))
        if n > BROADCAST_PAIRS:
            return pairs.join(node, "node").join(hub.join(pairs.select("hub").distinct(), "hub", "left_semi"), "hub")
        return node.join(F.broadcast(pairs), "node").join(hub.join(F.broadcast(pairs.select("hub").distinct()), "hub", "left_semi"), "hub")

    def faced(pairs: DataFrame, make: Callable[[DataFrame, Sets], DataFrame]) -> DataFrame:
        n = pairs.count()
        of = max(1, min(PARTS, -(-n // BROADCAST_PAIRS)))
        return in_parts(of, lambda part: make(facing(cut(pairs, "hub", part, of), n // of), sets))

    def measured(pairs: DataFrame) -> DataFrame:
        """(hub, node, nh, nn, d): the sizes, and how many tokens stand in one of the two only."""
        pairs = scratch.gather(pairs)
        found = faced(pairs, _compared)
        scratch.drop(pairs)
        return found

    linked = F.col("d") <= c * (F.col("nn") + F.col("nh"))

    def link(pairs: DataFrame) -> None:
        classes.link(pairs.where(linked).select(F.col("hub").alias("a"), F.col("node").alias("b")))

    def allowed(x: str, y: str) -> Column:
        """Whether sizes and sketches of two nodes leave room for the threshold."""
        differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{x}_sketch")[i].bitwiseXOR(F.col(f"{y}_sketch")[i])) for i in range(SKETCH)))
        return F.greatest(F.abs(F.col(f"{x}_size") - F.col(f"{y}_size")), differ) <= c * (F.col(f"{x}_size") + F.col(f"{y}_size"))

    # Each node meets its best hub first: most buckets are of one class after that.
    tops = wanted.select("hub").where("hub is not null").distinct()
    of_hub = contents.select(F.col("node").alias("hub"), F.col("size").alias("hub_size"), F.col("sketch").alias("hub_sketch"), F.col("content").alias("x"))
    of_node = contents.where("hub is not null").select("node", "hub", F.col("size").alias("node_size"), F.col("sketch").alias("node_sketch"), F.col("content").alias("y"))
    of = max(1, min(PARTS, -(-nodes // TOGETHER_NODES)))

    def meeting(part: int) -> DataFrame:
        own = cut(tops, "hub", part, of)
        met = cut(of_hub, "hub", part, of).join(F.broadcast(own) if nodes <= BROADCAST_PAIRS else own, "hub", "left_semi")
        return _compared(cut(of_node, "hub", part, of).join(met, "hub").where(allowed("hub", "node")), sets)

    first = in_parts(of, meeting)
    link(first)
    scratch.drop(first)
    # Then the pairs of the smaller buckets that are still in two classes.
    rooted = scratch.put(classes.of(wanted.select("node"), "node", "root"))
    edges, bucket = [], Window.partitionBy("bucket")
    several = reduce(lambda a, b: a | b, (F.min(f"root.{x}").over(bucket) != F.max(f"root.{x}").over(bucket) for x in ("h1", "h2")))
    for part in [shared] if shared.count() <= AT_ONCE else parts:
        near = part.where(F.col("n") <= TOGETHER).select("bucket", "node").join(rooted, "node")
        near = scratch.put(near.withColumn("several", several).where("several").select("bucket", "node", "root"))
        scratch.sweep()
        sketched = near.join(sketch_of, "node")
        p, q = (sketched.select("bucket", *(F.col(x).alias(f"{side}_{x}") for x in ("node", "root", "size", "sketch"))) for side in ("p", "q"))
        met = p.join(q, "bucket").where((F.col("p_node") < F.col("q_node")) & (F.col("p_root") != F.col("q_root")) & allowed("p", "q"))
        edges.append(scratch.put(met.select(F.col("p_node").alias("hub"), F.col("q_node").alias("node")).distinct()))
        scratch.drop(near)
        scratch.sweep()
    scratch.drop(*parts, rooted, wanted)
    link(measured(reduce(DataFrame.unionByName, edges).distinct()))
    scratch.drop(*edges)
    # Last the larger ones.
    key = ["g", "hub"]
    while True:
        rooted = classes.of(classes.of(groups, "node", "root"), "hub", "hub_root")
        mixed = rooted.groupBy(*key).agg(F.max((F.col("root") != F.col("hub_root")).cast("int")).alias("m")).where("m = 1").drop("m")
        live = scratch.gather(groups.join(mixed, key))
        scratch.drop(groups)
        if live.isEmpty():
            break
        seen = measured(live.select("hub", "node").distinct())
        link(seen)
        rows = classes.of(classes.of(live.join(seen, ["hub", "node"]), "node", "root"), "hub", "hub_root")
        # By the triangle inequality a member too far from the hub has no partner that the hub links.
        near = F.col("d") <= c * (F.col("nn") + (1 + 2 / t) * F.col("nh"))
        rows = rows.select(*key, "node", "root", "nn", "nh", "d", (~linked).alias("apart"), (~linked & near & (F.col("root") != F.col("hub_root"))).alias("seeker"))
        rows = scratch.gather(rows)
        wants = rows.groupBy(*key).agg(
            F.min(F.when(F.col("seeker"), F.col("d") - c * F.col("nn"))).alias("least"), F.min(F.when(F.col("apart"), F.col("root"))).alias("r0"), F.max(F.when(F.col("apart"), F.col("root"))).alias("r1")
        )
        several = F.coalesce(F.col("r0") != F.col("r1"), F.lit(False))
        reached = F.coalesce((F.col("d") > 0) & (F.col("d") + c * F.col("nn") >= F.col("least") - 1e-6), F.lit(False))
        needed = rows.join(wants, key).where((F.col("apart") & (several | F.col("seeker"))) | (~F.col("apart") & reached)).drop("least", "r0", "r1")
        needed = scratch.gather(needed.withColumn("m", F.monotonically_increasing_id()).withColumn("v", F.col("d") - c * F.col("nn")))
        scratch.drop(live, seen, rows)
        if needed.isEmpty():
            break
        counted = scratch.gather(needed.groupBy(*key).agg(F.count("*").alias("n")))
        some = needed.join(counted.where(F.col("n") <= FEW), key).select(*key, "node", "root", "nn", "d", "apart")
        p, q = (some.select(*key, *(F.col(x).alias(f"{side}_{x}") for x in ("node", "root", "nn", "d", "apart"))) for side in ("p", "q"))
        close = F.abs(F.col("p_d") - F.col("q_d")) <= c * (F.col("p_nn") + F.col("q_nn"))
        pairs = p.join(q, key).where((F.col("p_node") < F.col("q_node")) & (F.col("p_root") != F.col("q_root")) & (F.col("p_apart") | F.col("q_apart")) & close)
        compared = measured(pairs.select(F.col("p_node").alias("hub"), F.col("q_node").alias("node")).distinct())
        link(compared)
        # The others by tokens. What a member shares at least with a partner that is apart from the hub, and with one that the hub links:
        short = F.col("d") - _at_least((F.col("d") + c * (F.col("nh") - F.col("nn"))) / 2) + 1
        long = F.when(F.col("seeker"), F.col("d") - _at_least((F.col("d") - c * (F.col("nn") + F.col("nh"))) / 2) + 1).otherwise(short)
        many = scratch.gather(needed.join(counted.where(F.col("n") > FEW).drop("n"), key).withColumns({"short": short, "long": long}))
        scratch.drop(needed, counted, compared)
        if many.isEmpty():
            break
        each = faced(many.select("hub", "node", F.xxhash64(*key).alias("of"), "m", "long"), _different)
        frequency = each.groupBy("of", "t").agg(F.count("*").alias("n"))
        own = Window.partitionBy("m")
        ranked = each.join(frequency, ["of", "t"]).withColumn("i", F.row_number().over(own.orderBy("n", "t"))).withColumn("e", F.sum((F.col("n") > 1).cast("int")).over(own))
        ranked = ranked.where("n > 1 and i <= long").select("m", "t", "i", "e").join(many.select(*key, "m", "node", "root", "apart", "seeker", "short", "v"), "m")
        first = F.col("i") <= F.col("short")
        opening = ranked.select(
            *key, "t", "node", "root", "v", (2 * F.col("e") - F.col("v") + 1e-6).alias("most"), (~F.col("apart") & first).alias("hubs"), "seeker", (F.col("apart") & first).alias("own")
        )
        opening = scratch.gather(opening)
        # v(A) + v(B) is at most twice what either can share: v(A) <= most(B).
        fits = _bounded(_bounded(_bounded(opening, key, "hubs", "seeker", "h"), key, "seeker", "hubs", "s"), key, "own", "own", "o")
        fits = scratch.gather(fits.select(*key, "t", "node", "root", "v", "most", F.col("h").alias("hubs"), F.col("s").alias("seeker"), F.col("o").alias("own")).where("hubs or seeker or own"))
        kinds = fits.groupBy(*key, "t").agg(
            F.count_if("hubs").alias("n_hubs"), F.count_if("seeker").alias("n_seekers"), F.count_if("own").alias("n_own"), F.min(F.when(F.col("own"), F.col("root"))).alias("r0"), F.max(F.when(F.col("own"), F.col("root"))).alias("r1")
        )
        met = fits.join(kinds.where("n_hubs * n_seekers > 0 or r0 <> r1"), [*key, "t"])
        met = met.withColumn("own", F.col("own") & several).withColumn("hubs", F.expr("hubs and n_seekers > 0")).withColumn("seeker", F.expr("seeker and n_hubs > 0")).where("hubs or seeker or own")
        few = F.least("n_hubs", "n_seekers") <= PARTNERS
        met = scratch.gather(met.select(*key, "t", "node", "root", "v", "most", "hubs", "seeker", "own", (few & ((F.col("n_own") <= PARTNERS) | ~several)).alias("few")))
        one, two = (met.where("few").select(*key, "t", *(F.col(x).alias(f"{side}_{x}") for x in ("node", "root", "v", "most", "hubs", "seeker", "own"))) for side in ("p", "q"))
        meant = (F.col("p_hubs") & F.col("q_seeker")) | (F.col("p_own") & F.col("q_own") & (F.col("p_node") < F.col("q_node")))
        pairs = one.join(two, [*key, "t"]).where(meant & (F.col("p_root") != F.col("q_root")) & (F.col("p_v") <= F.col("q_most")) & (F.col("q_v") <= F.col("p_most")))
        candidates = measured(pairs.select(F.col("p_node").alias("hub"), F.col("q_node").alias("node")).distinct())
        link(candidates)
        subs = scratch.gather(met.where("not few").select(*key, "t", "node"))
        scratch.drop(many, each, opening, fits, met, candidates)
        if subs.isEmpty():
            break
        share = subs.groupBy(*key, "node").agg(F.count("*").alias("degree"))
        tops = subs.join(share, [*key, "node"]).groupBy(*key, "t").agg(F.max(F.struct("degree", "node")).alias("top"))
        groups = subs.join(tops, [*key, "t"]).where("node <> top.node").select(F.xxhash64(*key).alias("g"), F.col("top.node").alias("hub"), "node").distinct()
        groups = scratch.gather(groups)
        scratch.drop(subs)
    scratch.drop(*texts)
    scratch.sweep()
    return classes.roots
