"""Near duplicates by SimHash: documents whose fingerprints differ in few bits, found with vantage-point trees.

Two fingerprints that differ in at most ``radius`` bits differ in at most half as many in one of their halves, so a tree over
each half, with radius ``radius // 2``, meets every pair. (Distances of whole 64-bit fingerprints lie so close around 32 that
a ball of three bits overlaps both sides of nearly every vantage ball; halves keep most points on one side.) A
tree's top, fitted to a bounded sample, deals all distinct fingerprints out to shards: at a node those within the
threshold of the vantage point go left, the others right, and those of the right that the triangle inequality can't keep from a point
of the left go left too. A shard is searched by its own tree in the same way, and what meets in a leaf is compared over all 64 bits.

Links needn't be listed, only what they connect: a leaf sends a spanning forest. A crowd, which no vantage point divides, is
covered by balls: all within ``radius`` of a point are linked to it, and only balls of different components that lie near enough
are compared. Shards over ``limit`` fingerprints are cut into slabs that meet in pairs, so that no task grows with a crowd.

Defined cases: null, empty and blank texts have fingerprint zero, which links like any other; rows that repeat an id or a text
come out once each; a null id counts as the smallest, and a component that holds one has a null id; a text is read
whole in blocks of shingles; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common as c
from weftline.operators.graph import components

SEED = 42
BLOCK = 1 << 16
LEAF = 512
SAMPLE = 1 << 14
LIMIT = 1 << 18


def fingerprints_of(chunk: c.Chunk, words: int) -> np.ndarray:
    """The fingerprint of each text of a chunk."""
    w = c.Words(chunk, lower=True)
    raw = memoryview(w.norm)
    size = np.where(w.counts >= words, w.counts - words + 1, np.minimum(w.counts, 1))
    owner = np.repeat(np.arange(len(size)), size)
    first = np.repeat(w.first_word, size) + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    a, b = w.starts[first], w.ends[first + np.minimum(words, w.counts[owner]) - 1] if len(owner) else first
    ones = np.zeros((len(size), 64), np.int64)
    for at in range(0, len(owner), BLOCK):
        h = np.fromiter((xxhash.xxh64_intdigest(raw[x:y], SEED) for x, y in zip(a[at : at + BLOCK].tolist(), b[at : at + BLOCK].tolist(), strict=True)), np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        docs, cuts = np.unique(owner[at : at + BLOCK], return_index=True)
        ones[docs] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > size[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, fp``: a row for each document, with 64 bits as a long."""

    def read(batches):
        for chunk in c.chunks(batches, c.SMALL):
            yield pa.RecordBatch.from_arrays([pa.array(chunk.ids), pa.array(fingerprints_of(chunk, words).view(np.int64))], names=["_id", "fp"])

    return c.keyed(docs, id_col, text_col).mapInArrow(read, "_id long, fp long")


def half(fp: np.ndarray, side: int) -> np.ndarray:
    return (fp >> np.uint64(32 if side == 0 else 0)).astype(np.uint32)


def vantage(points: np.ndarray, radius: int, tries: int = 8) -> tuple[int, int, int] | None:
    """A vantage point and the threshold that leave the fewest points on the fuller side: (point, threshold, how many). Of the points at
    most a quarter may go both ways, and a tenth has to stay away from the fuller side; None where no try does that."""
    best = None
    for v in points[np.linspace(0, len(points) - 1, min(tries, len(points))).astype(int)].tolist():
        seen = np.cumsum(np.bincount(np.bitwise_count(points ^ np.uint32(v)), minlength=33))
        for m in range(33 - radius):
            left, right = int(seen[m + radius]), len(points) - int(seen[m])
            if left + right <= 1.25 * len(points) and (best is None or max(left, right) < best[2]):
                best = (v, m, max(left, right))
    return best if best and best[2] <= 0.9 * len(points) else None


def sides(points: np.ndarray, v: int, m: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the points that go left and right; of two that differ in ``radius`` bits, one goes where the other is."""
    d = np.bitwise_count(points ^ np.uint32(v))
    return np.flatnonzero(d <= m + radius), np.flatnonzero(d > m)


@dataclass
class Tree:
    """``nodes``: (vantage point, threshold, left, right), where a child below zero is the shard ``-1 - child``."""

    nodes: list[tuple[int, int, int, int]]
    shards: int

    @classmethod
    def fitted(cls, sample: np.ndarray, radius: int, shards: int) -> Tree:
        """The largest shard of the sample is divided until there are ``shards``."""
        nodes: list[list[int]] = []
        held: list[tuple[np.ndarray, tuple[int, int] | None]] = [(sample, None)]
        solid: list[tuple[np.ndarray, tuple[int, int] | None]] = []
        while held and len(held) + len(solid) < shards:
            held.sort(key=lambda x: len(x[0]))
            points, above = held.pop()
            found = vantage(points, radius) if len(points) > 16 else None
            if found is None:
                solid.append((points, above))
                continue
            left, right = sides(points, found[0], found[1], radius)
            if above:
                nodes[above[0]][above[1]] = len(nodes)
            nodes.append([found[0], found[1], 0, 0])
            held += [(points[left], (len(nodes) - 1, 2)), (points[right], (len(nodes) - 1, 3))]
        leaves = held + solid
        for k, (_, above) in enumerate(leaves):
            if above:
                nodes[above[0]][above[1]] = -1 - k
        return cls([tuple(n) for n in nodes], len(leaves))

    def dealt(self, points: np.ndarray, radius: int):
        """(shard, places of its points)."""
        todo = [(0 if self.nodes else -1, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield -1 - node, at
                continue
            v, m, *below = self.nodes[node]
            todo += [(child, at[places]) for child, places in zip(below, sides(points[at], v, m, radius), strict=True)]


def merged(label: np.ndarray, members: np.ndarray) -> None:
    """Give the components of the members one label."""
    names = np.unique(label[members])
    if len(names) > 1:
        flag = np.zeros(len(label), bool)
        flag[names] = True
        label[flag[label]] = names[0]


def cover(fp: np.ndarray, radius: int) -> np.ndarray:
    """Component labels by balls around points: a ball's points are linked to its centre; a point near a ball of another component is compared with it."""
    label, free, centres = np.arange(len(fp)), np.ones(len(fp), bool), []
    owner = np.zeros(len(fp), np.int64)
    while free.any():
        p = int(np.argmax(free))
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[p]) <= radius)
        owner[near[free[near]]] = p
        free[near] = False
        centres.append(p)
        merged(label, near)
    for p in centres:
        strange = np.flatnonzero((np.bitwise_count(fp ^ fp[p]) <= 2 * radius) & (label != label[p]))
        if not len(strange):
            continue
        own = np.flatnonzero(owner == p)
        for y in strange.tolist():
            if label[y] == label[p]:
                continue
            met = own[np.bitwise_count(fp[own] ^ fp[y]) <= radius]
            if len(met):
                merged(label, np.append(met, y))
    return label


def compared(fp: np.ndarray, radius: int) -> np.ndarray:
    """Component labels of a leaf, over all bits."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    label = np.arange(len(fp))
    if near.sum() == len(fp):
        return label
    while True:
        least = np.where(near, label[None, :], len(fp)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def linked(fp: np.ndarray, side: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among a shard's distinct fingerprints, by a tree over their halves."""
    points, todo = half(fp, side), [np.arange(len(fp))]
    a, b = [], []
    while todo:
        at = todo.pop()
        if len(at) < 2:
            continue
        if len(at) > LEAF:
            found = vantage(points[at], radius // 2)
            if found is not None:
                left, right = sides(points[at], found[0], found[1], radius // 2)
                todo += [at[left], at[right]]
                continue
        label = compared(fp[at], radius) if len(at) <= LEAF else cover(fp[at], radius)
        moved = np.flatnonzero(label != np.arange(len(at)))
        a.append(at[label[moved]])
        b.append(at[moved])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def fingerprint_links(distinct: DataFrame, radius: int = 3, shards: int | None = None, sample: int = SAMPLE, limit: int = LIMIT) -> DataFrame:
    """``a, b``: pairs of the fingerprints ``fp`` that connect what links of at most ``radius`` bits connect, and no more. ``shards`` by default two for
    each shuffle partition and tree; a tree's top is fitted to about ``sample`` of them, at most a quarter."""
    spark = distinct.sparkSession
    parts = c.partitions(spark)
    total = distinct.count()
    share = int(min(0.25, sample / max(total, 1)) * (1 << 31))
    some = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 31)) < share).orderBy(F.xxhash64("fp"), "fp").limit(2 * sample).collect()
    points = np.array([r["fp"] for r in some], np.int64).view(np.uint64)
    trees = [Tree.fitted(half(points, side), radius // 2, shards or 2 * parts) for side in (0, 1)]

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for side, tree in enumerate(trees):
                for shard, at in tree.dealt(half(fp.view(np.uint64), side), radius // 2):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 2 * shard + side, np.int32)), pa.array(fp[at])], names=["shard", "fp"])

    dealt = c.store(distinct.select("fp").mapInArrow(deal, "shard int, fp long"))
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count("*") / limit).cast("int").alias("k")).filter("k > 1")
    rows = dealt.join(F.broadcast(sizes), "shard", "left")  # at most a row for each shard
    slab = F.pmod(F.xxhash64("fp"), F.coalesce("k", F.lit(1))).cast("int")
    rows = rows.withColumn("i", slab).withColumn("j", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)))
    rows = rows.select("shard", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp")

    def search(batches):
        key, held = None, []

        def done():
            fp = np.concatenate(held).view(np.uint64)
            a, b = linked(fp, key[0] % 2, radius)
            if len(a):
                low, high = np.minimum(fp[a].view(np.int64), fp[b].view(np.int64)), np.maximum(fp[a].view(np.int64), fp[b].view(np.int64))
                both = np.unique(np.stack([low, high]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            fp = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x < y and tuple(keys[:, x]) != key:
                    if held:
                        yield from done()
                    key, held = tuple(keys[:, x]), []
                held.append(fp[x:y])
        if held:
            yield from done()

    met = rows.repartition(parts, "shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    return met.mapInArrow(search, "a long, b long").distinct()


def simhash_dedup(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint, component_id, n_equal``: sixteen hex digits, the smallest id that is reachable by links, and how many
    documents share the fingerprint."""
    rows = c.store(fingerprints(docs, words, id_col, text_col))
    distinct = c.store(rows.groupBy("fp").agg(F.min("_id").alias("least"), F.count("*").alias("n_equal")))
    labels = components(fingerprint_links(distinct, radius)).withColumnRenamed("v", "fp")
    named = distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    of = named.groupBy("label").agg(F.min("least").alias("component"))
    by_print = c.store(named.join(of, "label").select("fp", "component", "n_equal"))
    out = rows.join(by_print, "fp")
    return out.select(c.plain_id(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component") != c.NULL_ID, F.col("component")).alias("component_id"), "n_equal")
