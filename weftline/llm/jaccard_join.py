"""Exact n-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set holds the 64-bit hashes of its distinct shingles of ``n`` words. Two sets of sizes r and s with
Jaccard similarity of t % differ in at most (r + s)(100 - t)/(100 + t) tokens.

* Sizes fall into bands, each 1.25 times the last (100/t in general). A band's scheme cuts the hash universe into m
  segments; sets of the band and the reachable sets of the band below emit signatures for it.
* Each segment is allotted 1 (its subset must be equal) or 2 (equal up to one token: the subset and
  all its one-deletion neighbours are indexed). If the allotments exceed the possible difference,
  two similar sets must meet in some segment. ``allot`` weighs the number of signatures against the
  expected list lengths; small bands get one-deletion neighbourhoods.
* Large schemes have spare segments: each set leaves out its ``spare`` costliest subsets (fewest
  tokens that are not frequent in the corpus), and 2 * spare more segments keep the join complete.
* The pigeonhole also holds along the ring of segments: some segment matches from which on every run of
  segments differs in less than its allotments (cycle lemma). So a signature carries the 32-bit parity sketch of
  CHAIN segments from its own on, and classes of one list whose sketches differ in CHAIN bits or more
  can't meet there; lists fall apart into groups of near sketches before anything is verified.
* Documents of equal sets are one class. Signatures travel to buckets in compressed blobs; each class
  of a list joins the group of the list's first class, so candidates share a group. Groups are
  dealt in blocks of BLOCK classes with parity sketches of whole sets, whose differing bits never exceed the
  sets' difference: pairs that these rule out go. A block lists a forest of the others, not each pair. The classes that forests
  connect are dealt in blocks of SETS classes, where all pairs that sketches leave are verified on whole sets; a set travels once for each
  block that its own meets. Of links, too, blocks give a forest, and their number for each class.

Frequent shingles (for costs only; results don't depend on them) are the FREQUENT most common of
those in one in a hundred of a chunk's documents. Components are found by label propagation with pointer
jumping on stored tables.

Defined cases: null or wordless texts have an empty set and link with nothing; below n words the
whole sequence is the one shingle; rows that repeat an id are documents of their own that share the
id; a null id sorts first; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common as c

FREQUENT = 65_536
CHAIN = 4
BLOCK = 2048
SETS = 128


def shingle_sets(chunk: c.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, end to end, and their counts."""
    words = c.Words(chunk, lower=True)
    counts = np.zeros(len(chunk.ids), np.int64)
    if not words.total:
        return np.zeros(0, np.uint64), counts
    rolling = c.Rolling(c.word_hashes(words), c.M2)
    grams = rolling.windows(n)
    out = []
    for i, (first, m) in enumerate(zip(words.first_word.tolist(), words.counts.tolist(), strict=True)):
        if not m:
            continue
        if m < n:
            own = rolling.spans(np.array([first]), np.array([first + m]))
        else:
            own = np.sort(grams[first : first + m - n + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        counts[i] = len(own)
        out.append(own)
    return np.concatenate(out), counts


def set_marks(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit mark for each set (0 for empty ones), whatever the order of its tokens."""
    marks = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        marks[full] = c.mix(np.add.reduceat(c.mix(flat ^ np.uint64(c.M1)), starts) + counts[full].astype(np.uint64)) | np.uint64(1)
    return marks


@functools.cache
def bands(percent: int, limit: int) -> list[int]:
    """The least sizes of the bands up to ``limit``."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return out


@functools.cache
def allot(low: int, high: int, percent: int, list_cost: float = 200.0) -> tuple[int, int, int]:
    """For a scheme of sizes low to high - 1: segments of equality, of one deletion, and spare ones."""
    difference = 2 * (high - 1) * (100 - percent) // (100 + percent)
    spare = math.ceil(0.06 * (difference + 1)) if difference >= 15 else 0
    units = difference + 1 + 2 * spare
    best = None
    for two in range(0, units // 2 + 1 if difference < 15 else 1):
        one = units - 2 * two
        k = low / (one + two)
        cost = one + two * (k + 1) + list_cost * (one * math.exp(-k) + two * (math.exp(-k) + k * math.exp(1 - k)))
        if best is None or cost < best[0]:
            best = (cost, one, two)
    return best[1], best[2], spare


def signatures(flat: np.ndarray, counts: np.ndarray, scheme: int, shape: tuple[int, int, int], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signatures of sets under one scheme, the set that each is of, and the sketch of the segments
    from its own on (0 in schemes of few segments or with one-deletion neighbours, which aren't sifted)."""
    one, two, spare = shape
    m = one + two
    sets = np.repeat(np.arange(len(counts)), counts)
    segment = ((flat >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    cell = sets * m + segment
    token = c.mix(flat + np.uint64(c.M2))
    sums = np.zeros(len(counts) * m, np.uint64)
    first = np.concatenate([[True], cell[1:] != cell[:-1]])
    starts = np.flatnonzero(first)
    sums[cell[starts]] = np.add.reduceat(token, starts)
    where = np.tile(np.arange(m, dtype=np.uint64), len(counts))
    salt = c.mix(where + np.uint64((scheme + 1) << 24))
    whole = c.mix(sums ^ salt)
    owner = np.repeat(np.arange(len(counts)), m)
    sketch = np.zeros(len(whole), np.uint32)
    if not two and m >= CHAIN:
        sketch[cell[starts]] = np.bitwise_xor.reduceat(np.uint32(1) << (token >> np.uint64(59)).astype(np.uint32), starts)
        rows = sketch.reshape(len(counts), m)
        sketch = functools.reduce(np.bitwise_xor, (np.roll(rows, -k, axis=1) for k in range(CHAIN))).ravel()
    kept = np.ones(len(whole), bool)
    if spare:
        size = np.bincount(cell, minlength=len(whole))
        rare = np.bincount(cell[~np.isin(flat, frequent)], minlength=len(whole)) if len(frequent) else size
        order = np.lexsort((whole, size, rare, owner))
        kept[order.reshape(len(counts), m)[:, :spare].ravel()] = False
    out, of, sketches = [whole[kept]], [owner[kept]], [sketch[kept]]
    if two:
        deleted = segment >= one
        out.append(c.mix((sums[cell[deleted]] - token[deleted]) ^ salt[cell[deleted]]))
        of.append(sets[deleted])
        sketches.append(np.zeros(int(deleted.sum()), np.uint32))
    return np.concatenate(out), np.concatenate(of), np.concatenate(sketches)


def all_signatures(flat, counts, percent: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every set under its own band's scheme and, where it reaches, the next band's."""
    limits = np.array(bands(percent, int(counts.max(initial=1)) + 1))
    limits = np.append(limits, [max(limits[-1] + 1, -(-int(limits[-1]) * 100 // percent)), 0])
    band = np.searchsorted(limits[:-1], counts, side="right") - 1
    starts = np.cumsum(counts) - counts
    out, of, sketches = [], [], []
    for b in np.unique(band[counts > 0]).tolist():
        low, high = int(limits[b]), int(limits[b + 1])
        after = max(high + 1, -(-high * 100 // percent))
        for scheme, rows, shape in ((b, np.flatnonzero((band == b) & (counts > 0)), allot(low, high, percent)), (b + 1, np.flatnonzero((band == b) & (counts * 100 >= percent * high)), allot(high, after, percent))):
            if len(rows):
                n = counts[rows]
                at = np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                sig, owner, sketch = signatures(flat[at], n, scheme, shape, frequent)
                out.append(sig)
                of.append(rows[owner])
                sketches.append(sketch)
    return (np.concatenate(out), np.concatenate(of), np.concatenate(sketches)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32))


def parity_sketch(tokens: np.ndarray) -> bytes:
    """One bit for each of 2**k places, at least four for each token: whether an odd number of tokens falls there."""
    size = 64
    while size < 4 * len(tokens):
        size *= 2
    place = (c.mix(tokens ^ np.uint64(c.M2)) >> np.uint64(40)).astype(np.int64) & (size - 1)
    return np.packbits(np.bincount(place, minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


CLASS_SQL = "_id long, _h long, n long, mark long, sketch binary"
CLASS = pa.schema([("_id", pa.int64()), ("_h", pa.int64()), ("n", pa.int64()), ("mark", pa.int64()), ("sketch", pa.binary())])


def _classes(batches, n: int):
    """A row for each document; then (null, null, count, shingle, null) for frequent shingles of the chunk."""
    for chunk in c.chunks(batches, c.SMALL):
        flat, counts = shingle_sets(chunk, n)
        marks = set_marks(flat, counts).view(np.int64)
        ends = np.cumsum(counts)
        sketches = [parity_sketch(flat[e - k : e]) if k else None for e, k in zip(ends.tolist(), counts.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(chunk.ids), pa.array(chunk.hashes), pa.array(counts), pa.array(marks), pa.array(sketches, pa.binary())], schema=CLASS)
        tokens = np.sort(flat)
        edges = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]])) if len(tokens) else np.zeros(1, np.int64)
        times = np.diff(edges)
        often = times >= max(4, len(counts) // 100)
        if often.any():
            k = int(often.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(times[often]), pa.array(tokens[edges[:-1][often]].view(np.int64)), pa.nulls(k, pa.binary())], schema=CLASS)


def _map(batches, n: int, percent: int, buckets: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}
    size = 0

    def flush():
        rows, total = [], 0
        for k, parts in sorted(held.items()):
            sig, mark, count, sketch = (np.concatenate(x) for x in zip(*parts, strict=True))
            first = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))  # each class once, then its number of signatures
            short = np.ascontiguousarray(sig.view(np.uint8).reshape(-1, 8)[:, :6])
            rows.append((k, c.squeeze(b"".join(x.tobytes() for x in (np.array([len(sig), len(first)]), mark[first], count[first], np.diff(np.append(first, len(sig))).astype(np.int32), sketch, short)))))
            total += len(rows[-1][1])
            if total > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])
                rows, total = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])
        held.clear()

    for chunk in c.chunks(batches, c.SMALL):
        flat, counts = shingle_sets(chunk, n)
        marks = set_marks(flat, counts)
        _, first = np.unique(marks, return_index=True)
        chosen = np.sort(first[counts[first] > 0])
        if not len(chosen):
            continue
        starts, m = (np.cumsum(counts) - counts)[chosen], counts[chosen]
        at = np.repeat(starts - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        sig, owner, sketch = all_signatures(flat[at], m, percent, frequent)
        bucket, sig = (sig % np.uint64(buckets)).astype(np.int64), sig // np.uint64(buckets)
        order = np.lexsort((owner, bucket))
        bucket, sig, owner, sketch = bucket[order], sig[order], owner[order], sketch[order]
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        mark, count = marks[chosen][owner], m[owner].astype(np.int32)
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x < y:
                held.setdefault(int(bucket[x]), []).append((sig[x:y], mark[x:y], count[x:y], sketch[x:y]))
        size += 24 * len(sig)
        if size > 48 << 20:
            yield from flush()
            size = 0
    yield from flush()


def near_groups(codes: np.ndarray, limit: int) -> np.ndarray:
    """A group number for each of the distinct codes: codes that differ in up to ``limit`` (under four) bits share one."""
    group = np.arange(len(codes))
    edges = []
    if len(codes) <= 1024:
        x, y = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= limit)
        edges.append((x, y))
    else:  # one of four bytes must be equal
        for shift in (0, 8, 16, 24):
            byte = (codes >> np.uint32(shift)) & np.uint32(255)
            order = np.argsort(byte, kind="stable")
            cuts = np.searchsorted(byte[order], np.arange(257))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = order[a:b]
                for i in range(0, len(own), 1024):
                    x, y = np.nonzero(np.bitwise_count(codes[own[i : i + 1024], None] ^ codes[own][None, :]) <= limit)
                    edges.append((own[i + x], own[y]))
    x, y = (np.concatenate(e) for e in zip(*edges, strict=True))
    while True:
        step = group.copy()
        np.minimum.at(step, x, group[y])
        step = step[step]
        if (step == group).all():
            return group
        group = step


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], schema=PAIRS)


def _bucket(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
    """(first class of its group, class) for the groups of near sketches in each list."""
    parts = []
    for p in payloads:
        body = c.spread(p)
        n, k = np.frombuffer(body, np.int64, 2).tolist()
        mark, times, at = np.frombuffer(body, np.uint64, k, 16), np.frombuffer(body, np.int32, k, 16 + 12 * k), 16 + 16 * k
        sig = np.zeros((n, 8), np.uint8)
        sig[:, :6] = np.frombuffer(body, np.uint8, 6 * n, at + 4 * n).reshape(n, 6)
        parts.append((sig.view(np.uint64).ravel(), np.repeat(mark, times), np.frombuffer(body, np.uint32, n, at)))
    sig, mark, sketch = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((mark, sig))
    sig, mark, sketch = sig[order], mark[order], sketch[order]
    new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (mark[1:] != mark[:-1])])
    sig, mark, sketch = sig[new], mark[new].view(np.int64), sketch[new]
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    length = np.diff(np.append(begin, len(sig)))
    x = begin[length == 2]
    x = x[np.bitwise_count(sketch[x] ^ sketch[x + 1]) < CHAIN]
    firsts, others = [x], [x + 1]
    for a, n in zip(begin[length > 2].tolist(), length[length > 2].tolist(), strict=True):
        codes, which = np.unique(sketch[a : a + n], return_inverse=True)
        group = near_groups(codes, CHAIN - 1)[which]
        order = np.argsort(group, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if len(own) > 1:
                firsts.append(np.full(len(own) - 1, a + own[0]))
                others.append(a + own[1:])
    a, b = np.concatenate(firsts), np.concatenate(others)
    if len(a):
        pairs = np.unique(np.stack([mark[a], mark[b]], axis=1), axis=0)
        yield _pairs(pairs[:, 0], pairs[:, 1])


def _by_bucket(batches):
    bucket, held = None, []
    for batch in batches:
        b = batch.column(0).to_numpy()
        for i in range(batch.num_rows):
            if b[i] != bucket:
                if held:
                    yield from _bucket(held)
                bucket, held = b[i], []
            held.append(batch.column(1)[i].as_py())
    if held:
        yield from _bucket(held)


def forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the least row that its entries lead to."""
    label = np.arange(len(near))
    while True:
        least = [np.where(near[lo : lo + 256], label[None, :], len(near)).min(axis=1) for lo in range(0, len(near), 256)]
        step = np.minimum(label, np.concatenate(least))
        step = step[step]
        if (step == label).all():
            return label
        label = step


LINKED = "a long, b long, n_links long"


def _verified(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, n_links``: for blocks of classes, how many links a class has there and the class that they all lead to (itself for one of each). The classes of
    each component of ``near`` are dealt in blocks; each two blocks meet once, so each pair is compared once, by sketches and then on whole sets."""

    def work(batches):
        for batch in batches:
            for row, cross in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                mark, block, tokens = _members(row)
                tokens = [np.frombuffer(t.as_buffer(), np.uint64) for t in tokens]
                mark, block, count = mark.to_numpy(), block.to_numpy(), np.array([len(t) for t in tokens])
                pairs = np.triu(near_matrix(count, [parity_sketch(t) for t in tokens], percent))
                if cross:
                    pairs &= block[:, None] != block[None, :]
                linked = np.zeros(pairs.shape, bool)
                for x, y in zip(*(v.tolist() for v in np.nonzero(pairs)), strict=True):
                    found = np.sort(np.concatenate([tokens[x], tokens[y]]))
                    inter = int((found[1:] == found[:-1]).sum())
                    linked[x, y] = 100 * inter >= percent * (len(found) - inter)
                linked |= linked.T
                some = linked.any(axis=1)
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(mark[some]), pa.array(mark[forest(linked)][some]), pa.array(linked.sum(axis=1)[some])], names=["a", "b", "n_links"])

    labels = components(near)
    sizes = labels.groupBy("label").agg(F.ceil(F.count("*") / SETS).cast("int").alias("k"))
    dealt = c.store(labels.join(sizes, "label").select(F.col("v").alias("mark"), "label", "k", F.pmod(F.xxhash64("v"), F.col("k")).cast("int").alias("block")))
    rows = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "mark", "block")
    members = rows.join(sets, "mark").groupBy("label", "i", "j").agg(F.collect_list(F.struct("mark", "block", "tokens")).alias("members"))
    return members.select("members", (F.col("i") != F.col("j")).alias("cross")).mapInArrow(work, LINKED)


def components(links: DataFrame) -> DataFrame:
    """``v, label``: the least vertex of each vertex's component, for links ``a, b``. In a round each vertex goes over to its least neighbour (or
    stays), and then to where that one goes; links are renamed, and those within a vertex are gone, so later rounds have few. Vertices
    are hashes, so their order is a random one, and a long chain halves in a round, too."""
    links = c.store(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    moves = []
    while True:
        least = c.store(links.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
        then = least.select(F.col("v").alias("to"), F.col("to").alias("label"))
        moves.append(c.store(least.join(then, "to").select("v", "label")))
        ends = links
        for x in ("a", "b"):
            ends = ends.join(moves[-1].withColumnRenamed("v", x), x).drop(x).withColumnRenamed("label", f"_{x}")
        links = c.store(ends.filter("_a != _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        if links.isEmpty():
            break
    out = moves[0]
    for move in moves[1:]:
        out = out.join(move.select(F.col("v").alias("label"), F.col("label").alias("_next")), "label", "left").select("v", F.coalesce("_next", "label").alias("label"))
    return out


def near_matrix(counts: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Which pairs of classes neither sizes nor sketches rule out."""
    size = min(len(x) for x in sketches)
    rows = np.zeros((len(sketches), size // 8), np.uint64)
    for row, x in zip(rows, sketches, strict=True):
        row[:] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, size // 8), axis=0)
    out = np.zeros((len(rows), len(rows)), bool)
    for lo in range(0, len(rows), 128):
        part = rows[lo : lo + 128]
        differ = np.zeros((len(part), len(rows)), np.int64)
        for k in range(rows.shape[1]):
            differ += np.bitwise_count(part[:, k, None] ^ rows[None, :, k])
        n, m = counts[lo : lo + 128, None], counts[None, :]
        out[lo : lo + 128] = (differ * (100 + percent) <= (n + m) * (100 - percent)) & (np.minimum(n, m) * 100 >= percent * np.maximum(n, m))
    np.fill_diagonal(out, False)
    return out


def _placed(pairs: DataFrame) -> DataFrame:
    """``a, i, j, mark``: all pairs of each group meet in a block pair (i, j), of up to about 2 * BLOCK classes."""
    rows = pairs.select("a", F.col("b").alias("mark")).unionByName(pairs.select("a", F.col("a").alias("mark")).distinct())
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    rows = rows.join(sizes, "a").withColumn("block", F.pmod(F.xxhash64("mark"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return c.store(rows.select("a", "i", "j", "mark"))


def _blocks(placed: DataFrame, about: DataFrame) -> DataFrame:
    """``members``: structs of mark and the columns of ``about``, a row for each block pair."""
    return placed.join(about, "mark").groupBy("a", "i", "j").agg(F.collect_list(F.struct("mark", *[x for x in about.columns if x != "mark"])).alias("members")).select("members")


def _members(row: pa.Scalar) -> list[np.ndarray]:
    return [row.values.field(i) for i in range(row.values.type.num_fields)]


def similar_links(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal sets by document (``_id, _h, n, mark``), the number of links of each class to others (``mark, n_links``) and ``v, label`` of their components."""
    spark = docs.sparkSession
    parts = c.partitions(spark)
    buckets = 2 * parts
    texts = c.keyed(docs, id_col, text_col)
    stored = c.store(texts.mapInArrow(lambda it: _classes(it, n), CLASS_SQL))
    classes = stored.filter("_h is not null").select("_id", "_h", "n", "mark")
    often = stored.filter("_h is null").groupBy("mark").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "mark").limit(FREQUENT)
    frequent = np.array([r[0] for r in often.select("mark").collect()], np.int64).view(np.uint64)
    blobs = texts.mapInArrow(lambda it: _map(it, n, percent, buckets, frequent), "bucket int, payload binary")
    pairs = c.store(blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_by_bucket, "a long, b long").distinct())
    wanted = pairs.select(F.col("a").alias("mark")).unionByName(pairs.select(F.col("b").alias("mark"))).distinct()
    about = c.store(stored.filter("_h is not null").join(wanted, "mark", "left_semi").groupBy("mark").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch")))

    placed = _placed(pairs)

    def near(batches):
        for batch in batches:
            for row in batch.column(0):
                mark, count, sketch = _members(row)
                mark = mark.to_numpy()
                root = forest(near_matrix(count.to_numpy(), sketch.to_pylist(), percent))
                own = np.flatnonzero(root != np.arange(len(root)))
                if len(own):
                    yield _pairs(mark[root[own]], mark[own])

    tried = c.store(_blocks(placed, about).mapInArrow(near, "a long, b long").distinct())
    wanted = tried.select(F.col("a").alias("mark")).unionByName(tried.select(F.col("b").alias("mark"))).distinct()
    members = classes.join(wanted, "mark", "left_semi").groupBy("mark").agg(F.min(F.struct("_id", "_h")).alias("m")).select("mark", "m.*")

    def tokens(batches):
        for chunk in c.chunks(batches, c.SMALL):
            flat, counts = shingle_sets(chunk, n)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([pa.array(set_marks(flat, counts).view(np.int64)), pa.array([flat[e - k : e].tobytes() for e, k in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())], names=["mark", "tokens"])

    some = texts.join(members.select("_id", "_h"), ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"])
    sets = c.store(some.mapInArrow(tokens, "mark long, tokens binary"))
    links = c.store(_verified(tried, sets, percent))
    degree = links.groupBy(F.col("a").alias("mark")).agg(F.sum("n_links").alias("n_links"))
    return classes, degree, components(links.filter("a != b"))


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, _h, n_shingles, class_id`` (the set's mark; null if empty), ``n_links`` (of its class to other sets), ``component_id`` (smallest id reachable)."""
    classes, degree, labels = similar_links(docs, n, percent, id_col, text_col)
    by_class = classes.filter("n > 0").groupBy("mark").agg(F.min("_id").alias("least"))
    by_class = by_class.join(labels.withColumnRenamed("v", "mark"), "mark", "left").withColumn("label", F.coalesce("label", "mark"))
    least = by_class.groupBy("label").agg(F.min("least").alias("component"))
    by_class = by_class.join(least, "label").join(degree, "mark", "left").select("mark", "component", "n_links")
    out = classes.join(by_class, "mark", "left")
    component = F.coalesce(F.col("component"), F.col("_id"))
    return out.select(c.plain_id(), "_h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("mark")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(component != c.NULL_ID, component).alias("component_id"))
