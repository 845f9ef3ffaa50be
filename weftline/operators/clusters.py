"""Clusters of similar sequences in linear time: each meets only the longest one with which it shares a k-mer."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import stored


BASES = 1 << 20
WINDOWS = 1 << 12
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]  # MD5's constants, by its definition
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def md5_heads(windows: np.ndarray) -> np.ndarray:
    """The first eight bytes of each row's MD5 as a number. A row has at most 55 bytes, so that it fills one block of the digest."""
    rows, k = windows.shape
    block = np.zeros((rows, 64), np.uint8)
    block[:, :k] = windows
    block[:, k], block[:, 56], block[:, 57] = 128, 8 * k & 255, 8 * k >> 8
    words = np.ascontiguousarray(block.view("<u4").T)
    a, b, c, d = start = [np.full(rows, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[g]
        f += SINES[i]
        turn = TURNS[i // 16][i % 4]
        right = f >> np.uint32(32 - turn)
        f <<= np.uint32(turn)
        f |= right
        f += b
        a, d, c, b = d, c, b, f
    return np.stack([a + start[0], b + start[1]], axis=1).view(">u8")[:, 0].astype(np.uint64)


def least_grams(texts: list[str], k: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of a text and a hash, for the ``count`` least of the distinct hashes (the first eight bytes of MD5) of each text's ``k``
    successive bytes, one from each letter's place on."""
    raw = [x.encode() for x in texts]
    each = np.array([len(x) - k + 1 for x in texts])
    owner = np.repeat(np.arange(len(texts)), each)
    first = np.cumsum([0, *map(len, raw)])[:-1]
    at = np.arange(len(owner)) - (np.cumsum(each) - each)[owner] + first[owner]
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(raw), np.uint8), k)
    hashes = np.concatenate([md5_heads(windows[at[lo : lo + WINDOWS]]) for lo in range(0, len(at), WINDOWS)])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])
    owner, hashes = owner[new], hashes[new]
    keep = np.arange(len(owner)) - np.searchsorted(owner, owner) < count
    return owner[keep], hashes[keep]


def within(x: str, y: str, bound: int) -> bool:
    """Whether the edit distance of two texts is at most ``bound``: a column of the table is two numbers whose bits say where it goes up and down (Myers 1999)."""
    if abs(len(x) - len(y)) > bound:
        return False
    lo, end = 0, min(len(x), len(y))
    while lo < end and x[lo] == y[lo]:
        lo += 1
    x, y, end = x[lo:], y[lo:], end - lo
    hi = 0
    while hi < end and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    x, y = x[: len(x) - hi], y[: len(y) - hi]
    if max(len(x), len(y)) <= bound:
        return True
    if not x or not y:
        return False
    places = {c: int("".join("1" if v == c else "0" for v in reversed(x)), 2) for c in set(x)}
    full, top, distance = (1 << len(x)) - 1, 1 << (len(x) - 1), len(x)
    up, down = full, 0
    rest, step = len(x) - np.arange(len(x) + 1), max(64, len(y) // 12)
    for left, c in zip(range(len(y) - 1, -1, -1), y, strict=True):
        equal = places.get(c, 0)
        steep = equal | down
        flat = (((equal & up) + up) ^ up) | equal
        rise, fall = down | (full & ~(flat | up)), up & flat
        if rise & top:
            distance += 1
        elif fall & top:
            distance -= 1
        if distance - left > bound:
            return False
        rise = rise << 1 | 1
        up, down = (fall << 1 | ~(steep | rise)) & full, rise & steep & full
        if left % step == 0 and (done := len(y) - left) > bound:  # the best way on from any place of this column
            ups, downs = (np.unpackbits(np.frombuffer(v.to_bytes(len(x) // 8 + 1, "little"), np.uint8), count=len(x), bitorder="little").astype(np.int8) for v in (up, down))
            column = np.concatenate([[done], done + np.cumsum(ups - downs, dtype=np.int64)])
            if (column + np.abs(rest - left)).min() > bound:
                return False
    return distance <= bound


def centre_pairs(df: DataFrame, key: str, seq: str, k: int, per_sequence: int, identity: int, coverage: int) -> DataFrame:
    """``centre, member, n, m``: pairs of distinct keys and their lengths. Of a sequence's k-mers the ``per_sequence`` of least hash stand for it.
    For each of these, all sequences that have it meet the longest (ties: the least key), their centre, so that a k-mer of all
    rows gives a pair for each row. The shorter length must be ``coverage`` percent of the longer, and the edit distance at most
    ``100 - identity`` percent of it. ``k`` is at most 55. Pairs are compared where their members are dealt to, and a member has at most ``per_sequence`` centres. ``key`` is
    unique and not null."""
    kind = df.schema[key].dataType.simpleString()
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            part = np.cumsum(batch.column(2).to_numpy()) // BASES
            for lo, hi in zip(cuts := np.searchsorted(part, np.unique(part)), [*cuts[1:], len(part)], strict=True):
                owner, hashes = least_grams(batch.column(1).slice(lo, hi - lo).to_pylist(), k, per_sequence)
                own = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(2).take(own), pa.array(hashes.view(np.int64))], names=["member", "m", "_g"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(i) for i in range(4)]
            keep = [within(x, y, n * (100 - identity) // 100) for x, y, n in zip(*(batch.column(i).to_pylist() for i in (4, 5, 2)), strict=True)]
            yield pa.RecordBatch.from_arrays(own, names=["centre", "member", "n", "m"]).filter(pa.array(keep, pa.bool_()))

    t = df.filter(F.length(seq) >= k).select(F.col(key).alias("member"), F.col(seq).alias("_q"), F.length(seq).alias("m"))
    t = stored(t.mapInArrow(grams, f"member {kind}, m int, _g long"))
    tops = t.groupBy("_g").agg(F.min(F.struct(-F.col("m"), F.col("member"))).alias("_c"), F.count("*").alias("_n")).filter("_n > 1")
    tops = tops.select("_g", F.col("_c.member").alias("centre"), (-F.col("_c.col1")).alias("n"))
    pairs = t.join(tops, "_g").filter((F.col("centre") != F.col("member")) & (F.col("m") * 100 >= F.col("n") * coverage)).select("centre", "member", "n", "m").distinct()
    long, short = (df.select(F.col(key).alias(c), F.col(seq).alias(f"_{c}")) for c in ("centre", "member"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as the work of a task doesn't follow its bytes
    both = pairs.join(long, "centre").repartition(tasks, "member").join(short, "member").select("centre", "member", "n", "m", "_centre", "_member")
    return both.mapInArrow(alike, f"centre {kind}, member {kind}, n int, m int")


def greedy_clusters(pairs: DataFrame) -> DataFrame:
    """``member, cluster``: the longest sequence takes all members that it has a pair with, then the longest of the rest, and so on; what isn't
    listed is a cluster of its own. In a round every sequence that no longer one can take any more takes its members, so rounds are
    as many as the longest chain of such waits, and none of them orders all sequences."""
    open_, out = stored(pairs.select("centre", "member", "n")), None
    while True:
        tops = open_.select("centre").distinct().join(open_.select(F.col("member").alias("centre")).distinct(), "centre", "left_anti")
        taken = open_.join(tops, "centre").groupBy("member").agg(F.min(F.struct(-F.col("n"), F.col("centre"))).alias("_c")).select("member", F.col("_c.centre").alias("cluster"))
        taken = stored(taken)
        out = taken if out is None else out.unionByName(taken)
        rest = open_.join(taken.select("member"), "member", "left_anti").join(taken.select(F.col("member").alias("centre")), "centre", "left_anti")
        open_ = stored(rest)
        if open_.isEmpty():
            return out


def _equal(df: DataFrame, key: str, seq: str) -> DataFrame:
    return stored(df.filter(F.col(seq).isNotNull()).groupBy(F.col(seq).alias("_q")).agg(F.min(key).alias("_v")))


def _with_equal(pairs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    own = rows.filter(F.col(key) != F.col("_v")).select(F.col("_v").alias("a"), F.col(key).alias("b"))
    return pairs.select(F.col("centre").alias("a"), F.col("member").alias("b")).unionByName(own)


def linear_pairs(df: DataFrame, key: str, seq: str, k: int = 10, per_sequence: int = 20, identity: int = 50, coverage: int = 90) -> DataFrame:
    """``a, b``: the pairs of ``linear_clusters``, without its rounds."""
    df = stored(df.select(key, seq))
    equal = _equal(df, key, seq)
    rows = df.select(key, F.col(seq).alias("_q")).join(equal, "_q")
    return _with_equal(centre_pairs(equal, "_v", "_q", k, per_sequence, identity, coverage), rows, key)


def linear_clusters(df: DataFrame, key: str, seq: str, k: int = 10, per_sequence: int = 20, identity: int = 50, coverage: int = 90) -> tuple[DataFrame, DataFrame]:
    """``key, cluster`` (the key of its longest sequence) and the pairs (``a, b``) that tell it. Equal sequences are one from the start, known by their
    least key; nulls and sequences below ``k`` letters meet only their equals. Keys are unique."""
    equal = _equal(df, key, seq)
    pairs = stored(centre_pairs(equal, "_v", "_q", k, per_sequence, identity, coverage))
    found = equal.join(greedy_clusters(pairs).withColumnRenamed("member", "_v"), "_v", "left").select("_q", "_v", F.coalesce("cluster", "_v").alias("cluster"))
    rows = df.select(key, F.col(seq).alias("_q")).join(found, "_q", "left")
    return rows.select(key, F.coalesce("cluster", key).alias("cluster")), _with_equal(pairs, rows, key)
