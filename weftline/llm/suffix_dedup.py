"""Byte-exact substring deduplication by merging the Burrows-Wheeler transforms of shards.

Every window of ``k`` bytes belongs to its minimiser (the 16-byte gram of least hash), and runs of
windows that share one travel as one packed string to that minimiser's bucket, so all copies of a
window meet in one bucket. There the strings are cut into 16-byte blocks counted from the
minimiser, which puts equal windows on equal blocks. Shards of strings get their transforms (of
the strings' rotations); the transforms are then merged by iterative interleave refinement: each round is a stable
sort of the interleave by the next symbol, and rows stay in one interval as long as their prefixes
agree. After ``k // 16 - 1`` rounds an interval of two or more is a repeat of that many blocks, and
the 16 bytes at its two ends settle each window exactly. No suffix is sorted again.

A minimiser of a passage that many documents share would bring all their strings to one bucket. A first pass finds the minimisers that
hold more than a bucket's share; their windows travel one by one under 128-bit fingerprints instead, each distinct one once
a task, and are spread over all buckets.

Defined cases: null texts are empty; texts below ``k`` bytes keep all; rows that repeat id and text
are one document that nevertheless repeats itself, so its windows go; an empty table gives an empty
table; a very long text is a chunk of its own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm import common as c

BLOCK = 16
SHARD = 1 << 14


def pack(chunk: c.Chunk, k: int, one: c.Rolling) -> tuple[np.ndarray, ...]:
    """First byte and windows of the chunk's strings, and place and hash of their minimisers."""
    grams = one.windows(BLOCK)
    least = c.sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), k - BLOCK + 1)
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.zeros(len(at) + 1, np.int8)
    long = chunk.lens >= k
    change[chunk.starts[long]] += 1
    np.subtract.at(change, chunk.starts[long] + chunk.lens[long] - k + 1, 1)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    first, count = c.runs(np.cumsum(change[:-1], dtype=np.int8) > 0, new)
    return first, count, at[first], grams[at[first]]


def string_keys(chunk: c.Chunk, k: int) -> np.ndarray:
    """The minimiser of each of the chunk's strings."""
    return pack(chunk, k, c.byte_hash(chunk.data))[3] if len(chunk.data) >= k else np.zeros(0, np.uint64)


def _map(batches: Iterator[pa.RecordBatch], k: int, buckets: int, bins: np.ndarray) -> Iterator[pa.RecordBatch]:
    blobs, hot = c.Blobs(buckets), c.HotWindows(bins, buckets, earliest=False)
    for chunk in c.chunks(batches):
        if len(chunk.data) < k:
            continue
        one, two = c.byte_hash(chunk.data), c.byte_hash(chunk.data, c.M2)
        first, count, place, key = pack(chunk, k, one)
        if not len(first):
            continue
        a, b = first, first + count + k - 1
        marks = [r.spans(a, b) for r in (one, two)]
        order = np.lexsort(marks[::-1])
        same = np.concatenate([[False], (marks[0][order][1:] == marks[0][order][:-1]) & (marks[1][order][1:] == marks[1][order][:-1])])
        more = same.copy()
        more[:-1] |= same[1:]
        flag = np.zeros(len(order), bool)
        flag[order[more]] = True
        doc = np.searchsorted(chunk.starts, first, side="right") - 1
        ids, hs, start = chunk.ids[doc], chunk.hashes[doc], first - chunk.starts[doc]
        if flag.any():
            yield c.known(ids[flag], hs[flag], start[flag], count[flag], buckets)
        keep = np.sort(order[~same])
        warm = hot.takes(key[keep])
        single, keep = keep[warm], keep[~warm]
        if len(single):
            w, owner = c.each_window(first[single], count[single])
            yield from hot.add(*(r.spans(w, w + k) for r in (one, two)), ids[single][owner], hs[single][owner], w - chunk.starts[doc[single][owner]], flag[single][owner].astype(np.int64))
        if len(keep):
            yield from blobs.add(key[keep], {"id": ids[keep], "h": hs[keep], "key": key[keep], "start": start[keep], "windows": count[keep], "length": (b - a)[keep], "anchor": place[keep] - a[keep], "flag": flag[keep]}, chunk.data, a[keep], b[keep])
    yield from blobs.flush()
    yield from hot.flush()


def shard_transform(tokens: np.ndarray, following: np.ndarray, preceding: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted rotations of a shard's strings, by prefix doubling, and their transform."""
    rank, jump = tokens.astype(np.int64), following
    longest = int(np.diff(np.concatenate([[-1], np.flatnonzero(tokens == 0)])).max())
    for _ in range(longest.bit_length() + 1):
        _, rank = np.unique(rank, return_inverse=True)
        top = int(rank.max()) + 1
        if top == len(rank):
            break
        rank, jump = rank * top + rank[jump], jump[jump]
    order = np.argsort(rank, kind="stable")
    return order, tokens[preceding[order]]


def merge_transforms(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement: the merged order, as places in the concatenated shards, and the number of
    the interval of equal prefixes of ``depth`` symbols that each row lies in."""
    symbols = np.concatenate(transforms)
    source = np.repeat(np.arange(len(transforms), dtype=np.int16 if len(transforms) < 2**15 else np.int64), [len(t) for t in transforms])
    interval = np.zeros(len(source), np.int64)
    for _ in range(depth):
        merged = np.empty_like(symbols)
        merged[np.argsort(source, kind="stable")] = symbols
        step = np.argsort(merged, kind="stable")
        merged, interval, source = merged[step], interval[step], source[step]
        interval = np.cumsum(np.concatenate([[0], ((merged[1:] != merged[:-1]) | (interval[1:] != interval[:-1])).astype(np.int64)]))
    place = np.empty(len(source), np.int64)
    place[np.argsort(source, kind="stable")] = np.arange(len(source))
    return place, interval


def repeated_starts(strings: np.ndarray, at: np.ndarray, anchor: np.ndarray, k: int) -> np.ndarray:
    """Which bytes start a window of k bytes that starts elsewhere too; strings lie between the offsets ``at``."""
    dup = np.zeros(len(strings), bool)
    depth = k // BLOCK - 1
    spare = k - depth * BLOCK
    length = np.diff(at)
    phase = anchor % BLOCK
    blocks = np.maximum(0, (length - phase) // BLOCK)
    ends = np.cumsum(blocks + 1)
    begins = ends - blocks - 1
    string = np.repeat(np.arange(len(blocks)), blocks + 1)
    index = np.arange(int(ends[-1])) - begins[string]
    where = at[:-1][string] + phase[string] + BLOCK * index
    real = index < blocks[string]
    values = strings[np.where(real, where, 0)[:, None] + np.arange(BLOCK)].view(np.uint64)
    order = np.lexsort((values[:, 1], values[:, 0]))
    sorted_ = values[order]
    tokens = np.empty(len(order), np.int64)
    tokens[order] = np.cumsum(np.concatenate([[1], (sorted_[1:] != sorted_[:-1]).any(axis=1).astype(np.int64)]))
    tokens[~real] = 0
    following = np.arange(1, len(tokens) + 1)
    following[ends - 1] = begins
    preceding = np.arange(-1, len(tokens) - 1)
    preceding[begins] = ends - 1
    orders, transforms, lo = [], [], 0
    while lo < len(blocks):
        hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + SHARD, side="right")))
        x, y = int(begins[lo]), int(ends[hi - 1])
        o, t = shard_transform(tokens[x:y], following[x:y] - x, preceding[x:y] - x)
        orders.append(o + x)
        transforms.append(t)
        lo = hi
    place, interval = merge_transforms(transforms, depth)
    place = np.concatenate(orders)[place]
    full = blocks[string[place]] - index[place] >= depth
    sizes = np.bincount(interval, weights=full, minlength=int(interval[-1]) + 1)
    chosen = full & (sizes[interval] >= 2)
    q, group, s = where[place[chosen]], interval[chosen].astype(np.uint64), string[place[chosen]]
    padded = np.concatenate([np.zeros(spare, np.uint8), strings, np.zeros(spare, np.uint8)])
    for left in range(spare):
        p = q - left
        fits = (p >= at[s]) & (p + k <= at[s + 1])
        if fits.sum() < 2:
            continue
        p, g, base = p[fits], group[fits], q[fits] + spare
        ends_ = np.concatenate([padded[(base - left)[:, None] + np.arange(left)], padded[(base + depth * BLOCK)[:, None] + np.arange(spare - left)]], axis=1)
        if ends_.shape[1] % 8:
            ends_ = np.concatenate([ends_, np.zeros((len(ends_), 8 - ends_.shape[1] % 8), np.uint8)], axis=1)
        keys = [g, *np.ascontiguousarray(ends_).view(np.uint64).T]
        o = np.lexsort(keys)
        same = np.ones(len(o) - 1, bool)
        for x in keys:
            same &= x[o][1:] == x[o][:-1]
        dup[p[o[1:][same]]] = True
        dup[p[o[:-1][same]]] = True
    return dup


def _bucket(payloads: list[bytes], k: int) -> Iterator[pa.RecordBatch]:
    col, text = c.unpack(payloads)
    same, at = c.distinct_strings(col, text)
    times = np.bincount(same, minlength=len(same))[same]
    whole = (times > 1) & (col["flag"] == 0)
    out = [[col["id"][whole], col["h"][whole], col["start"][whole], col["windows"][whole]]]
    keep = np.flatnonzero(same == np.arange(len(same)))
    _, kind, size = np.unique(col["key"][keep], return_inverse=True, return_counts=True)
    keep = keep[size[kind] > 1]
    if len(keep):
        keep = keep[np.argsort(col["key"][keep], kind="stable")]
        raw = memoryview(text)
        strings = np.frombuffer(b"".join([raw[at[i] : at[i + 1]] for i in keep.tolist()]), np.uint8)
        cut = np.concatenate([[0], np.cumsum(col["length"][keep], dtype=np.int64)])
        dup = repeated_starts(strings, cut, col["anchor"][keep].astype(np.int64), k)
        begin = np.zeros(len(strings), bool)
        begin[cut[:-1]] = True
        starts, n = c.runs(dup, begin)
        i = np.searchsorted(cut, starts, side="right") - 1
        rows = keep[i]
        new = (times[rows] == 1) & (col["flag"][rows] == 0)
        out.append([col["id"][rows][new], col["h"][rows][new], (col["start"][rows] + starts - cut[i])[new], n[new]])
    ids, hs, s, n = (np.concatenate(x) for x in zip(*out, strict=True))
    if len(ids):
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hs), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], schema=c.SPANS)


def repeated_bytes(docs: DataFrame, k: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _h, s, n``: runs of n windows of k bytes, from byte s on, that start elsewhere too."""
    n = c.partitions(docs.sparkSession)
    buckets = 8 * n
    texts = c.keyed(docs, id_col, text_col)
    bins = c.hot_bins(texts, lambda chunk: string_keys(chunk, k), buckets)
    moved = texts.mapInArrow(lambda it: _map(it, k, buckets, bins), c.MOVED_SQL)
    dealt = moved.repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda it: c.by_bucket(it, lambda p: _bucket(p, k), earliest=False), c.SPANS_SQL)


def suffix_dedup(docs: DataFrame, k: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kept`` (remaining bytes), ``n_bytes, n_removed, n_spans, kept_sha256, spans`` (removed runs, as (start, length))."""
    spans = repeated_bytes(docs, k, id_col, text_col)

    def finish(batches):
        for batch in batches:
            rows = []
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for text, spans in zip(texts, c.span_lists(batch.column(3)), strict=True):
                kept, cut = text, []
                if spans:
                    gone = c.covered(len(text), spans[0], spans[1] + (k - 1))
                    s, n = c.runs(gone, np.zeros(len(gone), bool))
                    cut = [{"start": x, "length": y} for x, y in zip(s.tolist(), n.tolist(), strict=True)]
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((kept, len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), cut))
            kept, n, removed, count, sha, cut = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(sha, pa.string()), pa.array(cut, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))], names=["_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    joined = c.spans_by_document(spans, c.keyed(docs, id_col, text_col)).select("_id", "_h", "_text", "_spans")
    done = joined.mapInArrow(finish, "_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,length:int>>")
    return done.select(c.plain_id(), "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
