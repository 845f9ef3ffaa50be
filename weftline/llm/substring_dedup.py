"""Exact substring deduplication over windows of words, by super-k-mers.

Each window of ``k`` words belongs to its minimiser, the gram of ``m`` words with the least hash.
Consecutive windows that share one travel as one packed string to the minimiser's bucket, so all
occurrences of a window meet there; sorting the windows' 128-bit fingerprints then counts them. Before the
exchange every chunk keeps one of equal strings: the others' windows have an earlier start already.

A minimiser of a passage that many documents share would bring all their strings to one bucket. A first pass finds the minimisers that
hold more than a bucket's share; their windows travel one by one under their fingerprints instead, each distinct one once a
task, and are spread over all buckets.

Defined cases: null or empty texts have no words; a null id sorts first; rows that repeat id and
text are one document; windows equal in words match whatever white space separates them; a very long text is a chunk of its
own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm import common as c


def _earliest(ids, hashes, starts, group):
    """Of each group the row with the smallest (id, hash, start)."""
    order = np.lexsort((starts, hashes, ids, group))
    g = group[order]
    return order[np.concatenate([[True], g[1:] != g[:-1]])] if len(g) else order


def pack(chunk: c.Chunk, k: int, m: int):
    """The chunk's super-k-mers: document, first word, windows, minimiser's hash and span in ``words.norm``."""
    words = c.Words(chunk)
    if words.total < k:
        return words, None
    hashes = c.word_hashes(words)
    grams = c.Rolling(hashes, c.M2).windows(m)
    place = np.arange(len(grams), dtype=np.uint64)
    least = c.sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | place, k - m + 1)
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    n = words.total - k + 1
    valid = words.doc[:n] == words.doc[k - 1 :]
    new = np.ones(n, bool)
    new[1:] = at[1:] != at[:-1]
    starts, count = c.runs(valid, new)
    return words, (words.doc[starts], starts, count, grams[at[starts]], hashes)


def string_keys(chunk: c.Chunk, k: int, m: int) -> np.ndarray:
    """The minimiser of each of the chunk's super-k-mers."""
    packed = pack(chunk, k, m)[1]
    return packed[3] if packed is not None else np.zeros(0, np.uint64)


def _map(batches: Iterator[pa.RecordBatch], k: int, m: int, buckets: int, bins: np.ndarray) -> Iterator[pa.RecordBatch]:
    blobs, hot = c.Blobs(buckets), c.HotWindows(bins, buckets, earliest=True)
    for chunk in c.chunks(batches):
        words, packed = pack(chunk, k, m)
        if packed is None or not len(packed[1]):
            continue
        doc, first, count, key, hashes = packed
        last = first + count + k - 1
        rolling = [c.Rolling(hashes, x) for x in (c.M1, c.M2)]
        marks = [r.spans(first, last) for r in rolling]
        order = np.lexsort(marks[::-1])
        same = np.concatenate([[False], (marks[0][order][1:] == marks[0][order][:-1]) & (marks[1][order][1:] == marks[1][order][:-1])])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(~same)
        ids, hs, start = chunk.ids[doc], chunk.hashes[doc], first - words.first_word[doc]
        keep = np.sort(_earliest(ids, hs, start, group))
        rest = np.ones(len(order), bool)
        rest[keep] = False
        # the kept one may be another copy of the very same document
        kept_of = np.empty(int(group.max()) + 1, np.int64)
        kept_of[group[keep]] = keep
        other = kept_of[group]
        rest &= (ids != ids[other]) | (hs != hs[other]) | (start != start[other])
        if rest.any():
            yield c.known(ids[rest], hs[rest], start[rest], count[rest], buckets)
        warm = hot.takes(key[keep])
        single, keep = keep[warm], keep[~warm]
        if len(single):
            w, owner = c.each_window(first[single], count[single])
            yield from hot.add(*(r.spans(w, w + k) for r in rolling), ids[single][owner], hs[single][owner], w - words.first_word[doc[single][owner]], np.zeros(len(w), np.int64))
        if not len(keep):
            continue
        a, b = words.starts[first[keep]], words.ends[last[keep] - 1] + 1
        yield from blobs.add(key[keep], {"id": ids[keep], "h": hs[keep], "start": start[keep], "windows": count[keep], "length": b - a}, words.norm, a, b)
    yield from blobs.flush()
    yield from hot.flush()


def _bucket(payloads: list[bytes], k: int) -> Iterator[pa.RecordBatch]:
    col, text = c.unpack(payloads)
    same, at = c.distinct_strings(col, text)
    keep = _earliest(col["id"], col["h"], col["start"], same)
    first_of = np.empty(len(same), np.int64)
    first_of[same[keep]] = keep
    other = first_of[same]
    late = (col["id"] != col["id"][other]) | (col["h"] != col["h"][other]) | (col["start"] != col["start"][other])
    out = [[col["id"][late], col["h"][late], col["start"][late], col["windows"][late]]]
    # the distinct strings in order of their first start: a stable sort then leaves the first of equal windows in front
    keep = keep[np.lexsort((col["start"][keep], col["h"][keep], col["id"][keep]))]
    raw = memoryview(text)
    joined = np.frombuffer(b"".join([raw[at[i] : at[i + 1]] for i in keep.tolist()]), np.uint8)
    space = joined == 32
    ends = np.flatnonzero(space)
    hashes = c.byte_hash(joined).spans(np.concatenate([[0], ends[:-1] + 1]), ends)
    count = col["windows"][keep].astype(np.int64)
    word_at = np.concatenate([[0], np.cumsum(count + k - 1)])[:-1]
    string = np.repeat(np.arange(len(keep)), count)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
    w = word_at[string] + offset
    fa, fb = (c.Rolling(hashes, x).spans(w, w + k) for x in (c.M1, c.M2))
    order = np.argsort(fa, kind="stable")
    eq_a, eq_b = (x[order][1:] == x[order][:-1] for x in (fa, fb))
    if (eq_a & ~eq_b).any():
        order = np.lexsort((fb, fa))
        eq_a, eq_b = (x[order][1:] == x[order][:-1] for x in (fa, fb))
    dup = np.zeros(len(order), bool)
    dup[order[1:]] = eq_a & eq_b
    starts, n = c.runs(dup, offset == 0)
    rows = keep[string[starts]]
    out.append([col["id"][rows], col["h"][rows], col["start"][rows] + offset[starts], n])
    ids, hs, s, n = (np.concatenate(x) for x in zip(*out, strict=True))
    if len(ids):
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hs), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], schema=c.SPANS)


def repeated_windows(docs: DataFrame, k: int = 20, m: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _h, s, n``: runs of n windows, from word s on, whose words also start earlier."""
    spark = docs.sparkSession
    n = c.partitions(spark)
    buckets = 8 * n
    texts = c.keyed(docs, id_col, text_col)
    bins = c.hot_bins(texts, lambda chunk: string_keys(chunk, k, m), buckets)
    moved = texts.mapInArrow(lambda it: _map(it, k, m, buckets, bins), c.MOVED_SQL)
    dealt = moved.repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda it: c.by_bucket(it, lambda p: _bucket(p, k), earliest=True), c.SPANS_SQL)


def substring_dedup(docs: DataFrame, k: int = 20, m: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` (kept words joined by a space), ``n_words, n_removed, kept_sha256, spans`` (removed words, as (start, length))."""
    spans = repeated_windows(docs, k, m, id_col, text_col)

    def finish(batches):
        for batch in batches:
            rows = []
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for text, spans in zip(texts, c.span_lists(batch.column(3)), strict=True):
                words, removed, cut = text.split(), 0, []
                if spans:
                    gone = c.covered(len(words), spans[0], spans[1] + (k - 1))
                    removed = int(gone.sum())
                    s, n = c.runs(gone, np.zeros(len(gone), bool))
                    cut = [{"start": x, "length": y} for x, y in zip(s.tolist(), n.tolist(), strict=True)]
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                else:
                    kept = b" ".join(words)
                rows.append((len(words) if words else 0, removed, hashlib.sha256(kept).hexdigest(), kept, cut))
            n_words, n_removed, sha, kept, cut = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(cut, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))], names=["_id", "text", "n_words", "n_removed", "kept_sha256", "spans"])

    joined = c.spans_by_document(spans, c.keyed(docs, id_col, text_col)).select("_id", "_h", "_text", "_spans")
    done = joined.mapInArrow(finish, "_id long, text string, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,length:int>>")
    return done.select(c.plain_id(), "text", "n_words", "n_removed", "kept_sha256", "spans")
