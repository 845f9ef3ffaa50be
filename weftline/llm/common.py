"""What the text operators share: row keys, whole-text chunks as numpy arrays, rolling hashes,
compressed blobs that travel to buckets, and the shared folder for written tables.

A document is known inside an operator by ``(_id, _h)``: its integer id (null becomes the smallest
long) and the xxhash64 of its text. Rows that repeat both are one document that comes out once for
each row, always with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.storage import scratch  # noqa: F401  operators take it from here
from weftline.storage import stored as store  # noqa: F401

NULL_ID = -(2**63)
CHUNK, SMALL = 2 << 20, 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``_id, _h, _text`` and further columns under their own names; a null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text"), *more)


def plain_id(name: str = "doc_id"):
    """The public id again."""
    return F.when(F.col("_id") != NULL_ID, F.col("_id")).alias(name)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column and its offsets, without a copy."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if at is not None and len(column) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)


class Chunk:
    """Whole texts of about CHUNK bytes (one longer text is a chunk of its own), each followed by a line feed."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.ids, self.hashes = ids, hashes
        raw = memoryview(data)
        lens = np.diff(offsets)
        self.lens = lens
        self.starts = offsets[:-1] - offsets[0] + np.arange(len(lens))
        self.data = np.frombuffer(b"\n".join([*(raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), b""]), np.uint8)

    def texts(self) -> Iterator[bytes]:
        raw = self.data.tobytes()
        for a, n in zip(self.starts.tolist(), self.lens.tolist(), strict=True):
            yield raw[a : a + n]


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK) -> Iterator[Chunk]:
    """Cut batches whose first columns are ``_id, _h, _text``."""
    for batch in batches:
        ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        data, offsets = buffers(batch.column(2))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield Chunk(ids[at:to], hashes[at:to], data, offsets[at : to + 1])
            at = to


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, where texts become Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a chunk: ``norm`` has each followed by one space."""

    def __init__(self, chunk: Chunk, lower: bool = False):
        data = chunk.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        word = ~_SPACE[data]
        keep = word.copy()
        keep[1:] |= word[:-1]
        norm, inside = data[keep], word[keep]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        self.norm = np.where(inside, norm, np.uint8(32))
        self.starts = np.flatnonzero(first)
        self.ends = np.append(self.starts[1:], len(norm)) - 1 if len(self.starts) else self.starts
        kept_before = np.cumsum(keep)
        doc_at = np.where(chunk.starts > 0, kept_before[np.maximum(chunk.starts, 1) - 1], 0) if len(chunk.starts) else chunk.starts
        self.first_word = np.searchsorted(self.starts, doc_at)
        self.counts = np.diff(np.append(self.first_word, len(self.starts)))
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.total = len(self.starts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Polynomial hashes modulo 2**64 of any span of a sequence, from prefix sums. Two of them make 128 bits."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, multiplier: int):
        n = len(values) + 1
        powers, inverse = self._table(multiplier, n)
        self.inverse = inverse
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values * powers[: n - 1], out=self.sums[1:])

    @classmethod
    def _table(cls, m: int, n: int):
        have = cls._powers.get(m)
        if have is None or len(have[0]) < n:
            size = max(n, 1 << 16)
            cls._powers[m] = have = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64))]) for x in (m, pow(m, -1, 1 << 64)))
        return have

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a])

    def windows(self, k: int) -> np.ndarray:
        """Of every span of k values."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


M1, M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(M1))


def byte_hash(data: np.ndarray, multiplier: int = M1) -> Rolling:
    return Rolling(_BYTE[data], multiplier)


def word_hashes(words: Words) -> np.ndarray:
    """64 bits for each word."""
    return byte_hash(words.norm).spans(words.starts, words.ends)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive values, by doubling."""
    if len(v) < w:
        return v[:0]
    span = 1
    while span * 2 <= w:
        v = np.minimum(v[: len(v) - span], v[span:])
        span *= 2
    rest = w - span
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def runs(marks: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true marks; a new run begins where ``breaks`` is true."""
    if not len(marks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.zeros_like(marks)
    before[1:] = marks[:-1]
    starts = np.flatnonzero(marks & (~before | breaks))
    after = np.zeros_like(marks)
    after[:-1] = marks[1:] & ~breaks[1:]
    return starts, np.flatnonzero(marks & ~after) + 1 - starts


def each_window(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each window of the strings starts, and the number of its string."""
    owner = np.repeat(np.arange(len(count)), count)
    return np.repeat(first, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count), owner


FIELDS = (("id", np.int64), ("h", np.int64), ("key", np.uint64), ("start", np.int32), ("windows", np.int32), ("length", np.int32), ("anchor", np.int32), ("flag", np.int8))


def squeeze(body: bytes) -> bytes:
    """Compressed, with its length in front."""
    return np.int64(len(body)).tobytes() + pa.Codec("zstd", compression_level=3).compress(body, asbytes=True)


def spread(payload: bytes) -> bytes:
    return pa.decompress(payload[8:], int(np.frombuffer(payload[:8], np.int64)[0]), codec="zstd", asbytes=True)


class Blobs:
    """Packed strings on their way to buckets: gathered by bucket, compressed, and sent once a limit is reached."""

    def __init__(self, buckets: int, limit: int = 24 << 20):
        self.buckets, self.limit, self.size = buckets, limit, 0
        self.held: dict[int, list[tuple[list[np.ndarray], bytes]]] = {}

    def add(self, key: np.ndarray, columns: dict[str, np.ndarray], text: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Strings ``text[a:b]`` for the buckets of their keys, with columns of FIELDS."""
        bucket = (mix(key) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        raw = memoryview(text)
        pieces = [raw[x:y] for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True)]
        n = len(order)
        have = {k: columns[k][order].astype(t) if k in columns else np.zeros(n, t) for k, t in FIELDS}
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
            if x < y:
                packed = b"".join(pieces[x:y])
                self.held.setdefault(int(bucket[x]), []).append(([have[k][x:y] for k, _ in FIELDS], packed))
                self.size += len(packed) + 48 * (y - x)
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, bytes]] = []
        size = 0
        for k, parts in sorted(self.held.items()):
            columns = [np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True)]
            body = b"".join([np.int64(len(columns[0])).tobytes(), *(c.tobytes() for c in columns), *(p[1] for p in parts)])
            out.append((k, squeeze(body)))
            size += len(out[-1][1])
            if size > 4 << 20:
                yield self._batch(out)
                out, size = [], 0
        if out:
            yield self._batch(out)
        self.held, self.size = {}, 0

    @staticmethod
    def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], schema=MOVED)


MOVED = pa.schema([("bucket", pa.int32()), ("payload", pa.binary()), ("_id", pa.int64()), ("_h", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])
MOVED_SQL = "bucket int, payload binary, _id long, _h long, s int, n int"
SPANS = pa.schema([("_id", pa.int64()), ("_h", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])
SPANS_SQL = "_id long, _h long, s int, n int"


def known(ids, hashes, s, n, buckets: int) -> pa.RecordBatch:
    """Spans (in order) that are settled before the exchange, joined where one follows the other; they travel spread by document."""
    s, n = np.asarray(s, np.int64), np.asarray(n, np.int64)
    first = np.ones(len(s), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]) | (s[1:] != s[:-1] + n[:-1])
    at = np.flatnonzero(first)
    if len(at):
        ids, hashes, s, n = ids[at], hashes[at], s[at], np.add.reduceat(n, at)
    k = len(ids)
    bucket = (mix(np.asarray(hashes).view(np.uint64) ^ mix(np.asarray(ids).view(np.uint64))) % np.uint64(buckets)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.nulls(k, pa.binary()), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(np.asarray(s, np.int32)), pa.array(np.asarray(n, np.int32))], schema=MOVED)


BINS = 1 << 20


def key_bin(key: np.ndarray) -> np.ndarray:
    """One of BINS classes of a minimiser."""
    return (mix(key) >> np.uint64(44)).astype(np.int64)


def hot_bins(docs: DataFrame, keys, buckets: int) -> np.ndarray:
    """The classes of minimisers that hold more strings than a bucket's even share, so at most ``buckets``. A task counts its strings by class and
    sends the classes that stand out there; what it finds decides only how a class travels, not what is found."""

    def count(batches):
        seen = np.zeros(BINS, np.int64)
        for chunk in chunks(batches):
            seen += np.bincount(key_bin(keys(chunk)), minlength=BINS)
        total = int(seen.sum())
        at = np.flatnonzero(seen >= max(16, 8 * total // BINS))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(seen[at], total))], names=["bin", "n"])

    counted = store(docs.mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")))
    total = counted.filter("bin = -1").first()
    if total is None:
        return np.zeros(0, np.int64)
    return np.array(sorted(r["bin"] for r in counted.filter(F.col("bin") >= 0).filter(F.col("n") * buckets > F.lit(total["n"])).select("bin").collect()), np.int64)


class HotWindows:
    """Windows of hot minimisers, which travel one by one under their 128-bit fingerprint, so that a common passage is spread over all
    buckets. A task gathers up to ``limit`` of them and sends each distinct one once: with ``earliest`` the first start, the later ones being
    settled; else any, and all that repeat are settled, which the sent one says of itself. They are packed by bucket, an eighth as many as
strings have, and such a payload has 1 in column n."""

    def __init__(self, bins: np.ndarray, buckets: int, earliest: bool, limit: int = 1 << 20):
        self.hot = np.zeros(BINS, bool)
        self.hot[bins] = True
        self.buckets, self.earliest, self.limit, self.size = max(1, buckets // 8), earliest, limit, 0
        self.held: list[tuple[np.ndarray, ...]] = []

    def takes(self, key: np.ndarray) -> np.ndarray:
        return self.hot[key_bin(key)]

    def add(self, fa, fb, ids, hashes, s, settled) -> Iterator[pa.RecordBatch]:
        self.held.append((fa, fb, ids, hashes, s, settled))
        self.size += len(fa)
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        fa, fb, ids, hashes, s, settled = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        keep, late, settled = window_groups(fa, fb, ids, hashes, s, settled, self.earliest)
        if len(late):
            yield known(ids[late], hashes[late], s[late], np.ones(len(late), np.int64), self.buckets)
        bucket = (fa[keep] % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        keep, bucket = keep[order], bucket[order]
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        columns = [x[keep].astype(t) for x, (_, t) in zip((fa, fb, ids, hashes, s, settled), WINDOW, strict=True)]
        rows = [squeeze(b"".join([np.int64(y - x).tobytes(), *(v[x:y].tobytes() for v in columns)])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        k = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(rows, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array(np.ones(k, np.int32))], schema=MOVED)


WINDOW = (("fa", np.uint64), ("fb", np.uint64), ("id", np.int64), ("h", np.int64), ("s", np.int64), ("settled", np.int8))


def unpack_windows(payload: bytes) -> tuple[np.ndarray, ...]:
    body = spread(payload)
    n, at, out = int(np.frombuffer(body[:8], np.int64)[0]), 8, []
    for _, t in WINDOW:
        out.append(np.frombuffer(body, t, n, at))
        at += n * np.dtype(t).itemsize
    return tuple(out)


def window_groups(fa, fb, ids, hashes, s, settled, earliest: bool):
    """Of equal fingerprints: the row kept, the rows found to be late or repeated and not settled yet (in order of document and start), and all rows' new state."""
    order = np.lexsort((s, hashes, ids, fb, fa))
    first = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    first[1:] = (fa[a] != fa[b]) | (fb[a] != fb[b])
    group = np.cumsum(first) - 1
    keep = order[first]
    if earliest:
        lead = keep[group]
        found = order[(ids[order] != ids[lead]) | (hashes[order] != hashes[lead]) | (s[order] != s[lead])]
        state = settled
    else:
        found = order[(np.bincount(group)[group] > 1) & (settled[order] == 0)]
        state = settled.copy()
        state[found] = 1
        # the kept row is settled if any of its group was
        any_settled = np.zeros(len(keep), state.dtype)
        np.maximum.at(any_settled, group, state[order])
        state[keep] = any_settled
    return keep, found[np.lexsort((s[found], hashes[found], ids[found]))], state


def hot_spans(rows: list[tuple[np.ndarray, ...]], earliest: bool) -> Iterator[pa.RecordBatch]:
    """The spans of a bucket's windows that start elsewhere too (``earliest``: earlier)."""
    fa, fb, ids, hashes, s, settled = (np.concatenate(x) for x in zip(*rows, strict=True))
    _, found, _ = window_groups(fa, fb, ids, hashes, s, settled, earliest)
    if len(found):
        t = known(ids[found], hashes[found], s[found], np.ones(len(found), np.int64), 1)
        yield pa.RecordBatch.from_arrays([t.column(i) for i in (2, 3, 4, 5)], schema=SPANS)


def unpack(payloads: list[bytes]) -> tuple[dict[str, np.ndarray], bytes]:
    """The columns and the strings, end to end, of a bucket's blobs."""
    columns: list[list[np.ndarray]] = []
    texts: list[bytes] = []
    for p in payloads:
        body = spread(p)
        n, at, row = int(np.frombuffer(body[:8], np.int64)[0]), 8, []
        for _, t in FIELDS:
            row.append(np.frombuffer(body, t, n, at))
            at += n * np.dtype(t).itemsize
        columns.append(row)
        texts.append(body[at:])
    return {k: np.concatenate(x) for (k, _), x in zip(FIELDS, zip(*columns, strict=True), strict=True)}, b"".join(texts)


def by_bucket(batches: Iterator[pa.RecordBatch], work, earliest: bool) -> Iterator[pa.RecordBatch]:
    """Over a partition sorted by bucket: pass settled spans on, call ``work(payloads)`` for each bucket, and compare its hot windows."""
    bucket, held, hot = None, [], []

    def done():
        if held:
            yield from work(held)
        if hot:
            yield from hot_spans(hot, earliest)

    for batch in batches:
        b = batch.column(0).to_numpy()
        settled = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        if settled.any():
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(settled)) for i in (2, 3, 4, 5)], schema=SPANS)
        for i in np.flatnonzero(~settled).tolist():
            if b[i] != bucket:
                yield from done()
                bucket, held, hot = b[i], [], []
            payload = batch.column(1)[i].as_py()
            if batch.column(5)[i].is_valid:
                hot.append(unpack_windows(payload))
            else:
                held.append(payload)
    yield from done()


def distinct_strings(columns: dict[str, np.ndarray], text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each string the number of the first equal one, compared as bytes, and the offsets."""
    at = np.concatenate([[0], np.cumsum(columns["length"], dtype=np.int64)])
    seen: dict[bytes, int] = {}
    cuts = at.tolist()
    return np.fromiter((seen.setdefault(text[a:b], i) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))), np.int64, len(cuts) - 1), at


def spans_by_document(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """``_id, _h, _text, _spans`` (an array of (s, n), null where there is none)."""
    listed = spans.groupBy("_id", "_h").agg(F.collect_list(F.struct("s", "n")).alias("_spans"))
    return docs.join(listed, ["_id", "_h"], "left")


def span_lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """The spans of each row as arrays."""
    inner = column.values
    s, n = (inner.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    at = column.offsets.to_numpy()
    for i, there in enumerate(column.is_valid().to_numpy(zero_copy_only=False).tolist()):
        yield (s[at[i] : at[i + 1]], n[at[i] : at[i + 1]]) if there and at[i + 1] > at[i] else None


def covered(length: int, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of ``length`` places the spans cover."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, s, 1)
    np.add.at(change, s + n, -1)
    return np.cumsum(change[:-1]) > 0
