"""WARC archives of pages, read back, and their capture index merged from sorted runs.

Writing: payload digests come first; of equal payloads of ``min_bytes`` or more the page of least id is the
response and the others revisit it. Each record is a gzip member of its own, so the index's offset and length fetch one
record without the rest. Members are gathered into archives of about ``archive_bytes`` (a larger record is an archive of its own),
and Spark's text writer makes a file of each, so files are committed by task and a lost executor's work is redone. The
writer ends a file with a zero byte, which gzip readers take as padding.

Reading: archives are taken apart member by member. Each archive yields one capture run sorted by (URL key, timestamp, page),
stored as a table: the external runs. They are dealt by ranges of that key, so many that a range has about RANGE_ROWS
captures whatever the input; each task holds its slices of the k runs as Arrow columns and merges them with a loser tree that
turns a few rows of each at a time into tuples. Partitions in order hold all capture
histories in global order. A host or a URL may hold most captures: ranges cut inside hosts and URLs.

Defined cases: null html is an empty payload; a null url is an empty URL; a null page id counts as
the smallest id and comes back as null; rows that repeat page id and payload are all of the same type; small
payloads are never revisits; a very long payload is an archive of its own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common as c

END = "\r\n"
ARCHIVE, RANGE_ROWS, STEP = 16 << 20, 200_000, 1 << 14
INDEX_SQL = "url_key string, ts string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"
INDEX = pa.schema([("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write_archives(pages: DataFrame, path: str, min_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE) -> None:
    """Write one record for each page into archives under ``path``."""
    t = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(c.NULL_ID)).alias("id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\r\n]", "%0A").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    t = t.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html"))
    sized = t.filter(F.col("bytes") >= min_bytes).select("id", "digest")
    first = sized.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first != last").select("digest", "first")
    again = sized.join(first, "digest").filter("id != first").select("id", "digest", "first").distinct()
    t = t.join(again, ["id", "digest"], "left")
    revisit = F.col("first").isNotNull()
    head = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: <urn:page:"), F.col("id").cast("string"),
        F.lit(f">{END}WARC-Target-URI: "), F.col("url"),
        F.lit(f"{END}WARC-Date: "), F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.pmod("id", F.lit(100_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit(f"{END}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit(f"{END}X-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"{END}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit(f"{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.when(revisit, "0").otherwise(F.col("bytes").cast("string")),
        F.lit(END + END), F.when(revisit, "").otherwise(F.col("html")), F.lit(END + END),
    )

    def pack(batches):
        out, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                out.append(gzip.compress(record.as_buffer(), mtime=0))
                size += len(out[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["value"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["value"])

    archives = t.select(head.alias("value")).mapInArrow(pack, "value binary")
    archives.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


def url_key(url: str) -> str:
    """Host labels reversed, then the path, lower-cased; without scheme, ``www``, port and fragment."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)([^#]*)", url.lower())
    host = re.sub(r":\d+$", "", m[1].rpartition("@")[2])
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def records(data: memoryview | bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length (both of the gzip member), headers and payload of each record of an archive."""
    at, raw = 0, memoryview(data)
    while at < len(raw) and raw[at]:
        member, parts, to = zlib.decompressobj(31), [], at
        while not member.eof:
            if to >= len(raw):
                raise ValueError(f"the record at byte {at} is cut off")
            parts.append(member.decompress(raw[to : to + STEP]))
            to += STEP
        to = min(to, len(raw)) - len(member.unused_data)
        record = b"".join(parts)
        body = record.index(b"\r\n\r\n") + 4
        lines = record[: body - 4].decode().split(END)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield at, to - at, fields, record[body : body + int(fields["Content-Length"])]
        at = to


def _page(urn: str | None) -> int | None:
    return int(urn.removeprefix("<urn:page:").removesuffix(">")) if urn else None


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under ``path``: one sorted run for each archive. Response payloads are hashed anew."""

    def work(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for at, length, f, payload in records(content.as_buffer()):
                    kind = f["WARC-Type"]
                    digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {f['WARC-Record-ID']} doesn't match its digest")
                    rows.append((url_key(f["WARC-Target-URI"]), f["WARC-Date"], _page(f["WARC-Record-ID"]), f["WARC-Target-URI"], kind, _page(f.get("WARC-Refers-To")), len(payload) if kind == "response" else int(f["X-Payload-Length"]), digest, name.as_py(), at, length))
                rows.sort(key=lambda r: r[:3])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), INDEX.types, strict=True)], schema=INDEX)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, INDEX_SQL)


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so each next item costs one path of comparisons."""

    def __init__(self, sources: list[Iterator[tuple]], key: Callable):
        self.sources, self.key, self.k = sources, key, len(sources)
        self.items = [next(s, None) for s in sources]
        self.keys = [None if x is None else key(x) for x in self.items]
        self.losers = [-1] * max(1, self.k)
        self.winner = self._build(1) if self.k else -1

    def _beats(self, i: int, j: int) -> bool:
        if self.keys[i] is None or self.keys[j] is None:
            return self.keys[j] is None and (self.keys[i] is not None or i < j)
        return (self.keys[i], i) < (self.keys[j], j)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self):
        while self.winner >= 0 and self.keys[self.winner] is not None:
            w = self.winner
            yield self.items[w]
            self.items[w] = x = next(self.sources[w], None)
            self.keys[w] = None if x is None else self.key(x)
            node = (w + self.k) // 2
            while node >= 1:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def _slices(batches: Iterator[pa.RecordBatch]) -> list[list[pa.RecordBatch]]:
    """The runs in a range: for each archive its slices in order. A slice that begins before the last one's end starts a run of its own."""
    held: dict[str, list[list[pa.RecordBatch]]] = {}
    key = lambda batch, i: tuple(batch.column(k)[i].as_py() for k in range(3))
    for batch in batches:
        names = batch.column(8).dictionary_encode()
        code = names.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                part = batch.slice(a, b - a)
                own = held.setdefault(names.dictionary[int(code[a])].as_py(), [[]])
                if own[-1] and key(part, 0) < key(own[-1][-1], own[-1][-1].num_rows - 1):
                    own.append([])
                own[-1].append(part)
    return [run for runs in held.values() for run in runs]


def _tuples(run: list[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    for batch in run:
        for at in range(0, batch.num_rows, step):
            yield from zip(*(col.to_pylist() for col in batch.slice(at, step).columns), strict=True)


def merge_index(runs: DataFrame) -> DataFrame:
    """All captures in global order of (URL key, timestamp, page), from stored sorted runs."""
    n = max(c.partitions(runs.sparkSession), -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(n, "url_key", "ts", "page_id")

    def work(batches):
        out = []
        for row in LoserTree([_tuples(run) for run in _slices(batches)], lambda r: r[:3]):
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), INDEX.types, strict=True)], schema=INDEX)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), INDEX.types, strict=True)], schema=INDEX)

    merged = dealt.mapInArrow(work, INDEX_SQL)
    plain = lambda name: F.when(F.col(name) != c.NULL_ID, F.col(name)).alias(name)
    return merged.select(*[plain(x) if x in ("page_id", "refers_to") else x for x in INDEX.names])


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives (to the shared folder unless a path is given), read them back, and return the merged index."""
    spark = pages.sparkSession
    path = path or c.scratch(spark)
    write_archives(pages, path, min_bytes, id_col, url_col, html_col)
    return merge_index(c.store(read_index(spark, path)))
