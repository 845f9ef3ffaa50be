"""Line deduplication over levelled sorted runs of line hashes.

Documents arrive in batches. A batch's line keys (128-bit hashes, with the number of documents and the
largest id) are merge-joined with the runs held so far: keys that no run holds become a new sorted
run (so runs are disjoint), the others are logged as increments. When a level has ``fanout`` runs
they are compacted into one run of the next level, again sorted. Totals over runs and increments
tell which lines are common; documents then drop them. Runs are tables in the shared folder, so a
lost executor costs a task, not the index.

A key is the line without ASCII white space at its ends, A-Z lower-cased. Keys below ``min_chars``
code points always stay. A line that ``min_docs`` documents hold stays in the one of largest id.

Defined cases: null or empty text is one empty line; a null id sorts first; each row counts as a
document, so rows that repeat an id and hold the largest id all keep the line; very long texts are split as
whole texts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common as c

WHITE = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int) -> bytes | None:
    """The 16-byte hash of a line's key, None if the key is short."""
    key = line.strip(WHITE)
    return hashlib.blake2b(key.encode().lower(), digest_size=16).digest() if len(key) >= min_chars else None


def line_hashes(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _h, hi, lo``: the distinct long keys of each row."""

    def work(batches):
        for batch in c.slices(batches):
            keys, n = [], []
            for text in batch.column(2).to_pylist():
                own = {k for line in text.split("\n") if (k := line_key(line, min_chars))}
                keys += own
                n.append(len(own))
            at = np.repeat(np.arange(len(n)), n)
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["_id", "_h", "hi", "lo"])

    return c.keyed(docs, id_col, text_col).mapInArrow(work, "_id long, _h long, hi long, lo long")


class LineRuns:
    """The levelled runs. The driver holds only the tables' paths."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.increments: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _sorted(self, df: DataFrame) -> DataFrame:
        return c.store(df.select("hi", "lo", "n", "top").repartition(c.partitions(self.spark), "hi", "lo").sortWithinPartitions("hi", "lo"))

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` that no run holds."""
        for run in self.runs():
            keys = keys.join(run.select("hi", "lo"), ["hi", "lo"], "left_anti")
        return keys

    def ingest(self, lines: DataFrame) -> DataFrame:
        """Add a batch of ``_id, hi, lo`` rows; returns the run of keys that it saw first."""
        own = lines.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("_id").alias("top"))
        held = self.runs()
        if held:
            own = c.store(own)
            self.increments.append(own.join(self.unseen(own).select("hi", "lo"), ["hi", "lo"], "left_anti"))
        fresh = self._sorted(self.unseen(own))
        self.levels[0].append(fresh)
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                merged = self.levels[k][0]
                for run in self.levels[k][1:]:
                    merged = merged.unionByName(run)
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._sorted(merged))
                self.levels[k] = []
        return fresh

    def common(self, min_docs: int) -> DataFrame:
        """``hi, lo, top`` of the keys that ``min_docs`` documents hold."""
        every = self.runs() + self.increments
        out = every[0]
        for t in every[1:]:
            out = out.unionByName(t)
        return out.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("top").alias("top")).filter(F.col("n") >= min_docs).select("hi", "lo", "top")


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``text`` (lines kept), ``n_lines, n_dropped, kept_sha256``; ``docs`` goes through the runs in ``batches`` parts by id."""
    runs = LineRuns(docs.sparkSession, fanout)
    lines = c.store(line_hashes(docs, min_chars, id_col, text_col).withColumn("part", F.pmod(F.xxhash64("_id"), F.lit(batches))), "part")
    for k in range(batches):
        runs.ingest(lines.filter(F.col("part") == k))
    common = c.store(runs.common(min_docs))
    drops = lines.join(common, ["hi", "lo"]).filter(F.col("_id") < F.col("top")).groupBy("_id", "_h").agg(F.collect_set(F.struct("hi", "lo")).alias("_keys"))
    own = [F.col(x).alias(f"_keep_{x}") for x in keep]
    table = c.keyed(docs, id_col, text_col, *own)
    more = table.columns[3:]
    fields = "".join(f", `{x.name}` {x.dataType.simpleString()}" for x in table.schema.fields[3:])
    joined = table.join(drops, ["_id", "_h"], "left").select("_id", "_h", "_text", "_keys", *more)

    def finish(it):
        for batch in c.slices(it):
            rows = []
            for text, keys in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                lines = text.split("\n")
                kept = lines
                if keys:
                    gone = {np.array([k["hi"], k["lo"]], np.int64).tobytes() for k in keys}
                    kept = [x for x in lines if line_key(x, min_chars) not in gone]
                out = "\n".join(kept)
                rows.append((out, len(lines), len(lines) - len(kept), hashlib.sha256(out.encode()).hexdigest()))
            text, n, dropped, sha = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string()), *(batch.column(i) for i in range(4, batch.num_columns))], names=["_id", "_h", "text", "n_lines", "n_dropped", "kept_sha256", *more])

    done = joined.mapInArrow(finish, f"_id long, _h long, text string, n_lines long, n_dropped long, kept_sha256 string{fields}")
    return done.select(c.plain_id(), *(F.col(f"_keep_{x}").alias(x) for x in keep), "text", "n_lines", "n_dropped", "kept_sha256")
