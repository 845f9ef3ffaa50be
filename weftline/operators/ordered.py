"""Order-dependent work on groups of any size: running sums, and greedy batches.

Rows are dealt by ranges of (group, order), so a group of all rows is spread like any other. What a range or block has to
know of those before it is a few numbers, which are summed or folded over ranges and handed down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.storage import stored

BLOCK = 1 << 16
CLOSED = -1


def same(left: list[str], right: list[str]) -> Column:
    """Null-safe equality of column lists, as columns of two joined tables."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out &= F.col(a).eqNullSafe(F.col(b))
    return out


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``df`` with running sums (this row included) of each group in its order. Ranges are stored with their number; their sums, a row for each
    range and group that meet, give each its start, and a task runs only over one range. ``order`` is to tell the rows of a group
    apart: rows that repeat it lie in one range. Values are integers or decimals, so that sums don't depend on order."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = df.withColumns({f"_v_{k}": v for k, v in sums.items()})
    t = stored(t.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()))
    keys = [f"_g{i}" for i in range(len(group))]
    per = t.groupBy(F.col("_part").alias("_p"), *(F.col(g).alias(k) for g, k in zip(group, keys, strict=True))).agg(*(F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_p", *keys, *(F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums))
    own = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(per, (F.col("_part") == F.col("_p")) & same(group, keys))
    return t.withColumns({k: F.col(f"_b_{k}") + F.sum(f"_v_{k}").over(own) for k in sums}).select(*df.columns, *sums)


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.Array]]:
    """The columns of each stretch of rows that agree in their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for i in range(keys):
            code = batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change |= code[1:] != code[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            piece = batch.slice(a, b - a)
            if held and any(held[0].column(i)[0] != piece.column(i)[0] for i in range(keys)):
                yield [pa.concat_arrays(c) for c in zip(*(b.columns for b in held), strict=True)]
                held = []
            held.append(piece)
    if held:
        yield [pa.concat_arrays(c) for c in zip(*(b.columns for b in held), strict=True)]


def _next(begun: np.ndarray, start: np.ndarray, end: np.ndarray, budget: int, full_closes: bool) -> tuple[np.ndarray, np.ndarray]:
    """For batches that began at the offsets ``begun``, the place of the item that begins the next: the first that doesn't fit, or the one behind
    the item that fills the batch (if that closes it) or that alone is too large. Also whether the batch is closed where the block ends."""
    limit = begun + budget
    at = np.searchsorted(end, limit, side="left" if full_closes else "right")
    there = np.minimum(at, len(end) - 1)
    behind = (at < len(end)) & ((start[there] == begun) | (end[there] == limit if full_closes else False))
    return at + behind, behind & (at + 1 == len(end))


def first_start(state: int, start: np.ndarray, end: np.ndarray, budget: int, full_closes: bool) -> tuple[int, int]:
    """The place of the first batch that begins in a block whose items lie at [start, end) of their lane, and the state behind the block if none does.
    ``state`` is where the open batch began, or CLOSED."""
    if state == CLOSED:
        return 0, CLOSED
    place, closed = _next(np.array([state]), start, end, budget, full_closes)
    return int(place[0]), CLOSED if closed[0] else state


def chains(start: np.ndarray, end: np.ndarray, budget: int, full_closes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item as the begin of a batch: the next begin (the length of the block if there is none), how many begin from here to the
    block's end, and the state there. By pointer doubling."""
    n = len(start)
    step, closed = _next(start, start, end, budget, full_closes)
    jump, count, tail = np.append(step, n), np.append(np.ones(n, np.int64), 0), np.append(np.arange(n), n)
    while (jump[:n] < n).any():
        tail = np.where(jump < n, tail[jump], tail)
        count = count + count[jump]
        jump = jump[jump]
    exits = np.where(closed[tail[:n]], CLOSED, start[tail[:n]])
    return step, count[:n], exits


def greedy_batches(items: DataFrame, lane: list[str], order: str, size: str, budget: int, full_closes: bool = False, drop_last: bool = False, keep: tuple[str, ...] | list[str] = (), block: int = BLOCK) -> DataFrame:
    """``lane, order, size, batch`` and the columns ``keep``: in each lane, in order, an item begins a new batch if it would take the open one over its budget (an
    item larger than that is a batch of its own), and with ``full_closes`` a batch that is exactly full takes not even items of size
    0. With ``drop_last`` a lane's last batch goes unless it is full. A null size counts as 0.

    A lane may hold all rows. Blocks of ``block`` items say, for each item at which an earlier batch can end, where the chain of batches from
    there ends; only these few (no more than fit into a batch) are folded over a lane's blocks, and each block then marks its batches."""
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = items.select(*lane, order, size, *keep).withColumn("_n", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    rows = rows.withColumn("_lane", F.to_json(F.struct(*lane)) if lane else F.lit(""))
    t = running(rows, ["_lane"], [order], {"_place": F.lit(1).cast("long"), "_end": F.col("_n")})
    t = stored(t.withColumn("_block", F.floor((F.col("_place") - 1) / block)))

    def offsets(columns) -> tuple[np.ndarray, np.ndarray]:
        end, n = (columns[i].to_numpy() for i in (3, 4))
        return end - n, end

    def summarised(batches):
        for columns in _blocks(batches, 2):
            start, end = offsets(columns)
            _, count, exits = chains(start, end, budget, full_closes)
            k = min(len(end), int(np.searchsorted(end, start[0] + budget, side="right")) + 2)
            yield pa.RecordBatch.from_arrays([columns[0][:1], columns[1][:1], *(pa.array([x[:k]], pa.list_(pa.int64())) for x in (start, end, count, exits))], names=["_lane", "_block", "start", "end", "count", "exits"])

    def folded(batches):
        lane_now, state, begun = None, CLOSED, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["_lane"] != lane_now:
                    lane_now, state, begun = row["_lane"], CLOSED, 0
                out.append((row["_lane"], row["_block"], state, begun))
                k, state = first_start(state, np.array(row["start"]), np.array(row["end"]), budget, full_closes)
                if k < len(row["start"]):
                    state, begun = row["exits"][k], begun + row["count"][k]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["_lane", "_block", "_state", "_begun"])

    def marked(batches):
        for columns in _blocks(batches, 2):
            start, end = offsets(columns)
            step, _, _ = chains(start, end, budget, full_closes)
            state, begun = columns[5][0].as_py(), columns[6][0].as_py()
            new = np.zeros(len(end), np.int64)
            k, _ = first_start(state, start, end, budget, full_closes)
            while k < len(end):
                new[k] = 1
                k = int(step[k])
            yield pa.RecordBatch.from_arrays([columns[0], columns[2], pa.array(begun - 1 + np.cumsum(new))], names=["_lane", "_place", "batch"])

    slim = t.select("_lane", "_block", "_place", "_end", "_n")
    sorted_in = lambda df, *by: df.repartition(parts, *by).sortWithinPartitions(*by, "_place")
    summary = sorted_in(slim, "_lane", "_block").mapInArrow(summarised, "_lane string, _block long, start array<long>, end array<long>, count array<long>, exits array<long>")
    states = stored(summary.repartition(parts, "_lane").sortWithinPartitions("_lane", "_block").mapInArrow(folded, "_lane string, _block long, _state long, _begun long"))
    batches = sorted_in(slim.join(states, ["_lane", "_block"]), "_lane", "_block").mapInArrow(marked, "_lane string, _place long, batch long")
    out = t.join(batches, ["_lane", "_place"]).select(*lane, order, size, *keep, "batch", "_lane", "_n")
    if drop_last:
        out = stored(out)
        totals = out.groupBy("_lane", "batch").agg(F.sum("_n").alias("_total"))
        last = totals.groupBy("_lane").agg(F.max(F.struct("batch", "_total")).alias("x")).filter(F.col("x._total") < budget)
        out = out.join(last.select("_lane", F.col("x.batch").alias("batch")), ["_lane", "batch"], "left_anti")
    return out.select(*lane, order, size, *keep, "batch")
