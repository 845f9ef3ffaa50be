"""Packing and shuffled batches of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.sampling import hash_positions

PIECES = "lane string, key long, batch long, start long, stop long, at long"


def packed_pieces(stream: DataFrame, lane: str, key: str, size: str, budget: int) -> DataFrame:
    """``lane, key, batch, start, stop, at``: items of a stream packed into batches of exactly ``budget`` tokens. A lane's only state is
    the count of its tokens so far, so the open batch goes on in the next micro-batch; inside one, items go by ``key``."""

    def work(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = pd.concat(frames).sort_values("key")
        out = []
        for item, n in zip(rows["key"].tolist(), rows["n"].tolist(), strict=True):
            done = 0
            while done < n:
                batch, at = divmod(used, budget)
                step = min(n - done, budget - at)
                out.append((group[0], item, batch, done, done + step, at))
                done, used = done + step, used + step
        state.update((used,))
        yield pd.DataFrame(out, columns=["lane", "key", "batch", "start", "stop", "at"])

    t = stream.select(F.col(lane).cast("string").alias("lane"), F.col(key).cast("long").alias("key"), F.col(size).cast("long").alias("n")).filter("n > 0 and lane is not null")
    return t.groupBy("lane").applyInPandasWithState(work, PIECES, "used long", "append", GroupStateTimeout.NoTimeout)


def follow_shuffled(stream: DataFrame, path: str, checkpoint: str, key: str, seed: int, rows: int, drop_last: bool = False):
    """Each micro-batch as batches of ``rows`` in order of a hash, under its own number, so one that runs twice replaces itself. How
    much a micro-batch may hold is the source's limit (``maxFilesPerTrigger``): it is the shuffle buffer."""
    def write(df: DataFrame, k: int) -> None:
        t = hash_positions(df.withColumn("_all", F.lit(0)), ["_all"], key, seed + k)
        if drop_last:
            t = t.filter(F.floor(F.col("_pos") / rows) < F.floor(F.col("_total") / rows))
        t.withColumn("batch", F.floor(F.col("_pos") / rows)).drop("_pos", "_total", "_all").write.mode("overwrite").parquet(f"{path}/trigger={k}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
