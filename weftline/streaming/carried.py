"""Tables that a stream carries from one micro-batch to the next, and what is built on them: a shuffle buffer and packed batches.

A micro-batch reads what the one before left and writes its own under its number, so one that runs twice after a failure
reads and writes the same again. Tables are as distributed as any; nothing is held by a key's task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.packing import split_pack
from weftline.operators.sampling import hash_positions
from weftline.storage import stored


class Carried:
    """The table ``name`` that a stream carries under ``path``; two micro-batches' versions are kept."""

    def __init__(self, spark: SparkSession, path: str, name: str, schema: str):
        self.spark, self.base, self.schema = spark, f"{path}/_carried/{name}", schema

    def before(self, k: int) -> DataFrame:
        """What micro-batch ``k - 1`` left; nothing before the first."""
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/{k - 1}") if k else self.spark.createDataFrame([], self.schema)

    def leave(self, df: DataFrame, k: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/{k}")
        old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{k - 2}")
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def last(self) -> int:
        """The number of the last micro-batch; -1 before the first."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return max((int(x.getPath().getName()) for x in files.listStatus(top)), default=-1) if files.exists(top) else -1


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _numbered(pool: DataFrame, key: str, seed: int, start: int, rows: int) -> DataFrame:
    """Adds ``batch`` and ``turn`` by place in an order by hash, counted on from ``start``."""
    t = hash_positions(pool.withColumn("_all", F.lit(0)), ["_all"], key, seed).drop("_all")
    number = F.col("_pos") + start
    return t.withColumns({"batch": F.floor(number / rows), "turn": number % rows})


def follow_buffered(stream: DataFrame, path: str, checkpoint: str, key: str, seed: int, rows: int, buffer: int):
    """Batches of ``rows`` under ``path`` (``batch``, and ``turn`` within it) from a shuffle buffer that outlives micro-batches: each one adds its rows
    to the buffer, and all but ``buffer`` rows leave it, by hash. So a batch holds rows of many arrivals, and batches are numbered on
    through the stream. ``finish_buffered`` empties the buffer. ``key`` is unique."""
    schema = _schema(stream)
    columns = stream.columns

    def write(df: DataFrame, k: int) -> None:
        spark = df.sparkSession
        held, counts = Carried(spark, path, "rows", schema), Carried(spark, path, "counts", "start long")
        start = next(iter(r["start"] for r in counts.before(k).collect()), 0)  # one row
        pool = _numbered(held.before(k).unionByName(df), key, seed + k, start, rows)
        pool = stored(pool.withColumn("_go", F.col("_pos") < F.col("_total") - buffer))
        pool.filter("_go").select(*columns, "batch", "turn").write.mode("overwrite").parquet(f"{path}/trigger={k}")
        held.leave(pool.filter("not _go").select(*columns), k)
        counts.leave(pool.agg((F.count_if("_go") + start).alias("start")), k)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish_buffered(spark: SparkSession, path: str, schema: str, key: str, seed: int, rows: int, drop_last: bool = False) -> None:
    """Write the rows that are left in the buffer, whose columns are ``schema``, as the last batches; with ``drop_last`` not the one that isn't full. Done again
    it writes the same."""
    held, counts = Carried(spark, path, "rows", schema), Carried(spark, path, "counts", "start long")
    k = counts.last() + 1
    start = next(iter(r["start"] for r in counts.before(k).collect()), 0)
    t = _numbered(held.before(k), key, seed + k, start, rows)
    if drop_last:
        t = t.filter(F.col("batch") < F.floor((F.col("_total") + start) / rows))
    t.drop("_pos", "_total").write.mode("overwrite").parquet(f"{path}/trigger={k}")


def follow_packed(stream: DataFrame, path: str, checkpoint: str, lane: str, key: str, size: str, budget: int):
    """``lane, key, batch, start, stop, at`` under ``path``: items packed into batches of exactly ``budget`` tokens, the open batch carried on. Inside a micro-batch
    items go by ``key``. What is carried is a count for each lane; a lane may hold all rows."""
    slim = stream.select(F.col(lane).cast("string").alias("lane"), F.col(key).cast("long").alias("key"), F.col(size).cast("long").alias("n")).filter("n > 0 and lane is not null")

    def write(df: DataFrame, k: int) -> None:
        used = Carried(df.sparkSession, path, "used", "lane string, used long")
        before = stored(used.before(k))
        pieces = stored(split_pack(df, ["lane"], "key", "n", budget, offset=before.select("lane", F.pmod("used", F.lit(budget)).alias("offset"))))
        first = before.select("lane", F.floor(F.col("used") / budget).alias("_first"))
        out = pieces.join(first, "lane", "left").withColumn("batch", F.col("batch") + F.coalesce("_first", F.lit(0))).drop("_first")
        out.write.mode("overwrite").parquet(f"{path}/trigger={k}")
        new = before.unionByName(df.select("lane", F.col("n").alias("used"))).groupBy("lane").agg(F.sum("used").alias("used"))
        used.leave(new, k)

    return slim.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
