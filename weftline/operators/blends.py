"""Weighted mixes of data sets, as an order of draws, and the log of who reads what."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ordered import running
from weftline.operators.schedules import permuted


def quotas(weights: list[float], period: int) -> list[int]:
    """Shares of the absolute sum as whole numbers that add up to ``period``: rounded down, and one more for the largest remainders."""
    total = sum(abs(w) for w in weights)
    if not total:
        raise ValueError("weights sum to zero")
    exact = [abs(w) / total * period for w in weights]
    out = [int(x) for x in exact]
    for i in sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))[: period - sum(out)]:
        out[i] += 1
    if any(w and not q for w, q in zip(weights, out, strict=True)):
        raise ValueError("a longer period is needed for the smallest weight")
    return out


def turns(counts: list[int]) -> list[tuple[int, int]]:
    """(data set, its draw) for each slot of a period that has ``counts[i]`` draws of data set i. The k-th draw (from 0) of one with share s comes not before k / s and
    ends by (k + 1) / s, and of those that may come, the one that has to end first does, so after n slots each has n * s draws, less than one more or fewer."""
    period = sum(counts)
    waiting = [(0, i, 0) for i, q in enumerate(counts) if q]
    heapq.heapify(waiting)
    ready, out = [], []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // counts[i]), i, k))
        _, i, k = heapq.heappop(ready)
        out.append((i, k))
        if k + 1 < counts[i]:
            heapq.heappush(waiting, ((k + 1) * period // counts[i], i, k + 1))
    return out


def mixed_order(rows: DataFrame, dataset: str, key: str, weights: dict[str, float], samples: int, seed: int, period: int = 1 << 16) -> DataFrame:
    """``draw, dataset, epoch, key``: ``samples`` draws, of which every prefix has each data set's share, less than one draw more or fewer. Shares are
    whole numbers over ``period``, and a period's order of data sets, which tells any draw's data set and number, is the only list that is made
    ahead. A data set's own draws go through its rows in epochs, each in a permutation of its own; a data set without a row fails the
    job. ``key`` is unique in its data set."""
    spark = rows.sparkSession
    names = list(weights)
    counts = quotas(list(weights.values()), period)
    pattern = spark.createDataFrame([(slot, names[i], k, counts[i]) for slot, (i, k) in enumerate(turns(counts))], "_slot long, _d string, _k long, _q long")
    wanted = [n for n, q in zip(names, counts, strict=True) if q]
    indexed = running(rows.filter(F.col(dataset).isin(wanted)).select(F.col(dataset).alias("_d"), key), ["_d"], [key], {"_i": F.lit(1).cast("long")}).withColumn("_i", F.col("_i") - 1)
    sizes = spark.createDataFrame([(n,) for n in wanted], "_d string").join(indexed.groupBy("_d").agg(F.count("*").alias("_n")), "_d", "left")
    sizes = sizes.select("_d", F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("no rows of "), F.col("_d"))).cast("long")).otherwise(F.col("_n")).alias("_n"))
    t = spark.range(samples).withColumnRenamed("id", "draw").withColumn("_slot", F.col("draw") % period)
    t = t.join(F.broadcast(pattern), "_slot").join(F.broadcast(sizes), "_d")  # a period, and a row for each weight
    t = t.withColumn("_at", F.floor(F.col("draw") / period) * F.col("_q") + F.col("_k"))
    t = t.withColumns({"epoch": F.floor(F.col("_at") / F.col("_n")), "_place": F.col("_at") % F.col("_n")})
    name = F.concat_ws(":", F.lit(str(seed)), F.col("_d"), F.col("epoch").cast("string"))
    t = t.withColumn("_i", permuted(F.col("_place"), F.col("_n"), name)).select("draw", "_d", "epoch", "_i")
    return t.join(indexed, ["_d", "_i"]).select("draw", F.col("_d").alias(dataset), "epoch", key)


def append_log(log: DataFrame, path: str, run: str, time: str | None = None) -> None:
    """Write a run's access log under ``path``, in a folder by its name, with the ``time`` (a timestamp's text; default: now). A run that is written again
    replaces itself, whole, and others stay; a task that is tried again leaves one file, as Spark commits one attempt of each."""
    at = F.to_timestamp(F.lit(time)) if time else F.current_timestamp()
    t = log.withColumn("time", at).withColumn("run", F.lit(run))
    t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_log(spark, path: str) -> DataFrame:
    """All runs' rows, with ``run`` as a string."""
    t = spark.read.parquet(path)
    return t.withColumn("run", F.col("run").cast("string"))
