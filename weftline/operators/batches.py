"""Size buckets, batches and the shapes that batches take."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ordered import greedy_batches
from weftline.operators.sampling import hash_positions, size_bucket


def size_buckets(df: DataFrame, size: str, width: int, least: int) -> DataFrame:
    """``bucket, low, high, items``: consecutive buckets [low, high) of sizes. A bucket ends once it has ``least`` items or is
    ``width`` wide; a gap is filled with empty buckets of that width. Only the histogram, at most one row for each length
    that occurs, comes to the one task that walks over it. An empty table has no bucket."""
    if width <= 0 or least <= 0:
        raise ValueError("width and least must be positive")

    def walk(hist: pd.DataFrame) -> pd.DataFrame:
        todo, out = sorted(zip(hist["_size"].tolist(), hist["_n"].tolist(), strict=True)), []
        low = todo[0][0] if todo else 0
        while todo:
            items, taken = 0, 0
            for value, n in todo:
                if value - low >= width or (taken and items >= least):
                    break
                items, taken = items + n, taken + 1
            high, todo = (todo[taken][0] if taken < len(todo) else todo[-1][0] + 1), todo[taken:]
            steps = (high - low) // width
            ends = [low + width * k for k in range(1, steps + 1)] or [high]
            for end in ends:
                out.append((len(out), low, end, items))
                low, items = end, 0
        return pd.DataFrame(out, columns=["bucket", "low", "high", "items"])

    hist = df.filter(F.col(size).isNotNull()).groupBy(F.col(size).cast("long").alias("_size")).agg(F.count("*").alias("_n"))
    return hist.groupBy().applyInPandas(walk, "bucket int, low long, high long, items long")


def bucket_batches(df: DataFrame, key: str, size: Column, bounds: list[int], sizes: list[int], seed: int) -> DataFrame:
    """``bucket, key, batch``: batches of rows of one bucket, which has its own batch size, in order of a hash; rows outside all buckets are left out."""
    if len(sizes) != len(bounds) - 1 or min(sizes) <= 0:
        raise ValueError("a positive batch size for each bucket")
    t = df.select(key, size_bucket(size, bounds).alias("bucket")).filter("bucket is not null")
    t = hash_positions(t, ["bucket"], key, seed)
    return t.select("bucket", key, F.floor(F.col("_pos") / F.element_at(F.array(*map(F.lit, sizes)), F.col("bucket") + 1)).alias("batch"))


def padded(df: DataFrame, batch: list[str], ids: str, pad: int, multiple: int = 1) -> DataFrame:
    """Token lists filled to their batch's longest, rounded up to a multiple; adds ``mask`` (1 on tokens)."""
    most = df.groupBy(*batch).agg((F.ceil(F.max(F.size(ids)) / multiple) * multiple).cast("int").alias("_to"))
    t = df.join(most, batch)
    gap = F.col("_to") - F.size(ids)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), gap))
    return t.withColumn("mask", mask).withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad), gap))).drop("_to")


def zigzag(df: DataFrame, key: str, length: Column, ranks: int) -> DataFrame:
    """``key, rank, part, start, stop``: a sequence, filled to a multiple of 2 * ranks, in that many equal slices; rank r has
    slices r and 2 * ranks - 1 - r, so that all ranks carry alike under a causal mask."""
    step = F.ceil(length / (2 * ranks)).cast("int")
    t = df.select(key, step.alias("_step"), F.explode(F.sequence(F.lit(0), F.lit(2 * ranks - 1))).alias("part")).filter("_step > 0")
    return t.select(key, F.least(F.col("part"), 2 * ranks - 1 - F.col("part")).alias("rank"), "part", (F.col("part") * F.col("_step")).alias("start"), ((F.col("part") + 1) * F.col("_step")).alias("stop"))


def greedy_chunks(df: DataFrame, file: list[str], order: str, size: str, budget: int) -> DataFrame:
    """``file, chunk, rows, tokens``: how many rows each chunk of a file has when one is closed before it would exceed its
    budget. A file may hold all rows."""
    t = greedy_batches(df, file, order, size, budget).withColumn("chunk", F.col("batch").cast("int"))
    return t.groupBy(*file, "chunk").agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col(size).cast("long")), F.lit(0)).alias("tokens"))
