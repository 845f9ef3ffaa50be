"""Splits, samples and batches. Random choices hash a key with a seed, so they don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ordered import greedy_batches


def roll(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the MD5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32


def weighted_split(df: DataFrame, key: Column, weights: dict[str, float], seed: int) -> DataFrame:
    """Adds ``split`` by normalised absolute weights."""
    total = sum(abs(w) for w in weights.values())
    if not total:
        raise ValueError("weights sum to zero")
    r, edge, out = roll(key, seed), 0.0, None
    for name, w in weights.items():
        edge += abs(w) / total
        out = F.when(r < edge, name) if out is None else out.when(r < edge, name)
    return df.withColumn("split", out.otherwise(name))


def hash_positions(df: DataFrame, group: list[str], key: str, seed: int, blocks: int = 256) -> DataFrame:
    """Adds ``_pos``, the place from 0 of a row in its group by (roll, key), and ``_total``, the group's size. Counts of blocks of
    the hash range give each block its first place, and rows are ranked only inside a block, so a hot group is spread."""
    r = roll(F.col(key), seed)
    t = df.withColumns({"_r": r, "_b": F.floor(r * blocks)})
    w = Window.partitionBy(*(f"_g{i}" for i in range(len(group))))
    n = t.groupBy(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    n = n.withColumns({"_before": F.coalesce(F.sum("_n").over(w.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_n").over(w)})
    same = F.col("_b") == F.col("_c")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    t = t.join(n, same).withColumn("_pos", F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_r", key)) - 1)
    return t.drop("_r", "_b", "_c", "_n", "_before", *(f"_g{i}" for i in range(len(group))))


def stratified(df: DataFrame, stratum: str, key: str, fraction: float, seed: int) -> DataFrame:
    """ceil(fraction * size) rows of each stratum, in order of their roll."""
    return hash_positions(df, [stratum], key, seed).filter(F.col("_pos") < F.ceil(F.col("_total") * fraction)).drop("_pos", "_total")


def class_balanced(df: DataFrame, label: str, key: str, fraction: float, seed: int) -> DataFrame:
    """ceil(fraction * smallest class) rows of every class."""
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.ceil(F.min("n") * fraction).alias("_k"))
    return hash_positions(df, [label], key, seed).crossJoin(F.broadcast(least)).filter(F.col("_pos") < F.col("_k")).drop("_pos", "_total", "_k")


def size_bucket(size: Column, bounds: list[int]) -> Column:
    """The left-closed, right-open bucket, null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(bounds) - 1):
        out = F.when((size >= bounds[i]) & (size < bounds[i + 1]), i).otherwise(out)
    return out


def token_batches(items: DataFrame, lane: list[str], order: str, size: str, budget: int, drop_last: bool = False, full_closes: bool = False) -> DataFrame:
    """``lane, order, size, batch``: greedy batches of up to ``budget`` in each lane, in order; larger items are skipped, and
    with ``drop_last`` a lane's last batch goes unless it is full. A lane may hold all rows."""
    return greedy_batches(items.filter(F.col(size) <= budget), lane, order, size, budget, full_closes, drop_last).withColumn("batch", F.col("batch").cast("int"))
