"""Packing of token rows into batches, and draws of rows by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ordered import greedy_batches, running
from weftline.operators.sampling import roll


def _rounded(size: str, multiple: int) -> Column:
    return (F.ceil(F.col(size) / multiple) * multiple).cast("long")


def split_pack(items: DataFrame, lane: list[str], order: str, size: str, budget: int, multiple: int = 1, offset: DataFrame | None = None) -> DataFrame:
    """``lane, order, batch, start, stop, at``: every batch of a lane is filled to ``budget`` exactly (but its last one);
    an item that crosses an edge goes on in the next batch. Tokens [start, stop) of the item lie at ``at`` in the batch.
    With ``multiple`` each piece is padded to it, so a batch holds the largest multiple within the budget, and an item is cut at a
    multiple of its tokens. As all but an item's last piece are such multiples, running sums of padded sizes tell
    every piece; a lane may hold all rows. ``offset`` (``lane, offset``) says how much of a lane's first batch is taken."""
    room = budget // multiple * multiple
    if room <= 0:
        raise ValueError("the budget holds no multiple")
    t = items.filter(F.col(size) > 0).select(*lane, order, size)
    t = running(t, lane, [order], {"_to": _rounded(size, multiple)}).withColumn("_from", F.col("_to") - _rounded(size, multiple))
    if offset is not None:
        t = t.join(offset, lane, "left").withColumn("_by", F.coalesce("offset", F.lit(0)))
        t = t.withColumns({"_to": F.col("_to") + F.col("_by"), "_from": F.col("_from") + F.col("_by")})
    t = t.withColumn("batch", F.explode(F.sequence(F.floor(F.col("_from") / room), F.floor((F.col("_to") - 1) / room))))
    first, last = F.greatest(F.col("_from"), F.col("batch") * room), F.least(F.col("_to"), (F.col("batch") + 1) * room)
    stop = F.least(last - F.col("_from"), F.col(size))
    return t.select(*lane, order, "batch", (first - F.col("_from")).alias("start"), stop.alias("stop"), (first - F.col("batch") * room).alias("at"))


def whole_pack(items: DataFrame, lane: list[str], order: str, size: str, budget: int, multiple: int = 1, drop_last: bool = True) -> DataFrame:
    """``lane, order, size, padded, batch``: batches of whole items in order, each padded to ``multiple``; one is closed before it would exceed
    ``budget``, and where it is full. A larger item is an error. A lane may hold all rows."""
    padded = _rounded(size, multiple)
    checked = F.when(padded > budget, F.raise_error(F.lit("an item exceeds the budget of a batch")).cast("long")).otherwise(padded)
    t = greedy_batches(items.withColumn("padded", checked), lane, order, "padded", budget, full_closes=True, drop_last=drop_last, keep=[size])
    return t.select(*lane, order, size, "padded", "batch")


def flattened(packed: DataFrame, lane: list[str], multiple: int) -> DataFrame:
    """``lane, batch, cu_seq_lens, longest, padding``: where each sequence of a packed row ends, from 0, and the length of
    the mock sequence that fills the row to a multiple. Batches are bounded by their budget, so the lists are."""
    length = F.col("stop") - F.col("start")
    t = packed.groupBy(*lane, "batch").agg(F.array_sort(F.collect_list(F.col("at") + length)).alias("ends"), F.max(length).alias("longest"), F.sum(length).alias("total"))
    return t.select(*lane, "batch", F.concat(F.array(F.lit(0).cast("long")), "ends").alias("cu_seq_lens"), "longest", F.pmod(-F.col("total"), F.lit(multiple)).alias("padding"))


def padding_waste(packed: DataFrame, lane: list[str]) -> DataFrame:
    """``lane, batch, waste``: the share of a padded batch that is no token, had its pieces been rows of the longest's length."""
    length = F.col("stop") - F.col("start")
    return packed.groupBy(*lane, "batch").agg((1 - F.sum(length) / (F.count("*") * F.max(length))).alias("waste"))


def token_windows(df: DataFrame, id_col: str, length: Column, window: int, specials: int, overlap: int) -> DataFrame:
    """``id, window_no, start, stop`` of overlapping token windows that leave room for special tokens; the last one ends
    where the row does, and no row goes without one."""
    room, step = window - specials, window - specials - overlap
    if step <= 0:
        raise ValueError("the overlap leaves no step")
    n = 1 + F.ceil(F.greatest(length - room, F.lit(0)) / step).cast("int")
    t = df.select(id_col, length.alias("_n"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: k * step)).alias("window_no", "start"))
    return t.select(id_col, "window_no", "start", F.least(F.col("start") + room, F.col("_n")).alias("stop"))


def one_per_group(df: DataFrame, group: list[str], key: str, seed: int, epoch: int) -> DataFrame:
    """A row of each group by hash of (seed, epoch, key); partial aggregates, so a hot group does no harm."""
    r = F.md5(F.concat_ws("|", F.lit(f"{seed}:{epoch}"), F.col(key).cast("string")))
    return df.groupBy(*group).agg(F.min_by(key, F.struct(r, key)).alias(key))


def matched_controls(df: DataFrame, match: str, case: Column, key: str, repeats: int, seed: int) -> DataFrame:
    """``repeat, match, key``: in each repeat as many controls as cases of each match value, or all if there are fewer.
    Ranks by hash start with blocks of 2**-6 of the hash range, whose counts give the block in which the quota ends; rows
    are ranked only inside that block."""
    cases = df.filter(case).groupBy(match).agg(F.count("*").alias("_k"))
    t = df.filter(~case).select(match, key, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    t = t.withColumn("_r", roll(F.concat_ws(":", F.col("repeat").cast("string"), F.col(key).cast("string")), seed)).withColumn("_b", F.floor(F.col("_r") * 64))
    w = Window.partitionBy("repeat", match).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("repeat", match, "_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    blocks = blocks.join(cases, match).filter("_before < _k")
    t = t.join(blocks, ["repeat", match, "_b"])
    edge = t.filter("_before + _n > _k").withColumn("_rank", F.row_number().over(Window.partitionBy("repeat", match, "_b").orderBy("_r", key)))
    return t.filter("_before + _n <= _k").select("repeat", match, key).unionByName(edge.filter("_before + _rank <= _k").select("repeat", match, key))


def length_stratified(df: DataFrame, key: str, size: str, n: int, bins: int, seed: int) -> DataFrame:
    """``bin, key``: up to n / bins rows by hash of each of ``bins`` equal-width bins of size, the first n % bins take one more.
    The bounds of the rank are constants, so tasks drop rows beyond them before the shuffle."""
    ends = df.agg(F.min(size).alias("_lo"), F.max(size).alias("_hi"))
    width = F.greatest((F.col("_hi") - F.col("_lo")) / bins, F.lit(1e-9))
    t = df.filter(F.col(size).isNotNull()).crossJoin(F.broadcast(ends)).select(key, F.least(F.floor((F.col(size) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    rank = F.row_number().over(Window.partitionBy("bin").orderBy(roll(F.col(key), seed), key))
    t = t.withColumn("_r", rank).filter(F.col("_r") <= n // bins + 1)
    return t.filter(F.col("_r") <= F.lit(n // bins) + (F.col("bin") < n % bins).cast("int")).select("bin", key)


def rank_shards(df: DataFrame, key: str, world: int, seed: int) -> DataFrame:
    """Adds ``rank``: rows dealt to ``world`` readers by hash of their key."""
    return df.withColumn("rank", F.floor(roll(F.col(key), seed) * world).cast("int"))


def resampled(indexed: DataFrame, index: str, draws: int, seed: int) -> DataFrame:
    """``draw`` and the columns of ``indexed``, whose ``index`` runs densely from 0: each draw takes the row that a hash of
    (seed, draw) names, so a draw doesn't depend on how many others there are."""
    n = indexed.agg(F.count("*").alias("_len"))
    t = indexed.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(n)).filter("_len > 0")
    t = t.select("draw", F.floor(roll(F.col("draw"), seed) * F.col("_len")).cast("long").alias(index))
    return t.join(indexed.withColumn(index, F.col(index).cast("long")), index)
