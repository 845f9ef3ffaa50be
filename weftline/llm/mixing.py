"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

1. Each source's target is the budget shared by weight, capped at ``max_epochs`` times its size,
   the excess shared again (in closed form over sources ordered by size per weight).
2. Documents fall into blocks of their source by a permutation (MD5 of seed and id). A source's
   quota is its whole passes plus the first blocks of the permuted order; the block at the edge is
   cut inside, in the same order, so the quota is met to the word.
3. A quota in blocks is split among output shards by a binary tree: each node deals a uniform half of its
   slots, drawn without replacement, to the left, so that the sources' slot counts on either side
   are multivariate hypergeometric and add up exactly. Tickets are counted in BINS ranges first and ranked only inside a range.
4. Each shard then draws the next blocks of the permuted order, as many of a source as its slots say; blocks on different
   shards are disjoint but for whole passes. What a document gives is the sum over the draws of its block.
5. ``shard_rows`` shuffles each drawn block locally.

A source may hold most rows: nothing is partitioned by source but by (source, block), and a block's
size is bounded by ``block_docs`` until a source has 65536 blocks. The table of sources is
broadcast when it has at most BROADCAST_SOURCES rows (counted), else joined by a shuffle.

Defined cases: null text has size 0; a null source is a source of its own and sorts last; a null id
counts as the text ''; sources without words get target 0; an empty table gives an empty table;
rows that repeat an id are drawn in order of their text's hash; very long texts count as they are, in one pass over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import common as c

BROADCAST_SOURCES = 10_000
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(stats: DataFrame, weight: Column, budget: float, max_epochs: int) -> DataFrame:
    """``stats`` (_none, _source, docs, source_size) with ``target``: by weight, capped, the excess shared again."""
    order = Window.orderBy("_none", "_source")
    t = stats.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("cap", max_epochs * F.col("source_size"))
    every = Window.partitionBy()
    t = t.withColumn("goal", F.lit(budget) * F.sum("source_size").over(every))
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / left
    t = t.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    t = t.withColumn("final", F.max(F.when(F.col("open"), F.col("level"))).over(every))
    return t.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double")))).drop("goal", "level", "open", "final", "cap")


def splitting_tree(slots: DataFrame, shards: int, seed: int) -> DataFrame:
    """Deal the slots (_none, _source, _slot) to ``shards`` (a power of two): ``_none, _source, shard, _quota``, the slots of each source there."""
    levels = shards.bit_length() - 1
    if 1 << levels != shards:
        raise ValueError("the number of shards must be a power of two")
    t = slots.withColumn("shard", F.lit(0))
    for level in range(levels):
        ticket = F.md5(F.concat_ws("|", F.lit(f"{seed}-{level}"), "_none", "_source", "_slot"))
        t = t.withColumn("_ticket", ticket).withColumn("_bin", F.conv(F.substring("_ticket", 1, 3), 16, 10).cast("int"))
        node = Window.partitionBy("shard")
        bins = t.groupBy("shard", "_bin").agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(node.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.select("shard", "_bin", before.alias("_before"), F.floor(F.sum("_n").over(node) / 2).alias("_half"))
        rank = F.row_number().over(Window.partitionBy("shard", "_bin").orderBy("_ticket", "_none", "_source", "_slot"))
        t = t.join(F.broadcast(bins), ["shard", "_bin"]).withColumn("_rank", F.col("_before") + rank)  # at most BINS rows for each shard
        t = c.store(t.select("_none", "_source", "_slot", (2 * F.col("shard") + (F.col("_rank") > F.col("_half")).cast("int")).alias("shard")))
    return t.groupBy("_none", "_source", "shard").agg(F.count("*").alias("_quota"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, max_epochs: int = 2, shards: int = 8, seed: int = 7, block_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, draws, block, place``: how many of a document's words the mix takes (up to ``max_epochs``
    times its size); ``draws`` says how many on which shard in which pass, ``place`` is its place in its block."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    permuted = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    base = c.store(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).isNull().alias("_none"), F.coalesce(F.col(source_col), F.lit("")).alias("_source"), size.alias("size"), permuted.alias("_m"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h")))
    stats = base.groupBy("_none", "_source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    targets = c.store(source_targets(stats, weight, budget, max_epochs))
    words = F.floor(F.col("target") + 0.5).cast("long")
    per = targets.select("_none", "_source", "source_size", "target", F.least(F.lit(65536), F.ceil(F.col("docs") / block_docs)).alias("_blocks"), F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long").alias("_passes"), words.alias("_words_wanted"))
    per = per.withColumn("_rest", F.col("_words_wanted") - F.col("_passes") * F.col("source_size"))
    if targets.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    ticket = F.conv(F.substring("_m", 1, 8), 16, 10).cast("long")
    placed = base.join(per, ["_none", "_source"]).withColumn("_block", F.floor(ticket * F.col("_blocks") / F.lit(2.0**32)).cast("int"))
    order = Window.partitionBy("_none", "_source").orderBy("_block")  # at most 65536 blocks
    blocks = placed.groupBy("_none", "_source", "_block", "_passes", "_rest").agg(F.sum("size").alias("_words"))
    blocks = c.store(blocks.select("_none", "_source", "_block", "_passes", (F.row_number().over(order) - 1).cast("long").alias("_index"), (F.col("_rest") - F.coalesce(F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_room")))
    quotas = blocks.groupBy("_none", "_source").agg(F.count("*").alias("_b"), (F.max("_passes") * F.count("*") + F.count_if(F.col("_room") > 0)).alias("_units"))
    slots = quotas.filter("_units > 0").select("_none", "_source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_units") - 1)).alias("_slot"))
    dealt = splitting_tree(slots, shards, seed)
    until = F.sum("_quota").over(Window.partitionBy("_none", "_source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    dealt = dealt.withColumn("_to", until).join(quotas.select("_none", "_source", "_b"), ["_none", "_source"])
    units = dealt.select("_none", "_source", "shard", "_b", F.explode(F.sequence(F.col("_to") - F.col("_quota"), F.col("_to") - 1)).alias("_unit"))
    units = units.select("_none", "_source", "shard", F.floor(F.col("_unit") / F.col("_b")).cast("int").alias("epoch"), (F.col("_unit") % F.col("_b")).alias("_index"))
    drawn = units.join(blocks, ["_none", "_source", "_index"]).groupBy("_none", "_source", "_block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard", F.when(F.col("epoch") >= F.col("_passes"), F.col("_room")).alias("room")))).alias("_draws"))  # one draw for each pass
    inside = Window.partitionBy("_none", "_source", "_block").orderBy("_m", "_h", "size")
    out = placed.join(drawn, ["_none", "_source", "_block"], "left").withColumns({"_ahead": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "place": F.row_number().over(inside)})
    own = lambda d: F.struct(d["shard"].alias("shard"), d["epoch"].alias("epoch"), F.when(d["room"].isNull(), F.col("size")).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), d["room"] - F.col("_ahead")))).cast("long").alias("words"))
    draws = F.coalesce(F.filter(F.transform("_draws", own), lambda d: d["words"] > 0), F.array().cast("array<struct<shard:int,epoch:int,words:bigint>>"))
    out = out.withColumn("draws", draws).withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"]))
    return out.select("doc_id", F.when(~F.col("_none"), F.col("_source")).alias("source"), "size", "source_size", "target", "taken", "draws", F.col("_block").alias("block"), "place")


def shard_rows(mixed: DataFrame, seed: int = 7) -> DataFrame:
    """``shard, epoch, source, block, local, doc_id, words``: a row for each draw, its blocks shuffled locally (``local`` is the place inside)."""
    t = mixed.select("source", "block", "doc_id", "place", F.explode("draws").alias("d")).select("d.shard", "d.epoch", "source", "block", "doc_id", "place", "d.words")
    ticket = F.md5(F.concat_ws("|", F.lit(str(seed)), "shard", "epoch", "place"))
    return t.withColumn("local", F.row_number().over(Window.partitionBy("shard", "epoch", "source", "block").orderBy(ticket, "place"))).drop("place")
