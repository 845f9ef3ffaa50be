"""Walks up trees and acyclic graphs, and keys that an id contains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.storage import stored


def nearest_listed(starts: DataFrame, edges: DataFrame, listed: DataFrame, max_depth: int = 1000) -> DataFrame:
    """``node, ancestor, depth``: for each ``node`` of ``starts`` the nearest node of ``listed`` (``node``) on its ways up, itself
    included, by breadth first over ``edges`` (``child, parent``); ties by the least id, null where no way leads to one.
    A round is one join of the frontier, which is rid of repeats first; a node that met a listed one leaves it. A graph
    with a cycle ends too, as a pair is walked once."""
    goal = listed.select(F.col("node").alias("at")).distinct().withColumn("_hit", F.lit(True))
    frontier = starts.select("node", F.col("node").alias("at")).distinct()
    seen, found, depth = None, None, 0
    while depth <= max_depth:
        met = stored(frontier.join(goal, "at", "left").select("node", "at", F.coalesce("_hit", F.lit(False)).alias("_hit")))
        if met.isEmpty():
            break
        hits = met.filter("_hit").groupBy("node").agg(F.min("at").alias("ancestor")).withColumn("depth", F.lit(depth))
        found = hits if found is None else found.unionByName(hits)
        seen = met.select("node", "at") if seen is None else seen.unionByName(met.select("node", "at"))
        rest = met.join(hits.select("node"), "node", "left_anti")
        up = rest.join(edges.select(F.col("child").alias("at"), F.col("parent").alias("_up")), "at").select("node", F.col("_up").alias("at")).distinct()
        frontier, depth = up.join(seen, ["node", "at"], "left_anti"), depth + 1
    out = starts.select("node").distinct()
    return out.join(found, "node", "left") if found is not None else out.withColumns({"ancestor": F.col("node"), "depth": F.lit(0)})


def first_contained(ids: DataFrame, id_col: str, text: str, keys: DataFrame, key: str, order: str) -> DataFrame:
    """``id_col, key``: the first key, in its order, that ``text`` contains, else null. For each length that keys have, the
    pieces of the text of that length meet the keys in an equi-join, so no text is compared with every key; the lengths
    alone come to the driver, at most as many as the longest key has characters. Meant for names; an empty key is in every text."""
    lengths = sorted(r[0] for r in keys.select(F.length(key)).filter(F.col(key).isNotNull()).distinct().collect())

    def cut(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1)))
        return F.when(F.length(text) >= k, F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    pieces = [cut(k) for k in lengths]
    found = ids.filter(F.col(text).isNotNull()).select(id_col, F.explode(F.array_distinct(F.concat(*pieces)) if pieces else F.array().cast("array<string>")).alias(key))
    found = found.join(keys.select(key, F.col(order).alias("_o")), key).groupBy(id_col).agg(F.min(F.struct("_o", key))[key].alias(key))
    return ids.select(id_col).join(found, id_col, "left")


def components(links: DataFrame) -> DataFrame:
    """``v, label``: the least vertex of each vertex's component, for undirected links ``a, b``: labels spread to neighbours and jump to
    their own label's label, so the rounds grow with the logarithm of a component's length. No component is gathered anywhere."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "v"), "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("above"))
        moved = stored(step.join(jump, "label", "left").select("v", "old", F.least("label", "above").alias("label")))
        labels = moved.select("v", "label")
        if moved.filter("label != old").isEmpty():
            return labels
