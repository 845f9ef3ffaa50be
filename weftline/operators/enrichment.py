"""Enrichment of sets in ranked lists, with permutations, and profiles of a feature's best genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.schedules import permuted
from weftline.storage import stored


def enrichment(scores: DataFrame, sets: DataFrame, feature: str, gene: str, score: str, set_col: str, permutations: int = 0, seed: int = 0, least: int = 5, most: int = 10**6, database: str | None = None) -> DataFrame:
    """``feature, (database,) set, hits, es, p, q``: the running-sum score of each set in each feature's list of genes by descending score
    (ties by gene), p from permutations of places, (1 + those as extreme on that side) / (1 + permutations), and q by Benjamini
    and Hochberg over the feature's sets (of one ``database``, a column of ``sets``). Features that score all genes alike or none above 0, sets outside
    ``least..most`` hits and those whose hits all score 0 are left out; p and q are null without permutations.

    Between hits the running sum only falls, so its extremes lie at hits: the sum just after hit j is (weight so far)/total
    - misses/(N - hits), and before it the same with the weight of one hit less. Only hits are exploded by permutation, never genes by sets.
    A permutation moves a place in the same way for all lists of one length, so it is computed once for each place, length and number, stored and joined."""
    spark = scores.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of, per = ([database] if database else []), Window.partitionBy(feature)
    ranks = scores.filter(F.col(score).isNotNull()).withColumns({"_low": F.min(score).over(per), "_high": F.max(score).over(per)})
    ranks = ranks.filter((F.col("_low") < F.col("_high")) & (F.col("_high") != 0))
    ranks = ranks.select(feature, gene, F.abs(score).alias("_w"), (F.row_number().over(per.orderBy(F.desc(score), gene)) - 1).cast("long").alias("_rank"), F.count("*").over(per).alias("_all"))
    ranks = stored(ranks)
    w = Window.partitionBy(feature, *of, set_col)
    hits = ranks.join(sets.select(gene, *of, set_col).distinct(), gene).withColumn("hits", F.count("*").over(w)).filter(F.col("hits").between(least, most))
    hits = stored(hits.select(feature, *of, set_col, "hits", "_all", "_rank", "_w"))
    places = hits.select("_rank", "_all").distinct().withColumn("_perm", F.explode(F.sequence(F.lit(1), F.lit(max(permutations, 1))))).repartition(2 * parts, "_rank", "_all", "_perm")
    key = F.concat_ws(":", F.lit(str(seed)), F.col("_perm").cast("string"))
    moved = stored(places.select("_rank", "_all", "_perm", permuted(F.col("_rank"), F.col("_all"), key).alias("_to")))
    t = hits.withColumn("_perm", F.lit(0))
    if permutations:
        shuffled = hits.drop("_w").join(moved, ["_rank", "_all"]).drop("_rank").withColumnRenamed("_to", "_rank")
        t = t.unionByName(shuffled.join(ranks.select(feature, "_rank", "_w"), [feature, "_rank"]))
    w = Window.partitionBy(feature, *of, set_col, "_perm")
    run = w.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_w").over(w).cast("double")
    t = t.withColumns({"_total": total, "_sum": F.sum("_w").over(run).cast("double"), "_one": F.col("_w").cast("double"), "_missed": (F.col("_rank") + 1 - F.count("*").over(run)) / F.greatest(F.col("_all") - F.col("hits"), F.lit(1))}).filter("_total > 0")
    t = t.groupBy(feature, *of, set_col, "_perm").agg(F.first("hits").alias("hits"), F.max(F.col("_sum") / F.col("_total") - F.col("_missed")).alias("_up"), F.min((F.col("_sum") - F.col("_one")) / F.col("_total") - F.col("_missed")).alias("_down"))
    t = t.withColumn("_es", F.when(F.col("_up") >= -F.col("_down"), F.col("_up")).otherwise(F.col("_down")))
    t = t.withColumn("es", F.max(F.when(F.col("_perm") == 0, F.col("_es"))).over(Window.partitionBy(feature, *of, set_col)))
    extreme = (F.col("_perm") > 0) & F.when(F.col("es") >= 0, F.col("_es") >= F.col("es")).otherwise(F.col("_es") <= F.col("es"))
    t = t.filter("es is not null").groupBy(feature, *of, set_col).agg(F.first("hits").alias("hits"), F.first("es").alias("es"), F.count_if(extreme).alias("_k"))
    p = F.when(F.lit(permutations > 0), (F.col("_k") + 1) / F.lit(permutations + 1))
    t = t.withColumn("p", p)
    w = Window.partitionBy(feature, *of).orderBy("p")
    step = F.col("p") * (F.count("*").over(Window.partitionBy(feature, *of)) / F.count("*").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("_q", step).withColumn("q", F.least(F.lit(1.0), F.min("_q").over(w.rangeBetween(0, Window.unboundedFollowing))))
    return t.select(feature, *of, set_col, "hits", "es", "p", F.when(F.col("p").isNotNull(), F.col("q")).alias("q"))


def best_sets(found: DataFrame, feature: str, database: str, set_col: str, threshold: float) -> DataFrame:
    """``feature, database, set, hits, es, p, q, best``: the set of least ``q`` (ties: the larger score, then the name) of each feature and
    database, where that is below ``threshold``; ``best`` marks the least over a feature's databases."""
    order = F.struct(F.col("q").alias("q"), (-F.abs("es")).alias("e"), F.col(database).alias("d"), F.col(set_col).alias("s"), F.col("hits").alias("hits"), F.col("es").alias("es"), F.col("p").alias("p"))
    t = found.filter(F.col("q") < threshold).groupBy(feature, database).agg(F.min(order).alias("x"))
    best = F.row_number().over(Window.partitionBy(feature).orderBy("x.q", "x.e", "x.d", "x.s")) == 1
    return t.select(feature, database, F.col("x.s").alias(set_col), "x.hits", "x.es", "x.p", "x.q", best.alias("best"))


def best_family(top: DataFrame, feature: str, family: str, share: float = 0.5, least: int = 3) -> DataFrame:
    """``feature, family, n``: the commonest family among a feature's best genes (ties by name) where it has at least ``share``
    of them and ``least`` genes; families of under two characters don't count."""
    n = top.groupBy(feature, family).agg(F.count("*").alias("n"))
    of = n.groupBy(feature).agg(F.sum("n").alias("_all"), F.min(F.when(F.length(family) >= 2, F.struct((-F.col("n")).alias("k"), family))).alias("_b"))
    return of.filter((-F.col("_b.k") >= share * F.col("_all")) & (-F.col("_b.k") >= least)).select(feature, F.col(f"_b.{family}").alias(family), (-F.col("_b.k")).alias("n"))


def contrast_rows(acts: DataFrame, id_col: str, feature: str, value: str, high: int, zero: int, seed: int) -> DataFrame:
    """``feature, id, side, rank``: a feature's highest positive rows, and some of its rows at zero by hash; both bounds are constants,
    so tasks keep no more than that of a feature before the shuffle."""
    top = acts.filter(F.col(value) > 0).withColumn("rank", F.row_number().over(Window.partitionBy(feature).orderBy(F.desc(value), id_col))).filter(F.col("rank") <= high).withColumn("side", F.lit("high"))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(feature).cast("string"), F.col(id_col).cast("string")))
    low = acts.filter(F.col(value) <= 0).withColumn("_h", h).withColumn("rank", F.row_number().over(Window.partitionBy(feature).orderBy("_h", id_col))).filter(F.col("rank") <= zero).withColumn("side", F.lit("zero"))
    return top.select(feature, id_col, "side", "rank").unionByName(low.select(feature, id_col, "side", "rank"))
