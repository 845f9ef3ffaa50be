"""What jobs write: transcript tables, multi-part samples, token chunks, ranked examples, merged predictions, id maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.batches import greedy_chunks
from weftline.operators.matrix import dense_index


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """Tab-separated; with a header for tables, without for BED."""
    df.write.option("sep", "\t").option("header", header).csv(path)


def exon_bed(transcripts: DataFrame, tx: str, contig: str, starts: str, ends: str, strand: str) -> DataFrame:
    """``chrom, start, end, name, score, strand``, a row for each exon of comma-separated lists."""
    lists = F.arrays_zip(F.filter(F.split(starts, ","), lambda x: x != "").alias("a"), F.filter(F.split(ends, ","), lambda x: x != "").alias("b"))
    t = transcripts.select(tx, contig, strand, F.posexplode(lists).alias("i", "x"))
    name = F.concat_ws("_", F.col(tx).cast("string"), (F.col("i") + 1).cast("string"))
    return t.select(F.col(contig).alias("chrom"), F.col("x.a").cast("long").alias("start"), F.col("x.b").cast("long").alias("end"), name.alias("name"), F.lit(0).alias("score"), F.col(strand).alias("strand"))


def joined_parts(parts: dict[str, DataFrame], key: str, per_shard: int) -> DataFrame:
    """``key``, a column for each part, ``shard``: samples put together by key (points in it become dashes), numbered and dealt ``per_shard`` to a
    shard. A key that one part has and another lacks fails the job."""
    out = None
    for name, t in parts.items():
        own = t.select(key, F.struct(*(c for c in t.columns if c != key)).alias(name))
        out = own if out is None else out.join(own, key, "full")
    lost = F.when(F.greatest(*(F.col(n).isNull().cast("int") for n in parts)) > 0, F.raise_error(F.concat(F.lit("a part is missing: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    out = out.filter(lost).withColumn(key, F.replace(F.col(key).cast("string"), F.lit("."), F.lit("-")))
    return out.join(dense_index(out, key), key).withColumn("shard", F.floor(F.col("row_index") / per_shard)).drop("row_index")


def token_chunks(rows: DataFrame, file: list[str], order: str, size: str, budget: int) -> DataFrame:
    """``file, order, chunk, start, stop``: rows in chunks that close before they would exceed the budget, never across files, and where each lies in its chunk."""
    chunks = greedy_chunks(rows, file, order, size, budget)
    w = Window.partitionBy(*file).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    chunks = chunks.withColumn("_to", F.sum("rows").over(w)).select(*(F.col(f).alias(f"_{f}") for f in file), "chunk", F.col("_to").alias("_last"), (F.col("_to") - F.col("rows")).alias("_first"))
    t = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*file).orderBy(order)) - 1)
    same = (F.col("_i") >= F.col("_first")) & (F.col("_i") < F.col("_last"))
    for f in file:
        same &= F.col(f).eqNullSafe(F.col(f"_{f}"))
    t = t.join(chunks, same)
    run = F.sum(size).over(Window.partitionBy(*file, "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return t.select(*file, order, "chunk", (run - F.col(size)).alias("start"), run.alias("stop"))


def write_ranked(examples: DataFrame, path: str, feature: str, rank: str, parts: int) -> None:
    """Examples in ranges of features, sorted by feature and rank inside, so that a reader skips row groups."""
    examples.repartitionByRange(parts, feature).sortWithinPartitions(feature, rank).write.parquet(path)


def live_rows(table: DataFrame, live: DataFrame, feature: str) -> DataFrame:
    """The rows of live features."""
    return table.join(live.select(feature).distinct(), feature, "left_semi")


def merged_place(rank: Column, batch: Column, at: Column, world: int, size: int) -> Column:
    """Where a row stood before batches of ``size`` rows were dealt to ``world`` readers in turn."""
    return (batch * world + rank) * size + at


def id_map(df: DataFrame, key: str) -> DataFrame:
    """``key, place``: sorted ids, numbered densely from 0."""
    return dense_index(df, key).withColumnRenamed("row_index", "place")
