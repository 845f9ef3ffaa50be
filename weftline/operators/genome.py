"""Reads of regions from sequences that are stored in chunks of a fixed size, so no task holds a whole contig."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import sequences as S


def contig_chunks(sequences: DataFrame, contig: str, order: str, seq: str, size: int, block: int = 1024) -> DataFrame:
    """``contig, chunk_no, seq``: the whole sequences of each contig, end to end by ``order`` (a number; ties by sequence), in chunks of
    ``size`` bases; only a contig's last chunk may be shorter. Where a sequence begins is the sum of the blocks of ``block``
    orders before its own and a running sum inside the block, so no task numbers a whole contig."""
    n = F.length(seq).cast("long")
    t = sequences.filter(n > 0).select(contig, F.col(order).alias("_o"), F.col(seq).alias("_q"), n.alias("_n"), F.floor(F.col(order) / block).alias("_block"))
    before = Window.partitionBy(contig).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy(contig, "_block").agg(F.sum("_n").alias("_sum")).withColumn("_at", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    w = Window.partitionBy(contig, "_block").orderBy("_o", "_q").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_to", F.sum("_n").over(w)).join(blocks, [contig, "_block"])
    t = t.withColumn("_from", F.col("_at") + F.col("_to") - F.col("_n"))
    t = t.withColumn("chunk_no", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor((F.col("_from") + F.col("_n") - 1) / size))))
    first = F.greatest(F.col("chunk_no") * size - F.col("_from"), F.lit(0))
    piece = F.substring(F.col("_q"), (first + 1).cast("int"), ((F.col("chunk_no") + 1) * size - F.col("_from") - first).cast("int"))
    t = t.select(contig, "chunk_no", F.struct("_from", piece.alias("p")).alias("_p"))
    return t.groupBy(contig, "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda x: x["p"]), "").alias(seq))


def region_pieces(regions: DataFrame, chunks: DataFrame, keys: list[str], contig: str, start: str, end: str, size: int) -> DataFrame:
    """``keys, chunk_no, _p, _first, _last``: the bases of [start, end) of each region in each chunk that it reaches, as in ``read_regions``, and whether that is its first
    or last chunk; every region has a row."""
    first = F.greatest(F.col(start), F.lit(0)).cast("long")
    t = regions.select(*dict.fromkeys([*keys, contig]), first.alias("_begin"), F.greatest(first, F.col(end).cast("long")).alias("_stop"))
    low, high = F.floor(F.col("_begin") / size), F.floor((F.greatest(F.col("_stop"), F.col("_begin") + 1) - 1) / size)
    t = t.withColumn("chunk_no", F.explode(F.sequence(low, high)))
    t = t.join(chunks.select(contig, F.col("chunk_no").cast("long").alias("chunk_no"), F.col("seq").alias("_bases")), [contig, "chunk_no"], "left")
    at = F.greatest(F.col("_begin") - F.col("chunk_no") * size, F.lit(0))
    piece = F.substring(F.col("_bases"), (at + 1).cast("int"), (F.least(F.col("_stop") - F.col("chunk_no") * size, F.lit(size)) - at).cast("int"))
    return t.select(*keys, "chunk_no", F.coalesce(piece, F.lit("")).alias("_p"), (F.col("chunk_no") == low).alias("_first"), (F.col("chunk_no") == high).alias("_last"))


def read_regions(regions: DataFrame, chunks: DataFrame, keys: list[str], contig: str, start: str, end: str, size: int, out: str = "seq") -> DataFrame:
    """``keys, out``: bases [start, end) of each region, clamped to the contig. ``chunks`` has ``contig, chunk_no, seq`` with
    ``size`` bases in every chunk but a contig's last; ``keys`` name a region. An equi-join on (contig, chunk): a long
    contig or a hot one is spread over its chunks. A region outside all chunks is empty."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_no", "_p")))
    return region_pieces(regions, chunks, keys, contig, start, end, size).groupBy(*keys).agg(F.array_join(parts["_p"], "").alias(out))


def spliced(exons: DataFrame, chunks: DataFrame, tx: str, contig: str, start: str, end: str, minus: str, size: int) -> DataFrame:
    """``tx, n_bases, cds``: exons joined in order of their place; reverse complement where ``minus`` holds."""
    read = region_pieces(exons.select(tx, contig, start, end, minus).distinct(), chunks, [tx, contig, start, end, minus], contig, start, end, size)
    parts = F.sort_array(F.collect_list(F.struct(start, end, contig, minus, "chunk_no", "_p")))
    t = read.groupBy(tx).agg(F.array_join(parts["_p"], "").alias("cds"), F.bool_or(minus).alias("_minus"))
    t = t.withColumn("cds", F.when(F.col("_minus"), S.reverse_complement(F.col("cds"))).otherwise(F.col("cds")))
    return t.select(tx, F.length("cds").alias("n_bases"), "cds")


def reference_base(variants: DataFrame, chunks: DataFrame, contig: str, pos: str, size: int) -> DataFrame:
    """Adds ``ref``: the base at zero-based ``pos``, null outside the contig."""
    t = variants.withColumn("chunk_no", F.floor(F.col(pos) / size)).join(chunks.select(contig, F.col("chunk_no").cast("long").alias("chunk_no"), F.col("seq").alias("_s")), [contig, "chunk_no"], "left")
    base = F.substring(F.col("_s"), (F.col(pos) % size + 1).cast("int"), F.lit(1))
    return t.withColumn("ref", F.when(base != "", base)).drop("_s", "chunk_no")


def variant_windows(variants: DataFrame, chunks: DataFrame, keys: list[str], contig: str, pos: str, alt: str, flank: int, size: int) -> DataFrame:
    """``keys, ref_window, alt_window``: ``flank`` bases on both sides of a variant, clamped, without and with the alternate
    base; variants outside the contig have none."""
    t = variants.withColumns({"_from": F.greatest(F.col(pos) - flank, F.lit(0)), "_to": F.col(pos) + flank + 1})
    t = read_regions(t, chunks, [*keys, pos, alt, "_from"], contig, "_from", "_to", size, "ref_window")
    at = (F.col(pos) - F.col("_from")).cast("int")
    other = F.concat(F.substring(F.col("ref_window"), F.lit(1), at), F.col(alt), F.substring(F.col("ref_window"), at + 2, F.length("ref_window")))
    return t.filter(F.length("ref_window") > at).select(*keys, "ref_window", other.alias("alt_window"))


def canonical(transcripts: DataFrame, gene: str, tx: str, *tags: str) -> DataFrame:
    """``gene, tx``: one transcript for each gene, of the first tag (a boolean column) that any has, ties by id; genes without a tag go."""
    place = F.coalesce(*(F.when(F.col(t), F.lit(i)) for i, t in enumerate(tags)))
    t = transcripts.withColumn("_p", place).filter("_p is not null")
    return t.groupBy(gene).agg(F.min(F.struct("_p", tx))[tx].alias(tx))


def covered_length(spans: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """``group, covered``: how many places the union of a group's half-open intervals covers; empty intervals add none."""
    w = Window.partitionBy(*group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(F.max(end).over(w), F.col(start))))
    return spans.withColumn("_new", fresh).groupBy(*group).agg(F.sum("_new").alias("covered"))
