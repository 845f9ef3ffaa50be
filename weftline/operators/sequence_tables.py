"""Operators on sequence tables: windows, chunks, filters, codon statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import sequences as S


def windows(df: DataFrame, id_col: str, seq_col: str, window: int, stride: int) -> DataFrame:
    """``id, window_no, start, text``: overlapping windows of every sequence, one row each."""
    n = S.window_count(F.length(seq_col), window, stride)
    t = df.select(id_col, seq_col, F.explode(F.sequence(F.lit(0), n - 1)).alias("window_no"))
    start = F.col("window_no") * stride
    return t.select(id_col, "window_no", start.alias("start"), F.substring(F.col(seq_col), start + 1, F.lit(window)).alias("text"))


def fixed_chunks(df: DataFrame, id_col: str, seq_col: str, size: int) -> DataFrame:
    """Non-overlapping chunks named ``id:start-end`` (zero-based, half-open)."""
    n = F.length(seq_col)
    t = df.filter(n > 0).select(id_col, seq_col, F.explode(F.sequence(F.lit(0), n - 1, F.lit(size))).alias("start"))
    end = F.least(F.col("start") + size, F.length(seq_col))
    return t.select(F.concat_ws("", F.col(id_col).cast("string"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), end.cast("string")).alias("name"), F.substring(F.col(seq_col), F.col("start") + 1, end - F.col("start")).alias("text"))


def cds_flags(df: DataFrame, seq_col: str) -> DataFrame:
    """Adds ``starts_atg, ends_stop, whole, internal_stop`` and ``valid`` (all in order)."""
    seq, protein = F.col(seq_col), S.translate(F.col(seq_col))
    t = df.withColumns({"starts_atg": seq.startswith("ATG"), "ends_stop": F.substring(seq, -3, 3).isin("TAA", "TAG", "TGA"), "whole": F.length(seq) % 3 == 0, "internal_stop": F.instr(F.substring(protein, F.lit(1), F.greatest(F.lit(0), F.length(protein) - 1)), "*") > 0})
    return t.withColumn("valid", F.col("starts_atg") & F.col("ends_stop") & F.col("whole") & ~F.col("internal_stop"))


def both_strands(df: DataFrame, seq_col: str) -> DataFrame:
    """Each row twice: as it is (``strand`` +) and reverse complemented (-)."""
    two = F.array(F.struct(F.lit("+").alias("strand"), F.col(seq_col).alias("s")), F.struct(F.lit("-").alias("strand"), S.reverse_complement(F.col(seq_col)).alias("s")))
    return df.withColumn("_two", F.explode(two)).withColumns({"strand": F.col("_two.strand"), seq_col: F.col("_two.s")}).drop("_two")


def codon_counts(df: DataFrame, group: str, seq_col: str) -> DataFrame:
    return df.select(group, F.explode(S.codons(F.col(seq_col))).alias("codon")).groupBy(group, "codon").agg(F.count("*").alias("n"))


def inverse_frequency_weights(counts: DataFrame) -> DataFrame:
    """``codon, n, weight``: the mean of the counts over the count."""
    t = counts.groupBy("codon").agg(F.sum("n").alias("n"))
    return t.withColumn("weight", F.avg("n").over(Window.partitionBy()) / F.col("n"))


def adaptiveness(counts: DataFrame) -> DataFrame:
    """``codon, aa, cai, rscu`` over synonymous codons."""
    t = counts.groupBy("codon").agg(F.sum("n").alias("n")).withColumn("aa", S.amino_acid(F.col("codon")))
    w = Window.partitionBy("aa")
    return t.select("codon", "aa", "n", (F.col("n") / F.max("n").over(w)).alias("cai"), (F.col("n") * F.count("*").over(w) / F.sum("n").over(w)).alias("rscu"))


def length_between(df: DataFrame, seq_col: str, low: int, high: int) -> DataFrame:
    """Inclusive bounds; 0 turns one off."""
    n = F.length(seq_col)
    keep: Column = F.lit(True)
    if low:
        keep &= n >= low
    if high:
        keep &= n <= high
    return df.filter(keep)
