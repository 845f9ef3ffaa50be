"""FASTA in and out, and GTF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.matrix import dense_index


def read_fasta(spark: SparkSession, path: str, min_length: int = 0, max_length: int = 0, max_records: int = 0, whole_header: bool = False) -> DataFrame:
    """``seq_id, description, seq``: records are cut at ``>`` by the reader itself, so files are split as usual and gzip works. With
    ``whole_header`` the id is the whole header; ``max_records`` (0: all) takes so many of them, whichever come first."""
    t = fasta_records(spark.read.option("lineSep", ">").text(path), min_length, max_length)
    if whole_header:
        t = t.withColumn("seq_id", F.concat_ws(" ", "seq_id", F.nullif("description", F.lit(""))))
    return t.limit(max_records) if max_records else t


def count_records(spark: SparkSession, path: str) -> DataFrame:
    """``n``: how many records the files hold; sequences aren't put together for it."""
    return spark.read.option("lineSep", ">").text(path).filter(F.length(F.trim("value")) > 0).agg(F.count("*").alias("n"))


def fasta_records(records: DataFrame, min_length: int = 0, max_length: int = 0) -> DataFrame:
    """The same of a table or stream of records already cut at ``>``. Columns besides ``value`` are left out."""
    t = records.filter(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    t = t.select(F.regexp_extract(head, r"^\s*(\S*)", 1).alias("seq_id"), F.trim(F.regexp_replace(head, r"^\s*\S*", "")).alias("description"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "").alias("seq"))
    if min_length:
        t = t.filter(F.length("seq") >= min_length)
    return t.filter(F.length("seq") <= max_length) if max_length else t


def write_fasta(df: DataFrame, path: str, id_col: str = "seq_id", seq_col: str = "seq", width: int = 60, description: str | None = None) -> None:
    """Header ``>id description``, lines wrapped."""
    lines = F.regexp_replace(seq_col, f"(.{{{width}}})(?=.)", "$1\n")
    about = F.concat(F.lit(" "), F.col(description)) if description else F.lit("")
    df.select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.coalesce(about, F.lit("")), F.lit("\n"), lines).alias("value")).write.text(path)


def duplicate_ids(df: DataFrame, id_col: str = "seq_id") -> DataFrame:
    return df.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1")


def catalogue(df: DataFrame, id_col: str = "seq_id", allow_duplicates: bool = False, order: str | None = None) -> DataFrame:
    """``df`` with ``key``: its ids. An id that repeats, or is missing, raises; with ``allow_duplicates`` rows are keyed by their place in ``order`` instead."""
    if allow_duplicates:
        return df.join(dense_index(df, order), order).withColumn("key", F.col("row_index").cast("string")).drop("row_index")
    bad = df.groupBy(id_col).agg(F.count("*").alias("n")).filter(F.col(id_col).isNull() | (F.col(id_col) == "") | (F.col("n") > 1)).limit(3).collect()
    if bad:
        raise ValueError(f"ids missing or repeated: {[r[0] for r in bad]}")
    return df.withColumn("key", F.col(id_col))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Comments and short rows skipped, starts zero-based, attributes as a map."""
    t = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 9)
    pairs = F.regexp_extract_all(F.col("f")[8], F.lit(r'(\S+)\s+"([^"]*)"'), F.lit(0))
    bag = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1), F.regexp_extract(x, r'"([^"]*)"', 1)))))
    return t.select(F.col("f")[0].alias("chrom"), F.col("f")[2].alias("feature"), (F.col("f")[3].cast("int") - 1).alias("start"), F.col("f")[4].cast("int").alias("end"), F.col("f")[6].alias("strand"), bag.alias("attributes"))
