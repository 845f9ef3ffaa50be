"""Line and record formats: training logs, labelled JSON lines, codon tables, sequences as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.fasta import read_fasta

# The column names that are taken for sequences and for ids, in order of preference.
SEQUENCE_NAMES = ("seq", "cds", "sequence", "dna_seq")
ID_NAMES = ("id", "seq_id", "gene", "name")


def parse_metrics(lines: DataFrame, col: str = "value", keep: list[str] | None = None) -> DataFrame:
    """``ts, metric, iteration, reading`` of lines ``<ts> - INFO - <metric> iteration=<n> value=<x>``; other lines are left out. Columns of ``keep`` go along.
    Works on streams as on tables."""
    shape = r"^(\S+ \S+) - INFO - (\S+) iteration=(\d+) value=(\S+)$"
    part = lambda k: F.regexp_extract(col, shape, k)
    t = lines.filter(F.col(col).rlike(shape))
    return t.select(*(keep or []), F.try_to_timestamp(part(1)).alias("ts"), part(2).alias("metric"), part(3).try_cast("long").alias("iteration"), part(4).try_cast("double").alias("reading"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return parse_metrics(spark.read.text(path))


def read_labelled_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``sequence, label``; a broken line fails the job."""
    return spark.read.schema("sequence string, label int").option("mode", "FAILFAST").json(path)


def read_codon_csv(spark: SparkSession, path: str, seq_col: str | None = None, id_col: str | None = None, min_codons: int = 0, max_codons: int = 0) -> DataFrame:
    """``id, sequence`` and the other columns. The two are found by name unless given; null sequences and those outside the
    bounds (0: none) are left out; a file without ids is keyed by a hash of the sequence."""
    t = spark.read.option("header", True).csv(path)

    def found(given: str | None, names: tuple[str, ...]) -> str | None:
        if given and given not in t.columns:
            raise ValueError(f"no column {given}")
        return given or next((n for n in names if n in t.columns), None)

    seq, key = found(seq_col, SEQUENCE_NAMES), found(id_col, ID_NAMES)
    if seq is None:
        raise ValueError("no sequence column")
    n = F.floor(F.length(seq) / 3)
    t = t.filter(F.col(seq).isNotNull() & (n >= min_codons) & ((n <= max_codons) if max_codons else F.lit(True)))
    first = F.col(key) if key else F.md5(seq)
    return t.select(first.alias("id"), F.col(seq).alias("sequence"), *(c for c in t.columns if c not in (seq, key) and c.lower() not in ("id", "sequence")))


def fasta_to_jsonl(spark: SparkSession, source: str, target: str, upper: bool = False) -> int:
    """``id, prompt`` as JSON lines; returns how many."""
    seq = F.upper("seq") if upper else F.col("seq")
    read_fasta(spark, source).select(F.col("seq_id").alias("id"), seq.alias("prompt")).write.json(target)
    return spark.read.schema("id string").json(target).count()


def position(text: Column) -> Column:
    """Struct ``start, stop`` (zero-based, half-open) of ``45`` or ``45..120``; ``<`` and ``>`` are dropped, an unknown
    (``?``) or foreign (``:``) place gives null."""
    clean = F.translate(text, "<>", "")
    first = F.when(clean.rlike(r"^\d+(?:\.\.\d+)?$"), F.substring_index(clean, "..", 1).try_cast("int"))
    return F.when(first.isNotNull(), F.struct((first - 1).alias("start"), F.coalesce(F.substring_index(clean, "..", -1).try_cast("int"), first).alias("stop")))
