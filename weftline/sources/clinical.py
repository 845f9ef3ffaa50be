"""Variant tables, assembly lists and coding-sequence files of public archives."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.sequence_tables import cds_flags
from weftline.sources.fasta import read_fasta
from weftline.sources.records import read_codon_csv
from weftline.sources.tables import require

VARIANT_SQL = "chrom string, pos long, ref string, alt string, score double"


def read_variants(spark: SparkSession, *paths: str, schema: str = VARIANT_SQL) -> DataFrame:
    """Headerless tables of variants, one or more for each chromosome, as one with the schema's names."""
    return spark.read.schema(schema).option("sep", "\t").csv(list(paths))


# The columns of the archive's summary table and their names here.
SUMMARY_NAMES = {"Type": "kind", "Assembly": "assembly", "Chromosome": "chrom", "PositionVCF": "pos", "ReferenceAlleleVCF": "ref", "AlternateAlleleVCF": "alt", "ReviewStatus": "review", "ClinicalSignificance": "significance"}


def summary_variants(df: DataFrame, kind: str, assembly: str, unreviewed: str = "no assertion") -> DataFrame:
    """Rows of one kind and assembly that were reviewed, named as SUMMARY_NAMES say, chromosomes with ``chr``, and the id ``chrom_pos_ref_alt``."""
    t = require(df, *SUMMARY_NAMES).select(*(F.col(a).alias(b) for a, b in SUMMARY_NAMES.items()))
    t = t.filter((F.col("kind") == kind) & (F.col("assembly") == assembly) & ~F.col("review").startswith(unreviewed))
    t = t.withColumn("chrom", F.concat(F.lit("chr"), F.regexp_replace("chrom", "^chr", "")))
    return t.withColumn("id", F.concat_ws("_", "chrom", F.col("pos").cast("string"), "ref", "alt"))


def census_variants(samples: DataFrame, census: DataFrame, gene: str, tier: str, tiers: tuple[int, ...]) -> DataFrame:
    """The samples' rows whose gene the census lists in one of the tiers."""
    return samples.join(census.filter(F.col(tier).isin(*tiers)).select(gene).distinct(), gene, "left_semi")


def read_assemblies(spark: SparkSession, path: str, excluded: DataFrame | None = None) -> DataFrame:
    """Rows of an assembly list whose category is ``reference genome``; lines above the header are comments. ``excluded`` has ``taxid``s that go."""
    lines = spark.read.text(path)
    head = lines.filter(F.col("value").startswith("#assembly_accession")).limit(1).collect()
    if not head:
        raise ValueError(f"no header in {path}")
    names = head[0][0].lstrip("#").split("\t")
    f = F.split("value", "\t")
    t = lines.filter(~F.col("value").startswith("#")).select(*(F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)))
    t = require(t, "taxid", "refseq_category").filter("refseq_category = 'reference genome'")
    return t.join(excluded.select(F.col("taxid").cast("string").alias("taxid")).distinct(), "taxid", "left_anti") if excluded is not None else t


def coding_rows(records: DataFrame, assemblies: DataFrame, file: str) -> DataFrame:
    """``assembly, group, taxid, seq_id, cds`` of records (``seq_id, seq`` and their ``file``): ids are what follows the bar of ``lcl|``, the assembly is
    in the file's name, ``assemblies`` (assembly, group, taxid) tells the rest; only valid coding sequences, each once in an assembly."""
    t = records.withColumns({"assembly": F.regexp_extract(file, r"(GC[AF]_\d+(?:\.\d+)?)", 1), "seq_id": F.regexp_extract("seq_id", r"^(?:lcl\|)?(.*)$", 1), "cds": F.upper("seq")})
    t = cds_flags(t, "cds").filter("valid").groupBy("assembly", "cds").agg(F.min("seq_id").alias("seq_id"))
    return t.join(assemblies, "assembly").select("assembly", "group", "taxid", "seq_id", "cds")


def read_input(spark: SparkSession, path: str) -> DataFrame:
    """``id, sequence`` of a table or a sequence file, told by its suffix; a file without ids is keyed by the sequences."""
    if re.search(r"\.csv(\.gz)?/?$", path):
        return read_codon_csv(spark, path).select("id", "sequence")
    if re.search(r"\.(fa|fasta|fna)(\.gz)?/?$", path):
        return read_fasta(spark, path).select(F.col("seq_id").alias("id"), F.col("seq").alias("sequence"))
    raise ValueError(f"neither a table nor a sequence file: {path}")


def read_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of all files below a folder, with their ``file``. A broken line fails the job, and Spark's error names its file."""
    t = spark.read.schema(schema).option("recursiveFileLookup", True).option("mode", "FAILFAST").json(path)
    return t.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1).alias("file"))


def lacking(spark: SparkSession, files: dict[str, tuple[str, ...]]) -> DataFrame:
    """``file, rows, missing``: for each CSV file the columns that it should have and lacks, by name."""
    out = None
    for path, names in files.items():
        t = spark.read.option("header", True).csv(path)
        missing = ",".join(n for n in names if n not in t.columns)
        row = t.agg(F.count("*").alias("rows")).select(F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("file"), "rows", F.lit(missing).alias("missing"))
        out = row if out is None else out.unionByName(row)
    return out


def site_scores(points: DataFrame, spans: DataFrame, on: str, pos: str, value: Column) -> DataFrame:
    """``points`` with ``score``: the value of the span [start, end) that holds each; a table of spans instead of a file of bases."""
    from weftline.operators.intervals import point_in_interval

    keys = points.columns
    found = point_in_interval(points, spans.withColumn("score", value), on, pos, "start", "end").groupBy(*keys).agg(F.max("score").alias("score"))
    return points.join(found, keys, "left")
