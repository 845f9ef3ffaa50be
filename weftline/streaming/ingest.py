"""Files that keep arriving: sequences and metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.fasta import fasta_records
from weftline.sources.records import parse_metrics


def follow_fasta(spark: SparkSession, path: str, target: str, checkpoint: str, min_length: int = 0, max_length: int = 0, files_per_trigger: int = 1000):
    """New FASTA files under ``path`` as Parquet, each once: the file source and the Parquet sink both keep logs."""
    lines = spark.readStream.option("lineSep", ">").option("maxFilesPerTrigger", files_per_trigger).text(path)
    t = fasta_records(lines, min_length, max_length)
    return t.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metric_windows(lines: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Count and mean of each metric in windows of event time; lines later than ``late`` are left out, state is dropped with them."""
    t = parse_metrics(lines).withWatermark("ts", late)
    return t.groupBy(F.window("ts", width).alias("span"), "metric").agg(F.count("*").alias("n"), F.avg("reading").alias("mean")).select("span.start", "metric", "n", "mean")
