"""Feature statistics that keep up with arriving activations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mergeable(acts: DataFrame) -> DataFrame:
    """Count, sum, sum of squares and maximum per feature; parts of the data add up."""
    v = F.col("value").cast("double")
    return acts.groupBy("feature").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.max("value").alias("top"))


def merge(parts: DataFrame) -> DataFrame:
    """Parts of ``mergeable`` into one, with mean and population variance."""
    t = parts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.max("top").alias("top"))
    mean = F.col("total") / F.col("n")
    return t.withColumns({"mean": mean, "variance": F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - mean * mean)})


def follow(stream: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch's part under its own batch id, so a batch that runs twice replaces itself."""
    return stream.writeStream.foreachBatch(lambda df, k: mergeable(df).write.mode("overwrite").parquet(f"{path}/batch={k}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
