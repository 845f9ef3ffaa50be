"""Tables written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared checkpoint folder. Only a session on one machine may go without that setting, as in tests; on a cluster
    a local folder would be lost with its executor, so it raises there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        if spark.conf.isModifiable("spark.checkpoint.dir"):
            spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/weftline-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` (in folders by the columns ``by``) and read it back: cuts lineage, and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
