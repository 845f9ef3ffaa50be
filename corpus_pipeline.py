"""A corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept. All but the
last return the columns of ``documents``; the last returns the mix. No SQL equivalent: the first stage scores
with a trained model.

Defined cases: null and empty texts are clean, have no words and no shingles, and stay; rows that repeat id and text are one
document, which stays or goes in all its rows; a null id sorts first; very long texts are worked on whole; an empty table gives an empty table; other
columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common as c
from weftline.llm import toxicity
from weftline.llm.decontamination import decontaminate
from weftline.llm.jaccard_join import jaccard_join
from weftline.llm.line_dedup import line_dedup
from weftline.llm.mixing import mix_sources

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows of ``gone`` (``doc_id, _h``)."""
    gone = gone.select(F.coalesce("doc_id", F.lit(c.NULL_ID)).alias("_id"), "_h").distinct()
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id"), F.lit(c.NULL_ID)), "_h": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    return keyed.join(gone, ["_id", "_h"], "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labels outside the held-out fifth."""
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 0
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train)
    scored = toxicity.score(docs, model, *(F.col(x) for x in COLUMNS[1:]))
    return scored.filter("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points that five documents hold stay in one of them."""
    out = line_dedup(docs, keep=("lang", "source"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word shingle similarity 0.8 stays, that of least id."""
    rows = jaccard_join(docs, n=5, percent=80)
    return _without(docs, rows.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words lie in 13-word windows of benchmark items go."""
    rows = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=13)
    return _without(docs, rows.filter("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, and its place in the output shards."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = c.store(stage(spark, docs, sf_dir).select(*COLUMNS))
    return STAGES[-1][1](spark, docs, sf_dir)
