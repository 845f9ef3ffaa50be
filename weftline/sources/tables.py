"""Tables of other formats: four-line records, taxonomy dumps, term graphs, layer names, score tables, checksums."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` itself; columns that it lacks raise."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)}")
    return df


def standard_names(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Columns renamed: as ``mapping`` says, else camelCase and spaces to snake_case."""
    snake = lambda c: re.sub(r"[\s\-]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", c.strip())).lower()
    return df.toDF(*((mapping or {}).get(c) or snake(c) for c in df.columns))


def validated(df: DataFrame, seq: str, position: str, *columns: str) -> DataFrame:
    """``check, rows``: how many rows break each rule: a length that is no multiple of three, a null in a column, a position outside the
    sequence's codons. One pass; a missing column raises."""
    require(df, seq, position, *columns)
    bad = {"length": F.length(seq) % 3 != 0, "position": (F.col(position) < 0) | (F.col(position) >= F.floor(F.length(seq) / 3))} | {f"null_{c}": F.col(c).isNull() for c in columns}
    t = df.agg(*(F.count_if(b).alias(k) for k, b in bad.items()))
    return t.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("rows")) for k in bad))).alias("x")).select("x.check", "x.rows")


def read_benchmark(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """``id, value, ref_seq, split`` of a CSV file, U read as T, of one split if named."""
    t = require(spark.read.option("header", True).csv(path), "id", "value", "ref_seq", "split")
    t = t.select("id", F.col("value").try_cast("double").alias("value"), F.translate("ref_seq", "Uu", "Tt").alias("ref_seq"), "split")
    return t.filter(F.col("split") == split) if split else t


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, sequence, structure`` of files of four-line records (id, length, residues, states; blanks don't count,
    ``.`` reads ``~``). A file is read as one text, as only the place of a line tells what it is; files are the unit of parallelism."""
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    t = spark.read.text(path, wholetext=True).select(lines.alias("x")).filter(F.size("x") >= 4)
    t = t.select("x", F.explode(F.sequence(F.lit(0), F.size("x") - 4, F.lit(4))).alias("i"))
    line = lambda k: F.get("x", F.col("i") + k)
    return t.select(line(0).alias("record_id"), F.replace(line(2), F.lit(" ")).alias("sequence"), F.translate(F.replace(line(3), F.lit(" ")), ".", "~").alias("structure"))


def parse_dump(lines: DataFrame, names: list[str], col: str = "value") -> DataFrame:
    """Columns of lines whose fields end in tab, bar, tab; the last bar ends the line."""
    f = F.split(F.regexp_replace(col, r"\t\|$", ""), r"\t\|\t", -1)
    return lines.select(*(F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)))


def parse_terms(stanzas: DataFrame, col: str = "value") -> DataFrame:
    """``term, name, parents`` of stanzas ``id: / name: / is_a:``; obsolete terms and stanzas without an id go."""
    value = lambda tag: F.regexp_extract(col, rf"(?m)^{tag}: ([^\r\n]+)", 1)
    t = stanzas.filter(F.col(col).rlike(r"(?m)^id: ") & ~F.col(col).rlike(r"(?m)^is_obsolete: true"))
    return t.select(value("id").alias("term"), value("name").alias("name"), F.regexp_extract_all(col, F.lit(r"(?m)^is_a: (\S+)"), F.lit(1)).alias("parents"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Stanzas are cut by the reader, so a file is split as usual."""
    return parse_terms(spark.read.option("lineSep", "[Term]\n").text(path))


def term_edges(terms: DataFrame) -> DataFrame:
    """``child, parent``."""
    return terms.select(F.col("term").alias("child"), F.explode("parents").alias("parent"))


def parse_layers(lines: DataFrame, col: str = "value") -> DataFrame:
    """``part, number, layer`` of log lines that name a layer: encoder layers by number (least name of each), heads, embeddings, others."""
    name = F.regexp_extract(col, r"Assigned layer name: (.+)$", 1)
    t = lines.select(F.trim(name).alias("layer")).filter("layer != ''")
    number = F.regexp_extract("layer", r"\.encoder\.layers\.(\d+)\.", 1).try_cast("int")
    part = F.when(number.isNotNull(), "encoder").when(F.col("layer").contains("head"), "head").when(F.col("layer").contains("embedding"), "embedding").otherwise("other")
    t = t.select(part.alias("part"), number.alias("number"), "layer")
    encoder = t.filter("part = 'encoder'").groupBy("part", "number").agg(F.min("layer").alias("layer"))
    return encoder.unionByName(t.filter("part != 'encoder'"))


def gene_scores(df: DataFrame, gene: str, score: str, order: str) -> DataFrame:
    """``gene, score``: a gene's first score in ``order``; nulls go."""
    t = df.filter(F.col(score).isNotNull() & F.col(gene).isNotNull())
    return t.groupBy(gene).agg(F.min_by(score, order).alias(score))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_shards(indexed: DataFrame, index: str, rows: int, path: str) -> None:
    """Parquet in folders ``shard=k`` of ``rows`` rows each, in the order of a dense index; a shard is one file."""
    t = indexed.withColumn("shard", F.floor(F.col(index) / rows))
    t.repartition("shard").sortWithinPartitions("shard", index).write.partitionBy("shard").parquet(path)


def numbered_windows(df: DataFrame, record: str, window: str) -> DataFrame:
    """Adds ``row_id``: a record's id, followed by ``_k`` for its window k where it has more than one."""
    w = Window.partitionBy(record)
    k = F.row_number().over(w.orderBy(window)) - 1
    return df.withColumns({"_k": k, "_m": F.count("*").over(w)}).withColumn("row_id", F.when(F.col("_m") > 1, F.concat_ws("_", F.col(record).cast("string"), F.col("_k").cast("string"))).otherwise(F.col(record).cast("string"))).drop("_k", "_m")
