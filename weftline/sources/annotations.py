"""Feature tables of proteins, and the spans in their annotation texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.sources.records import position
from weftline.storage import stored

# Normalised column names and the codes of their features.
FEATURES = {
    "active_site": "ACT_SITE",
    "binding_site": "BINDING",
    "disulfide_bond": "DISULFID",
    "glycosylation": "CARBOHYD",
    "lipidation": "LIPID",
    "modified_residue": "MOD_RES",
    "signal_peptide": "SIGNAL",
    "transit_peptide": "TRANSIT",
    "helix": "HELIX",
    "turn": "TURN",
    "beta_strand": "STRAND",
    "coiled_coil": "COILED",
    "compositional_bias": "COMPBIAS",
    "domain_[ft]": "DOMAIN",
    "motif": "MOTIF",
    "region": "REGION",
    "zinc_finger": "ZN_FING",
}


def read_features(spark: SparkSession, path: str, *carried: str) -> DataFrame:
    """``carried`` columns (by normalised name), ``feature, text``: a row for each feature column with a text; other columns are left out."""
    t = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    t = t.toDF(*(x.strip().lower().replace(" ", "_") for x in t.columns))
    have = [x for x in FEATURES if x in t.columns]
    if missing := [x for x in carried if x not in t.columns]:
        raise ValueError(f"no column {', '.join(missing)}")
    rows = F.explode(F.array(*(F.struct(F.lit(FEATURES[x]).alias("feature"), F.col(f"`{x}`").alias("text")) for x in have)))
    return t.select(*carried, rows.alias("_f")).select(*carried, "_f.feature", "_f.text").filter(F.trim(F.coalesce("text", F.lit(""))) != "")


def spans(df: DataFrame, key: str, text: str, length: Column, block: int = 1024) -> DataFrame:
    """``key, concept, start, stop, domain``: the entries ``TYPE a..b`` of texts cut at ``; ``; entries that begin with a stroke qualify the
    one before. A concept is the type, with its first note where there is one; entries outside the sequence or without a
    place go. ``domain`` numbers the instances of a concept on through all texts by ``key`` (a number): counts of blocks of
    keys come first, and only a block's rows are ranked, so a common concept isn't numbered in one task."""
    part = F.rtrim(F.trim("_part"), F.lit(";"))
    t = df.select(key, length.alias("_len"), F.posexplode(F.split(text, "; ")).alias("_i", "_part")).withColumn("_part", part).filter("_part != ''")
    w = Window.partitionBy(key).orderBy("_i")
    t = t.withColumn("_entry", F.count_if(~F.col("_part").startswith("/")).over(w)).filter("_entry > 0")
    note = F.regexp_extract("_part", r'/note="([^"]*)"', 1)
    noted = F.col("_part").startswith("/") & F.col("_part").contains('/note="') & F.col("_part").rlike(r'/note="[^"]*"')
    t = t.groupBy(key, "_len", "_entry").agg(F.min_by("_part", "_i").alias("_head"), F.min_by(F.when(noted, note), F.when(noted, F.col("_i"))).alias("_note"))
    # A column that is exploded is computed once; a filter on a derived one would compute it again for each of its mentions.
    once = lambda x: F.explode(F.array(x))
    head = F.struct(*(F.regexp_extract("_head", r"^(\S+)\s+(\S.*)$", i).alias(x) for i, x in ((1, "kind"), (2, "place"))))
    t = t.select(key, "_entry", "_note", "_len", once(head).alias("_h"))
    t = t.select(key, "_entry", F.concat("_h.kind", F.when(F.col("_note") != "", F.concat(F.lit(":"), "_note")).otherwise("")).alias("concept"), "_len", once(position(F.col("_h.place"))).alias("_p"))
    t = t.filter(F.col("_p").isNotNull() & (F.col("_p.start") >= 0) & (F.col("_p.stop") <= F.col("_len"))).select(key, "_entry", "concept", "_p", F.floor(F.col(key) / block).alias("_b"))
    t = stored(t)
    blocks = t.groupBy("concept", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("concept").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("concept", "_b", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("concept", "_b").orderBy(key, "_entry"))
    t = t.join(blocks, ["concept", "_b"])
    return t.select(key, "concept", F.col("_p.start").alias("start"), F.col("_p.stop").alias("stop"), (F.col("_before") + rank).alias("domain"))


def places(found: DataFrame, key: str) -> DataFrame:
    """``key, concept, place, domain``: of overlapping spans of one concept the later one labels a place."""
    t = found.filter("stop > start").select(key, "concept", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("place"), "domain")
    return t.groupBy(key, "concept", "place").agg(F.max("domain").alias("domain"))
