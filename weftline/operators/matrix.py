"""Sparse matrices as long tables (row, column, value), neighbour lists and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import sequences as S
from weftline.storage import stored

TASK_ROWS = 1 << 19


def shape(coo: DataFrame, row: str, col: str) -> DataFrame:
    """Rows, columns, stored values and sparsity."""
    t = coo.agg(F.countDistinct(row).alias("n_rows"), F.countDistinct(col).alias("n_cols"), F.count("*").alias("n_stored"))
    return t.withColumn("sparsity", 1 - F.col("n_stored") / (F.col("n_rows") * F.col("n_cols")))


def csr_rows(coo: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """A row for each matrix row: ``columns`` and ``values`` in column order."""
    t = coo.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(F.col(col).alias("c"), F.col(value).alias("v")))).alias("x"))
    return t.select(row, F.transform("x", lambda e: e["c"]).alias("columns"), F.transform("x", lambda e: e["v"]).alias("values"))


def dense_index(df: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """``key, row_index``: the place of each distinct key in order, without one global sort: keys are dealt by ``ranges`` (default: as many as the
    session has shuffle partitions) and stored with their range's number; counts of ranges give each its first place, and a task ranks one range."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = stored(df.select(key).distinct().repartitionByRange(n, key).withColumn("_part", F.spark_partition_id()))
    counts = keys.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", before.alias("_before"))  # a row for each range
    return keys.join(F.broadcast(counts), "_part").select(key, (F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1).alias("row_index"))


def neighbour_stats(edges: DataFrame, row: str, nbr: str) -> DataFrame:
    per = edges.groupBy(row).agg(F.count(nbr).alias("n"))
    return per.agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def first_neighbour(rows: DataFrame, edges: DataFrame, row: str, nbr: str, order: list[str]) -> DataFrame:
    """Each row with its first neighbour, or itself if it has none."""
    first = edges.groupBy(row).agg(F.min(F.struct(*order, F.col(nbr).alias("_n"))).alias("_f")).select(row, F.col("_f._n").alias("neighbour"))
    return rows.select(row).distinct().join(first, row, "left").withColumn("neighbour", F.coalesce("neighbour", row))


def activations(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, feature, value``: positive parts as decimals, so that sums don't depend on order."""
    t = vectors.select(id_col, F.posexplode(vec_col).alias("feature", "_v"))
    return t.select(id_col, "feature", F.greatest(F.col("_v").cast("double"), F.lit(0.0)).cast("decimal(18,6)").alias("value"))


def feature_stats(acts: DataFrame) -> DataFrame:
    """Share of active rows, mean and maximum over active rows."""
    on = F.col("value") > 0
    return acts.groupBy("feature").agg(F.avg(on.cast("double")).alias("frequency"), F.avg(F.when(on, F.col("value").cast("double"))).alias("mean_active"), F.max("value").alias("top"))


def top_rows(acts: DataFrame, id_col: str, k: int) -> DataFrame:
    """The k largest positive rows of each feature, ties by id."""
    w = Window.partitionBy("feature").orderBy(F.desc("value"), id_col)
    return acts.filter("value > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dense_rows(coo: DataFrame, row: str, col: str, value: str, width: int) -> DataFrame:
    """``row, values``: arrays of ``width`` with zeros where nothing is stored; entries of one place add up, columns outside go."""
    t = coo.filter(F.col(col).between(0, width - 1)).groupBy(row, F.col(col).cast("int").alias("_c")).agg(F.sum(value).alias("_v"))
    t = t.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("_c", "_v"))).alias("_m"))
    return t.select(row, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0))).alias("values"))


def lookup(wanted: DataFrame, entries: DataFrame, row: str, col: str, value: str, missing=None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Each wanted place once, with the sum of the entries stored there, else ``missing``; a place with a null has none. Both tables meet in one aggregation, without
    a join, and are dealt to as many tasks as leave each about ``task_rows`` of their rows, so a task's memory doesn't grow with the tables or hang on the
    session's partitions. Rows are counted first, which reads no column of a Parquet table; one place's rows stream through one task."""
    kept = entries.filter(F.col(row).isNotNull() & F.col(col).isNotNull()).select(row, col, value, F.lit(False).alias("_wanted"))
    both = kept.unionByName(wanted.select(row, col, F.lit(None).cast(entries.schema[value].dataType).alias(value), F.lit(True).alias("_wanted")))
    tasks = max(int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(entries.count() + wanted.count()) // task_rows))
    t = both.repartition(tasks, row, col).groupBy(row, col).agg(F.sum(value).alias(value), F.max("_wanted").alias("_wanted")).filter("_wanted")
    return t.select(row, col, F.coalesce(F.col(value), F.lit(missing)).alias(value))


def block_bounds(blocks: DataFrame, block: str, rows: str) -> DataFrame:
    """``block, start, stop`` of rows that are numbered on through the blocks; there are as many rows here as blocks."""
    w = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("stop", F.sum(rows).over(w)).select(block, (F.col("stop") - F.col(rows)).alias("start"), "stop")


def near_maximum(values: DataFrame, row: str, place: str, value: str, reach: int, out: str) -> DataFrame:
    """Adds the maximum of the values within ``reach`` places of the same row."""
    w = Window.partitionBy(row).orderBy(place).rowsBetween(-reach, reach)
    return values.withColumn(out, F.max(value).over(w))


def cast_losses(coo: DataFrame, value: str, to: str, tolerance: float) -> DataFrame:
    """``largest, beyond``: the largest change of a value that a cast makes, and how many values change by more than ``tolerance``."""
    change = F.abs(F.col(value) - F.col(value).cast(to).cast("double"))
    return coo.agg(F.max(change).alias("largest"), F.count_if(change > tolerance).alias("beyond"))


def least_unsigned(coo: DataFrame, value: str) -> DataFrame:
    """``fits``: the least unsigned type that holds all values; a negative one fails the job."""
    top = F.max(value)
    kind = F.when(top < 2**8, "uint8").when(top < 2**16, "uint16").when(top < 2**32, "uint32").otherwise("uint64")
    return coo.agg(F.when(F.min(value) < 0, F.raise_error(F.lit("a negative value")).cast("string")).otherwise(kind).alias("fits"))


def neighbour_lists(edges: DataFrame, row: str, nbr: str, weight: str, order: list[str]) -> DataFrame:
    """``row, neighbours, weights`` in the given order; a list is as long as a row's degree."""
    t = edges.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(nbr).alias("_n"), F.col(weight).alias("_w")))).alias("_x"))
    return t.select(row, F.transform("_x", lambda v: v["_n"]).alias("neighbours"), F.transform("_x", lambda v: v["_w"]).alias("weights"))


def neighbour_counts(rows: DataFrame, edges: DataFrame, row: str, nbr: str) -> DataFrame:
    """``total, least, most, mean, without`` over all rows, those without a neighbour too."""
    per = rows.join(edges.groupBy(row).agg(F.count(nbr).alias("n")), row, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return per.agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.count_if(F.col("n") == 0).alias("without"))


def row_range(bounds: DataFrame, block: str, start: int, stop: int) -> DataFrame:
    """``block, first, last``: the part [first, last) of each block that the rows [start, stop) lie in."""
    t = bounds.filter((F.col("start") < stop) & (F.col("stop") > start))
    return t.select(block, (F.greatest(F.col("start"), F.lit(start)) - F.col("start")).alias("first"), (F.least(F.col("stop"), F.lit(stop)) - F.col("start")).alias("last"))


def member_places(members: DataFrame, name: str, offsets: DataFrame, group: str, first: str) -> DataFrame:
    """Adds ``place`` to members named ``group_i`` (cut at the last stroke): the group's offset and i."""
    t = members.withColumns({group: F.regexp_extract(name, r"^(.*)_(\d+)$", 1), "_i": F.regexp_extract(name, r"^(.*)_(\d+)$", 2).try_cast("long")})
    return t.join(offsets, group).withColumn("place", F.col(first) + F.col("_i")).drop("_i", first)


def first_match(proteins: DataFrame, candidates: DataFrame, key: str, protein: str, cds: str, order: str, genomic: str) -> DataFrame:
    """``key, candidate``: the first candidate, in order, whose translation is the protein or differs in its first residue only; null without one."""
    t = candidates.filter(~F.col(genomic) & (F.col(cds) != "")).select(key, order, S.translate(F.col(cds)).alias("_t")).join(proteins, key)
    rest = lambda x: F.substring(x, 2, 2**31 - 1)
    same = (F.length("_t") == F.length(protein)) & (rest("_t") == rest(protein))
    return proteins.select(key).join(t.filter(same).groupBy(key).agg(F.min(order).alias("candidate")), key, "left")


def layer(rows: DataFrame, name: str, row: str, col: str, densest: float) -> DataFrame:
    """``row, col, value`` of one layer (a column). A missing layer raises; a matrix that stores more than ``densest`` of its places fails the job."""
    if name not in rows.columns:
        raise ValueError(f"no layer {name}")
    t = rows.select(row, col, F.col(name).alias("value")).filter(F.col("value").isNotNull())
    full = shape(t, row, col).select((1 - F.col("sparsity")).alias("_full"))
    checked = F.when(F.col("_full") > densest, F.raise_error(F.lit("a dense matrix")).cast("boolean")).otherwise(F.lit(True))
    return t.crossJoin(F.broadcast(full.filter(checked))).drop("_full")  # one row


def checked_union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all, columns by name; other columns or types than the first's raise."""
    kinds = dict(first.dtypes)
    for t in others:
        if dict(t.dtypes) != kinds:
            raise ValueError(f"schemas differ: {sorted(set(kinds.items()) ^ set(t.dtypes))}")
    out = first
    for t in others:
        out = out.unionByName(t)
    return out


def concatenated(parts: list[DataFrame], row: str, col: str, value: str) -> DataFrame:
    """``part, row, row_index, n, pointer, entries``: the rows of all parts in order of part and row, numbered on, with the count of stored
    values before each. Integers of different widths take the widest, other mixed kinds raise. A part's rows are counted by
    ranges first, so no task numbers them all."""
    kinds = {dict(p.dtypes)[value] for p in parts}
    if len(kinds) > 1 and not kinds <= {"tinyint", "smallint", "int", "bigint"} and not kinds <= {"float", "double"}:
        raise ValueError(f"values of {', '.join(sorted(kinds))}")
    every = None
    for k, p in enumerate(parts):
        t = p.select(F.lit(k).alias("part"), row, col, value)
        every = t if every is None else every.unionByName(t)
    rows = every.groupBy("part", row).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(col).alias("c"), F.col(value).alias("v")))).alias("entries"))
    rows = rows.withColumn("_o", F.struct("part", row))
    rows = rows.join(dense_index(rows, "_o"), "_o").drop("_o")
    t = rows.withColumn("_b", F.floor(F.col("row_index") / 4096))
    before = t.groupBy("_b").agg(F.sum("n").alias("_n")).withColumn("_at", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.sum("n").over(Window.partitionBy("_b").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return t.join(before, "_b").select("part", row, "row_index", "n", (F.col("_at") + inside).alias("pointer"), "entries")


def feature_blocks(parts: DataFrame, order: str, rows: str, features: str) -> DataFrame:
    """``block, first, rows, features``: consecutive parts of equal feature lists (told by their hash) are one block. One row for each part."""
    w = Window.orderBy(order)
    t = parts.withColumn("_h", F.sha2(F.to_json(F.struct(features)), 256))
    t = t.withColumn("_new", (~F.col("_h").eqNullSafe(F.lag("_h").over(w))).cast("int")).withColumn("block", F.sum("_new").over(w))
    return t.groupBy("block").agg(F.min(order).alias("first"), F.sum(rows).alias("rows"), F.min_by(features, order).alias("features"))
