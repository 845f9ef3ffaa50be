"""Products of two sets of vectors, of which the highest and lowest are kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.storage import stored


def _packed(df: DataFrame, key: str, vector: str, block: int, at: str, name: str) -> DataFrame:
    """``at, name``: blocks of about ``block`` rows, dealt by hash, as arrays of structs (key, vector)."""
    n = max(1, -(-df.count() // block))
    t = df.select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(at), F.struct(F.col(key).alias("k"), F.col(vector).alias("v")).alias("_x"))
    return stored(t.groupBy(at).agg(F.collect_list("_x").alias(name)))


def _matrix(column: pa.Array, i: int) -> tuple[pa.Array, np.ndarray]:
    """The keys and the vectors of one packed block."""
    rows = column[i].values
    keys, vectors = rows.field(0), rows.field(1)
    return keys, vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)


def extreme_products(a: DataFrame, b: DataFrame, row: str, col: str, vector: str, k: int, centred: bool = False, block: int = 1024, unit: int | None = None) -> DataFrame:
    """``row, side, rank, col, score``: for each row of ``a`` the ``k`` rows of ``b`` with the highest (``side`` top) and lowest (bottom) product of
    vectors, ties by ``col``. With ``centred`` a score is less the mean score of its ``col`` over all of ``a``, which is the product with the
    mean vector. Keys are unique and not null, vectors of one length without nulls; those of whole numbers give exact scores (``centred``
    ones are that number times the rows of ``a``, over it). With ``unit`` scores are rounded to its multiples before they are ranked, halves
    away from zero, so that those alike by then are tied.

    Vectors travel in blocks of about ``block`` rows, each as often as the other side has blocks. A task multiplies a pair of
    blocks and keeps ``k`` of each side for a row, so what is merged grows with rows times blocks, not with rows times columns."""
    key, kind = (a.schema[row].dataType.simpleString(), b.schema[col].dataType.simpleString())
    whole = a.schema[vector].dataType.elementType.simpleString() in ("tinyint", "smallint", "int", "bigint") and b.schema[vector].dataType.elementType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    score = "long" if whole else "double"
    left, right = _packed(a, row, vector, block, "i", "left"), _packed(b, col, vector, block, "j", "right")
    rows, total = 1, None
    if centred:
        parts = a.select(F.posexplode(vector).alias("d", "x")).groupBy("d").agg(F.sum("x").alias("s"), F.count("*").alias("n")).orderBy("d").collect()  # a number for each dimension
        rows, total = (parts[0]["n"], np.array([p["s"] for p in parts])) if parts else (1, None)

    def best(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                (mine, x), (other, y) = _matrix(batch.column(0), r), _matrix(batch.column(1), r)
                s = x @ y.T
                if total is not None:
                    s = s * rows - (y @ total)[None, :]
                if unit is not None:
                    step = unit * rows
                    s = np.sign(s) * ((2 * np.abs(s) + step) // (2 * step)) * step
                order = np.argsort(np.array(other.to_pylist()), kind="stable")  # ties by key
                other, s = other.take(pa.array(order)), s[:, order]
                for side, ranked in (("top", np.argsort(-s, axis=1, kind="stable")), ("bottom", np.argsort(s, axis=1, kind="stable"))):
                    at = ranked[:, :k]
                    own = np.repeat(np.arange(len(mine)), at.shape[1])
                    yield pa.RecordBatch.from_arrays([mine.take(pa.array(own)), pa.array([side] * at.size), other.take(pa.array(at.ravel())), pa.array(s[own, at.ravel()])], names=[row, "side", col, "score"])

    pairs = left.withColumn("j", F.explode(F.array(*map(F.lit, sorted(x[0] for x in right.select("j").collect()))).cast("array<int>"))).join(right, "j")
    found = pairs.repartition("i", "j").select("left", "right").mapInArrow(best, f"{row} {key}, side string, {col} {kind}, score {score}")
    rank = F.row_number().over(Window.partitionBy(row, "side").orderBy(F.when(F.col("side") == "top", -F.col("score")).otherwise(F.col("score")), col))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select(row, "side", "rank", col, (F.col("score") / rows if centred else F.col("score")).alias("score"))
