"""Orders of training samples: keyed permutations without a sort, epochs, resumption, splits by place."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.sampling import roll

ROUNDS = 32


def permuted(index: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Where a permutation of [0, n) keyed by ``key`` puts ``index``: swap-or-not rounds (Hoang, Morris, Rogaway 2012). A round
    pairs x with K - x mod n and swaps the pair by a hash bit of its larger member, so every round is a bijection for any n
    and no index has to walk. An index outside [0, n) gives null. The rounds' K depend on key and n alone, so a task draws them
    once for each of these, not for each row."""

    @F.pandas_udf("long")
    def walk(index: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        drawn, out = {}, []
        for x, m, k in zip(index.tolist(), n.tolist(), key.tolist(), strict=True):
            if not (x is not None and m is not None and 0 <= x < m):  # nulls may come as NaN
                out.append(None)
                continue
            x, m = int(x), int(m)
            steps = drawn.get((k, m))
            if steps is None:
                names = [(str(r) if k is None else f"{k}|{r}").encode() for r in range(rounds)]
                steps = drawn[k, m] = [(name + b"|", int(hashlib.md5(name).hexdigest()[:13], 16) % m) for name in names]
            for name, draw in steps:
                other = (draw - x) % m
                if hashlib.md5(name + b"%d" % (x if x > other else other)).digest()[0] >= 128:
                    x = other
            out.append(x)
        return pd.Series(out, dtype="Int64")

    return walk(index.cast("long"), n.cast("long"), key)


def epoch_schedule(indexed: DataFrame, index: str, seed: int, epochs: int | None = None, samples: int | None = None, consumed: int = 0, batch: int | None = None) -> DataFrame:
    """``place, epoch`` and the columns of ``indexed``, whose ``index`` runs densely from 0: each epoch in an order of its own,
    the last one cut off where ``samples`` ends. ``consumed`` resumes there: a place has the same row whether resumed or
    not. With ``batch`` an epoch ends with its last whole batch (or the last row, if there is none). An empty table has no
    schedule."""
    if (epochs is None) == (samples is None):
        raise ValueError("give either epochs or samples")
    rows = indexed.withColumn(index, F.col(index).cast("long"))
    size = rows.count()
    used = size // batch * batch or size if batch else size
    end = samples if samples is not None else epochs * used
    places = indexed.sparkSession.range(min(consumed, end) if size else 0, end if size else 0).withColumnRenamed("id", "place")
    epoch = F.floor(F.col("place") / max(used, 1))
    t = places.withColumn("epoch", epoch)
    key = F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"))
    return t.withColumn(index, permuted(F.col("place") % max(used, 1), F.lit(size), key)).join(rows, index)


def permutation_split(indexed: DataFrame, index: str, weights: dict[str, float], seed: int) -> DataFrame:
    """Adds ``split``: places of a permutation cut by shares of the row count (truncated; the last split takes the rest)."""
    n = indexed.agg(F.count("*").alias("_n"))
    t = indexed.crossJoin(F.broadcast(n)).withColumn("_p", permuted(F.col(index), F.col("_n"), F.lit(str(seed))))
    return _cut(t, F.col("_p"), weights).drop("_p", "_n")


def contiguous_split(indexed: DataFrame, index: str, weights: dict[str, float]) -> DataFrame:
    """Adds ``split``: stretches of the given order, cut as in ``permutation_split``."""
    n = indexed.agg(F.count("*").alias("_n"))
    return _cut(indexed.crossJoin(F.broadcast(n)), F.col(index), weights).drop("_n")


def _cut(t: DataFrame, place: Column, weights: dict[str, float]) -> DataFrame:
    total, names = sum(abs(w) for w in weights.values()), list(weights)
    if not total:
        raise ValueError("weights sum to zero")
    out, edge = F.lit(names[-1]), F.lit(0).cast("long")
    cases = []
    for name in names[:-1]:
        edge = edge + F.floor(F.col("_n") * (abs(weights[name]) / total))
        cases.append((name, edge))
    for name, end in reversed(cases):
        out = F.when(place < end, name).otherwise(out)
    return t.withColumn("split", out)


def uniform_sample(df: DataFrame, key: str, keep: Column, n: int, seed: int) -> DataFrame:
    """``n`` of the rows that ``keep`` admits, those of least hash; Spark takes each task's n least before it merges them."""
    return df.filter(keep).orderBy(roll(F.col(key), seed), key).limit(n)


def first_records(indexed: DataFrame, index: str, keep: Column, n: int) -> DataFrame:
    """The first ``n`` admitted rows in order of ``index`` (dense from 0), with ``scanned``: how many rows had been read by then."""
    return indexed.filter(keep).withColumn("scanned", F.col(index) + 1).orderBy(index).limit(n)
