"""Vector codes: each vector is cut into parts, and a part's code is its nearest entry in the codebook of its position.

Components become integers, so distances, sums and codebooks are exact. The search is LAESA: some entries of
the first codebook stay fixed as pivots, the distances of all parts to them are computed once and stored, and
in each round the distances of pivots to entries give a lower bound for each entry (triangle inequality).
Entries are evaluated in the order of their bounds, until the bound passes the best distance found.

A round is one pass over the stored table; a task sends the sums of its own parts for each entry, so what is
shuffled and what comes to the driver (the codebooks) doesn't depend on the distribution of labels or vectors.

Defined cases: vectors that are null or hold null or non-finite components are dropped, as are those of another length
than the vector of smallest id (their parts have no codebook); that length must be a multiple of ``parts``. Rows that
repeat an id each count, and take places in the first codebook in the order of their vectors; a null id sorts first.
Components of any size are exact; an error beyond a long's range is null. Fewer kept vectors than entries make smaller
codebooks, none an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common as c

ROWS = 2048
PLAIN = 1 << 27  # up to here squared distances of 64 components, and sums over a batch, fit 64 bits
LIMB = 48
SLACK = 1e-6  # pivot distances are stored in single precision


@dataclass
class Codebooks:
    """``entries``: integers by part, entry and place within the part. ``pivots``: fixed, by part likewise."""

    entries: np.ndarray
    pivots: np.ndarray

    def text(self) -> str:
        return ",".join(str(x) for x in self.entries.ravel().tolist())


def integers(values: np.ndarray) -> np.ndarray:
    """``floor(256 * x)``: 64-bit integers, or Python's where they might not do."""
    scaled = 256.0 * values if not len(values) or np.abs(values).max() < PLAIN else None
    if scaled is not None and (not len(scaled) or np.abs(scaled).max() <= PLAIN):
        return np.floor(scaled).astype(np.int64)
    return np.array([int(x) * 256 if abs(x) >= 2.0**53 else math.floor(256 * x) for x in values.tolist()], object)


def squares(difference: np.ndarray) -> np.ndarray:
    return (difference * difference).sum(axis=-1)


def real(x: np.ndarray) -> np.ndarray:
    """As doubles; integers beyond their range are infinite."""
    if x.dtype != object:
        return x.astype(np.float64)
    return np.array([float(v) if v < 1 << 1023 else math.inf for v in x.ravel().tolist()], np.float64).reshape(x.shape)


def root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(real(squared))


def farthest_first(entries: np.ndarray, count: int) -> list[int]:
    """Entries far from each other, beginning with the first."""
    found, near = [0], squares(entries - entries[0])
    while len(found) < min(count, len(entries)):
        found.append(int(np.argmax(near)))
        near = np.minimum(near, squares(entries - entries[found[-1]]))
    return found


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each part (ties: the lower index), its squared distance, and how many distances were computed."""
    from_pivots = root(squares(pivots[:, None, :] - entries[None, :, :]))
    low = np.zeros((len(x), len(entries)))
    for p in range(len(pivots)):
        a, b = to_pivots[:, p, None].astype(np.float64), from_pivots[p][None, :]
        with np.errstate(invalid="ignore"):  # an infinite distance gives no bound
            np.fmax(low, np.abs(a - b) - SLACK * (a + b + 1), out=low)
    low *= low * (1 - SLACK)
    order = np.argsort(low, axis=1)
    active, tried = np.arange(len(x)), 0
    best, code = np.zeros(len(x), x.dtype if x.dtype == entries.dtype else object), np.zeros(len(x), np.int64)
    for t in range(len(entries)):
        e = order[active, t]
        if t:
            open_ = low[active, e] <= real(best[active])
            active, e = active[open_], e[open_]
        if not len(active):
            break
        d = squares(x[active] - entries[e])
        tried += len(active)
        closer = (d < best[active]) | ((d == best[active]) & (e < code[active])) if t else np.ones(len(active), bool)
        best[active[closer]], code[active[closer]] = d[closer], e[closer]
    return code, best, tried


def _limbs(total: int):
    """A sum of any size as summands of 48 bits: (limb, value)."""
    sign, rest, k = (-1 if total < 0 else 1), abs(total), 0
    while rest:
        yield k, sign * (rest & ((1 << LIMB) - 1))
        rest >>= LIMB
        k += 1


def _vectors(column: pa.Array, parts: int) -> np.ndarray:
    """Integers of the rows, by row, part and place."""
    return integers(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), parts, -1)


def _assigned(batches, books: Codebooks):
    """For slices of ``_id, _label, _v, _near``: the slice, its parts, codes and squared distances."""
    for batch in c.slices(batches, ROWS):
        parts, width = len(books.entries), books.pivots.shape[1]
        x = _vectors(batch.column(2), parts)
        to_pivots = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(x), parts, width)
        found = [nearest(x[:, j], to_pivots[:, j], books.entries[j], books.pivots[j]) for j in range(parts)]
        yield batch, x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def updated(table: DataFrame, books: Codebooks) -> np.ndarray:
    """Entries replaced by the floor of their parts' mean; unused ones stay."""
    shape = books.entries.shape

    def sums(batches):
        total, count = np.zeros(shape, object), np.zeros(shape[:2], np.int64)
        for _, x, code, _ in _assigned(batches, books):
            for j in range(shape[0]):
                count[j] += np.bincount(code[:, j], minlength=shape[1])
                own = np.zeros(shape[1:], x.dtype)
                np.add.at(own, code[:, j], x[:, j])
                total[j] += own
        out = [(j, e, -1, 0, n) for (j, e), n in np.ndenumerate(count) if n]
        out += [(j, e, i, k, v) for (j, e, i), s in np.ndenumerate(total) for k, v in _limbs(int(s))]
        yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out) if out else [[]] * 5, [pa.int32()] * 4 + [pa.int64()])], names=["part", "entry", "axis", "limb", "total"])

    rows = table.mapInArrow(sums, "part int, entry int, axis int, limb int, total long")
    rows = rows.groupBy("part", "entry", "axis", "limb").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()
    count, total = {}, {}
    for r in rows:
        if r["axis"] < 0:
            count[r["part"], r["entry"]] = int(r["total"])
        else:
            key = (r["part"], r["entry"], r["axis"])
            total[key] = total.get(key, 0) + (int(r["total"]) << (LIMB * r["limb"]))
    entries = books.entries.astype(object)
    for (j, e), n in count.items():
        entries[j, e] = [total.get((j, e, i), 0) // n for i in range(shape[2])]
    return plain(entries)


def plain(entries: np.ndarray) -> np.ndarray:
    """As 64-bit integers where they are small."""
    return entries.astype(np.int64) if all(-PLAIN <= x <= PLAIN for x in entries.ravel().tolist()) else entries.astype(object)


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, pivots: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, label, code, error, label_error, codebooks_sha256``: two hex digits for each part (so ``entries`` is at most 256), the squared
    distance to the entries of the code, that error summed over equal labels, and a digest of the final codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so at most 256 entries")
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).cast("array<double>").alias("_d"), F.col(vector_col).alias("_v"))
    finite = F.forall("_d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    kept = kept.filter(F.col("_d").isNotNull() & (F.size("_d") > 0) & finite)
    first = kept.orderBy(F.col("_id").asc_nulls_first(), "_d").select("_d").limit(entries).collect()
    length = len(first[0][0]) if first else parts
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    kept = kept.filter(F.size("_d") == length).select("_id", "_label", "_v")
    first = [r[0] for r in first if len(r[0]) == length]
    start = plain(np.stack([integers(np.array(v)).reshape(parts, -1).astype(object) for v in first], 1)) if first else np.zeros((parts, 1, length // parts), np.int64)
    fixed = np.stack([book[farthest_first(book, pivots)] for book in start])

    def to_pivots(batches):
        for batch in c.slices(batches, ROWS):
            x = _vectors(batch.column(2), parts)
            far = np.stack([root(squares(x[:, j, None, :] - fixed[None, j])) for j in range(parts)], 1).astype(np.float32)
            near = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (parts * fixed.shape[1])), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), near], names=["_id", "_label", "_v", "_near"])

    fields = {f.name: f.dataType.simpleString() for f in kept.schema}
    table = c.store(kept.mapInArrow(to_pivots, f"_id long, _label {fields['_label']}, _v {fields['_v']}, _near array<float>"))
    books = Codebooks(start, fixed)
    for _ in range(rounds):
        books = Codebooks(updated(table, books), fixed)
    digest = hashlib.sha256(books.text().encode()).hexdigest() if first else None

    def coded(batches):
        for batch, _, code, best in _assigned(batches, books):
            error = best.sum(axis=1)
            error = pa.array([int(e) if int(e) < 1 << 63 else None for e in error.tolist()], pa.int64())
            flat = code.astype(np.uint8).tobytes().hex()
            text = pa.array([flat[2 * parts * i : 2 * parts * (i + 1)] for i in range(len(code))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, error], names=["_id", "_label", "code", "error"])

    out = c.store(table.mapInArrow(coded, f"_id long, _label {fields['_label']}, code string, error long"))
    long = lambda x: F.expr(f"try_cast({x} AS bigint)")
    by_label = out.groupBy(F.col("_label").alias("_of")).agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("_sum"), F.max(F.col("error").isNull()).alias("_none"))
    by_label = by_label.select("_of", F.when(~F.col("_none"), long("_sum")).alias("label_error"))
    out = out.join(by_label, F.col("_label").eqNullSafe(F.col("_of")), "left")
    return out.select(F.col("_id").alias(id_col), F.col("_label").alias(label_col), "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))
