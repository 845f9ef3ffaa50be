"""Language identification with a convolutional network over bytes, trained in numpy.

Each whole text is cut into windows of WINDOW bytes (the last one padded). Filters of two, three and four bytes,
whose first layer is a table row for each byte, run over a window; the maximum over places, a
rectifier and a softmax layer give its language. A document's prediction is the length-weighted
mean of its windows' log-probabilities.

Training: every language of the training rows is a class; at most ``per_language`` documents of each (in expectation, drawn by
hash), three windows of each document. This bound is the one place where not all rows count; every row is predicted. The
sample and the softmax layer grow with the number of languages alone. Training is seeded and single-threaded, so reruns agree.

Defined cases: a text that is null or has no letter gets ``und`` with score 0, and so do all texts when
nothing can be learned; rows that repeat an id are predicted each on its own; a very long text is a chunk of its own, scored
1,024 windows at a time; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import common as c

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def windows_of(text: bytes, places: list[int]) -> np.ndarray:
    out = np.zeros((len(places), WINDOW), np.uint8)
    for row, at in zip(out, places, strict=True):
        piece = np.frombuffer(text[at : at + WINDOW], np.uint8)
        row[: len(piece)] = piece
    return out


class ByteNetwork:
    """Tables ``t[w][k]`` (256 x FILTERS) for the k-th byte of a filter of width w, and a softmax layer."""

    def __init__(self, labels: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.t = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima over places, and where they are."""
        tops, places = [], []
        for w, t in zip(WIDTHS, self.t, strict=True):
            n = WINDOW - w + 1
            v = t[0][x[:, :n]]
            for k in range(1, w):
                v += t[k][x[:, k : k + n]]
            at = v.argmax(axis=1)
            places.append(at)
            tops.append(np.take_along_axis(v, at[:, None, :], 1)[:, 0])
        return np.concatenate(tops, axis=1), places

    def pair_tables(self) -> list[list[np.ndarray]]:
        """Sums of tables for pairs of bytes, so that scoring takes one look-up for two bytes."""
        out = []
        for w, t in zip(WIDTHS, self.t, strict=True):
            parts = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            out.append(parts + ([t[w - 1]] if w % 2 else []))
        return out

    def log_probs(self, x: np.ndarray, pairs: list[list[np.ndarray]]) -> np.ndarray:
        out = []
        for lo in range(0, len(x), 64):
            b = x[lo : lo + 64]
            code = b[:, :-1].astype(np.int32) * 256 + b[:, 1:]
            tops = []
            for w, parts in zip(WIDTHS, pairs, strict=True):
                n = WINDOW - w + 1
                v = parts[0].take(code[:, :n], axis=0)
                if w == 3:
                    v += parts[1].take(b[:, 2 : 2 + n], axis=0)
                elif w == 4:
                    v += parts[1].take(code[:, 2 : 2 + n], axis=0)
                tops.append(v.max(axis=1))
            out.append(self.layer(np.concatenate(tops, axis=1)))
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)))

    def layer(self, top: np.ndarray) -> np.ndarray:
        z = np.maximum(top + self.bias, 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 5) -> ByteNetwork:
        """Adam on the cross-entropy."""
        rng = np.random.default_rng(seed)
        params = [*self.t, self.bias, self.out, self.out_bias]
        m, s = ([np.zeros_like(p) for p in params] for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                xb, yb = x[rows], y[rows]
                top, places = self.pooled(xb)
                hidden = np.maximum(top + self.bias, 0)
                p = np.exp(self.layer(top))
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                back = (p @ self.out.T) * (hidden > 0)
                grads = []
                for i, (w, at) in enumerate(zip(WIDTHS, places, strict=True)):
                    g = np.zeros_like(self.t[i])
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        byte = np.take_along_axis(xb, at + k, 1)
                        np.add.at(g[k], (byte, np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
                grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
                step += 1
                for q, g, a, b in zip(params, grads, m, s, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def placed(key: Column) -> Column:
    """A hash below 2 ** 62; a share of the keys lies below that share of it, however small it is."""
    return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 62))


def train(docs: DataFrame, train_rows: Column, per_language: int = 400, windows: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNetwork | None:
    """Learn from the rows where ``train_rows`` holds; None if there are none. Of each language ``per_language`` texts are drawn by hash (in expectation; all, if
    it has no more), and of each of them its first window, its last and others by hash over the whole text, ``windows`` in all."""
    rows = docs.filter(train_rows & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()  # a row for each class of the softmax layer
    if not counts:
        return None
    place = placed(F.col(id_col))
    share = F.try_element_at(F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["n"]) * float(1 << 62)))), F.col(lang_col).cast("string"))
    labels = sorted(r["lang"] for r in counts)
    index = {x: i for i, x in enumerate(labels)}

    def cut(batches):
        for batch in batches:
            x, y = [], []
            for text, lang, seed in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                raw = text.encode()
                last = max(0, len(raw) - WINDOW)
                places = sorted({0, last, *((seed * (2 * i + 1) + i) % (last + 1) for i in range(windows - 2))})
                x += [w.tobytes() for w in windows_of(raw, places)]
                y += [index[lang]] * len(places)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.int32())], names=["x", "y"])

    chosen = rows.filter(place < share).select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"), place.alias("s"))
    got = sorted((bytes(r["x"]), r["y"]) for r in chosen.mapInArrow(cut, "x binary, y int").collect())
    if not got:
        return None
    x = np.frombuffer(b"".join(r[0] for r in got), np.uint8).reshape(-1, WINDOW)
    return ByteNetwork(labels).fit(x, np.array([r[1] for r in got]))


def identify(docs: DataFrame, model: ByteNetwork | None, *keep: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` and the columns ``keep``."""
    table = c.keyed(docs, id_col, text_col, *keep)
    more = table.columns[3:]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        model = shared.value
        pairs = model.pair_tables() if model else None
        for batch in batches:
            langs, scores = [], []
            for chunk in c.chunks(iter([batch])):
                n = len(chunk.ids)
                letters = np.zeros(n, bool)
                found = np.concatenate([[0], np.cumsum(_LETTER[chunk.data])])
                letters = found[chunk.starts + chunk.lens] > found[chunk.starts]
                raw = chunk.data
                for i in np.flatnonzero(~letters & (chunk.lens > 0)).tolist():
                    letters[i] = any(x.isalpha() for x in raw[chunk.starts[i] : chunk.starts[i] + chunk.lens[i]].tobytes().decode())
                if model is None:
                    letters[:] = False
                rows = np.flatnonzero(letters)
                parts = -(-chunk.lens[rows] // WINDOW)
                doc = np.repeat(np.arange(len(rows)), parts)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = chunk.starts[rows][doc] + k * WINDOW
                size = np.minimum(WINDOW, chunk.lens[rows][doc] - k * WINDOW)
                total = np.zeros((len(rows), len(model.labels) if model else 1))
                padded = np.concatenate([raw, np.zeros(WINDOW, np.uint8)])
                for lo in range(0, len(doc), 1024):
                    at = slice(lo, lo + 1024)
                    x = padded[start[at][:, None] + np.arange(WINDOW)]
                    x[np.arange(WINDOW)[None, :] >= size[at][:, None]] = 0
                    np.add.at(total, doc[at], model.log_probs(x, pairs) * size[at][:, None])
                total /= np.maximum(1, chunk.lens[rows])[:, None]
                own, score = np.full(n, -1), np.zeros(n)
                if len(rows):
                    p = np.exp(total - total.max(axis=1, keepdims=True))
                    own[rows] = total.argmax(axis=1)
                    score[rows] = 1 / p.sum(axis=1)
                langs += ["und" if i < 0 else model.labels[i] for i in own.tolist()]
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in range(3, batch.num_columns)), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["_id", *more, "lang_pred", "score"])

    fields = "".join(f", `{x.name}` {x.dataType.simpleString()}" for x in table.schema.fields[3:])
    return table.mapInArrow(work, f"_id long{fields}, lang_pred string, score double").select(c.plain_id(), *more, "lang_pred", "score")
