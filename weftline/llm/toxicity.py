"""Toxicity with noisy-channel deobfuscation.

1. A character model: counts of letter trigrams over all plain words of all documents.
2. Tokens that may be disguised (figures or signs beside letters, doubled letters,
   spaced-out single characters) become lattices: each character may stand for itself, for the
   letters that it imitates, or for nothing (separators); a run of one letter may be one or two.
   Viterbi decoding takes the path of least channel cost plus character-model cost, and the words it
   restores join the text's own words.
3. A logistic model on the presence of words and of word beginnings (four, five and six bytes) scores the restored text. It is
   fitted on at most ``sample`` labelled training rows (in expectation, drawn by hash, half of each
   class where there are enough); its ``width``, eight features for 125 rows of the sample unless given, takes those most tied to the label among those in ``least`` rows of that
   sample. Width and support are sizes of the model and leave no text or label out. Every whole text is scored.

Defined cases: null or empty texts get the score of a text without features, and so do all texts when there
are no labels of both kinds; several labels of one document count as toxic if any is; rows that repeat an id are
scored each on its own; a very long text is a chunk of its own, a very long disguised token takes time in proportion; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import common as c

LEAST = 5
# What characters imitate.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = ".-_*~'`·, "
LETTERS = "abcdefghijklmnopqrstuvwxyz"
_KIND = np.zeros(256, np.int64)  # 0: boundary, 1 to 26: letters, 27: other letters
_KIND[97:123] = _KIND[65:91] = np.arange(1, 27)
_KIND[128:] = 27
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LETTER = (_KIND > 0)
_IMITATES, _DISGUISE = np.zeros(256, bool), np.zeros(256, bool)
_IMITATES[[ord(x) for x in IMITATES if x < "\x80"]] = True
_DISGUISE[[ord(x) for x in [*IMITATES, *SEPARATORS] if " " < x < "\x80"]] = True
_WIDE = re.compile("|".join(x for x in [*IMITATES, *SEPARATORS] if x >= "\x80").encode())  # those of several bytes
_ONE = rb"(?:[a-zA-Z0-9@$!|+(]|(?!\xc2\xb7)[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2})"
_BETWEEN = rb"(?:[\s.,*_~'`-]|\xc2\xb7)"
_SINGLES = re.compile(rb"(?<!\S)" + _ONE + rb"(?:" + _BETWEEN + rb"+" + _ONE + rb")+(?![a-zA-Z0-9\x80-\xff])")


def character_costs(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Negative log-probabilities ``[a, b, c]`` of a letter after two others, from all documents."""
    table = docs.select(F.lit(0).cast("long").alias("_id"), F.lit(0).cast("long").alias("_h"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def work(batches):
        total = np.zeros(28**3, np.int64)
        for chunk in c.chunks(batches, c.SMALL):
            k = _KIND[chunk.data]
            k = np.concatenate([[0, 0], k])
            total += np.bincount(k[:-2] * 784 + k[1:-1] * 28 + k[2:], minlength=28**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    counts = np.zeros(28**3)
    for r in table.mapInArrow(work, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most 28 ** 3 rows
        counts[r["k"]] = r["n"]
    counts = counts.reshape(28, 28, 28)
    pairs = counts.sum(axis=0)
    smooth = (pairs + 0.5) / (pairs + 0.5).sum(axis=1, keepdims=True)
    p = (counts + 5 * smooth[None]) / (counts.sum(axis=2, keepdims=True) + 5)
    return -np.log(p)


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """For each run of one character the strings it may stand for, with their channel costs."""
    i = 0
    token = token.lower()
    while i < len(token):
        ch, j = token[i], i
        while j < len(token) and token[j] == ch:
            j += 1
        n, options = j - i, []
        if ch in LETTERS or (ch >= "\x80" and ch.isalpha()):
            options = [(ch * min(n, 2), 0.1 if n <= 2 else 1.0)]
            if n > 1:
                options.append((ch, 2.0 if n == 2 else 0.8))
        else:
            for letter in IMITATES.get(ch, ""):
                options += [(letter * m, 1.0 + 0.5 * (n - m)) for m in {1, min(n, 2)}]
            if ch in SEPARATORS or ch in IMITATES:
                options.append(("", 0.5 if ch in SEPARATORS else 2.5))
            if not options:
                options.append(("", 3.0))
        yield options
        i = j


def _path(node: tuple | None) -> str:
    """The strings along a chain of back-pointers, first to last."""
    out = []
    while node is not None:
        node, text = node
        out.append(text)
    return "".join(reversed(out))


def decode(token: str, costs: np.ndarray | list) -> str:
    """The likeliest word behind a token, by Viterbi over its lattice; states are the last two letters. States keep back-pointers, and
    what all survivors share is settled whenever one is left, so time grows with the token's length and no prefix is copied."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    settled: list[str] = []
    for options in lattice(token):
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, node) in best.items():
            for text, channel in options:
                x, y, total = a, b, cost + channel
                for k in (x - 96 if x < 128 else 27 for x in text.encode()):
                    total += costs[x][y][k]
                    x, y = y, k
                have = step.get((x, y))
                if have is None or total < have[0]:
                    step[x, y] = (total, (node, text))
        best = step
        if len(best) == 1:
            [(state, (_, node))] = best.items()
            settled.append(_path(node))
            best = {state: (0.0, None)}
    ends = [(cost + costs[a][b][0], i, node) for i, ((a, b), (cost, node)) in enumerate(best.items())]
    return "".join(settled) + _path(min(ends, key=lambda e: e[:2])[2])


class Restorer:
    """Finds disguised tokens of a chunk and decodes each distinct one once."""

    def __init__(self, costs: np.ndarray, memory: int = 200_000):
        self.costs, self.memory, self.seen = costs.tolist(), memory, {}

    def one(self, token: bytes) -> bytes:
        word = self.seen.get(token)
        if word is None:
            if len(self.seen) >= self.memory:
                self.seen.clear()
            word = self.seen[token] = decode(token.decode("utf-8", "ignore"), self.costs).encode()
        return word

    def __call__(self, chunk: c.Chunk) -> tuple[list[int], list[bytes]]:
        """Documents and restored words."""
        data = chunk.data
        low = _LOW[data]
        letter = _LETTER[data]
        raw = data.tobytes()
        odd = np.zeros(len(data), bool)
        if len(data) > 3:
            sign, imitates = _DISGUISE[data], _IMITATES[data]
            odd[1:-1] = sign[1:-1] & letter[:-2] & (letter[2:] | sign[2:])
            odd[1:] |= imitates[1:] & letter[:-1]
            odd[:-1] |= sign[:-1] & letter[1:]
            odd[1:] |= (low[1:] == low[:-1]) & letter[1:] & (data[1:] < 128)
            odd[3:] |= (data[3:] == data[1:-2]) & (data[2:-1] == data[:-3]) & (data[2:-1] >= 0xC2) & (data[2:-1] <= 0xDF)
            odd[[m.start() for m in _WIDE.finditer(raw)]] = True
        space = np.isin(data, np.array([32, 9, 10, 11, 12, 13], np.uint8))
        docs, words = [], []
        at = np.flatnonzero(odd)
        if len(at):
            gaps = np.flatnonzero(space)
            right = np.searchsorted(gaps, at)
            right = np.unique(right)
            ends = gaps[np.minimum(right, len(gaps) - 1)]
            starts = np.where(right > 0, gaps[np.maximum(right, 1) - 1] + 1, 0)
            doc = np.searchsorted(chunk.starts, starts, side="right") - 1
            for d, a, b in zip(doc.tolist(), starts.tolist(), ends.tolist(), strict=True):
                token = raw[a:b].strip(b".,;:?\"')([]{}" if b")" in raw[a:b] else b".,;:?\"'[]{}")
                if token:
                    docs.append(d)
                    words.append(self.one(token))
        for d, text in enumerate(chunk.texts()):
            for m in _SINGLES.finditer(text):
                docs.append(d)
                words.append(self.one(m[0]))
        return docs, words


def _lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 capitals in UTF-8."""
    low = _LOW[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    return np.where(after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), low + np.uint8(32), low)


def _word_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word (run of letters) and of its beginnings."""
    low = _lowered(data)
    inside = _KIND[low] > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    rolling = c.byte_hash(low)
    where, marks = [s], [rolling.spans(s, e)]
    for k in (4, 5, 6):
        long = e - s > k
        where.append(s[long])
        marks.append(rolling.spans(s[long], s[long] + k) ^ np.uint64(k * c.M2 & (2**64 - 1)))
    return np.concatenate(where), np.concatenate(marks)


def features(chunk: c.Chunk, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """Document and feature hash of everything in the chunk; may repeat."""
    where, marks = _word_features(chunk.data)
    doc = np.searchsorted(chunk.starts, where, side="right") - 1
    docs, words = restorer(chunk)
    if words:
        text = np.frombuffer(b"\n".join([*words, b""]), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])[:-1]])
        more, marks2 = _word_features(text)
        doc = np.concatenate([doc, np.asarray(docs)[np.searchsorted(starts, more, side="right") - 1]])
        marks = np.concatenate([marks, marks2])
    return doc, marks


class ToxicityModel:
    """Sorted feature hashes with weights."""

    def __init__(self, marks: np.ndarray, weights: np.ndarray, bias: float, costs: np.ndarray):
        self.marks, self.weights, self.bias, self.costs = marks, weights, bias, costs
        self.filter = np.zeros(1 << 22, bool)
        self.filter[marks >> np.uint64(42)] = True

    def present(self, doc: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (document, place in ``self.marks``)."""
        maybe = self.filter[marks >> np.uint64(42)]
        doc, marks = doc[maybe], marks[maybe]
        if not len(marks) or not len(self.marks):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.marks, marks), len(self.marks) - 1)
        hit = self.marks[at] == marks
        both = np.unique(doc[hit] * len(self.marks) + at[hit])
        return both // len(self.marks), both % len(self.marks)

    def scores(self, chunk: c.Chunk, restorer: Restorer) -> np.ndarray:
        doc, at = self.present(*features(chunk, restorer))
        z = self.bias + np.bincount(doc, weights=self.weights[at], minlength=len(chunk.ids))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, sample: int = 8000, width: int | None = None, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on labelled rows where ``train_rows`` holds: about ``sample`` of them, by the ``width`` features (default: eight for 125 rows) most tied to the label among
    those that stand in ``least`` rows. Equal texts are one row, toxic if any of them is."""
    costs = character_costs(docs, text_col)
    empty = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -3.0, costs)
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_key")).agg(F.max(F.col(label_col).cast("int")).alias("_label")).filter(F.col("_key").isNotNull() & F.col("_label").isin(0, 1))
    rows = docs.filter(train_rows & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    known = c.store(known.join(rows.select("_key").distinct(), "_key", "left_semi"))
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return empty
    share = F.when(F.col("_label") == 1, F.lit(min(1.0, sample / 2 / counts[1]))).otherwise(F.lit(min(1.0, sample / 2 / counts[0])))
    place = F.pmod(F.xxhash64("_key", F.lit(13)), F.lit(1 << 20))
    drawn = c.store(known.filter(place < share * (1 << 20)))
    # ``sample`` rows in expectation, whatever the input: small enough to broadcast, and full texts stay where they are
    chosen = c.store(rows.join(F.broadcast(drawn), "_key").select(F.col("_label").cast("long").alias("_id"), F.xxhash64("_text").alias("_h"), "_text").repartition(8, "_h"))
    chosen = chosen.groupBy("_h").agg(F.max("_id").alias("_id"), F.first("_text").alias("_text")).select("_id", "_h", "_text")
    shared = docs.sparkSession.sparkContext.broadcast(costs)

    def count(batches):
        restorer = Restorer(shared.value)
        for batch in batches:
            for chunk in c.chunks(iter([batch]), c.SMALL):
                doc, marks = features(chunk, restorer)
                order = np.lexsort((doc, marks))
                doc, marks = doc[order], marks[order]
                new = np.concatenate([[True], (marks[1:] != marks[:-1]) | (doc[1:] != doc[:-1])]) if len(marks) else np.zeros(0, bool)
                label, marks = chunk.ids[doc[new]], marks[new]
                begin = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]])) if len(marks) else np.zeros(0, np.int64)
                if len(begin):
                    one = np.add.reduceat(label, begin)
                    both = np.diff(np.append(begin, len(marks)))
                    yield pa.RecordBatch.from_arrays([pa.array(marks[begin].view(np.int64)), pa.array(one), pa.array(both - one)], names=["mark", "one", "zero"])

    sizes = {r["_id"]: r["n"] for r in chosen.groupBy("_id").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return empty
    stats = chosen.mapInArrow(count, "mark long, one long, zero long").groupBy("mark").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")).filter(F.col("one") + F.col("zero") >= least)
    ratio = F.log((F.col("one") + 0.3) / (n1 + 0.6)) - F.log((F.col("zero") + 0.3) / (n0 + 0.6))
    top = stats.withColumn("tie", F.abs(ratio) * F.sqrt(F.col("one") / n1 + F.col("zero") / n0)).orderBy(F.desc("tie"), "mark").limit(width or sample * 8 // 125).select("mark").collect()
    marks = np.sort(np.array([r["mark"] for r in top], np.int64).view(np.uint64))
    model = ToxicityModel(marks, np.zeros(len(marks)), 0.0, costs)
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def vectors(batches):
        model = shared_model.value
        restorer = Restorer(model.costs)
        for chunk in c.chunks(batches, c.SMALL):
            doc, at = model.present(*features(chunk, restorer))
            cut = np.searchsorted(doc, np.arange(len(chunk.ids) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(chunk.hashes), pa.array(chunk.ids), pa.array([at[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.list_(pa.int64()))], names=["h", "label", "at"])

    data = sorted((r["h"], r["label"], r["at"]) for r in chosen.mapInArrow(vectors, "h long, label long, at array<long>").collect())
    weights, bias = fit_logistic([r[2] for r in data], np.array([r[1] for r in data], float), len(marks))
    drawn_odds = np.log(max(1, n1) / max(1, n0))
    real_odds = np.log(counts[1] / counts[0])
    return ToxicityModel(marks, weights, bias + 0.3 * (real_odds - drawn_odds), costs)


def fit_logistic(rows: list[list[int]], y: np.ndarray, width: int, penalty: float = 1e-4, rounds: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Adam on the whole sample, with a small ridge penalty."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.array([x for r in rows for x in r], np.int64)
    w, b = np.zeros(width), 0.0
    m, s, mb, sb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(doc, weights=w[at], minlength=len(rows)), -30, 30)))
        err = (p - y) / max(1, len(y))
        g, gb = np.bincount(at, weights=err[doc], minlength=width) + penalty * w, err.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.999**step)) + 1e-8)
    return w, float(b)


def score(docs: DataFrame, model: ToxicityModel, *keep: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the columns ``keep``, ``score``, ``predicted`` for every row."""
    table = c.keyed(docs, id_col, text_col, *keep)
    more = table.columns[3:]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        model = shared.value
        restorer = Restorer(model.costs)
        for batch in batches:
            parts = [model.scores(chunk, restorer) for chunk in c.chunks(iter([batch]), c.SMALL)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in range(3, batch.num_columns)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["_id", *more, "score", "predicted"])

    fields = "".join(f", `{x.name}` {x.dataType.simpleString()}" for x in table.schema.fields[3:])
    return table.mapInArrow(work, f"_id long{fields}, score double, predicted int").select(c.plain_id(), *more, "score", "predicted")
