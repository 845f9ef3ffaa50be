"""Quality rules by distribution divergence.

Every language's reference holds two histograms over all its documents: classes of bytes (letters,
capitals, digits, spaces, line feeds, punctuation, symbols, parts of non-ASCII letters) and its common words
(whole words of any length, A-Z lower-cased, each of at least COMMON_SHARE of the language's words; all the rest as one). A document is
compared with its language's reference, or with the nearest one if its language is null, by Jensen-Shannon distance (base 2, 0 to 1).
It is rejected if either distance passes its limit; each distance is judged only from a minimum length on.
The base rules (few words, or repeated 8-word windows) reject before.

Words are counted by 64-bit hash in Spark over all documents. Every language that occurs has a reference of at most
1 / COMMON_SHARE words, so references grow with the number of languages alone.

Defined cases: null or empty texts have no words and fail the base rule; rows that repeat an id are judged
each on its own; a language whose texts hold no word has a reference without common words; a very long text is a chunk of its own; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common as c

COMMON_SHARE, CLASSES = 0.002, 10
_CLASS = np.full(256, 6, np.int64)  # other ASCII punctuation
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 3, 4
_CLASS[[ord(x) for x in ".,;:!?'\"()-"]] = 5
_CLASS[[ord(x) for x in "#*$%&|<>"]] = 7
_CLASS[128:192], _CLASS[192:] = 8, 9
_SYMBOL = _CLASS == 7


def whole_words(words: c.Words) -> np.ndarray:
    """The hash of each word, lower case in ASCII."""
    low = words.norm
    return c.byte_hash(np.where((low >= 65) & (low <= 90), low + np.uint8(32), low)).spans(words.starts, words.ends).view(np.int64)


def class_counts(chunk: c.Chunk) -> np.ndarray:
    """Bytes of each class, by document."""
    classes = _CLASS[chunk.data].astype(np.uint8)
    return np.array([np.bincount(classes[a : a + n], minlength=CLASSES) for a, n in zip(chunk.starts.tolist(), chunk.lens.tolist(), strict=True)], np.int64).reshape(-1, CLASSES)


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Language, class shares, common words (sorted) and their shares with that of the rest in the last place."""
    table = docs.select(F.lit(0).cast("long").alias("_id"), F.lit(0).cast("long").alias("_h"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(lang_col).cast("string").alias("_lang")).filter("_lang is not null")

    def work(batches):
        for batch in batches:
            langs = batch.column(3).to_pylist()
            at = 0
            for chunk in c.chunks(iter([batch])):
                own = langs[at : at + len(chunk.ids)]
                at += len(own)
                names, which = np.unique(own, return_inverse=True)
                per_class = class_counts(chunk)
                words = c.Words(chunk)
                key, doc = whole_words(words), which[words.doc]
                for i, name in enumerate(names.tolist()):
                    values, counts = np.unique(key[doc == i], return_counts=True)
                    k = np.concatenate([np.arange(CLASSES), values, [0]])
                    kind = np.repeat(np.array([0, 1, 2], np.int32), [CLASSES, len(values), 1])
                    n = np.concatenate([per_class[which == i].sum(axis=0), counts, [int(words.counts[which == i].sum())]])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(kind), pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["lang", "kind", "k", "n"])

    counted = table.mapInArrow(work, "lang string, kind int, k long, n long").groupBy("lang", "kind", "k").agg(F.sum("n").alias("n"))
    counted = c.store(counted)
    words = counted.filter("kind = 2").select("lang", F.col("n").alias("words"))
    common = counted.filter("kind = 1").join(words, "lang").filter(F.col("n") >= F.col("words") * F.lit(COMMON_SHARE)).drop("words")
    rows = counted.filter("kind != 1").unionByName(common).collect()  # for each language its classes and at most 1 / COMMON_SHARE words
    by: dict[str, tuple[dict, dict, dict]] = {}
    for r in rows:
        by.setdefault(r["lang"], ({}, {}, {}))[r["kind"]][r["k"]] = r["n"]
    out = []
    for name, (per_class, own, total) in sorted(by.items()):
        classes = np.array([per_class.get(k, 0) for k in range(CLASSES)], float)
        keys = sorted(own)
        shares = np.array([*(own[k] for k in keys), total[0] - sum(own.values())], float)
        out.append((name, classes / max(1, classes.sum()), np.array(keys, np.int64), shares / max(1, shares.sum())))
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of shares p to q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(axis=-1)
        return np.sqrt(np.clip((kl(p) + kl(np.broadcast_to(q, p.shape))) / 2, 0, 1))


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, reference string, kept boolean"


def judge(chunk: c.Chunk, langs: list, refs: list, class_limit: float, word_limit: float, min_chars: int, min_words: int) -> list:
    """The columns of COLUMNS for a chunk."""
    words = c.Words(chunk)
    n = len(chunk.ids)
    space = np.isin(chunk.data, np.array([32, 9, 10, 11, 12, 13], np.uint8))
    ends = chunk.starts + chunk.lens

    def per_doc(mask):
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[ends] - sums[chunk.starts]

    word_chars = per_doc(~space & ((chunk.data & 0xC0) != 0x80))
    symbols = per_doc(_SYMBOL[chunk.data])
    dup_lines = np.zeros(n, np.int64)
    for i, text in enumerate(chunk.texts()):
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup_lines[i] = len(lines) - len(set(lines))
    repeat = np.zeros(n, np.int64)
    if words.total >= 8:
        grams = c.Rolling(c.word_hashes(words), c.M2).windows(8)
        inside = words.doc[: len(grams)] == words.doc[7:]
        at = np.flatnonzero(inside)
        key = c.mix(grams[at] + c.mix(words.doc[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        more = np.zeros(len(at), bool)
        more[order[1:][same]] = True
        more[order[:-1][same]] = True
        gone = c.covered(words.total, at[more], np.full(int(more.sum()), 8))
        repeat = np.bincount(words.doc[gone], minlength=n)
    failed = (words.counts < 20) | (100 * repeat > 30 * words.counts)
    classes = class_counts(chunk)
    shares = classes / np.maximum(1, classes.sum(axis=1, keepdims=True))
    key, doc = whole_words(words), words.doc
    by_class, by_word = np.full((n, len(refs)), np.nan), np.full((n, len(refs)), np.nan)
    known = {r[0]: i for i, r in enumerate(refs)}
    own = np.array([known.get(x, -1) for x in langs], np.int64)
    for i, (_, ref_classes, common, ref_words) in enumerate(refs):
        rows = np.flatnonzero((own == i) | (own < 0))
        if not len(rows):
            continue
        by_class[rows, i] = js_distance(shares[rows], ref_classes)
        place = np.searchsorted(common, key)
        place[place == len(common)] = 0
        hit = (common[place] == key) if len(common) else np.zeros(len(key), bool)
        counts = np.bincount(doc[hit] * (len(common) + 1) + place[hit], minlength=n * (len(common) + 1)).reshape(n, -1)[rows]
        counts[:, -1] = words.counts[rows] - counts.sum(axis=1)
        by_word[rows, i] = js_distance(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)), ref_words)
    best = np.zeros(n, np.int64)
    if refs:
        both = np.where(np.isnan(by_class), np.inf, by_class + by_word)
        best = np.argmin(both, axis=1)
        far_class, far_word = by_class[np.arange(n), best], by_word[np.arange(n), best]
        bad = ((chunk.lens >= min_chars) & (far_class > class_limit)) | ((words.counts >= min_words) & (far_word > word_limit))
    else:
        far_class = far_word = np.full(n, np.nan)
        bad = np.zeros(n, bool)
    names = [refs[i][0] if refs else None for i in best.tolist()]
    return [pa.array(words.counts), pa.array(word_chars), pa.array(symbols), pa.array(dup_lines), pa.array(repeat.astype(np.int64)), pa.array(failed), pa.array(far_class), pa.array(far_word), pa.array(names, pa.string()), pa.array(~failed & ~bad)]


def quality_rules(docs: DataFrame, class_limit: float = 0.25, word_limit: float = 0.5, min_chars: int = 300, min_words: int = 60, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id``, the base counts, both distances, the reference used, and ``kept``."""
    refs = references(docs, text_col, lang_col)

    def work(batches):
        for batch in batches:
            langs, at = batch.column(3).to_pylist(), 0
            for chunk in c.chunks(iter([batch])):
                own = langs[at : at + len(chunk.ids)]
                at += len(own)
                yield pa.RecordBatch.from_arrays([pa.array(chunk.ids), *judge(chunk, own, refs, class_limit, word_limit, min_chars, min_words)], names=["_id", *(x.split()[0] for x in COLUMNS.split(", "))])

    out = c.keyed(docs, id_col, text_col, F.col(lang_col).cast("string").alias("_lang")).mapInArrow(work, f"_id long, {COLUMNS}")
    return out.select(c.plain_id(), *(x.split()[0] for x in COLUMNS.split(", ")))
