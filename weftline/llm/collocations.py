"""Phrase collocations of each language, with exact counts of all phrases from one count of the longest windows.

A word of a piece of text leads one window: the word and the words that follow it, padded at the end of the piece. Only these
longest windows are counted. A shorter phrase is a prefix of the window at its first word, so ``ROLLUP`` over the
columns of the window sums the counts of successively shorter prefixes, and no other n-gram is exploded; the level of the
language alone is its number of words.

Windows travel as codes of words, two longs, summed within a task first. The list of coded words has at most ``coded`` rows (the
most frequent); other words travel as text beside the codes, or, if the list holds all words that are frequent
enough, end the window, as no phrase with such a word can count. Windows meet by their first two words, where words too hot for
that meet by three or four. There each prefix that is too rare to be a phrase is cut off before the sums
(its window still counts for the rest), so that the rollup works on frequent phrases alone. What
follows needs no other counts: every part of a candidate occurs at least as often as it does.

Defined cases: null and empty texts and pieces without words have no phrase; a null language is ``und``; repeated rows
count again; a text is worked on whole, whatever its length; an empty table gives an empty table; other columns are
left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import common as c

LONGEST = 4
OTHER = (1 << 31) - 1  # the code of a word that is not in the list
GATHERED = 1 << 19
_HARD, _SOFT = np.zeros(256, bool), np.zeros(256, bool)
_HARD[[*b".,;:!?", 10, 11, 12, 13]] = True
_SOFT[[9, 32]] = True


def piece_words(chunk: c.Chunk) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a chunk, lower-cased and each with a space behind it, the piece of each, and the number of each document's words."""
    data = np.where((chunk.data >= 65) & (chunk.data <= 90), chunk.data + np.uint8(32), chunk.data)
    hard = _HARD[data]
    word = ~(hard | _SOFT[data])
    keep = word.copy()
    keep[1:] |= word[:-1]
    inside = word[keep]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    norm = np.where(inside, data[keep], np.uint8(32))
    starts = np.flatnonzero(first)
    piece = np.cumsum(hard, dtype=np.int32)[keep][starts]
    before = np.append(0, np.cumsum(keep))[np.append(chunk.starts, len(data))]
    counts = np.diff(np.searchsorted(starts, before))
    offsets = np.append(starts, len(norm)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(norm)]), piece, counts


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(F.lit(0).cast("long").alias("_id"), F.lit(0).cast("long").alias("_h"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), lang.alias("lang"))


def word_list(texts: DataFrame, least: int, coded: int, parts: int) -> tuple[list[str], bool, int]:
    """The most frequent words, whether all that occur ``least`` times are among them, and how many are hot: over a quarter of a partition's share."""

    def count(batches):
        held, size = [], 0

        def flush():
            t = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            yield from pa.table({"word": t["word"], "n": t["n_sum"]}).to_batches(max_chunksize=1 << 16)
            held.clear()
            pa.default_memory_pool().release_unused()

        for chunk in c.chunks(batches, c.SMALL):
            seen = piece_words(chunk)[0].value_counts()
            held.append(pa.RecordBatch.from_arrays([pc.ascii_rtrim(seen.field(0), " "), seen.field(1)], names=["word", "n"]))
            size += len(seen)
            if size > GATHERED // 2:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    words = c.store(texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n")).first()[0] or 0
    found = words.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(coded + 1).collect()
    hot = sum(r["n"] * 4 * parts > total for r in found[:coded])
    return [r["word"] for r in found[:coded]], len(found) <= coded, hot


def windows(texts: DataFrame, listed: list[str], complete: bool) -> DataFrame:
    """``lang, hi, lo, x, n``: windows of four codes, two in a long, 0 for padding; ``x`` has the words that are coded as OTHER."""
    outside = 0 if complete else OTHER

    def count(batches):
        values = pa.array([f"{w} " for w in listed], pa.string())
        held, size = [], 0

        def flush():
            t = pa.concat_tables(held).group_by(["lang", "hi", "lo", "x"], use_threads=False).aggregate([([], "count_all")])
            yield from t.rename_columns(["lang", "hi", "lo", "x", "n"]).combine_chunks().to_batches(max_chunksize=1 << 16)
            held.clear()
            pa.default_memory_pool().release_unused()

        for batch in batches:
            at = 0
            for chunk in c.chunks([batch], c.SMALL):
                langs = batch.column(3).slice(at, len(chunk.ids))
                at += len(chunk.ids)
                words, piece, counts = piece_words(chunk)
                if not len(words):
                    continue
                code = pc.fill_null(pc.index_in(words, value_set=values), outside - 1).to_numpy().astype(np.int64) + 1
                column, place, index = code, np.arange(len(code)), []
                codes = []
                for k in range(LONGEST):
                    codes.append(column)
                    index.append(np.where(column == OTHER, place + k, -1))
                    if k + 1 < LONGEST:
                        there = np.minimum(place + k + 1, len(code) - 1)
                        go = (column > 0) & (place + k + 1 < len(code)) & (piece[there] == piece)
                        column = np.where(go, code[there], 0)
                other = np.stack(index) >= 0
                x = pa.nulls(len(code), pa.string())
                if other.any():
                    some = np.flatnonzero(other.any(axis=0))
                    taken = [words.take(pa.array(np.maximum(i[some], 0), mask=i[some] < 0)) for i in index]
                    text = pc.ascii_rtrim(pc.binary_join_element_wise(*taken, "", null_handling="skip"), " ")
                    back = np.full(len(code), -1)
                    back[some] = np.arange(len(some))
                    x = text.take(pa.array(np.maximum(back, 0), mask=back < 0))
                own = langs.take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                held.append(pa.table({"lang": own, "hi": codes[0] << 32 | codes[1], "lo": codes[2] << 32 | codes[3], "x": x}))
                size += len(code)
                if size >= GATHERED:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return texts.mapInArrow(count, "lang string, hi long, lo long, x string, n long")


def frequent_windows(counted: DataFrame, least: int, hot: int, parts: int) -> DataFrame:
    """The windows, each cut before the first of its prefixes that occurs fewer than ``least`` times, summed. Windows meet by two words; those that
    begin with two hot ones by three, with three by all, and such a prefix isn't cut, as its windows don't meet in one place."""
    code = {k: F.expr(f"CAST({e} AS INT)") for k, e in ((1, "hi >> 32"), (2, "hi & 4294967295"), (3, "lo >> 32"), (4, "lo & 4294967295"))}
    texts = lambda k: F.when(F.col(f"_m{k}") > 0, F.substring_index("x", " ", 1) if k == 1 else F.expr(f"substring_index(x, ' ', _m{k})"))
    others = {f"_m{k}": sum((code[i] == OTHER).cast("int") for i in range(1, k + 1)) for k in (1, 2, 3)}
    warm = lambda k: F.least(*(code[i].between(1, hot) for i in range(1, k + 1)))
    rows = counted.withColumns(others).withColumns({"_x2": texts(2), "_x3": texts(3), "_c": code[3]})
    salt = F.when(warm(3), F.xxhash64("lo", "x")).when(warm(2), F.xxhash64("_c", "_x3")).when(F.col("_m2") > 0, F.xxhash64("_x2")).otherwise(0)
    rows = rows.select("lang", "hi", "lo", "x", "n", salt.alias("_salt")).repartition(parts, "hi", "lang", "_salt")
    rows = rows.withColumns(others | {"_hot2": warm(2), "_hot3": warm(3), "_c": code[3]}).withColumns({"_x1": texts(1), "_x2": texts(2), "_x3": texts(3)})
    two = ["hi", "lang", "_salt", "_x2"]
    three, four = [*two, "_c", "_x3"], [*two, "_c", "_x3", "lo", "x"]
    for name, by in (("_n4", four), ("_n3", three), ("_n2", two)):
        rows = rows.withColumn(name, F.sum("n").over(Window.partitionBy(*by)))
    rare2, rare3, rare4 = ~F.col("_hot2") & (F.col("_n2") < least), ~F.col("_hot3") & (F.col("_n3") < least), F.col("_n4") < least
    high, low = F.expr("hi & -4294967296"), F.expr("lo & -4294967296")
    cut = rows.select(
        "lang",
        F.when(rare2, high).otherwise(F.col("hi")).alias("hi"),
        F.when(rare2 | rare3, 0).when(rare4, low).otherwise(F.col("lo")).alias("lo"),
        F.when(rare2, F.col("_x1")).when(rare3, F.col("_x2")).when(rare4, F.col("_x3")).otherwise(F.col("x")).alias("x"),
        "n",
    )
    return cut.groupBy("lang", "hi", "lo", "x").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, least: int = 30, coded: int = 1 << 18, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, size, phrase, f``: phrases of one to four words that occur ``least`` times, and a row of size 0 with the number of
    words for each language."""
    parts = c.partitions(docs.sparkSession)
    texts = _texts(docs, lang_col, text_col)
    listed, complete, hot = word_list(texts, least, coded, parts)
    counted = frequent_windows(windows(texts, listed, complete), least, hot, parts)
    names = [f"w{k + 1}" for k in range(LONGEST)]

    def decode(batches):
        words = np.array([None, *listed], object)
        for batch in batches:
            hi, lo = (batch.column(i).to_numpy() for i in (1, 2))
            codes = np.stack([hi >> 32, hi & 0xFFFFFFFF, lo >> 32, lo & 0xFFFFFFFF])
            columns = words[np.where(codes == OTHER, 0, codes)]
            for i in np.flatnonzero((codes == OTHER).any(axis=0)).tolist():
                columns[codes[:, i] == OTHER, i] = batch.column(3)[i].as_py().split(" ")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(w, pa.string()) for w in columns), batch.column(4)], names=["lang", *names, "n"])

    rows = counted.mapInArrow(decode, "lang string, w1 string, w2 string, w3 string, w4 string, n long")
    summed = rows.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("_level"))
    size = LONGEST - F.bit_count("_level")
    last = F.when(F.col("size") == 0, "").otherwise(F.element_at(F.array(*names), F.greatest(F.col("size"), F.lit(1))))
    found = summed.withColumn("size", size).filter(F.col("size") >= 0).filter(last.isNotNull() & ((F.col("size") == 0) | (F.col("f") >= least)))
    return found.select("lang", "size", F.concat_ws(" ", *names).alias("phrase"), "f")


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _contained(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, longer``: the shorter phrases inside those of three words and more, and the most that one of these occurs."""
    w = F.split("phrase", " ")
    sizes = F.sequence(F.lit(2), F.col("size") - 1)
    parts = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: _part(w, i, k))))
    inner = phrases.filter("size > 2").select("lang", "f", F.explode(F.array_distinct(parts)).alias("phrase"))
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def _scored(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """The cut of each candidate with the lowest score: ``lang, phrase, a, l, r, score``."""
    w = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), _part(w, F.lit(1), k).alias("head"), _part(w, k + 1, F.col("size") - k).alias("tail")))
    cut = candidates.select("lang", "phrase", F.col("f").alias("a"), F.inline(cuts))
    for side, name in (("head", "l"), ("tail", "r")):
        cut = cut.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000, coded: int = 1 << 18, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases by score, without those that a longer phrase holds
    in ``share`` percent of its occurrences or more."""
    found = c.store(phrase_counts(docs, least, coded, lang_col, text_col))
    phrases = found.filter("size > 0")
    candidates = phrases.filter("size > 1")
    kept = candidates.join(_contained(candidates), ["lang", "phrase"], "left").filter(F.expr(f"longer IS NULL OR CAST(100 AS DECIMAL(3,0)) * longer < CAST({share:d} AS DECIMAL(3,0)) * f"))
    by_rank = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = _scored(kept.select("lang", "size", "phrase", "f"), phrases).withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= top)
    words = found.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
