"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

A test item gives windows of ``n`` consecutive words (an item of fewer words is one window). Documents are cut into words once, and these
are stored. One pass over them counts the test terms; each window then picks its rarest terms, one more than the edits that it allows. A
second pass writes the postings (term, document, position) of the chosen terms as a table, each with the words
around it. Lists are intersected by (window, document, position less offset); all words of the phrase are compared last.

Exact hits hold the window as it is: each chosen term stands at its offset. Near hits hold it with one to ``edits``
words put in, left out or changed (two neighbours swapped are two edits): SLOP edits for a window, but at most one for
each six of its words, so windows of under six words have none. One of the chosen terms is then left, at its offset give or take the edits.
Windows with more terms that no document holds than they allow edits are dropped, since they cannot occur.

Terms and windows are broadcast up to BROADCAST_ROWS rows (counted) and joined by a shuffle beyond, in which a word has at most its
neighbours with it. Windows are distinct phrases; the items that hold one are joined to its hits. Hits are exchanged, and full texts never are.

Defined cases: null or empty texts and items have no words; an item of null id still marks words
but is not listed; rows that repeat id and text are one document that comes out once for each row;
empty tables on either side give no hits; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import common as c

BROADCAST_ROWS = 200_000
SLOP = 2
_BREAKS = "".join(chr(x) for x in range(128) if chr(x) not in string.ascii_letters + string.digits)


def words_of(text: Column) -> Column:
    """ASCII letters lower-cased, cut at all other ASCII but digits."""
    plain = F.translate(text, string.ascii_uppercase + _BREAKS, string.ascii_lowercase + " " * len(_BREAKS))
    return F.filter(F.split(F.trim(plain), " +"), lambda w: w != "")


def item_windows(items: DataFrame, n: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, window`` (array of words), one row for each window of each item."""
    t = items.select(F.col(item_col).alias("item_id"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).filter(F.size("w") > 0)
    t = t.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1))))
    return t.select("item_id", F.slice("w", F.col("i"), n).alias("window")).distinct()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def edits(n: Column) -> Column:
    """How many edits a window of ``n`` words allows."""
    return F.least(F.lit(SLOP), F.floor(n / 6)).cast("int")


def postings(texts: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """The table ``term, _id, _h, pos, left, around``: where documents hold a term, and the words from place ``left`` on, ``reach`` on both sides. Terms
    that are broadcast are met in the document's own row; else a word takes these neighbours along, and not its whole document."""
    left = F.greatest(F.col("pos") - reach, F.lit(0))
    around = F.slice("_words", F.col("left") + 1, F.col("pos") + reach + 1 - F.col("left")).alias("around")
    t = texts.select("_id", "_h", "_words", F.posexplode("_words").alias("pos", "term")).withColumn("left", left)
    columns = ("term", "_id", "_h", "pos", "left")
    few = terms.count() <= BROADCAST_ROWS
    return c.store(t.join(F.broadcast(terms), "term").select(*columns, around) if few else t.select(*columns, around).join(terms, "term"))


def nearest(window: Column, span: Column, first: Column, start: Column, n: Column) -> Column:
    """Struct ``d, off, s, n``: the stretch of ``span`` (whose first word is at ``first``) of least word edit distance to the
    window, among those that begin and end within SLOP of its place."""
    code = lambda words: F.array_join(F.transform(words, lambda w: F.format_string("%c", (F.array_position(window, w) + 256).cast("int"))), "")
    here, there = code(span), code(window)
    found = []
    for shift in range(-SLOP, SLOP + 1):
        at = start + shift
        for longer in range(-SLOP, SLOP + 1):
            part = F.substring(here, (at - first + 1).cast("int"), (n + longer).cast("int"))
            found.append(F.when((at >= first) & (n + longer > 0), F.struct(F.levenshtein(part, there).alias("d"), F.lit(abs(longer)).alias("off"), at.cast("int").alias("s"), F.length(part).alias("n"))))
    return F.array_min(F.array(*found))


def word_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The table ``_id, _h, n_words, _words``: each document's words, cut once."""
    t = c.keyed(docs, id_col, text_col).select("_id", "_h", words_of(F.col("_text")).alias("_words"))
    return c.store(t.select("_id", "_h", F.size("_words").cast("long").alias("n_words"), "_words"))


def find_items(texts: DataFrame, items: DataFrame, n: int = 13, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``_id, _h, hits`` (distinct structs of first word ``s`` and length ``n``), ``items``, and ``near`` (with the edits ``d``) and
    ``near_items`` for documents with any hit."""
    owned = c.store(item_windows(items, n, item_col, item_text_col).withColumn("_w", F.xxhash64("window")))
    windows = owned.select("_w", "window").distinct()
    terms = _small(c.store(windows.select(F.explode("window").alias("term")).distinct()))
    counts = c.store(texts.select(F.explode("_words").alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("df")))
    ranked = windows.select("window", "_w", F.posexplode("window").alias("at", "term")).join(counts, "term", "left")
    ranked = ranked.groupBy("_w", "window").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "at", "term"))).alias("r"), F.count("df").alias("there"))
    ranked = ranked.withColumns({"n": F.size("window"), "e": edits(F.size("window"))}).filter(F.col("n") - F.col("there") <= F.col("e"))
    chosen = ranked.select("_w", "window", "n", "e", F.explode(F.slice("r", F.lit(1), F.col("e") + 1)).alias("r")).filter("r.df > 0")
    chosen = c.store(chosen.select("_w", "window", "n", "e", F.col("r.term").alias("term"), F.col("r.at").alias("at")))
    lists = postings(texts, c.store(chosen.select("term").distinct()), n + SLOP)
    start = F.col("pos") - F.col("at")
    first = F.greatest(start - F.col("e"), F.lit(0))
    t = lists.join(_small(chosen), "term").withColumns({"start": start, "first": first}).filter(F.col("start") >= -F.col("e"))
    t = t.withColumn("span", F.slice("around", F.greatest(F.col("first") - F.col("left") + 1, F.lit(1)), F.greatest(F.col("start") + F.col("n") + F.col("e") - F.col("first"), F.lit(0))))
    t = t.filter(F.size(F.array_intersect("span", "window")) >= F.size(F.array_distinct("window")) - F.col("e"))
    t = t.groupBy("_w", "_id", "_h", "start").agg(F.countDistinct("at").alias("lists"), *(F.any_value(x).alias(x) for x in ("window", "n", "e", "first", "span")))
    exact = (F.col("lists") == F.col("e") + 1) & (F.col("start") >= 0) & (F.slice("span", F.greatest(F.col("start") - F.col("first") + 1, F.lit(1)), F.col("n")) == F.col("window"))
    t = t.withColumn("exact", exact).filter(F.col("exact") | (F.col("e") > 0))
    best = F.when(~F.col("exact") & (F.col("e") > 0), nearest(F.col("window"), F.col("span"), F.col("first"), F.col("start"), F.col("n")))
    t = t.withColumn("best", best).withColumn("close", F.coalesce(F.col("best.d").between(1, F.col("e")), F.lit(False)))
    t = t.join(_small(owned.select("_w", "item_id")), "_w")
    hit, near = F.struct(F.col("start").alias("s"), "n"), F.struct(F.col("best.s").alias("s"), F.col("best.n").alias("n"), F.col("best.d").alias("d"))
    picked = {"hits": F.when(F.col("exact"), hit), "items": F.when(F.col("exact"), F.col("item_id")), "near": F.when(F.col("close"), near), "near_items": F.when(F.col("close"), F.col("item_id"))}
    return t.groupBy("_id", "_h").agg(*(F.collect_set(x).alias(name) for name, x in picked.items()))


def covered_words(hits: Column) -> Column:
    """How many words the hits cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc, x):
        end = x["s"] + x["n"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["s"]))).alias("n"))

    return F.aggregate(F.array_sort(hits), start, add, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 13, per_hit: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, items, hits, near, near_items, contaminated``: a document is contaminated if ``per_hit`` times its
    exactly hit words reach its words; near hits are listed in columns of their own."""
    texts = word_table(docs, id_col, text_col)
    found = find_items(texts, items, n, item_col, item_text_col)
    t = texts.select("_id", "_h", "n_words").join(found, ["_id", "_h"], "left")
    n_hit = F.coalesce(covered_words(F.col("hits")), F.lit(0)).cast("long")
    listed = lambda x: F.coalesce(F.array_sort(F.transform(x, lambda i: i.cast("string"))), F.array().cast("array<string>")).alias(x)
    t = t.select(c.plain_id(), "_h", "n_words", n_hit.alias("n_hit"), listed("items"), "hits", "near", listed("near_items"))
    return t.withColumn("contaminated", (F.col("n_hit") > 0) & (per_hit * F.col("n_hit") >= F.col("n_words")))
