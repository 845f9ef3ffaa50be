"""Very long texts and rows that repeat."""

import random

from pyspark.sql import functions as F
from test_operators import WORD, frame

from weftline.llm import common as c
from weftline.llm import language_id, toxicity
from weftline.llm.decontamination import decontaminate
from weftline.llm.jaccard_join import jaccard_join
from weftline.llm.line_dedup import line_dedup
from weftline.llm.mixing import mix_sources
from weftline.llm.quality_rules import quality_rules
from weftline.llm.substring_dedup import substring_dedup
from weftline.llm.suffix_dedup import suffix_dedup


def test_texts_beyond_a_chunk(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(4)) for _ in range(260_000)]
    long = " ".join(words[:200_000]) + "\nA line of some forty characters and more, it is long\n" + " ".join(words[200_000:])
    assert len(long) > c.CHUNK
    part = words[150_000:150_070]
    texts = [long, "before " + " ".join(part) + " after", "short one", long + " end"] + ["A line of some forty characters and more, it is long"] * 4
    docs = frame(spark, texts)
    n = len(WORD.findall(long))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(docs).collect()}
    assert got[0] == (n, 0) and got[1] == (72, 70) and got[3] == (n + 1, n)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup(docs).collect()}
    assert got[0] == (len(long), len(long), 1) and got[3] == (len(long) + 4, len(long), 1)
    assert got[1][1] >= len(" ".join(part)) and got[2] == (9, 0, 0)
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup(docs).collect()}
    assert [got[i] for i in (0, 3, 4, 7)] == [(3, 1), (3, 1), (1, 1), (1, 0)]
    got = {r.doc_id: r.component_id for r in jaccard_join(docs).collect()}
    assert (got[0], got[1], got[3], got[7]) == (0, 1, 0, 4)
    got = {r.doc_id: (r.n_words, r.base_failed) for r in quality_rules(docs).collect()}
    assert got[0] == (n, False)
    bench = spark.createDataFrame([(1, " ".join(part[:30]))], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in decontaminate(docs, bench).collect()}
    assert got[0] == (n, 30, False) and got[1] == (72, 30, True)
    labels = spark.createDataFrame([(0, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels, F.lit(True))).filter("score between 0 and 1").count() == 8
    assert language_id.identify(docs, language_id.train(docs, F.lit(True))).filter("lang_pred = 'en'").count() == 8
    assert {r.doc_id: r["size"] for r in mix_sources(docs).collect()}[0] == n


def test_rows_that_repeat(spark):
    text = "the same words in a row " * 4 + "and some more of them to pass the base rules\nA line of some forty characters and more, it is long"
    docs = frame(spark, [text, text, text, "other"], [1, 1, 2, None])
    bench = spark.createDataFrame([(1, "and some more of them to pass the base rules")] * 2, "item_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    found = {
        "lines": line_dedup(docs, min_docs=2),
        "items": decontaminate(docs, bench, n=5),
        "toxicity": toxicity.score(docs, toxicity.train(docs, labels, F.lit(True))),
        "language": language_id.identify(docs, language_id.train(docs, F.lit(True))),
        "quality": quality_rules(docs),
    }
    for name, t in found.items():
        rows = [tuple(map(str, r)) for r in t.filter("doc_id = 1").collect()]
        assert len(rows) == 2 and rows[0] == rows[1], name
        assert t.count() == 4, name
