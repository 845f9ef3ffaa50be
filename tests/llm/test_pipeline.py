"""The stages of the corpus pipeline, each held against a plain version on what the stage before kept."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import WORD, jaccard_brute  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "This very line stands in many of the documents, word for word"


def texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(900)]
    own = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = " ".join(f"b{i}" for i in range(30))
    out = [own(60) + (" idiot moron" if i % 5 == 0 else "") for i in range(60)]
    out += [f"{own(40)}\n{LINE}\n{own(20)}" for _ in range(8)]
    base = own(100).split()
    out += [" ".join([*base[:-1], f"x{i}"]) for i in range(6)] + [out[1], out[1]]
    out += [f"{own(10)} {item} {own(10)}", own(30), "", None, "one two"]
    return out, item


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    rows, item = texts()
    docs = [(i, t, "en", ["s0", "s1", None][i % 3], len(t or "")) for i, t in enumerate(rows)]
    docs += [docs[1], docs[64], (None, rows[7], None, "s0", 1)]  # rows that repeat, and one without id
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, item), (8, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_one_after_the_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mix"]
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    gone = ids(docs) - ids(clean)
    assert set(gone) == {i for i in range(60) if i % 5 == 0}
    lines = stages["line_dedup"](spark, clean, folder)
    assert lines.columns == docs.columns and ids(lines) == ids(clean)
    kept = {r.doc_id: r.text for r in lines.collect() if r.doc_id is not None}
    assert sorted(i for i, t in kept.items() if t and LINE in t) == [67]
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    near = stages["near_duplicates"](spark, lines, folder)
    assert near.columns == docs.columns
    known = sorted(kept)
    brute = jaccard_brute([kept[i] for i in known])
    want = {known[i] for i, (_, c) in brute.items() if c == i} - {7}  # document 7 equals the one without id, which comes first
    assert set(ids(near)) - {None} == want
    assert ids(near)[None] == 1 and ids(near)[64] == 2  # rows that repeat id and text are one document, in as many rows
    whole = stages["decontamination"](spark, near, folder)
    assert whole.columns == docs.columns
    assert set(ids(near) - ids(whole)) == {i for i in want if "b5 b6 b7" in (kept[i] or "")} != set()
    mixed = stages["mix"](spark, whole, folder).collect()
    assert Counter(r.doc_id for r in mixed) == ids(whole)
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in whole.collect()}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] for r in mixed)
    for source in {r.source for r in mixed}:
        own = [r for r in mixed if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, run.collect())) == sorted(map(str, mixed))


def test_stages_of_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).isEmpty()


def test_extra_columns_are_left_out(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"_id": F.lit("clash"), "_h": F.lit("clash"), "mark": F.lit("clash"), "size": F.lit("clash")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert re.search("size", " ".join(corpus_pipeline.STAGES[-1][1](spark, docs, folder).columns))
