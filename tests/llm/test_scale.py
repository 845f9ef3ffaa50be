"""What changes with size: joins beyond the broadcast bound, shares of large languages, copies with unlike labels, decoders against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import frame

from weftline.llm import decontamination as dc
from weftline.llm import language_id, toxicity


def passages(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(300)]
    items = [[rng.choice(vocab) for _ in range(20)] for _ in range(6)] + [["short", "one"]]
    items.append(items[0][:])  # two items that share all their windows
    texts = []
    for i in range(40):
        body = [rng.choice(vocab) for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            body[10:10] = items[(i // 3) % 7][: 20 if i == 0 else rng.choice([5, 15, 20])]
        texts.append(" ".join(body))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(None, " ".join(items[1]))], "item_id long, text string")
    return frame(spark, [*texts, None, ""]), bench


@pytest.mark.parametrize("rows", [0, 200_000])
def test_decontamination_on_both_sides_of_the_broadcast_bound(spark, monkeypatch, rows):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", rows)
    docs, bench = passages(spark)
    got = {r.doc_id: (r.n_hit, tuple(r["items"])) for r in dc.decontaminate(docs, bench).collect()}
    want = {}
    items = [(r.item_id, (r.text or "").split()) for r in bench.collect()]
    for r in docs.collect():
        w = (r.text or "").split()
        hit, found = set(), set()
        for item, t in items:
            for i in range(max(1, len(t) - 12)):
                window = t[i : i + 13]
                for at in range(len(w) - len(window) + 1):
                    if w[at : at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        found.add(item)
        want[r.doc_id] = (len(hit), tuple(sorted(str(x) for x in found if x is not None)))
    assert got == want and any(len(v[1]) > 1 for v in want.values())


def test_no_word_list_goes_through_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    held = []
    store = dc.c.store
    monkeypatch.setattr(dc.c, "store", lambda df, *by: held.append(df._jdf.queryExecution().optimizedPlan().toString()) or store(df, *by))
    docs, bench = passages(spark)
    dc.decontaminate(docs, bench).collect()
    joined = [plan for plan in held if "around" in plan and "Join" in plan]
    assert joined
    for plan in joined:
        below = plan[plan.index("Join") :].split("\n")[1]
        assert "_words" not in below.split("AS around")[-1] and "around" in below


@pytest.mark.parametrize("rows", [0, 200_000])
def test_near_passages_at_the_start_of_a_text(spark, monkeypatch, rows):
    """The first word or two of a window are missing where the text begins, so the window would start before it."""
    monkeypatch.setattr(dc, "BROADCAST_ROWS", rows)
    words = [f"u{i}" for i in range(13)]
    docs = frame(spark, [" ".join(words[k:] + ["more", "text"]) for k in range(4)] * 3)
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words))], "item_id long, text string")
    got = sorted((r.doc_id, r.n_hit, len(r.near or []), r.near_items) for r in dc.decontaminate(docs, bench).collect())
    assert got == [(i, 13 if i % 4 == 0 else 0, int(i % 4 in (1, 2)), ["1", "2"] if i % 4 in (1, 2) else []) for i in range(12)]


def test_a_language_of_a_billion_documents_keeps_its_sample(spark):
    """400 of 4.2e8 documents are a share for which 20 bits of a hash were too few."""
    share = 400 / 4.2e8
    ids = spark.range(8_000_000)
    assert 1 <= ids.filter(language_id.placed(F.col("id")) < F.lit(share * 2.0**62)).count() <= 25
    assert 650 <= ids.filter(language_id.placed(F.col("id")) < F.lit(1e-4 * 2.0**62)).count() <= 950


def test_copies_with_unlike_labels_are_toxic(spark):
    texts = ["you awful vile wretch of a thing"] * 6 + ["a calm and pleasant day in the garden"] * 6
    labels = spark.createDataFrame([(i, int(i == 3)) for i in range(12)], "doc_id long, toxic int")
    models = []
    for parts in (2, 5):
        docs = frame(spark, texts).repartition(parts)
        models.append(toxicity.train(docs, labels, F.lit(True), least=1))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, models[0]).collect()}
    assert got == {i: int(i < 6) for i in range(12)}
    assert (models[0].marks == models[1].marks).all() and np.allclose(models[0].weights, models[1].weights)


def test_pair_tables_equal_a_plain_convolution():
    rng = np.random.default_rng(1)
    net = language_id.ByteNetwork(["a", "b", "c"])
    x = rng.integers(0, 256, (70, language_id.WINDOW)).astype(np.uint8)
    got = net.log_probs(x, net.pair_tables())
    assert np.allclose(np.exp(got).sum(axis=1), 1, atol=1e-5)
    assert np.allclose(got, net.layer(net.pooled(x)[0]), atol=1e-4)
