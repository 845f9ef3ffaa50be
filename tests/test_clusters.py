"""Clusters of similar sequences and products of vectors, against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from weftline.operators import clusters, corpora, products, similar

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, p in enumerate(x):
        new = [i + 1]
        for j, q in enumerate(y):
            new.append(min(row[j] + (p != q), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def mutant(rng, x, identity):
    y = list(x)
    for i in rng.sample(range(len(x)), round(len(x) * (1 - identity))):
        y[i] = rng.choice([c for c in LETTERS if c != y[i]])
    return "".join(y)


def greedy(rows, pairs):
    """Longest first: a sequence without a cluster takes all that it has a pair with."""
    of = {}
    for key, _ in sorted(rows, key=lambda r: (-len(r[1]), r[0])):
        if key not in of:
            of[key] = key
            for a, b in pairs:
                if a == key:
                    of.setdefault(b, key)
    return of


def test_planted_mutants_are_found(spark):
    """Of mutants of 60 % identity nearly all join their origin (recall is printed), of 40 % none."""
    rng = random.Random(4)
    rows, near, far = [], [], []
    for f in range(25):
        base = "".join(rng.choice(LETTERS) for _ in range(300 + f))
        rows.append((len(rows), base))
        origin = rows[-1][0]
        for kind, identity in [(near, 0.6)] * 4 + [(far, 0.4)]:
            kind.append((origin, len(rows)))
            rows.append((len(rows), mutant(rng, base, identity)))
    found, _ = clusters.linear_clusters(spark.createDataFrame(rows, "id long, q string"), "id", "q", 5, 60, 50, 90)
    of = {r.id: r.cluster for r in found.collect()}
    recall = sum(of[a] == of[b] for a, b in near) / len(near)
    print("recall", recall)
    assert recall >= 0.95
    assert not any(of[a] == of[b] for a, b in far)


def test_a_word_of_all_rows_gives_a_pair_for_each_row(spark):
    rng = random.Random(5)
    shared = "".join(rng.choice(LETTERS) for _ in range(90))
    rows = [(i, shared + "".join(rng.choice(LETTERS) for _ in range(rng.randrange(4, 9)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "ACD"), (503, "ACD"), (504, rows[7][1]), (505, rows[7][1])]
    found, pairs = clusters.linear_clusters(spark.createDataFrame(rows, "id long, q string").repartition(3), "id", "q", 8, 20, 70, 90)
    of, links = {r.id: r.cluster for r in found.collect()}, [(r.a, r.b) for r in pairs.collect()]
    text = dict(rows)
    assert len(links) <= 20 * len(rows) and len(links) >= 119
    assert all(100 * distance(text[a], text[b]) <= 30 * len(text[a]) and len(text[b]) * 100 >= 90 * len(text[a]) for a, b in links)
    assert (of[500], of[501], of[502], of[503], of[504]) == (500, 501, 502, 502, of[7])
    chosen = {k: v for k, v in rows if k < 500}
    assert {k: of[k] for k in chosen} == greedy(chosen.items(), [(a, b) for a, b in links if b < 500])


def test_greedy_clusters_over_chains(spark):
    rng = random.Random(6)
    size = {i: rng.randrange(50) for i in range(80)}
    order = lambda i: (-size[i], i)
    pairs = [(a, b) for a in size for b in size if order(a) < order(b) and rng.random() < 0.04]
    got = {r.member: r.cluster for r in clusters.greedy_clusters(spark.createDataFrame([(a, b, size[a]) for a, b in pairs], "centre long, member long, n int")).collect()}
    of = {}
    for i in sorted(size, key=order):
        if i not in of:
            of[i] = i
            for a, b in pairs:
                if a == i:
                    of.setdefault(b, i)
    assert {i: got.get(i, i) for i in size} == of


def test_no_sequences(spark):
    t = spark.createDataFrame([], "id long, q string")
    found, pairs = clusters.linear_clusters(t, "id", "q")
    assert found.isEmpty() and pairs.isEmpty()


def test_held_out_takes_pairs(spark):
    t = spark.createDataFrame([(i, i % 5) for i in range(40)], "id long, cluster long")
    links = spark.createDataFrame([(0, 7), (8, 3), (1, 2)], "a long, b long")
    split = {r.id: r.split for r in corpora.held_out(t, "id", "cluster", 0.4, 3, links).collect()}
    for a, b in [(0, 7), (8, 3), (1, 2)]:
        assert {split[a], split[b]} != {"held", "train"}


@pytest.mark.parametrize("block", [7, 1000])
@pytest.mark.parametrize("centred", [False, True])
def test_extreme_products_equal_brute_force(spark, block, centred):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-4, 5, (17, 6)), rng.integers(-4, 5, (60, 6))
    score = a @ b.T
    s = score - score.mean(axis=0) if centred else score
    want = []
    for i in range(17):
        for side, sign in (("top", -1), ("bottom", 1)):
            ranked = sorted(range(60), key=lambda j: (sign * round(s[i, j] * 17), j))[:4]
            want += [(i, side, r + 1, 100 + j) for r, j in enumerate(ranked)]
    frame = lambda m, key, at: spark.createDataFrame([(at + i, v.tolist()) for i, v in enumerate(m)], f"{key} long, v array<long>")
    got = products.extreme_products(frame(a, "r", 0), frame(b, "c", 100), "r", "c", "v", 4, centred=centred, block=block)
    assert sorted((x["r"], x["side"], x["rank"], x["c"]) for x in got.collect()) == sorted(want)
    assert all(abs(x["score"] - s[x["r"], x["c"] - 100]) < 1e-9 for x in got.collect())


def test_scores_alike_after_rounding_are_tied(spark):
    a = spark.createDataFrame([(0, [1]), (1, [0])], "r long, v array<long>")
    b = spark.createDataFrame([(i, [v]) for i, v in enumerate([2001, 1999, 2002, -2000, 3000, 1000])], "c long, v array<long>")
    got = products.extreme_products(a, b, "r", "c", "v", 3, centred=True, unit=1000)
    # halves of the vectors, in whole thousands away from zero: 1, 1, 1, -1, 2, 1
    assert [(x["c"], x["score"]) for x in got.filter("r = 0 and side = 'top'").orderBy("rank").collect()] == [(4, 2000), (0, 1000), (1, 1000)]
    assert [x["c"] for x in got.filter("r = 0 and side = 'bottom'").orderBy("rank").collect()] == [3, 0, 1]


def shuffled(spark, work):
    """How many rows ``work`` writes to shuffles."""
    store, empty = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, empty, spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    work()
    return total() - before


@pytest.mark.parametrize("block", [4096, 60])
def test_unlike_sequences_of_common_grams_are_not_shuffled_in_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "SETS", block)
    draw = random.Random(5)
    words = ["".join(draw.choice("ACGT") for _ in range(14)) for _ in range(40)]
    rows = [(i, "".join(draw.sample(words, 20))) for i in range(300)]
    rows += [(300 + i, rows[i][1][: -draw.randrange(1, 60)]) for i in range(0, 300, 3)] + [(900, "ACGT"), (901, None), (902, rows[7][1])]
    df = spark.createDataFrame(rows, "i long, q string").repartition(4).cache()
    df.count()
    got = {}
    assert shuffled(spark, lambda: got.update((r.i, r.cluster) for r in corpora.similar_sequences(df, "i", "q", 12, 60).collect())) < 30 * len(rows)
    sets = {i: {q[a : a + 12] for a in range(len(q) - 11)} for i, q in rows if q and len(q) > 11}
    want = {i: i for i, _ in rows}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b]) and want[a] != want[b]:
            low, high = sorted((want[a], want[b]))
            want = {i: low if c == high else c for i, c in want.items()}
    assert got == want and len(set(want.values())) < len(rows) - 90


def test_sequences_travel_a_bounded_number_of_times(spark, monkeypatch):
    """60 blocks of like sizes: a text used to travel once for each of them."""
    monkeypatch.setattr(similar, "SETS", 10)
    draw = random.Random(6)
    rows = [(i, "".join(draw.choice("ACGT") for _ in range(200))) for i in range(400)]
    rows += [(1000 + i, rows[i][1][draw.randrange(20) :]) for i in range(0, 400, 2)]
    df = spark.createDataFrame(rows, "i long, q string").repartition(4).cache()
    df.count()
    got = {}
    assert shuffled(spark, lambda: got.update((r.i, r.cluster) for r in corpora.similar_sequences(df, "i", "q", 12, 60).collect())) < 30 * len(rows)
    assert got == {i: i - 1000 * (i >= 1000) for i, _ in rows}


@pytest.mark.parametrize("block, held", [(4096, 1 << 20), (7, 1 << 20), (7, 10)])
def test_share_links_in_blocks_equal_brute_force(monkeypatch, block, held):
    """Of a share with itself and of two, in one block and in many, in memory and in a file: the links join what brute force joins, and no others are there."""
    monkeypatch.setattr(similar, "SETS", block)
    monkeypatch.setattr(similar, "HELD", held)
    draw = random.Random(3)
    base = ["".join(draw.choice("ACGTé") for _ in range(draw.randrange(30, 400))) for _ in range(30)]
    texts = [base[i % 30][draw.randrange(len(base[i % 30]) // 3) :] if i % 2 else base[i % 30][: -draw.randrange(1, len(base[i % 30]) // 3)] for i in range(150)]
    sets = [set(x.tolist()) for x in similar.gram_sets(texts, 12)]
    rows = sorted((len(s), i, zlib.compress(q.encode())) for i, (q, s) in enumerate(zip(texts, sets, strict=True)))
    linked = {(a, b) for a, b in itertools.combinations(range(150), 2) if 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])}

    def joined(links):
        label = list(range(150))
        for a, b in links:
            x, y = sorted((label[a], label[b]))
            label = [x if v == y else v for v in label]
        return label

    sided = sorted((int(r[1] % 3 > 0), *r) for r in rows)
    for given, alone in (([(0, *r) for r in rows], True), (sided, False), ([r for r in sided if not r[0]], False)):
        here = {r[2]: r[0] for r in given}
        want = {(a, b) for a, b in linked if a in here and b in here and (alone or here[a] != here[b])}
        got = [tuple(sorted(x)) for x in similar.share_links(iter(given), 12, 60, alone)]
        assert set(got) <= want and joined(got) == joined(want)


def test_edit_distance_within_equals_the_table():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.choice([5, 14, 150])
        x = "".join(rng.choice("ACGé") for _ in range(rng.randrange(n)))
        y = "".join(v for v in x if rng.random() < 0.8) if rng.random() < 0.5 else "".join(rng.choice("ACGé") for _ in range(rng.randrange(n)))
        d = distance(x, y)
        assert all(clusters.within(x, y, b) == (d <= b) for b in {0, 1, 4, max(d - 1, 0), d, d + 1, d + 30})


def test_least_grams_are_those_of_md5():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACGTé") for _ in range(n)) for n in (12, 13, 60, 9000)]
    owner, hashes = clusters.least_grams(texts, 12, 20)
    for j, q in enumerate(texts):
        data = q.encode()
        want = sorted({int(hashlib.md5(data[i : i + 12]).hexdigest()[:16], 16) for i in range(len(q) - 11)})[:20]
        assert hashes[owner == j].tolist() == want


def test_pairs_need_no_rounds(spark, monkeypatch):
    """Pairs alone equal those of the clusters, and aren't kept waiting by their rounds."""
    rng = random.Random(10)
    base = ["".join(rng.choice("ACGT") for _ in range(200)) for _ in range(6)]
    rows = [(i, mutant(rng, base[i % 6], 0.9)) for i in range(30)] + [(40, base[0]), (41, base[0]), (42, None), (43, "AC")]
    t = spark.createDataFrame(rows, "id long, q string")
    want = {tuple(r) for r in clusters.linear_clusters(t, "id", "q", 8, 20, 70, 90)[1].collect()}
    monkeypatch.setattr(clusters, "greedy_clusters", None)
    got = [tuple(r) for r in clusters.linear_pairs(t, "id", "q", 8, 20, 70, 90).collect()]
    assert set(got) == want and len(got) == len(want) > 20
