"""Fingerprints, collocations and vector codes against brute force, and their defined cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import simhash_dedup as sd
from weftline.llm import vector_codes as vc
from weftline.llm.collocations import collocations
from weftline.llm.simhash_dedup import fingerprint_links, simhash_dedup
from weftline.llm.vector_codes import vector_codes

DOCS = "doc_id long, text string, lang string, fp long, _id string, n string, label string, phrase string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs_of(spark, texts, langs=None, ids=None):
    ids = ids or range(len(texts))
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, g, 7, "clash", "clash", "clash", "clash") for i, t, g in zip(ids, texts, langs, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def print_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(ids, links):
    label = dict(zip(ids, ids, strict=True))
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return label


def brute_prints(texts):
    prints = [print_of(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    label = least_reachable(range(len(texts)), links)
    return {i: (f"{p:016x}", label[i]) for i, p in enumerate(prints)}


def near_texts(seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ß", "Zq"]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    out = [" ".join(text(rng.randrange(1, 90))) for _ in range(60)]
    for _ in range(4):
        base = text(400)
        for _ in range(15):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(400)] = rng.choice(vocab)
            out.append("  ".join(own) if rng.random() < 0.5 else "\n".join(own))
    return out + [None, "", " \t\n", "one", "One", "one two", "one TWO", " ".join(text(9000)), *out[:5]]


def test_components_of_fingerprints_equal_brute_force(spark):
    texts = near_texts()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup(docs_of(spark, texts)).collect()}
    assert got == brute_prints(texts)
    assert len({v[1] for v in got.values()}) < len(texts) - 40


def test_fingerprint_hash_is_the_one_of_spark(spark):
    assert xxhash.xxh64_intdigest("añb c d".encode(), 42) == spark.range(1).select(F.xxhash64(F.lit("añb c d"))).first()[0] % (1 << 64)


def test_repeated_rows_null_ids_and_no_rows(spark):
    texts = ["a b c d", "a b c d", None, "x y z q", "x y z q"]
    got = sorted(((r["doc_id"], r["component_id"], r["n_equal"]) for r in simhash_dedup(docs_of(spark, texts, ids=[3, 3, 9, None, 5])).collect()), key=repr)
    assert got == sorted([(3, 3, 2), (3, 3, 2), (9, 9, 1), (None, None, 2), (5, None, 2)], key=repr)
    assert simhash_dedup(docs_of(spark, [])).collect() == []


def noisy(rng, base, n, share):
    bits = rng.random((n, 64)) < share
    return np.uint64(base) ^ np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


@pytest.mark.parametrize("limit", [1 << 18, 150])
def test_links_of_a_crowd_and_of_scattered_prints(spark, limit):
    """A crowd that no vantage point divides, small groups and single prints; with a small limit in slabs."""
    rng = np.random.default_rng(5)
    prints = np.unique(np.concatenate([noisy(rng, 77, 900, 0.04), rng.integers(0, 2**63, 900, dtype=np.uint64), *(noisy(rng, b, 9, 0.03) for b in rng.integers(0, 2**63, 60))]))
    ids = prints.view(np.int64).tolist()
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    want = least_reachable(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    found = fingerprint_links(spark.createDataFrame([(i,) for i in ids], "fp long"), limit=limit, sample=400).collect()
    assert least_reachable(ids, [(r["a"], r["b"]) for r in found]) == want


def test_a_tree_keeps_near_points_together():
    rng = np.random.default_rng(6)
    prints = np.unique(np.concatenate([noisy(rng, b, 6, 0.02) for b in rng.integers(0, 2**63, 400)]))
    points = sd.half(prints, 1)
    tree = sd.Tree.fitted(points[::3], 1, 16)
    assert tree.shards == 16
    where = [set() for _ in prints]
    for shard, at in tree.dealt(points, 1):
        for i in at.tolist():
            where[i].add(shard)
    assert all(where)
    for i, j in zip(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 1), strict=True):
        assert where[i] & where[j]


def brute_phrases(texts, langs, least=30, top=2000):
    f, n = Counter(), Counter()
    for t, g in zip(texts, langs, strict=True):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[g or "und"] += len(w)
            f.update((g or "und", *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    rows = []
    for p, a in cands.items():
        g, w = p[0], p[1:]
        if any(q[0] == g and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(w)] == w for i in range(1, len(q))) for q, b in cands.items()):
            continue
        cuts = [(2000000 * a // (f[(g, *w[:k])] + f[(g, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        rows.append((g, " ".join(w), a, f[(g, *w[:k])], f[(g, *w[k:])], n[g], score))
    out = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(g, i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(out)


def phrase_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def phrase_texts(seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Éa", "ß", "\x1f"]
    fixed = ["Strong tea with Milk", "new york city", "a a a a a", "strong tea"]
    texts = []
    for _ in range(250):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choice(vocab) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(8))]
        texts.append(rng.choice([", ", "\n", " \t ", "!"]).join(parts))
    langs = [rng.choice(["en", "de", None]) for _ in texts]
    return [*texts, None, "", "..", "x " * 5000, *texts[:4]], [*langs, "en", None, "en", "fr", *langs[:4]]


@pytest.mark.parametrize("coded", [1 << 18, 12, 0])
def test_collocations_equal_brute_force(spark, coded):
    """With all frequent words in the list, few, and none."""
    texts, langs = phrase_texts()
    got = phrase_rows(collocations(docs_of(spark, texts, langs), coded=coded))
    assert got == brute_phrases(texts, langs)
    assert len(got) > 20 and ("fr", 1, "x x x x", 4997, 4998, 5000, 5000, 2000000 * 4997 // 9998) in got or any(r[0] == "fr" for r in got)


def test_collocations_cut_to_the_top_and_of_no_rows(spark):
    texts, langs = phrase_texts(3)
    assert phrase_rows(collocations(docs_of(spark, texts, langs), top=3, least=20)) == brute_phrases(texts, langs, 20, 3)
    assert phrase_rows(collocations(docs_of(spark, []))) == []
    assert phrase_rows(collocations(docs_of(spark, [None, "", ". ."]))) == []


VECTORS = "vec_id long, embedding array<double>, label int, _v string, code string, error string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, g, "clash", "clash", "clash") for i, v, g in rows], VECTORS).repartition(3)


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256 for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is not None, r[0], r[1]))
    kept = [r for r in kept if r[1] and len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = [[r[1][j * width : (j + 1) * width] for j in range(parts)] for r in kept]
    books = [[list(c[j]) for c in cut[:entries]] for j in range(parts)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e, strict=True))
    assign = lambda: [[min(range(len(books[j])), key=lambda k: (far(c[j], books[j][k]), k)) for j in range(parts)] for c in cut]
    for _ in range(rounds):
        codes = assign()
        for j in range(parts):
            for k in range(len(books[j])):
                own = [c[j] for c, a in zip(cut, codes, strict=True) if a[j] == k]
                if own:
                    books[j][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assign()
    errors = [sum(far(c[j], books[j][a[j]]) for j in range(parts)) for c, a in zip(cut, codes, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = Counter()
    for r, e in zip(kept, errors, strict=True):
        total[r[2]] += e
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((r[0], "".join(f"{k:02x}" for k in a), fits(e), fits(total[r[2]]), digest) for r, a, e in zip(kept, codes, errors, strict=True)), key=repr)


def code_rows(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def vector_rows(n=150, scale=1.0, seed=8):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.normal(size=64) * scale).tolist(), [0, 1, None][i % 3]) for i in rng.permutation(n)]
    rows += [(1000, None, 1), (2, [1.0] * 63 + [None], 0), (1, [math.nan] * 64, 0), (3, [math.inf] + [0.0] * 63, 1), (4, [-math.inf] * 64, 1), (1002, [0.5] * 10, 1), (1003, [], None)]
    return rows + rows[:5] + [(5, rows[0][1], 1), (None, rows[1][1], 0), (1001, [0.0] * 64, None), (1004, [-0.001] * 64, 0)]


def test_codes_equal_brute_force(spark):
    rows = vector_rows()
    assert code_rows(vector_codes(vectors_of(spark, rows))) == brute_codes(rows)


def test_codes_of_components_beyond_64_bits(spark):
    rows = vector_rows(90, 1e25, seed=9)
    got = code_rows(vector_codes(vectors_of(spark, rows), rounds=1))
    assert got == brute_codes(rows, rounds=1)
    assert any(r[2] is None for r in got)


def test_few_vectors_ties_and_none(spark):
    rows = [(2, [1.0] * 32, 0), (1, [1.0] * 32, 0), (3, [2.0] * 32, 0), (4, [1.5] * 32, 1)]
    assert code_rows(vector_codes(vectors_of(spark, rows), entries=3)) == brute_codes(rows, entries=3)
    assert vector_codes(vectors_of(spark, [(1, None, 0), (2, [None] * 64, 1)])).collect() == []
    with pytest.raises(ValueError):
        vector_codes(vectors_of(spark, [(1, [1.0] * 10, 0)]))


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    x = vc.integers(rng.normal(size=4000)).reshape(-1, 4)
    entries = x[:64]
    pivots = entries[vc.farthest_first(entries, 4)]
    near = vc.root(vc.squares(x[:, None] - pivots[None])).astype(np.float32)
    code, best, tried = vc.nearest(x, near, entries, pivots)
    full = vc.squares(x[:, None] - entries[None])
    assert (code == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert tried < 0.2 * full.size
