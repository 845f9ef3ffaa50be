import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import jaccard_join as jj
from weftline.llm import common as c
from weftline.llm import language_id, mixing, toxicity, warc
from weftline.llm.decontamination import decontaminate
from weftline.llm.line_dedup import LineRuns, line_dedup, line_hashes
from weftline.llm.mixing import mix_sources, shard_rows, splitting_tree
from weftline.llm.quality_rules import js_distance, quality_rules
from weftline.llm.substring_dedup import substring_dedup
from weftline.llm.suffix_dedup import merge_transforms, repeated_starts, shard_transform, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, bucket string, mark string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    """Words from a small set, shared passages, copies, nulls, empty and long texts, a run of one letter."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "ß"]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = [text(60) for _ in range(3)]
    out = [text(rng.randrange(1, 120)) + "\n" + (rng.choice(shared) if rng.random() < 0.5 else "") + "  " + text(rng.randrange(40)) for _ in range(n)]
    out += out[:4] + ["", None, "a" * 1500, "a" * 900, "ab " * 700, text(6000), "x", "one two three", "one two three"]
    out += [" ".join(["z", *o.split()[1:]]) for o in out[:5]]
    return out


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", ["s0", "s1", None][(i or 0) % 3], 0, "clash", "clash", "clash") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def brute_words(texts, k):
    first = {}
    words = [WORD.findall(t or "") for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), (d, i))
    want = {}
    for d, w in enumerate(words):
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] != (d, i):
                gone.update(range(i, i + k))
        want[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return want


def test_substring_dedup_equals_brute_force(spark):
    texts, k = corpus(), 20
    want = brute_words(texts, k)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(frame(spark, texts), k).collect()}
    assert got == want


def brute_bytes(texts, k):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + k] for b in raw for i in range(len(b) - k + 1))
    out = {}
    for d, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - k + 1):
            if n[b[i : i + k]] > 1:
                gone[i : i + k] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0, sha(kept))
    return out


@pytest.mark.parametrize("k", [200, 400])
def test_suffix_dedup_equals_brute_force(spark, k):
    texts = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(frame(spark, texts), k).collect()}
    assert got == brute_bytes(texts, k)


def hot_corpus():
    """Many documents around one passage, whole copies, and rows of one id."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(180))
    own = lambda k: " ".join(f"u{rng.randrange(10**6)}" for _ in range(k))
    return [f"{own(rng.randrange(30))} {passage} {own(rng.randrange(30))}".strip() for _ in range(60)] + [passage, passage, passage + " " + passage, own(300), "", None]


@pytest.mark.parametrize("every", [False, True])
def test_hot_minimisers_change_nothing(spark, monkeypatch, every):
    texts = hot_corpus()
    real, seen = c.hot_bins, []

    def bins(docs, keys, buckets):
        seen.append(real(docs, keys, buckets))
        return np.arange(c.BINS) if every else seen[-1]

    monkeypatch.setattr(c, "hot_bins", bins)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(frame(spark, texts).coalesce(1 + every), 200).collect()}
    assert got == brute_bytes(texts, 200)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(frame(spark, texts).coalesce(1 + every), 20).collect()}
    assert got == brute_words(texts, 20)
    assert every or all(len(x) for x in seen)  # the passage's minimisers are found hot
    same = substring_dedup(frame(spark, [texts[0]] * 2 + [texts[1]], [4, 4, 9]), 20).collect()
    assert sorted((r.doc_id, r.n_removed > 0) for r in same) == [(4, False), (4, False), (9, True)]


def test_merged_transforms_give_the_order_of_all_rotations():
    rng = np.random.default_rng(0)
    shards = []
    for _ in range(3):
        strings = [np.append(rng.integers(1, 4, rng.integers(3, 12)), 0) for _ in range(5)]
        ends = np.cumsum([len(s) for s in strings])
        begins = ends - [len(s) for s in strings]
        following, preceding = np.arange(1, ends[-1] + 1), np.arange(-1, ends[-1] - 1)
        following[ends - 1], preceding[begins] = begins, ends - 1
        shards.append((np.concatenate(strings), following, preceding))
    parts = [shard_transform(*s) for s in shards]
    place, interval = merge_transforms([p[1] for p in parts], 6)
    rotations = []
    for (tokens, following, _), (order, _) in zip(shards, parts, strict=True):
        for at in order.tolist():
            row = []
            for _ in range(6):
                row.append(int(tokens[at]))
                at = following[at]
            rotations.append(tuple(row))
    merged = [rotations[i] for i in place.tolist()]
    assert merged == sorted(rotations)
    assert [a == b for a, b in zip(merged[:-1], merged[1:], strict=True)] == (interval[1:] == interval[:-1]).tolist()


def test_repeated_starts_within_and_across_strings():
    s = np.frombuffer(b"abcdefgh" * 20 + bytes(range(100)), np.uint8)
    at = np.array([0, len(s)])
    dup = repeated_starts(s, at, np.array([3]), 48)
    raw = s.tobytes()
    n = Counter(raw[i : i + 48] for i in range(len(raw) - 47))
    # only windows on equal blocks from the anchor can be compared, so what is found must be right
    assert all(n[raw[i : i + 48]] > 1 for i in np.flatnonzero(dup))


def test_line_dedup_and_runs(spark):
    line = "This line is long enough to count as a common line"
    texts = [f"own {i}\n  {line.upper() if i % 2 else line}\t\nshort" for i in range(7)] + ["", None, line + "\n" + line]
    got = {r.doc_id: r for r in line_dedup(frame(spark, texts)).collect()}
    assert [got[i].n_dropped for i in range(10)] == [1] * 7 + [0, 0, 0]
    assert got[0].kept_sha256 == sha("own 0\nshort")
    assert (got[8].n_lines, got[8].kept_sha256) == (1, sha(""))
    lines = line_hashes(frame(spark, texts), 40)
    runs = LineRuns(spark, fanout=2)
    fresh = [runs.ingest(lines.filter(F.pmod("_id", F.lit(4)) == k)).count() for k in range(4)]
    assert fresh == [1, 0, 0, 0]
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert runs.common(5).count() == 1


def test_mix_meets_targets(spark):
    texts = corpus(3, 200)
    rows = mix_sources(frame(spark, texts), block_docs=10).collect()
    again = mix_sources(frame(spark, texts).repartition(2), block_docs=10).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert own[0].source_size == sum(r.size for r in own)
        for r in own:
            assert sum(d.words for d in r.draws) == r.taken and len({d.epoch for d in r.draws}) == len(r.draws)
    units = {(d.shard, d.epoch, r.source, r.block) for r in rows for d in r.draws}
    assert len({u[1:] for u in units}) == len(units)  # a block's pass is on one shard
    per = Counter(u[0] for u in units)
    assert len(per) == 8 and max(per.values()) - min(per.values()) <= 4
    placed = shard_rows(mix_sources(frame(spark, texts), block_docs=10)).collect()
    assert sum(r.words for r in placed) == sum(r.taken for r in rows)
    assert len({(r.shard, r.epoch, r.source, r.block, r.local) for r in placed}) == len(placed)


def test_what_a_mix_takes_comes_through_the_tree(spark, monkeypatch):
    """Without the shards' quotas nothing is drawn."""
    whole = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda *a: whole(*a).filter("shard < 4"))
    half = mix_sources(frame(spark, corpus(3, 50)), block_docs=10).collect()
    assert {d.shard for r in half for d in r.draws} == {0, 1, 2, 3}
    assert {r.taken for r in half} > {0}


def test_tree_deals_exact_halves(spark):
    slots = spark.createDataFrame([(False, s, i) for s, n in (("a", 61), ("b", 20), ("c", 3)) for i in range(n)], "_none boolean, _source string, _slot long")
    got = splitting_tree(slots, 4, 1).collect()
    assert {s: sum(r._quota for r in got if r._source == s) for s in "abc"} == {"a": 61, "b": 20, "c": 3}
    assert sorted(sum(r._quota for r in got if r.shard == k) for k in range(4)) == [21, 21, 21, 21]


def test_decontamination_small_cases(spark):
    items = ["The quick-brown fox 99 " + " ".join(f"t{i}" for i in range(20)), "short item", "", None, "absent words here"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [items[0].upper(), "pad " * 300 + items[0], "a Short; ITEM b", "short thing item", "", None]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate(frame(spark, texts), bench).collect()}
    assert got == {0: (25, 25, ["0"], True), 1: (325, 25, ["0"], True), 2: (4, 2, ["1"], True), 3: (3, 0, [], False), 4: (0, 0, [], False), 5: (0, 0, [], False)}


def test_decontamination_near_passages(spark):
    words = [f"t{i}" for i in range(26)]
    bench = spark.createDataFrame([(0, " ".join(words)), (1, "six words are one near hit"), (2, "two words")], "item_id long, text string")
    put_in = words[:6] + ["new"] + words[6:19] + ["more"] + words[19:]
    swapped = words[:6] + [words[7], words[6]] + words[8:19] + [words[20], words[19]] + words[21:]
    changed = [("x" if i % 6 == 2 else w) for i, w in enumerate(words)]
    far = [("x" if i % 4 == 2 else w) for i, w in enumerate(words)]
    texts = [put_in, swapped, changed, far, words, ["pad"] * 5 + put_in[:9], "six words are no near hit".split(), ["two", "other"], None]
    got = {r.doc_id: r for r in decontaminate(frame(spark, [t and " ".join(t) for t in texts]), bench).collect()}
    assert [got[i]["near_items"] for i in range(9)] == [["0"], ["0"], ["0"], [], [], [], ["1"], [], []]
    assert [got[i].n_hit for i in range(9)] == [13, 0, 0, 0, 26, 0, 0, 0, 0]
    assert {(x.s, x.n, x.d) for x in got[6].near} == {(0, 6, 1)}
    assert (0, 14, 1) in {(x.s, x.n, x.d) for x in got[0].near}


def jaccard_brute(texts, n=5, percent=80):
    sets = []
    for t in texts:
        w = [x.lower() for x in WORD.findall(t or "")]
        sets.append(set(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = corpus(seed, 30)
    for size in (4, 6, 9, 15, 30, 80, 200, 500):  # chains of edited copies around the threshold
        base = [f"{size}v{i}" for i in range(size)]
        for _ in range(12):
            base = list(base)
            for _ in range(max(1, size // 60)):
                base[rng.randrange(size)] = f"{size}n{rng.random()}"
            texts.append(" ".join(base))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_join(frame(spark, texts)).collect()}
    assert got == jaccard_brute(texts)


@pytest.mark.parametrize("block", [3, 128])
def test_jaccard_join_lists_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(jj, "SETS", block)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(0, 200, 12)] + [" ".join([*base[:100], *(f"y{i}" for i in range(k))]) for k in range(0, 40, 3)]
    texts += texts[:2]  # copies are of one class
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    kinds = {frozenset(s) for s in sets}
    want = {i: sum(len(s & k) * 100 >= 80 * len(s | k) for k in kinds) - 1 for i, s in enumerate(sets)}
    assert max(want.values()) > 10
    assert {r.doc_id: r.n_links for r in jj.jaccard_join(frame(spark, texts)).collect()} == want


def test_jaccard_join_of_near_copies_stores_no_row_for_each_pair(spark, monkeypatch):
    draw, stored, store = random.Random(4), [], jj.c.store
    monkeypatch.setattr(jj.c, "store", lambda df: stored.append(store(df)) or stored[-1])
    base = [f"w{draw.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base[:at] + ["new"] + base[at + 1 :]) for at in range(0, 240, 3)]
    got = jj.jaccard_join(frame(spark, texts)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(79, min(r.doc_id for r in got))}
    assert max(t.count() for t in stored if t.columns[:2] == ["a", "b"]) < 10 * len(texts)


def test_allotments_exceed_every_difference():
    b = jj.bands(80, 3000)
    for low, high in zip(b[:-1], b[1:], strict=True):
        one, two, spare = jj.allot(low, high, 80)
        assert one + 2 * two >= 2 * (high - 1) * 20 // 180 + 1 + 2 * spare


def test_sketch_bits_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for n in (10, 100, 900):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[n // 10 :], rng.integers(0, 2**63, n // 20).astype(np.uint64)])
        near = jj.near_matrix(np.array([len(a), len(b)]), [jj.parity_sketch(a), jj.parity_sketch(b)], 80)
        union = len(set(a.tolist()) | set(b.tolist()))
        inter = len(set(a.tolist()) & set(b.tolist()))
        if 100 * inter >= 80 * union:
            assert near[0, 1]


def test_toxicity_restores_disguised_words(spark):
    costs = toxicity.character_costs(frame(spark, ["an idiot and a moron are clowns; the idiot is stupid"] * 5))
    assert toxicity.decode("1d10t", costs) == "idiot"
    assert toxicity.decode("s-t-u-p-i-d", costs) == "stupid"
    assert toxicity.decode("stuuuupid", costs) == "stupid"
    rng = random.Random(0)
    clean = lambda: " ".join(rng.choice(["the", "of", "river", "stone", "and", "light"]) for _ in range(30))
    texts = [clean() + (" idiot" if i % 3 == 0 else "") for i in range(150)]
    docs = frame(spark, [*texts, None, "", clean() + " i d i o t", clean() + " 1d10t"])
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert [got[i] for i in range(150)] == [int(i % 3 == 0) for i in range(150)]
    assert (got[150], got[151], got[152], got[153]) == (0, 0, 1, 1)
    none = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def test_toxicity_tries_every_disguise(spark):
    costs = toxicity.character_costs(frame(spark, ["an idiot and a fat moron are clowns; the idiot is a crétin and dense, the ass"] * 50))
    cases = {"iidiioot": "idiot", "d\u20acnse": "dense", "i\u00b7d\u00b7i\u00b7o\u00b7t": "idiot", "f a t": "fat", "i. d. i. o. t": "idiot", "cr\u00e9t1n": "crétin", "as$": "ass", "idi0t": "idiot"}
    for text, word in cases.items():
        raw = f"then {text} there".encode()
        chunk = c.Chunk(np.zeros(1, np.int64), np.zeros(1, np.int64), np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        docs, words = toxicity.Restorer(costs)(chunk)
        assert word.encode() in words and set(docs) == {0}, (text, words)


def test_held_out_labels_never_reach_the_scores(spark):
    texts = [f"the river {'idiot' if i % 4 == 0 else 'stone'} and light {i}" for i in range(120)]
    docs = frame(spark, texts)
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0]
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    scores = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, 0, 1 if flip and i in held else int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
        scores.append(sorted(map(tuple, toxicity.score(docs, toxicity.train(docs, labels, train)).collect())))
    assert held and scores[0] == scores[1]


def test_toxicity_decodes_long_tokens_in_linear_time(spark):
    costs = toxicity.character_costs(frame(spark, ["an idiot and a moron are clowns; the idiot is stupid"] * 5)).tolist()
    word = toxicity.decode("1d10t" * 20_000, costs)
    assert word[-50:] == "idiot" * 10 and len(word) >= 90_000


def test_every_language_is_a_class(spark):
    """As many languages as there are, each with a letter of its own."""
    rows = [(100 * k + i, f"{chr(0x4E00 + 97 * k)}{chr(0x3041 + k)} " * 30, f"l{k:02}") for k in range(70) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True))
    assert len(model.labels) == 70
    assert language_id.train(docs.limit(0), F.lit(True)) is None
    assert language_id.identify(docs.limit(0), model).isEmpty()


def test_language_id(spark):
    rng = random.Random(0)
    words = {"en": ["the", "with", "house", "thing"], "de": ["und", "der", "straße", "schön"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(40)), x) for i in range(200) for x in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34", "en"), (902, "", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs, F.col("doc_id") < 150)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert all(got[i] == x for i, _, x in rows)
    assert [got[i] for i in (900, 901, 902)] == ["und"] * 3
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_quality_rules(spark):
    assert js_distance(np.array([[1.0, 0.0]]), np.array([0.0, 1.0]))[0] == 1.0
    base = "The man of the house and his dog go to the sea, and it is a fine day for all. "
    rng = random.Random(0)
    texts = [" ".join(rng.sample(base.split() * 6, 90)) for _ in range(40)] + ["#$%& " * 200, None, "one two", "x y z\nx y z\n \nx y z"]
    got = {r.doc_id: r for r in quality_rules(frame(spark, texts)).collect()}
    assert all(got[i].kept for i in range(40))
    assert not got[40].kept
    assert [got[i].base_failed for i in (41, 42)] == [True, True]
    assert (got[43].n_dup_lines, got[43].word_chars, got[43].n_words) == (2, 9, 9)
    assert (got[40].n_symbols, got[40].n_repeat_words) == (800, 200)


def quality_brute(rows, class_limit=0.25, word_limit=0.5):
    """The base counts and the verdict of each (text, language), one character and one word at a time."""
    kinds = {**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", 0), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), **dict.fromkeys("0123456789", 2), **dict.fromkeys(" \t\x0b\x0c\r", 3), "\n": 4, **dict.fromkeys(".,;:!?'\"()-", 5), **dict.fromkeys("#*$%&|<>", 7)}

    def classes(text):
        n = Counter()
        for ch in text:
            if ch < "\x80":
                n[kinds.get(ch, 6)] += 1
            else:
                n[9] += 1
                n[8] += len(ch.encode()) - 1
        return n

    low = lambda w: "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in w)
    refs = {}
    for lang in {x for _, x in rows if x}:
        own = [t or "" for t, x in rows if x == lang]
        words = Counter(low(w) for t in own for w in WORD.findall(t))
        refs[lang] = (sum((classes(t) for t in own), Counter()), {w: n for w, n in words.items() if n >= 0.002 * sum(words.values())}, sum(words.values()))

    def distance(p, q):
        ps, qs, out = sum(p.values()) or 1, sum(q.values()) or 1, 0.0
        for k in set(p) | set(q):
            x, y = p.get(k, 0) / ps, q.get(k, 0) / qs
            out += sum(v * np.log2(2 * v / (x + y)) for v in (x, y) if v > 0)
        return min(1.0, max(0.0, out / 2)) ** 0.5

    out = []
    for text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeat = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
        best = None
        for name in sorted(refs) if lang not in refs else [lang]:
            cls, common, total = refs[name]
            own = Counter(w if (w := low(x)) in common else "" for x in words)
            found = distance(classes(text), cls), distance(own, {**common, "": total - sum(common.values())})
            if best is None or sum(found) < sum(best):
                best = found
        bad = best is not None and ((len(text.encode()) >= 300 and best[0] > class_limit) or (len(words) >= 60 and best[1] > word_limit))
        out.append((len(words), sum(len(w) for w in words), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat), failed, not failed and not bad, best))
    return out


def test_quality_rules_equal_brute_force(spark):
    rng = random.Random(7)
    vocab = {"en": "the of and house which their through going Light River".split(), "el": "και του αυτό θάλασσα σπίτι δρόμος μεγάλος ουρανός νερό φως".split(), "zz": ["" for _ in range(3)]}
    rows = []
    for i in range(90):
        lang = ["en", "el", None][i % 3]
        own = vocab[lang or "el"]
        rows.append((" ".join(rng.choice(own) + ("," if rng.random() < 0.1 else "") for _ in range(rng.choice((5, 30, 90, 200)))), lang))
    rows += [("qzx vrrk " * 70 + " ".join(f"x{i}" for i in range(300)), "en"), ("\u03b1" * 900, "el"), ("#$%&" * 200, "en"), (None, "en"), ("", None), ("  \n \n", "zz"), (rows[4][0], "en"), (rows[4][0], "en"), ("a b\na b\n\na b c", "el")]
    docs = spark.createDataFrame([(i, t, x, "clash") for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, _lang string").repartition(4)
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for i, want in enumerate(quality_brute(rows)):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == want[:7], rows[i]
        assert (r.class_distance, r.word_distance) == pytest.approx(want[7], abs=1e-9)
    assert 3 <= sum(not r.kept and not r.base_failed for r in got.values()) < 60


def test_warc_round_trip(spark, tmp_path):
    body = "<p>é" + "x" * 200 + "</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(5, "http://a.org/x", body), (3, "HTTPS://www.a.org:80/x?q=1#f", body), (9, "http://b.org", "small"), (2, None, "small"), (7, "u", None), (None, "http://z", body), (3, "HTTPS://www.a.org:80/x?q=1#f", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_pages(pages, f"file://{tmp_path}/w").collect()
    assert [r.url_key for r in got] == sorted(r.url_key for r in got)
    types = sorted((r.page_id or -1, r.record_type, r.payload_bytes) for r in got)
    n = len(body.encode())
    assert types == [(-1, "response", n), (2, "response", 5), (3, "revisit", n), (3, "revisit", n), (5, "revisit", n), (7, "response", 0), (9, "response", 5)]
    assert warc.url_key("http://www.A.org:80/p?q#f") == "org,a)/p?q"
    for r in got:  # an entry of the index fetches its record alone
        raw = open(r.archive.removeprefix("file:"), "rb").read()
        record = gzip.decompress(raw[r.offset : r.offset + r.length])
        assert record.startswith(b"WARC/1.1") and r.url.encode() in record
        gzip.decompress(raw)  # the whole archive is a gzip file too


def test_warc_many_archives_and_long_payloads(spark, tmp_path):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdef \n") for _ in range(3 << 20))
    rows = [(i, f"http://h{i % 7}.org/p{i % 11}", long if i in (5, 9) else f"<p>{i // 2}</p>" * 20, "clash", "clash") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id string, digest string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path, archive_bytes=4000)
    index = warc.read_index(spark, path)
    assert index.select("archive").distinct().count() > 3
    got = warc.merge_index(index).collect()
    assert [(r.url_key, r.ts, r.page_id) for r in got] == sorted((r.url_key, r.ts, r.page_id) for r in got)
    assert sorted(r.page_id for r in got) == list(range(300))
    by = {r.page_id: r for r in got}
    assert (by[9].record_type, by[9].refers_to, by[9].payload_bytes, by[9].payload_digest) == ("revisit", 5, len(long), sha(long))
    assert all((by[i].record_type, by[i].refers_to) == ("revisit", i - 1) for i in range(1, 300, 2) if i not in (5, 9) and i - 1 not in (5, 9))


def test_loser_tree_merges():
    rng = random.Random(0)
    for k in (1, 2, 3, 7):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([], lambda x: x)) == []


def test_empty_tables(spark):
    none = frame(spark, ["x"]).limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    for t in (substring_dedup(none), suffix_dedup(none), line_dedup(none), mix_sources(none), decontaminate(none, bench), jj.jaccard_join(none), quality_rules(none), warc.archive_pages(pages)):
        assert t.isEmpty()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(none, toxicity.train(none, labels, F.lit(True))).isEmpty()
    assert language_id.identify(none, language_id.train(none, F.lit(True))).isEmpty()


def test_repeated_rows_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(120))
    docs = frame(spark, [long, long, long], [1, 1, None])
    got = sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup(docs).collect())
    assert got == [(-1, 0), (1, 120), (1, 120)]
    assert {r.n_removed for r in suffix_dedup(docs).collect()} == {len(long)}
    assert jj.jaccard_join(docs).count() == 3
