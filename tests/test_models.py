import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import sequences as S
from weftline.functions import tokens as T
from weftline.operators import batches, enrichment, genome, graph, matrix, sampling, schedules, scores, transcripts
from weftline.plans import basics, biology, models
from weftline.sources import tables
from weftline.streaming import packing_stream

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("n", [1, 2, 97, 1000])
def test_permutation_is_a_bijection(spark, n):
    t = spark.range(n)
    a, b = ([r[0] for r in t.select(schedules.permuted(F.col("id"), F.lit(n), F.lit(k))).collect()] for k in "pq")
    assert sorted(a) == sorted(b) == list(range(n))
    assert n < 50 or (a != b and sum(i == x for i, x in enumerate(a)) < 12)
    assert one(spark, schedules.permuted(F.lit(n), F.lit(n), F.lit("p"))) is None


def test_epochs_resume_where_they_were(spark):
    rows = spark.range(10).select(F.col("id").alias("i"), (F.col("id") * 7).alias("v"))
    full = {r.place: (r.epoch, r.v) for r in schedules.epoch_schedule(rows, "i", 1, epochs=3, batch=4).collect()}
    assert sorted(full) == list(range(24)) and all(len({full[p][1] for p in full if full[p][0] == e}) == 8 for e in range(3))
    later = {r.place: (r.epoch, r.v) for r in schedules.epoch_schedule(rows, "i", 1, epochs=3, batch=4, consumed=13).collect()}
    assert later == {p: full[p] for p in full if p >= 13}
    assert schedules.epoch_schedule(rows, "i", 1, samples=7).count() == 7
    assert schedules.epoch_schedule(rows.limit(0), "i", 1, epochs=2).isEmpty()
    assert schedules.epoch_schedule(rows, "i", 1, epochs=1, consumed=99).isEmpty()
    for bad in ({}, {"epochs": 1, "samples": 1}):
        with pytest.raises(ValueError, match="epochs or samples"):
            schedules.epoch_schedule(rows, "i", 1, **bad)


def test_positions_in_groups(spark):
    rows = [(i, None if i % 3 == 0 else "hot") for i in range(90)] + [(5, "hot")]
    got = sampling.hash_positions(spark.createDataFrame(rows, "k int, g string"), ["g"], "k", 1, 8).collect()
    for g, n in ((None, 30), ("hot", 61)):
        assert sorted(r._pos for r in got if r.g == g) == list(range(n)) and {r._total for r in got if r.g == g} == {n}
    assert sampling.hash_positions(spark.createDataFrame([], "k int, g string"), ["g"], "k", 1).isEmpty()


def edges_of(spark, sizes, width, least):
    t = batches.size_buckets(spark.createDataFrame([(s,) for s in sizes], "n int"), "n", width, least).orderBy("bucket").collect()
    return [r.low for r in t] + [t[-1].high] if t else [], [r["items"] for r in t]


def test_size_buckets(spark):
    assert edges_of(spark, [1] * 3 + [2] * 4 + [3] * 5 + [22] * 4, 5, 10) == ([1, 6, 11, 16, 21, 23], [12, 0, 0, 0, 4])
    assert edges_of(spark, range(20), 10, 5) == ([0, 5, 10, 15, 20], [5, 5, 5, 5])
    assert edges_of(spark, [7, None], 3, 1) == ([7, 8], [1])
    assert edges_of(spark, [], 3, 1) == ([], [])
    with pytest.raises(ValueError, match="positive"):
        edges_of(spark, [1], 0, 1)


def test_greedy_chunks(spark):
    rng = random.Random(3)
    rows = [(f, i, rng.choice([1, 5, 9, 40])) for f in "ab" for i in range(60)]
    got = {(r.f, r.chunk): (r["rows"], r.tokens) for r in batches.greedy_chunks(spark.createDataFrame(rows, "f string, i int, n int"), ["f"], "i", "n", 20).collect()}
    want = {}
    for f in "ab":
        open_, all_ = [], []
        for n in (n for g, _, n in rows if g == f):
            if open_ and sum(open_) + n > 20:
                all_.append(open_)
                open_ = []
            open_.append(n)
        want |= {(f, k): (len(c), sum(c)) for k, c in enumerate([*all_, open_])}
    assert got == want


def test_padding_and_slices(spark):
    t = spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, [])], "b int, ids array<int>")
    assert sorted((r.ids, r["mask"]) for r in batches.padded(t, ["b"], "ids", 9, 2).collect()) == [([], []), ([1, 2, 3, 9], [1, 1, 1, 0]), ([4, 9, 9, 9], [1, 0, 0, 0])]
    got = batches.zigzag(spark.createDataFrame([(1, 5), (2, 0)], "k int, n int"), "k", F.col("n"), 2).collect()
    assert sorted((r.k, r["rank"], r.start, r.stop) for r in got) == [(1, 0, 0, 2), (1, 0, 6, 8), (1, 1, 2, 4), (1, 1, 4, 6)]


def mask_of(spark, text, longest=2048):
    ids = F.array(*(F.lit(0 if c == "~" else ord(c)) for c in text)).cast("array<int>")
    return "".join(map(str, one(spark, T.tag_mask(ids, longest))))


@pytest.mark.parametrize(
    ("text", "longest", "mask"),
    [
        ("", 99, ""),
        ("|", 99, "0"),
        ("A", 99, "1"),
        ("x", 99, "1"),
        ("~", 99, "1"),
        ("ACGT", 99, "1111"),
        ("AC_T", 99, "0000"),
        ("AC_T", 3, "1101"),
        ("|d__x;s__y|ACgt", 99, "000000000001111"),
        ("d__x|ACGT", 99, "000001111"),
        ("ACGT|d__x", 99, "111100000"),
        ("ACGT|d__x|GG|d__y", 99, "11110000001100000"),
        ("GG|d", 99, "1100"),
        ("GG|A", 99, "0001"),
        ("GG|", 99, "110"),
        ("d__x|", 99, "00000"),
        ("|d__x|AC~|d__y|GG", 99, "00000011100000011"),
        ("AC@#N-x", 3, "1111110"),
        # the second piece is too long for a tag, so it stays but for what is no base (d is one), and the one after it counts as one
        ("|d__AAAA|CC|GG", 5, "0100" + "1111" + "0" + "00" + "0" + "11"),
    ],
)
def test_tag_masks(spark, text, longest, mask):
    assert mask_of(spark, text, longest) == mask


def test_token_rows(spark):
    row = F.array(*map(F.lit, [0, 11, 12, 13, 1]))
    assert one(spark, T.variant_input(row, F.lit(0), F.lit(4))) == [0, 4, 12, 13, 1]
    assert one(spark, T.variant_input(row, F.lit(2), F.lit(4))) == [0, 11, 12, 4, 1]
    for place in (-1, 3):
        with pytest.raises(Exception, match="outside its row"):
            one(spark, T.variant_input(row, F.lit(place), F.lit(4)))
    assert one(spark, T.headed(row, [7], [8], 9, 8)) == [7, 0, 11, 12, 13, 1, 8, 9]
    assert one(spark, T.headed(row, [7], [8], 9, 4)) == [7, 0, 11, 8]
    assert one(spark, T.control_name(F.lit("A1__x"))) == "<ctrl_a1>" and one(spark, T.control_name(F.lit("Ab"))) == "<ctrl_ab>"
    assert one(spark, T.class_labels(F.lit("HEC?"), "HEC", F.lit(1), F.lit(4))) == [-100, 1, 2, -100, -100]


def test_sequence_texts(spark):
    assert tuple(one(spark, S.coding_change(F.lit("T1:c.45A>G")))) == ("T1", 45, "A", "G")
    assert tuple(one(spark, S.coding_change(F.lit("c.7C>T")))) == (None, 7, "C", "T")
    assert one(spark, S.coding_change(F.lit("p.V600E"))) is None
    assert one(spark, S.gene_prefix(F.lit("ZNF123"))) == "ZNF"
    assert [one(spark, S.bin_of(F.lit(v).cast("double"), 10)) for v in (0.99, None, float("nan"))] == [9, -1000, -1000]


def test_regions_and_windows(spark):
    g = "".join(random.Random(5).choice("ACGT") for _ in range(100))
    chunks = spark.createDataFrame([("x", k, g[k * 16 : k * 16 + 16]) for k in range(7)], "c string, chunk_no int, seq string")
    spans = [(i, "x", a, b) for i, (a, b) in enumerate([(0, 100), (5, 5), (-3, 4), (15, 17), (90, 300), (200, 210), (9, 2)])] + [(9, "none", 0, 5)]
    got = genome.read_regions(spark.createDataFrame(spans, "i int, c string, s int, e int"), chunks, ["i"], "c", "s", "e", 16).collect()
    assert {r.i: r.seq for r in got} == {i: g[max(a, 0) : max(b, 0)] if c == "x" else "" for i, c, a, b in spans}
    v = spark.createDataFrame([(p, "x", p, "N") for p in (0, 3, 50, 99, 100)], "i int, c string, p int, alt string")
    for r in genome.variant_windows(v, chunks, ["i"], "c", "p", "alt", 5, 16).collect():
        a = max(r.i - 5, 0)
        assert r.ref_window == g[a : r.i + 6] and r.alt_window == g[a : r.i] + "N" + g[r.i + 1 : r.i + 6] and r.i < 100
    assert {r.i: r.ref for r in genome.reference_base(v, chunks, "c", "p", 16).collect()} == {0: g[0], 3: g[3], 50: g[50], 99: g[99], 100: None}


def test_whole_sequences_reach_the_genome(spark):
    rng = random.Random(4)
    rows = [(i, i % 3, "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 7, 40, 300])))) for i in range(60)] + [(9, 0, "ACGTACGT"), (61, 1, None)]
    got = genome.contig_chunks(spark.createDataFrame(rows, "i long, c int, seq string"), "c", "i", "seq", 16, block=8).collect()
    for k in range(3):
        whole = "".join(q for _, c, q in sorted((r for r in rows if r[2]), key=lambda r: (r[0], r[2])) if c == k)
        assert {r.chunk_no: r.seq for r in got if r.c == k} == {at // 16: whole[at : at + 16] for at in range(0, len(whole), 16)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_whole_queries_use_every_base_and_codon(spark):
    bases = biology.seqs(spark, SF).select(F.length("seq").alias("n"), F.floor(F.length("seq") / 3).alias("codons"))
    n, codons, longest = bases.agg(F.sum("n"), F.sum("codons"), F.max("codons")).first()
    assert longest > 126
    whole, sizes = models.whole_genome(spark, SF)
    assert whole.agg(F.sum(F.length("seq"))).first()[0] == sizes.agg(F.sum("n")).first()[0] == n
    tokens = lambda name: basics.QUERIES[name](spark, SF).agg(F.sum(F.size(F.array_remove(F.split("ids", ","), "3")))).first()[0]
    rows = {name: basics.QUERIES[name](spark, SF).count() for name in ("m04_variant_input", "p16_control_tags")}
    assert tokens("m04_variant_input") == codons + 2 * rows["m04_variant_input"]
    assert tokens("p16_control_tags") == codons + 4 * rows["p16_control_tags"]
    places = basics.QUERIES["j18_reference_base"](spark, SF)
    assert places.join(sizes, "chrom").filter(F.col("pos") > F.col("n") * 0.9).count() > 0


def test_covered_length(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(4), s := rng.randrange(60), s + rng.choice([0, 1, 4, 30])) for _ in range(60)]
    got = {r.g: r.covered for r in genome.covered_length(spark.createDataFrame(rows, "g int, s int, e int"), ["g"], "s", "e").collect()}
    assert got == {g: len({k for h, s, e in rows if h == g for k in range(s, e)}) for g in {r[0] for r in rows}}


def test_nearest_listed(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "e"), ("x", "y"), ("y", "x")], "child string, parent string")
    starts = spark.createDataFrame([(n,) for n in "abcx"] + [("a",)], "node string")
    listed = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    got = {r.node: (r.ancestor, r.depth) for r in graph.nearest_listed(starts, edges, listed("c", "e")).collect()}
    assert got == {"a": ("c", 2), "b": ("c", 1), "c": ("c", 0), "x": (None, None)}
    assert graph.nearest_listed(starts.limit(0), edges, listed("c")).isEmpty()


def test_first_contained(spark):
    ids = spark.createDataFrame([(1, "homo_sapiens_9"), (2, "mus"), (3, None), (4, "")], "i int, t string")
    keys = spark.createDataFrame([("sapiens", 2), ("o_s", 1), ("us", 5), ("absent", 0)], "k string, o int")
    assert {r.i: r.k for r in graph.first_contained(ids, "i", "t", keys, "k", "o").collect()} == {1: "o_s", 2: "us", 3: None, 4: None}
    assert {r.k for r in graph.first_contained(ids, "i", "t", keys.limit(0), "k", "o").collect()} == {None}


def test_enrichment_equals_the_running_sum(spark):
    rng = random.Random(7)
    genes = [(f, g, float(rng.randrange(1, 500))) for f in "pq" for g in range(40)]
    sets = [(g, s) for g in range(40) for s in "uvw" if rng.random() < 0.3] + [(g, "flat") for g in range(2)]
    got = {(r.f, r.s): r for r in enrichment.enrichment(spark.createDataFrame(genes, "f string, g int, x double"), spark.createDataFrame(sets, "g int, s string"), "f", "g", "x", "s", 9, 1, least=3).collect()}
    for f in "pq":
        order = sorted((r for r in genes if r[0] == f), key=lambda r: (-r[2], r[1]))
        for s in "uvw":
            members = {g for g, t in sets if t == s}
            total, run, best = sum(x for _, g, x in order if g in members), 0.0, 0.0
            for _, g, x in order:
                run += x / total if g in members else -1 / (40 - len(members))
                best = run if abs(run) > abs(best) + 1e-12 else best
            assert got[f, s].es == pytest.approx(best) and got[f, s].hits == len(members) and 0.1 <= got[f, s].p <= got[f, s].q <= 1
        assert (f, "flat") not in got


def test_best_set_of_each_database(spark):
    """A planted set at the top of the list is best in its database and over all; flat features are left out; q is within a database."""
    rng = random.Random(8)
    genes = [("f", g, 100.0 - g + rng.random()) for g in range(80)] + [("flat", g, 5.0) for g in range(80)] + [("dead", g, 0.0) for g in range(80)]
    sets = [("x", "top", g) for g in range(10)] + [("x", f"r{k}", g) for k in range(5) for g in rng.sample(range(80), 12)] + [("y", f"s{k}", g) for k in range(5) for g in rng.sample(range(80), 12)]
    found = enrichment.enrichment(spark.createDataFrame(genes, "f string, g int, x double"), spark.createDataFrame(sets, "d string, s string, g int"), "f", "g", "x", "s", 60, 1, database="d")
    rows = found.collect()
    assert {r.f for r in rows} == {"f"} and len(rows) == 11
    best = {r.d: r for r in enrichment.best_sets(found, "f", "d", "s", 1.1).collect()}
    assert best["x"].s == "top" and best["x"].best and not best["y"].best and best["x"].hits == 10
    for d in "xy":
        own = [r for r in rows if r.d == d]
        assert best[d].q == min(r.q for r in own)
        assert all(r.q <= min(1.0, r.p * len(own) / sum(o.p <= r.p for o in own)) + 1e-12 for r in own)
    assert enrichment.best_sets(found, "f", "d", "s", 0.0).isEmpty()


def test_forest_search_prefers_the_depth_of_the_function(spark):
    """A step in each of two features takes two levels of a tree: depth 2 has less error than depth 0, which is the deviation from the mean."""
    rng = random.Random(9)
    rows = [(x := [rng.random(), rng.random(), rng.random()], (x[0] > 0.5) * 4.0 + (x[1] > 0.3) * 1.0, i % 3) for i in range(300)]
    t = spark.createDataFrame(rows, "x array<double>, y double, fold int")
    got = {r.maxDepth: r for r in scores.forest_search(t, "x", "y", "fold", 3, {"numTrees": [10], "maxDepth": [0, 2]}).collect()}
    mean = sum(r[1] for r in rows) / len(rows)
    assert got[0.0].rmse == pytest.approx((sum((r[1] - mean) ** 2 for r in rows) / len(rows)) ** 0.5, rel=0.05)
    assert got[2.0].best and not got[0.0].best and got[2.0].rmse < 0.6 * got[0.0].rmse


def test_scores(spark):
    t = spark.createDataFrame([("g", [0.0, 0.0], 1), ("g", [1000.0, 0.0], 0)], "g string, x array<double>, y int")
    logp = [r[0] for r in t.select(scores.log_probability(F.col("x"), F.col("y"))).collect()]
    assert logp == [pytest.approx(-0.693147), pytest.approx(0)]
    r = scores.token_losses(t.withColumn("p", scores.log_probability(F.col("x"), F.col("y"))), "g", "p").first()
    assert r.tokens == 2 and r.perplexity == pytest.approx(2**0.5)
    assert tuple(scores.token_accuracy(t, "x", "y").first()) == (2, 0.5)
    dense = matrix.dense_rows(spark.createDataFrame([(1, 0, 2), (1, 2, 3), (1, 2, 1), (1, 9, 5)], "r int, c int, v int"), "r", "c", "v", 3)
    assert dense.first()["values"] == [2, 0, 4]


def test_formats(spark, tmp_path):
    (tmp_path / "s.txt").write_text("1ABC\n3\nM K L\nH . E\n\n2XYZ\n1\nA\nC\n")
    path = f"file://{tmp_path}/s.txt"
    assert sorted(map(tuple, tables.read_structures(spark, path).collect())) == [("1ABC", "MKL", "H~E"), ("2XYZ", "A", "C")]
    assert tables.checksums(spark, path).first().sha256 == hashlib.sha256((tmp_path / "s.txt").read_bytes()).hexdigest()
    (tmp_path / "b.csv").write_text("id,value,ref_seq,split\na,1.5,AUG,train\nb,x,GUU,test\n")
    assert [tuple(r) for r in tables.read_benchmark(spark, f"file://{tmp_path}/b.csv", "test").collect()] == [("b", None, "GTT", "test")]
    with pytest.raises(ValueError, match="no column z"):
        tables.require(spark.range(1), "id", "z")
    (tmp_path / "t.obo").write_text("format-version: 1\n\n[Term]\nid: G:1\nname: root\n\n[Term]\nid: G:2\nname: leaf\nis_a: G:1 ! root\n\n[Term]\nid: G:3\nis_obsolete: true\n")
    got = tables.read_terms(spark, f"file://{tmp_path}/t.obo")
    assert sorted(map(tuple, got.collect())) == [("G:1", "root", []), ("G:2", "leaf", ["G:1"])]
    assert [tuple(r) for r in tables.term_edges(got).collect()] == [("G:2", "G:1")]
    tables.write_shards(spark.range(10).withColumnRenamed("id", "i"), "i", 4, f"file://{tmp_path}/sh")
    assert sorted((r.shard, r["count"]) for r in spark.read.parquet(f"file://{tmp_path}/sh").groupBy("shard").count().collect()) == [(0, 4), (1, 4), (2, 2)]


def test_stream_packing_goes_on_over_micro_batches(spark, tmp_path):
    sizes = {0: 5, 1: 9, 2: 1, 3: 20, 4: 0}
    src = f"file://{tmp_path}/in"
    for part in ([0, 1], [2], [3, 4]):
        spark.createDataFrame([("a", k, sizes[k]) for k in part], "lane string, k long, n long").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("lane string, k long, n long").parquet(src)
        q = packing_stream.packed_pieces(stream, "lane", "k", "n", 8).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.key, i): (r.batch, r["at"] + i - r.start) for r in spark.read.parquet(f"file://{tmp_path}/out").collect() for i in range(r.start, r.stop)}
    assert got == {t: divmod(j, 8) for j, t in enumerate((k, i) for k in range(5) for i in range(sizes[k]))}
    packing_stream.follow_shuffled(spark.readStream.schema("lane string, k long, n long").parquet(src), f"file://{tmp_path}/sh", f"file://{tmp_path}/ck2", "k", 1, 2, drop_last=True).awaitTermination()
    assert sorted(r["count"] for r in spark.read.parquet(f"file://{tmp_path}/sh").groupBy("trigger", "batch").count().collect()) == [2, 2]


def test_permutation_is_drawn_once_for_a_key(spark):
    t = spark.range(3000).select(F.col("id"), (F.col("id") % 2).cast("string").alias("key")).coalesce(1)
    got = t.select("key", schedules.permuted(F.floor(F.col("id") / 2), F.lit(1500), F.col("key")).alias("to"))
    assert {r.key: r.n for r in got.groupBy("key").agg(F.countDistinct("to").alias("n")).collect()} == {"0": 1500, "1": 1500}
    assert "aggregate(" not in got._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([(None, 5, "a"), (5, 5, "a"), (-1, 5, "a"), (0, None, "a")], "i long, n long, k string")
    assert [r[0] for r in odd.select(schedules.permuted(F.col("i"), F.col("n"), F.col("k"))).collect()] == [None] * 4


def test_concept_f1_crosses_counts_not_activations(spark):
    from weftline.operators import features

    acts = spark.createDataFrame([(1, p, 0, 1.0 if p < 6 else 0.3) for p in range(12)] + [(2, 0, 0, 1.0)], "s int, p int, feature int, value double")
    labels = spark.createDataFrame([(1, p, "DOM:a", d) for d in (7, 8) for p in range(4)] + [(1, 9, "DOM:a", 9)], "s int, p int, concept string, domain int")
    got = features.concept_f1(acts, labels, "s", "p", 3, (), (0.0, 0.5))
    r = got.collect()[0]  # above 0.5: places 0-3 in two domains each, 4 and 5 outside; sequence 2 carries nothing
    assert (r.threshold, r.precision, r.recall) == (0.5, 8 / 10, 8 / 9)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, ((_s" not in plan


def test_spliced_reads_take_one_aggregation(spark):
    genome_ = "".join(random.Random(2).choice("ACGT") for _ in range(100))
    chunks = spark.createDataFrame([("c", i, genome_[16 * i : 16 * i + 16]) for i in range(7)], "c string, chunk_no int, seq string")
    spans = [(1, 1, 3, 40, False), (1, 2, 50, 52, False), (2, 1, 60, 120, True), (2, 2, 10, 35, True), (3, 1, 200, 210, True)]
    rows = spark.createDataFrame([(t, "c", n, s, e, m) for t, n, s, e, m in spans], "t int, c string, n int, s int, e int, m boolean")
    flip = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    joined = transcripts.joined_exons(rows, chunks, "t", "c", "s", "e", "n", "m", 16, between="@", leading="!")
    want = {1: genome_[3:40] + "@" + genome_[50:52], 2: "!" + flip(genome_[60:100]) + "@!" + flip(genome_[10:35]), 3: "!"}
    assert {r.t: r.seq for r in joined.collect()} == want
    spliced = genome.spliced(rows, chunks, "t", "c", "s", "e", "m", 16)
    assert {r.t: r.cds for r in spliced.collect()} == {1: genome_[3:40] + genome_[50:52], 2: flip(genome_[10:35] + genome_[60:100]), 3: ""}
    for t in (joined, spliced):
        assert t._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1


def test_lookup_sums_places_in_tasks_of_bounded_rows(spark):
    """Tasks follow the rows, not the session's partitions; places with a null have no entries, and none is listed twice."""
    entries = spark.createDataFrame([(1, 2, 5.0), (1, 2, 3.0), (2, 2, 7.0), (None, 2, 9.0), (3, 1, None)], "r int, c int, v double")
    wanted = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (None, 2), (3, 1)], "r int, c int")
    t = matrix.lookup(wanted, entries, "r", "c", "v", 0.0)
    assert sorted(map(tuple, t.collect()), key=str) == [(1, 2, 8.0), (2, 3, 0.0), (3, 1, 0.0), (None, 2, 0.0)]
    many = spark.range(3000).select((F.col("id") % 50).alias("r"), F.col("id").alias("c"), F.lit(1).alias("v"))
    t = matrix.lookup(many.select("r", "c"), many, "r", "c", "v", 0, task_rows=200)
    assert t.rdd.getNumPartitions() == 30 and t.agg(F.sum("v"), F.count("*")).first() == (3000, 3000)
