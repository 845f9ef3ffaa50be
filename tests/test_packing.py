import pytest
from pyspark.sql import functions as F

from weftline.functions import tokens as T
from weftline.operators import packing, scores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_token_functions(spark):
    assert one(spark, T.codon_ids(F.lit("AAATTTNNNac"))) == [5, 68, 2]
    assert one(spark, T.byte_ids(F.lit("AC"))) == [65, 67, 0]
    assert one(spark, T.byte_ids(F.lit(""))) == [0]
    assert one(spark, T.framed(F.array(*map(F.lit, range(5, 15))), 6)) == [0, 5, 6, 7, 8, 1]
    assert one(spark, T.framed(F.array(F.lit(9)), 6)) == [0, 9, 1, 3, 3, 3]
    assert one(spark, T.next_labels(F.array(F.lit(7), F.lit(8)), 3)) == [8, 3]
    assert one(spark, T.next_labels(F.array(F.lit(7)), 3)) == [3]
    assert one(spark, T.genomic_labels(T.byte_ids(F.lit("A@t")))) == [65, -100, 116, -100]
    assert one(spark, T.lineage_tag({"d": F.lit("x"), "s": F.lit(None).cast("string")}, F.lit(1), 1)) == "|d__x;s__None|"
    assert one(spark, T.inject_tag(F.lit("ABCDE"), F.lit("|t|"), 5)) == "|t|AB|t|CD|t|E"
    assert one(spark, T.inject_tag(F.lit(""), F.lit("|t|"), 5)) == ""


def test_masking_shares(spark):
    t = spark.range(200).select(T.masked(F.array_repeat(F.lit(20), F.lit(100)), F.col("id"), 1).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    n, drawn, mask, kept = t.agg(F.count("*"), F.count_if(F.col("label") != -100), F.count_if(F.col("input") == T.MASK), F.count_if((F.col("label") != -100) & (F.col("input") == 20))).first()
    assert drawn / n == pytest.approx(0.15, abs=0.01) and mask / drawn == pytest.approx(0.8, abs=0.03) and kept / drawn == pytest.approx(0.1, abs=0.03)
    assert t.filter("label = -100 and input != 20").isEmpty()
    assert one(spark, T.masked(F.array(F.lit(T.CLS), F.lit(T.SEP)), F.lit(1), 1, 1.0).label) == [-100, -100]


def test_split_pack_keeps_every_token(spark):
    rows = [("a", i, n) for i, n in enumerate([5, 0, 13, 1, 4, 9])] + [("b", 0, 30)]
    got = packing.split_pack(spark.createDataFrame(rows, "g string, i int, n int"), ["g"], "i", "n", 8).collect()
    for lane in "ab":
        seen = {(r.i, k): (r.batch, r["at"] + k - r.start) for r in got if r.g == lane for k in range(r.start, r.stop)}
        want = {t: divmod(j, 8) for j, t in enumerate((i, k) for g, i, n in rows if g == lane for k in range(n))}
        assert seen == want
    assert all(r.padding == -r.cu_seq_lens[-1] % 6 for r in packing.flattened(packing.split_pack(spark.createDataFrame(rows, "g string, i int, n int"), ["g"], "i", "n", 8), ["g"], 6).collect())


def test_token_windows_cover_the_row(spark):
    t = spark.createDataFrame([(n, n) for n in (0, 1, 8, 9, 30, 31)], "id int, n int")
    got = packing.token_windows(t, "id", F.col("n"), 10, 2, 3).collect()
    for n in (0, 1, 8, 9, 30, 31):
        mine = sorted((r.start, r.stop) for r in got if r.id == n)
        assert mine[0][0] == 0 and mine[-1][1] == n and all(b[0] == a[0] + 5 and a[1] == a[0] + 8 for a, b in zip(mine, mine[1:]))
    with pytest.raises(ValueError, match="overlap"):
        packing.token_windows(t, "id", F.col("n"), 5, 2, 3)


def test_matched_controls_take_all_when_short(spark):
    rows = [("x", i, i < 5) for i in range(300)] + [("y", 1000 + i, i < 3) for i in range(4)] + [("z", 2000, False)]
    got = packing.matched_controls(spark.createDataFrame(rows, "m string, k int, c boolean"), "m", F.col("c"), "k", 4, 1)
    counts = {(r["repeat"], r.m): (r.n, r.d) for r in got.groupBy("repeat", "m").agg(F.count("*").alias("n"), F.countDistinct("k").alias("d")).collect()}
    assert counts == {(q, m): (n, n) for q in range(4) for m, n in (("x", 5), ("y", 1))}


def test_strata_and_groups(spark):
    t = spark.range(1000).select("id", (F.col("id") % 100).alias("n"), (F.col("id") % 7).alias("g"))
    got = packing.length_stratified(t, "id", "n", 25, 10, 1).groupBy("bin").count().collect()
    assert {r.bin: r["count"] for r in got} == {b: 3 if b < 5 else 2 for b in range(10)}
    assert packing.length_stratified(t.limit(0), "id", "n", 25, 10, 1).isEmpty()
    first, second = (packing.one_per_group(t, ["g"], "id", 1, e).collect() for e in (0, 1))
    assert len(first) == len(second) == 7 and sorted(first) != sorted(second) and all(r.id % 7 == r.g for r in first)


def test_spearman_with_ties(spark):
    t = spark.createDataFrame([("g", 1, 1), ("g", 2, 3), ("g", 2, 2), ("g", 3, 4), ("g", None, 9)], "g string, a int, b int")
    assert scores.spearman(t, "a", "b", "g").first().spearman == pytest.approx(0.9486832981)


def test_pr_auc(spark):
    t = spark.createDataFrame([("g", 3, 1), ("g", 2, 1), ("g", 2, 0), ("g", 1, 0), ("h", 1, 0)], "g string, s int, y int")
    got = {r.g: r.pr_auc for r in scores.pr_auc(t, "s", "y", "g").collect()}
    assert got == {"g": pytest.approx(0.5 + 0.5 * (1 + 2 / 3) / 2), "h": None}


def test_draws(spark):
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(10)], "i int, v string")
    few, many = ({(r.draw, r.v) for r in packing.resampled(rows, "i", k, 1).collect()} for k in (20, 50))
    assert len(few) == 20 and few < many
    assert packing.resampled(rows.limit(0), "i", 5, 1).isEmpty()
    assert {r["rank"] for r in packing.rank_shards(spark.range(100), "id", 4, 1).collect()} == {0, 1, 2, 3}
