import random

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline import registry
from weftline.functions import sequences as S
from weftline.operators import intervals, matrix, sampling, scores
from weftline.sources import fasta
from weftline.streaming import feature_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("a", "b"), [(0, 4), (2, 100), (-5, -1), (-100, 3), (4, 2), (8, 8)])
def test_slices_follow_python(spark, a, b):
    s = "ACGTNACGTA"
    assert one(spark, S.python_slice(F.lit(s), a, b)) == s[a:b]


def test_translate_and_strands(spark):
    assert one(spark, S.translate(F.lit("ATGGCCTAAxx"))) == "MA*"
    assert one(spark, S.translate(F.lit("ATGNNN"))) == "M?"
    assert one(spark, S.translate(F.lit("AT"))) == ""
    assert one(spark, S.reverse_complement(F.lit("AACGN"))) == "NCGTT"
    assert one(spark, S.sample_id(F.lit("A__EXT-S1__C"))) == "S1"


def test_fasta_round_trip(spark, tmp_path):
    rows = [(f"s{i}", "ACGT" * (i * 7 + 1)) for i in range(20)]
    path = f"file://{tmp_path}/x"
    fasta.write_fasta(spark.createDataFrame(rows, "seq_id string, seq string"), path)
    assert sorted((r.seq_id, r.seq) for r in fasta.read_fasta(spark, path).collect()) == sorted(rows)
    assert fasta.read_fasta(spark, path, min_length=100).count() == sum(len(s) >= 100 for _, s in rows)
    assert fasta.duplicate_ids(fasta.read_fasta(spark, path)).isEmpty()


def test_gtf(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#x\nchr1\tsrc\texon\t11\t20\t.\t+\t.\tgene_id "g;1"; transcript_id "t1";\nshort\n')
    r = fasta.read_gtf(spark, f"file://{tmp_path}/a.gtf").first()
    assert (r.chrom, r.start, r.end, r.attributes) == ("chr1", 10, 20, {"gene_id": "g;1", "transcript_id": "t1"})


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(1)
    points = [(i, rng.randrange(2), rng.randrange(5000)) for i in range(300)]
    spans = [(i, rng.randrange(2), s := rng.randrange(5000), s + rng.choice([0, 1, 30, 3000])) for i in range(60)]
    got = intervals.point_in_interval(spark.createDataFrame(points, "p int, k int, pos int"), spark.createDataFrame(spans, "i int, k int, s int, e int"), "k", "pos", "s", "e")
    assert sorted((r.p, r.i) for r in got.collect()) == sorted((p, i) for p, k, x in points for i, q, s, e in spans if k == q and s <= x < e)


def test_interval_join_of_crowded_points_and_long_spans(spark):
    """All points on one key and half of them at one place, which is salted; spans from one base to a million, some null or empty."""
    rng = random.Random(2)
    points = [(i, 0, 7_000 if i % 2 else rng.randrange(1_000_000)) for i in range(900)] + [(1000, None, 5), (1001, 0, None)]
    spans = [(i, 0, s := rng.randrange(1_000_000), s + rng.choice([1, 15, 16, 17, 4000, 900_000])) for i in range(120)] + [(200, 0, 6_999, 7_001), (201, 0, 7_000, 7_000), (202, 0, None, 9), (203, None, 0, 9_000), (204, 0, -40, 7_001)]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = intervals.point_in_interval(spark.createDataFrame(points, "p int, k int, pos int").repartition(3), spark.createDataFrame(spans, "i int, k int, s int, e int"), "k", "pos", "s", "e")
        assert sorted((r.p, r.i) for r in got.collect()) == sorted((p, i) for p, k, x in points for i, q, s, e in spans if k == q and k is not None and None not in (x, s) and s <= x < e)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_interval_join_spreads_crowded_spans(spark):
    """3,000 spans over three points, of which one task would compare all; tasks follow the rows, and no cut loses or repeats a pair."""
    points = spark.createDataFrame([(i, 0, 100 + 40 * i) for i in range(1000)] + [(2000 + i, 0, 90_001 + i) for i in range(3)], "p int, k int, pos int").coalesce(1)
    spans = spark.createDataFrame([(i, 0, 90_000, 90_010) for i in range(3000)] + [(5000, 0, 100, 101)], "i int, k int, s int, e int")
    met = intervals.point_in_interval(points, spans, "k", "pos", "s", "e", task_rows=500)
    assert met.rdd.getNumPartitions() == 9
    found = met.select("p", "i", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.p, r.i) for r in found) == sorted([(0, 5000), *((2000 + j, i) for j in range(3) for i in range(3000))])
    tasks = [r.task for r in found]
    assert max(map(tasks.count, set(tasks))) < 0.5 * len(tasks)


def test_interval_join_lists_equal_spans_one_after_another(spark):
    """300 equal spans meet 200 points, among others: a point's spans come in runs, so a task's rows hold few changes; all pairs are there, with those of rows without other columns."""
    points = [(i, 0, 1000 + i % 40, None if i % 3 else i) for i in range(200)] + [(900, 0, 5000, 1)]
    spans = [(i if i % 2 else None, 0, 990, 1050) for i in range(300)] + [(700 + i, 0, 1000 + i, 1030) for i in range(20)]
    p, x = spark.createDataFrame(points, "p int, k int, pos int, v int").repartition(5), spark.createDataFrame(spans, "i int, k int, s int, e int").repartition(5)
    met = intervals.point_in_interval(p, x, "k", "pos", "s", "e")
    assert met.columns == ["k", "i", "s", "e", "p", "pos", "v"]
    got = [r[:-1] for r in met.withColumn("task", F.spark_partition_id()).collect()]
    whole = sorted(((k, i, s, e, q, pos, v) for q, k, pos, v in points for i, c, s, e in spans if k == c and s <= pos < e), key=repr)
    assert sorted(map(tuple, got), key=repr) == whole
    wide = [r for r in got if (r[2], r[3]) == (990, 1050)]
    assert sum(a[4] != b[4] for a, b in zip(wide[:-1], wide[1:], strict=True)) < len(wide) / 12
    bare = intervals.point_in_interval(p.select("k", "pos"), x.select("k", "s", "e"), "k", "pos", "s", "e").collect()
    assert sorted(map(tuple, bare)) == sorted((k, s, e, pos) for k, _, s, e, _, pos, _ in whole)


@pytest.mark.parametrize("name", ["j03_variant_exon_join", "j04_j05_positions", "j06_coding_places"])
def test_rows_of_equal_exons_stand_together(spark, tmp_path, name):
    """200 transcripts whose second exons are equal, at three offsets: neither events nor places change from row to row."""
    lines = [(o, o % 3 if n == 1 else 2, 7, n, 1.0, 1.0) for o in range(200) for n in (1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(200).selectExpr("id as o_orderkey", "50L as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(8000).selectExpr("id as event_id", "0L as user_id").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()[name](spark, str(tmp_path))
    rows = [tuple(r) for r in got.collect()]
    duck = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = duck.sql(registry.oracle_sql()[name])
    assert got.columns == want.columns and sorted(rows) == sorted(want.fetchall())
    for at in {"event_id", "cds_pos", "cds_place"} & set(got.columns):
        column = [r[got.columns.index(at)] for r in rows]
        assert sum(a != b for a, b in zip(column[:-1], column[1:], strict=True)) < len(rows) / 8


def test_token_batches(spark):
    rows = [("a", i, 2) for i in range(5)] + [("a", 9, 50)]
    got = sampling.token_batches(spark.createDataFrame(rows, "lane string, i int, n int"), ["lane"], "i", "n", 4).collect()
    assert [r.batch for r in sorted(got, key=lambda r: r.i)] == [0, 0, 1, 1, 2]


def test_split_rejects_zero_weights(spark):
    with pytest.raises(ValueError, match="zero"):
        sampling.weighted_split(spark.range(3), F.col("id"), {"a": 0.0}, 1)


def test_dense_index(spark):
    got = matrix.dense_index(spark.range(0, 1000, 3), "id", 8).collect()
    assert sorted((r.id, r.row_index) for r in got) == [(3 * i, i) for i in range(334)]


def test_auc_and_reconstruction(spark):
    t = spark.createDataFrame([("g", 1, 0), ("g", 2, 1), ("g", 2, 0), ("g", 3, 1)], "g string, s int, y int")
    assert scores.rank_auc(t, "s", "y", "g").first().auc == pytest.approx(0.875)
    v = spark.createDataFrame([([1.0, 2.0], [1.0, 4.0])], "a array<double>, b array<double>")
    assert scores.reconstruction(v, "a", "b").first().mse == 2.0


def test_streamed_parts_equal_batch(spark, tmp_path):
    for k in range(3):
        spark.range(20).select((F.col("id") % 4).alias("feature"), ((F.col("id") * 7 + k) % 5).cast("decimal(18,6)").alias("value")).write.mode("append").parquet(f"{tmp_path}/in")
    src = f"{tmp_path}/in"
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 5).parquet(src)
    feature_stream.follow(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    key = lambda t: sorted((r.feature, r.n, round(r.mean, 9), round(r.variance, 9), r.top) for r in t.collect())
    assert key(feature_stream.merge(spark.read.parquet(f"{tmp_path}/out"))) == key(feature_stream.merge(feature_stream.mergeable(spark.read.parquet(src))))


def test_coding_places_shuffle_no_hits(spark):
    from weftline.operators import transcripts

    hits = spark.createDataFrame([(1, 130, 100, 50, False, 200), (2, 130, 100, 50, True, 200)], "tx int, pos int, s int, offset int, minus boolean, total int")
    got = transcripts.coding_places(hits, "pos", "s", "offset", "minus", "total")
    assert {r.tx: r.cds_place for r in got.collect()} == {1: 80, 2: 119}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ["p08_amino_ids", "j23_protein_matches"])
def test_bases_are_computed_once_for_a_scan(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == plan.count("Relation [")
