"""Streams whose buffer and open batch outlive micro-batches, restarted from their checkpoints."""

import random

from pyspark.sql import functions as F

from weftline.streaming import carried


def arrivals(spark, path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame([(k, i, n) for k, n in rows], "k long, file int, n long").coalesce(1).write.mode("append").parquet(path)


def followed(spark, path, name, parts, restart):
    """All parts in one run, or a run for each: what a stream that is stopped and started again does."""
    source, target, mark = (f"file://{path}/{name}-{x}" for x in ("in", "out", "mark"))
    stream = lambda: spark.readStream.schema("k long, file int, n long").option("maxFilesPerTrigger", 1).parquet(source)
    for some in [[p] for p in parts] if restart else [parts]:
        arrivals(spark, source, some)
        carried.follow_buffered(stream(), target, mark, "k", 3, 16, 100).awaitTermination()
    for _ in range(2):  # done twice, it writes the same
        carried.finish_buffered(spark, target, "k long, file int, n long", "k", 3, 16)
    return spark.read.parquet(target)


def test_the_buffer_outlives_micro_batches_and_restarts(spark, tmp_path):
    parts = [[(100 * i + j, 1) for j in range(80)] for i in range(5)]
    once, again = (followed(spark, tmp_path, name, parts, restart) for name, restart in (("a", False), ("b", True)))
    rows = lambda t: sorted((r.batch, r.turn, r.k) for r in t.collect())
    assert rows(once) == rows(again)
    got = rows(once)
    assert sorted(k for _, _, k in got) == sorted(k for p in parts for k, _ in p)
    assert [(b, t) for b, t, _ in got] == [divmod(i, 16) for i in range(400)]
    assert max(len({k // 100 for b, _, k in got if b == batch}) for batch in range(25)) >= 3


def test_the_last_batch_can_be_dropped(spark, tmp_path):
    source, target, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    arrivals(spark, source, [[(j, 1) for j in range(50)]])
    stream = spark.readStream.schema("k long, file int, n long").parquet(source)
    carried.follow_buffered(stream, target, mark, "k", 3, 16, 20).awaitTermination()
    carried.finish_buffered(spark, target, "k long, file int, n long", "k", 3, 16, drop_last=True)
    assert {r.batch: r["count"] for r in spark.read.parquet(target).groupBy("batch").count().collect()} == {0: 16, 1: 16, 2: 16}


def test_packed_lanes_go_on_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    source, target, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    parts = [[(100 * i + j, rng.randrange(30)) for j in range(40)] for i in range(4)]
    for part in parts:
        arrivals(spark, source, [part])
        stream = spark.readStream.schema("k long, file int, n long").parquet(source).withColumn("lane", F.lit("all"))
        carried.follow_packed(stream, target, mark, "lane", "k", "n", 64).awaitTermination()
    got = {(r.key, t): (r.batch, r["at"] + t - r.start) for r in spark.read.parquet(target).collect() for t in range(r.start, r.stop)}
    tokens = [(k, t) for part in parts for k, n in part for t in range(n)]
    assert got == {token: divmod(i, 64) for i, token in enumerate(tokens)}
