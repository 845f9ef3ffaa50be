"""Mixed orders, the access log and proportional clusters against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import blends, corpora
from weftline.operators.sampling import roll


def test_every_prefix_has_each_share():
    rng = random.Random(1)
    for _ in range(100):
        m, period = rng.randint(1, 9), rng.choice([50, 97, 400])
        counts = [1] * m
        for _ in range(period - m):
            counts[rng.choice([0, rng.randrange(m)])] += 1
        have = [0] * m
        for n, (i, k) in enumerate(blends.turns(counts), 1):
            assert k == have[i]
            have[i] += 1
            assert all(abs(h - n * q / period) < 1 for h, q in zip(have, counts, strict=True))


def test_shares_are_whole_numbers():
    assert blends.quotas([5, -1.5, 2.25], 100) == [57, 17, 26]
    assert blends.quotas([1, 0, 1], 4) == [2, 0, 2]
    with pytest.raises(ValueError, match="zero"):
        blends.quotas([0, 0], 10)
    with pytest.raises(ValueError, match="longer period"):
        blends.quotas([1, 1e-9], 10)


def test_a_mix_goes_through_each_data_set_in_epochs(spark):
    rows = spark.createDataFrame([("a", i) for i in range(7)] + [("b", i) for i in range(50)] + [("c", 1), (None, 3)], "d string, k int")
    got = sorted(blends.mixed_order(rows, "d", "k", {"a": 3, "b": 1, "z": 0}, 40, 5, period=8).collect())
    assert [r.draw for r in got] == list(range(40)) and {r.d for r in got} == {"a", "b"}
    mine = [(r.epoch, r.k) for r in got if r.d == "a"]
    assert len(mine) == 30 and [e for e, _ in mine] == [i // 7 for i in range(30)]
    orders = [[k for e, k in mine if e == epoch] for epoch in range(4)]
    assert all(sorted(o) == list(range(7)) for o in orders) and len({tuple(o) for o in orders}) > 1
    assert sorted(blends.mixed_order(rows.repartition(3), "d", "k", {"a": 3, "b": 1, "z": 0}, 40, 5, period=8).collect()) == got
    with pytest.raises(Exception, match="no rows of q"):
        blends.mixed_order(rows, "d", "k", {"a": 1, "q": 1}, 4, 5, period=8).collect()


def test_a_run_in_the_log_replaces_itself(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log = spark.range(30).select("id", (F.col("id") % 3).alias("rank")).repartition(4)
    for run, time in (("r1", "2024-01-01 00:00:00"), ("r2", None), ("r1", "2024-01-02 00:00:00")):
        blends.append_log(log, path, run, time)
    t = blends.read_log(spark, path)
    assert {r.run: (r["count"], r.days) for r in t.groupBy("run").agg(F.count("*").alias("count"), F.count_distinct("time").alias("days")).collect()} == {"r1": (30, 1), "r2": (30, 1)}
    assert {str(r.time)[:10] for r in t.filter("run = 'r1'").select("time").distinct().collect()} == {"2024-01-02"}


def walk(counts, size, order, used=()):
    """One organism after the other, rarest first."""
    total = {}
    for (_, o), n in counts.items():
        total[o] = total.get(o, 0) + n
    everything, taken = sum(total.values()), set()
    for o in sorted(total, key=lambda o: (total[o], o)):
        target = max(1, int(size * (total[o] / everything)))
        have = sum(n for (c, p), n in counts.items() if p == o and c in taken)
        for c in sorted((c for c, p in counts if p == o and c not in taken and c not in used), key=lambda c: (order[c], c)):
            if have >= target:
                break
            taken.add(c)
            have += counts[c, o]
    return taken


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_drawn_in_rounds_equal_the_walk(spark, seed):
    """Organisms that share clusters in chains, some in one hot cluster, some alone."""
    rng = random.Random(seed)
    rows = [(rng.randrange(60), f"o{rng.randrange(12)}") for _ in range(400)] + [(100 + i // 2, f"x{i // 4}") for i in range(60)] + [(7, f"o{i}") for i in range(12)]
    counts = {}
    for row in rows:
        counts[row] = counts.get(row, 0) + 1
    t = spark.createDataFrame(rows + [(None, "o1"), (5, None)], "c int, o string")
    order = {r.c: r.h for r in t.select("c", roll(F.col("c"), seed).alias("h")).distinct().filter("c is not null").collect()}
    used = {0, 1, 2, 3}
    for size, out in ((60, ()), (150, used)):
        frame = spark.createDataFrame([(c,) for c in out], "c int") if out else None
        got = corpora.proportional_clusters(t, "c", "o", size, seed, frame).collect()
        assert len(got) == len({r.c for r in got}) and {r.c for r in got} == walk(counts, size, order, out)
