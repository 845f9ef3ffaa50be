"""Greedy batches, running sums and ranks of a group that holds all rows, against plain walks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import ordered, packing, scores


def walk(sizes, budget, full_closes=False):
    batch, used, out = -1, 0, []
    for n in sizes:
        if batch < 0 or (used and used + n > budget) or (full_closes and used >= budget):
            batch, used = batch + 1, 0
        used += n
        out.append(batch)
    return out


@pytest.mark.parametrize("full_closes", [False, True])
def test_chains_over_blocks_equal_the_walk(full_closes):
    rng = random.Random(1)
    for _ in range(1500):
        budget, block = rng.choice([3, 5, 10, 20]), rng.choice([1, 2, 3, 7, 64])
        most = budget if full_closes or rng.random() < 0.5 else 3 * budget
        sizes = [rng.choice([0, 0, rng.randint(0, most), rng.randint(1, max(1, most // 4))]) for _ in range(rng.randrange(1, 60))]
        end = np.cumsum(sizes)
        start, state, begun, got = end - np.array(sizes), ordered.CLOSED, 0, []
        for a in range(0, len(sizes), block):
            s, e = start[a : a + block], end[a : a + block]
            step, count, exits = ordered.chains(s, e, budget, full_closes)
            k, behind = ordered.first_start(state, s, e, budget, full_closes)
            new, j = np.zeros(len(e), int), k
            while j < len(e):
                new[j] = 1
                j = int(step[j])
            got += (begun - 1 + np.cumsum(new)).tolist()
            state, begun = (int(exits[k]), begun + int(count[k])) if k < len(e) else (behind, begun)
        assert got == walk(sizes, budget, full_closes)


def test_one_lane_of_all_rows_is_spread(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 5, 40, 300, 1500]) for _ in range(3000)]
    rows = spark.createDataFrame([(i, n, f"x{i}") for i, n in enumerate(sizes)], "i int, n int, more string").repartition(5)
    for closes in (False, True):
        items = [(i, n) for i, n in enumerate(sizes) if n <= 1000 or not closes]
        df = rows.filter("n <= 1000") if closes else rows
        got = ordered.greedy_batches(df, [], "i", "n", 1000, full_closes=closes, keep=["more"], block=64).collect()
        assert sorted((r.i, r.n, r.batch, r.more) for r in got) == [(i, n, b, f"x{i}") for (i, n), b in zip(items, walk([n for _, n in items], 1000, closes), strict=True)]


def test_lanes_nulls_and_the_last_batch(spark):
    rows = [("a", i, n) for i, n in enumerate([4, None, 4, 3, 5, 8])] + [(None, i, n) for i, n in enumerate([8, 8, 1])] + [("b", 0, 2)]
    t = spark.createDataFrame(rows, "lane string, i int, n int")
    got = sorted(((r.lane or "", r.i, r.batch) for r in ordered.greedy_batches(t, ["lane"], "i", "n", 8, full_closes=True, drop_last=True).collect()))
    assert got == [("", 0, 0), ("", 1, 1), ("a", 0, 0), ("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("a", 4, 1), ("a", 5, 2)]
    assert ordered.greedy_batches(t.limit(0), ["lane"], "i", "n", 8).isEmpty()


def reference_split(sizes, budget, multiple):
    """Packs as a loader does: pieces (item, tokens) of each batch; the open batch at the end too."""
    up = lambda n: -(-n // multiple) * multiple
    batches, held, used = [], [], 0
    for i, n in enumerate(sizes):
        while True:
            if used + up(n) < budget:
                held.append((i, n))
                used += up(n)
                break
            if used + up(n) == budget:
                batches.append([*held, (i, n)])
                held, used = [], 0
                break
            room = (budget - used) // multiple * multiple
            if room <= 0:
                batches.append(held)
                held, used = [], 0
                continue
            batches.append([*held, (i, room)])
            held, used, n = [], 0, n - room
    return batches + ([held] if held else [])


@pytest.mark.parametrize(("budget", "multiple"), [(24, 4), (26, 4), (24, 1), (30, 8)])
def test_split_pack_pads_each_piece(spark, budget, multiple):
    rng = random.Random(budget)
    sizes = [rng.randrange(1, 20) for _ in range(200)]
    got = packing.split_pack(spark.createDataFrame(list(enumerate(sizes)), "i int, n int"), [], "i", "n", budget, multiple).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.batch, r["at"])):
        by.setdefault(r.batch, []).append((r.i, r.stop - r.start))
    assert [by[b] for b in sorted(by)] == reference_split(sizes, budget, multiple)
    assert all(r["at"] % multiple == 0 for r in got)


def test_whole_pack_pads_and_refuses_larger_items(spark):
    sizes = [5, 3, 8, 1, 1, 9, 7, 16, 2]
    t = spark.createDataFrame(list(enumerate(sizes)), "i int, n int")
    got = sorted((r.i, r.n, r.padded, r.batch) for r in packing.whole_pack(t, [], "i", "n", 16, 4, drop_last=False).collect())
    padded = [-(-n // 4) * 4 for n in sizes]
    assert got == [(i, n, p, b) for i, (n, p, b) in enumerate(zip(sizes, padded, walk(padded, 16, True), strict=True))]
    with pytest.raises(Exception, match="exceeds the budget"):
        packing.whole_pack(t, [], "i", "n", 12, 4).collect()


def test_running_sums_of_a_group_of_all_rows(spark):
    rows = [("g", i, i % 7) for i in range(2000)] + [(None, i, 1) for i in range(20)] + [("h", 1, 5)]
    t = spark.createDataFrame(rows, "g string, i int, v int").repartition(6)
    out = ordered.running(t, ["g"], ["i"], {"s": F.col("v").cast("long"), "k": F.lit(1)}, ranges=8)
    total = {}
    want = []
    for g, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        s, k = total.get(g, (0, 0))
        total[g] = (s + v, k + 1)
        want.append((g, i, v, s + v, k + 1))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_ranks_of_one_group_are_ranked_by_many_tasks(spark):
    rng = random.Random(3)
    rows = [("g", rng.random() if i % 3 else 0.5, int(rng.random() < 0.3)) for i in range(1500)]
    t = spark.createDataFrame(rows, "g string, s double, y int")
    pos, neg = [r[1] for r in rows if r[2]], [r[1] for r in rows if not r[2]]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    assert scores.rank_auc(t, "s", "y", "g").first().auc == pytest.approx(auc)
    assert scores.mann_whitney(t, "s", "y", "g").first().u == pytest.approx(auc * len(pos) * len(neg))


def test_comparisons_take_means_per_item_first(spark):
    rows = [(i, kind, float(i % 5) + k, float(-i)) for i in range(40) for k, kind in enumerate(["case A" if i % 2 else "control", "case A"][: 1 + i % 2])]
    rows += [(99, None, 1.0, 1.0), (98, "case B", None, 2.0)]
    t = spark.createDataFrame(rows, "item int, kind string, a double, b double")
    got = {(r.model, r.case): r for r in scores.comparison_tests(t, "item", "kind", ["a", "b"], [("case", "control"), ("case B", "control")]).collect()}
    case, control = [i % 5 + 0.5 for i in range(1, 40, 2)], [float(i % 5) for i in range(0, 40, 2)]
    assert got["a", "case"].n_case == 20 and got["a", "case"].n_control == 20
    assert got["a", "case"].u == sum((p > q) + (p == q) / 2 for p in case for q in control)
    assert got["b", "case B"].n_case == 1 and got["a", "case B"].u is None
