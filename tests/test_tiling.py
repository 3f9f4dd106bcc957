"""Ordered helpers against plain Python, with tiles small enough that borders matter."""

import random

import numpy as np
from pyspark.sql import functions as F

from genespark.operators import tiling

RNG = random.Random(7)
POS = {c: sorted(RNG.sample(range(1, 400), n)) for c, n in (("a", 120), ("b", 7), ("c", 1))}


def frame(spark):
    return spark.createDataFrame([(c, p, p % 5) for c, ps in POS.items() for p in ps], "chrom string, pos long, x int").repartition(5)


def test_neighbours(spark, partitions):
    t = tiling.with_neighbour(frame(spark), ["chrom"], "pos", "pos", "prev", size=10)
    t = tiling.with_neighbour(t, ["chrom"], "pos", "pos", "next", size=10, side="next")
    for r in t.collect():
        ps = POS[r.chrom]
        i = ps.index(r.pos)
        assert r.prev == (ps[i - 1] if i else None)
        assert r.next == (ps[i + 1] if i + 1 < len(ps) else None)


def test_running_sum_and_row_numbers(spark, partitions):
    t = tiling.row_numbers(tiling.running_sum(frame(spark), ["chrom"], "pos", {"s": F.col("x")}, size=16), ["chrom"], "pos", size=9)
    for r in t.collect():
        ps = POS[r.chrom]
        i = ps.index(r.pos)
        assert r.rn == i + 1
        assert r.s == sum(p % 5 for p in ps[: i + 1])


def test_rolling_rows(spark):
    t = tiling.rolling_rows(frame(spark), ["chrom"], "pos", 6, {"s": F.sum("x"), "n": F.count("x")}, size=10, bucket=8)
    rows = t.collect()
    assert len(rows) == sum(map(len, POS.values()))
    for r in rows:
        ps = POS[r.chrom]
        i = ps.index(r.pos)
        window = ps[max(0, i - 5) : i + 1]
        assert (r.s, r.n) == (sum(p % 5 for p in window), len(window))


def greedy(ps, gap):
    out, last = {}, None
    for p in ps:
        if last is None or p > last + gap:
            last = p
        out[p] = last
    return out


def test_greedy_anchors(spark):
    # chained step functions, then the tree: gaps under a tile, of a few tiles, and past the whole axis
    for gap, sizes in ((0, (8, 32)), (1, (64,)), (7, (8, 32, 1 << 20)), (25, (8, 32)), (90, (8, 1 << 20)), (1000, (32,))):
        for size in sizes:
            t = tiling.greedy_anchors(frame(spark), ["chrom"], "pos", gap, size=size)
            got = {(r.chrom, r.pos): r.anchor for r in t.collect()}
            want = {(c, p): a for c, ps in POS.items() for p, a in greedy(ps, gap).items()}
            assert got == want, (gap, size)


def test_no_task_holds_more_than_a_tile_of_a_wide_gap(spark):
    ps = [7 * k + k * k % 5 for k in range(3000)]
    df = spark.createDataFrame([("a", p) for p in ps], "chrom string, pos long")
    for gap in (999, 5000):
        t = tiling.greedy_anchors(df, ["chrom"], "pos", gap, size=1000)
        plan = t._jdf.queryExecution().toString()
        assert "FlatMapGroupsInPandas" not in plan or gap < 1000
        assert {r.pos: r.anchor for r in t.collect()} == greedy(ps, gap)


def test_exact_quantiles_with_heavy_ties(spark, partitions):
    values = [3.0] * 500 + [RNG.random() * 10 for _ in range(300)] + [None]
    df = spark.createDataFrame([("k", v) for v in values] + [("one", 4.0)], "k string, v double").repartition(3)
    got = {r.k: r for r in tiling.exact_quantiles(df, ["k"], "v", [0.0, 0.025, 0.5, 0.9, 1.0]).collect()}
    want = np.percentile([v for v in values if v is not None], [0, 2.5, 50, 90, 100])
    np.testing.assert_allclose([got["k"][f"q{i}"] for i in range(5)], want)
    assert got["one"].q2 == 4.0


def test_average_ranks(spark):
    values = [RNG.randrange(6) for _ in range(60)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")
    for r in tiling.average_ranks(df, [], "v", "rank").collect():
        below, same = sum(x < r.v for x in values), sum(x == r.v for x in values)
        assert r["rank"] == below + (same + 1) / 2


def test_hash_rank_is_a_permutation_whatever_the_partitions(spark, partitions):
    df = spark.range(300).repartition(partitions)
    ranks = {r.id: r["rank"] for r in tiling.hash_rank(df, [], ["id"], 3).collect()}
    assert sorted(ranks.values()) == list(range(1, 301))
    again = {r.id: r["rank"] for r in tiling.hash_rank(spark.range(300), [], ["id"], 3).collect()}
    assert ranks == again
