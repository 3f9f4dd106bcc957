import random

from pyspark.sql import functions as F

from genespark.operators import intervals as I

RNG = random.Random(3)


def random_intervals(n):
    return [("c%d" % RNG.randrange(2), s, s + RNG.randrange(1, 60), "g%03d" % i) for i, s in ((i, RNG.randrange(0, 500)) for i in range(n))]


def test_annotation_picks_the_first_of_overlapping_genes(spark, partitions):
    iv = random_intervals(60) + [("c0", 10, 400, "long"), ("c0", 10, 400, "alsolong")]
    points = [("c%d" % c, p) for c in range(3) for p in range(0, 560, 3)]
    genes = spark.createDataFrame(iv, "chrom string, start long, end long, name string")
    pts = spark.createDataFrame(points, "chrom string, pos long")
    got = {(r.chrom, r.pos): r.gene for r in I.interval_annotation(pts, genes).collect()}
    for c, p in points:
        hits = sorted((s, e, n) for ch, s, e, n in iv if ch == c and s <= p < e)
        assert got[(c, p)] == (hits[0][2] if hits else ""), (c, p)


def test_touching_borders(spark):
    iv = spark.createDataFrame([("c", 10, 20, "g")], "chrom string, start long, end long, name string")
    pts = spark.createDataFrame([("c", p) for p in (9, 10, 11, 19, 20, 21)], "chrom string, pos long")
    assert sorted(r.pos for r in I.region_filter(pts, iv).collect()) == [11, 19, 20]
    assert sorted(r.pos for r in I.interval_annotation(pts, iv).filter("gene = 'g'").collect()) == [10, 11, 19]
    blocks = iv.withColumn("sample", F.lit("s"))
    gts = pts.withColumn("sample", F.lit("s")).withColumn("site_id", F.col("pos")).withColumn("gt", F.lit(1))
    # closed ends; sites that lose their only call disappear
    assert sorted(r.pos for r in I.interval_mask(gts, blocks).collect()) == [9, 21]


def test_repeated_points_and_one_hot_interval(spark):
    iv = spark.createDataFrame([("c", 0, 1000000, "g")] + [("c", 5, 6 + i, "h%d" % i) for i in range(50)], "chrom string, start long, end long, name string")
    pts = spark.createDataFrame([("c", 5)] * 40 + [("c", 999999)], "chrom string, pos long")
    assert I.interval_annotation(pts, iv).filter("gene = 'g'").count() == 41


def test_mappability(spark):
    seg = spark.createDataFrame([("c", 0, 10, 1.0), ("c", 10, 20, 0.5), ("c", 30, 40, 0.2)], "chrom string, start long, end long, score double")
    win = spark.createDataFrame([("c", 5, 15), ("c", 18, 32), ("c", 40, 50), ("d", 0, 4)], "chrom string, start long, end long")
    got = {(r.chrom, r.start): round(r.mappability, 9) for r in I.mappability_window(win, seg).collect()}
    assert got == {("c", 5): 0.75, ("c", 18): round((2 * 0.5 + 2 * 0.2) / 14, 9), ("c", 40): 0.0, ("d", 0): 0.0}


def test_target_window(spark):
    dep = spark.createDataFrame([("c", p, p % 4) for p in range(1, 60)], "chrom string, pos long, dp int")
    tgt = spark.createDataFrame([("c", 20), ("c", 25), ("c", 500)], "chrom string, pos long")
    for r in I.target_window_coverage(dep, tgt, 10).collect():
        near = [p % 4 for p in range(1, 60) if abs(p - r.target) <= 5]
        assert r.area == sum(near) and r.nonzero == sum(1 for x in near if x) and r.max_depth == max(near, default=0)


def test_aggregates_over_deep_overlaps(spark, partitions):
    rng = random.Random(8)
    iv = [("c", a, a + rng.randrange(1, 400)) for a in (rng.randrange(0, 900) for _ in range(150))] + [("c", 0, 1300), ("c", 5, 5), ("d", 1, 9), ("c", 0, 1300)]
    pts = [("c", rng.randrange(-20, 1400), rng.choice([None, *range(-9, 10)])) for _ in range(700)]
    bins = spark.createDataFrame(iv, "chrom string, start long, end long")
    out = I.interval_aggregate(bins, spark.createDataFrame(pts, "chrom string, pos0 long, x int"), "x").collect()
    assert len(out) == len(iv)
    for r in out:
        here = [x for c, p, x in pts if c == r.chrom and r.start <= p < r.end]
        known = [x for x in here if x is not None]
        if not here:
            assert r.n is None
        else:
            assert (r.n, r.total, r.low, r.high) == (len(known), sum(known) if known else None, min(known, default=None), max(known, default=None))


def test_rows_do_not_grow_with_the_depth_of_overlap(spark):
    """A span is made of two nodes a level at most, however many spans lie over a point."""
    pts = spark.range(2000).select(F.lit("c").alias("chrom"), F.col("id").alias("p"), F.lit(1).alias("x"))
    deep = spark.range(1000).select(F.lit("c").alias("chrom"), F.col("id").alias("_start"), (F.lit(2000) - F.col("id")).alias("_end"))
    out = I.over_spans(deep, pts, ["chrom"], "p", {"n": (F.sum, "x")})
    assert {r._start: r.n for r in out.collect()} == {k: 2000 - 2 * k for k in range(1000)}
    plan = out._jdf.queryExecution().executedPlan()
    rows = [int(m) for m in _join_rows(spark, plan)]
    assert rows and max(rows) < 2000 * 24  # 1,001,000 pairs of a span and a point


def _join_rows(spark, plan):
    def walk(node):
        if "Join" in node.nodeName():
            m = node.metrics().get("numOutputRows")
            if m.isDefined():
                yield m.get().value()
        if node.nodeName() == "AdaptiveSparkPlan":
            yield from walk(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            yield from walk(node.plan())
        for k in range(node.children().size()):
            yield from walk(node.children().apply(k))

    return list(walk(plan))


def test_bin_median(spark):
    pts = [("c", p, float(p * 7 % 13)) for p in range(95)] + [("c", 12, None)]
    for r in I.bin_aggregate(spark.createDataFrame(pts, "chrom string, start long, x double"), "x", 20).collect():
        here = sorted(x for _, p, x in pts if r.bin_start <= p < r.bin_end and x is not None)
        mid = len(here) // 2
        assert r.median == (here[mid] if len(here) % 2 else (here[mid - 1] + here[mid]) / 2)
