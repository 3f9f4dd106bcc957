import math
import random
import re

import pytest
from pyspark.sql import functions as F

from genespark.operators import pairs, popgen, tiling, variants

RNG = random.Random(11)
SCHEMA = "site_id long, chrom int, pos long, idx int, sample string, grp string, gt int"


def genotypes(spark, sites=80, people=9, missing=0.15):
    rows = []
    for s in range(sites):
        for i in range(people):
            gt = None if RNG.random() < missing else RNG.choice([0, 0, 1, 2, 2])
            rows.append((s, s % 3, 10 + s * 7, i, f"S{i}", f"P{i % 4}", gt))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def freq(rows, site, grp):
    g = [r[6] for r in rows if r[0] == site and r[5] == grp and r[6] is not None]
    return (sum(g) / (2 * len(g))) if g else None


def test_d_statistic_brute_force(spark, partitions):
    rows, df = genotypes(spark)
    num = den = n = baba = 0
    for s in range(80):
        f = [freq(rows, s, g) for g in ("P0", "P1", "P2", "P3")]
        if None in f:
            continue
        w, x, y, z = f
        n += 1
        num += (w - x) * (y - z)
        den += (w + x - 2 * w * x) * (y + z - 2 * y * z)
        baba += (w - x) * (y - z) > 0
    r = popgen.d_statistic(df, {"t": ("P0", "P1", "P2", "P3")}).first()
    assert r.covered == n and r.baba == baba and math.isclose(r.d, num / den)


def test_all_missing_site_and_zero_denominator(spark):
    rows = [(0, 1, 1, i, f"S{i}", f"P{i}", None) for i in range(4)] + [(1, 1, 2, i, f"S{i}", f"P{i}", 2) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert popgen.allele_freq_by_group(df).count() == 4
    r = popgen.d_statistic(df, {"t": ("P0", "P1", "P2", "P3")}).first()
    assert (r.d, r.covered) == (0.0, 1)


def test_block_with_one_site_is_kept(spark):
    rows = [(s, 1, p, i, f"S{i}", f"P{i}", 2 * ((s + i) % 2)) for s, p in enumerate((1, 5, 1000)) for i in range(4)]
    b = popgen.abba_baba_blocks(spark.createDataFrame(rows, SCHEMA), {"t": ("P0", "P1", "P2", "P3")}, 100, mode="greedy")
    assert sorted((r.block, r.nsites) for r in b.collect()) == [(1, 2), (1000, 1)]


def test_drawn_patterns_add_up_and_do_not_depend_on_partitions(spark, partitions):
    RNG.seed(5)
    _, df = genotypes(spark)
    b = popgen.abba_baba_blocks(df, {"t": ("P0", "P1", "P2", "P3")}, 200)
    got = sorted(tuple(r) for r in b.select("chrom", "block", "nsites", *popgen.PATTERNS).collect())
    for row in got:
        assert row[2] == sum(row[3:])
    test_drawn_patterns_add_up_and_do_not_depend_on_partitions.seen = getattr(
        test_drawn_patterns_add_up_and_do_not_depend_on_partitions, "seen", got)
    assert got == test_drawn_patterns_add_up_and_do_not_depend_on_partitions.seen


def test_pair_counts_of_many_individuals_on_bit_planes(spark):
    rng = random.Random(11)
    calls = {(c, s, k): rng.choice([0, 1, 2, None]) for c in "ab" for s in range(150) for k in range(0, 210, 3) if rng.random() < 0.7}
    rows = [(c, s * 10, f"k{s % 3}", k, f"I{k}", g) for (c, s, k), g in calls.items()]
    df = spark.createDataFrame(rows, "chrom string, pos long, class string, idx int, sample string, gt int").repartition(6)
    want = {}
    for c in "ab":
        for s in range(150):
            here = [(k, calls[c, s, k]) for k in range(0, 210, 3) if calls.get((c, s, k)) is not None]
            for n, (k, g) in enumerate(here):
                for other, h in here[n + 1 :]:
                    w = want.setdefault((f"k{s % 3}", f"I{k}", f"I{other}"), [0, 0, 0])
                    w[0], w[1], w[2] = w[0] + (g != h), w[1] + 1, w[2] + abs(g - h)
    for block in (64, 1 << 13):
        out = pairs.pair_counts(df, ["class"], site_block=block).collect()
        assert {(r["class"], r.i, r.j): [r.differ, r.comparable, r.weight] for r in out} == want
    # a call crosses the network as two bits of a long: sites times longs, and sums of pairs
    assert pairs.pair_counts(df.limit(0), ["class"]).collect() == []


def test_pairwise_distance_with_many_blocks(spark):
    rows, df = genotypes(spark)
    got = {(r.i, r.j): (r.differ, r.comparable) for r in pairs.pairwise_distance(df, site_block=7).collect()}
    by = {(r[0], r[3]): r[6] for r in rows}
    want = {}
    for i in range(9):
        for j in range(i + 1, 9):
            both = [(by[s, i], by[s, j]) for s in range(80) if by[s, i] in (0, 2) and by[s, j] in (0, 2)]
            if both:
                want[(f"S{i}", f"S{j}")] = (sum(a != b for a, b in both), len(both))
    assert got == want


def theta(n, s, h):
    r, tot = len(n), sum(n)
    if sum(s) in (0, tot):
        return 0.0
    if min(n) == 0:
        return None
    p = sum(s) / tot
    inds = tot / 2
    nbar, hbar = inds / r, sum(h) / inds
    nc = (inds - sum(x * x for x in n) / 4 / inds) / (r - 1)
    if nbar <= 1 or nc == 0:
        return None
    s2 = sum(x * (a / x - p) ** 2 for x, a in zip(n, s)) / ((r - 1) * nbar) / 2
    inner = p * (1 - p) - s2 * (r - 1) / r
    a = nbar / nc * (s2 - (inner - hbar / 4) / (nbar - 1))
    b = nbar / (nbar - 1) * (inner - hbar * (2 * nbar - 1) / (4 * nbar))
    return a / (a + b + hbar / 2) if a + b + hbar / 2 else None


def test_fst_jackknife_equals_leaving_out_every_pair(spark):
    rows, df = genotypes(spark, sites=25, people=12)
    got = {r.site_id: r for r in popgen.fst_jackknife(df, ["P0", "P1"]).collect()}
    for s in range(25):
        g = {p: [r[6] for r in rows if r[0] == s and r[5] == p and r[6] is not None] for p in ("P0", "P1")}
        f = []
        for i in range(len(g["P0"])):
            for j in range(len(g["P1"])):
                a, b = g["P0"][:i] + g["P0"][i + 1 :], g["P1"][:j] + g["P1"][j + 1 :]
                t = theta([2 * len(a), 2 * len(b)], [sum(a), sum(b)], [a.count(1), b.count(1)])
                if t is not None:
                    f.append(t)
        if not f:
            assert s not in got
            continue
        m = sum(f) / len(f)
        assert got[s].replicates == len(f) and math.isclose(got[s].fst_mean, m, abs_tol=1e-9)
        sd = math.sqrt(sum((x - m) ** 2 for x in f) * (len(f) - 1) / len(f))
        assert math.isclose(got[s].ci_high, m + 1.97 * sd, abs_tol=1e-6)


def test_hypergeometric_tail(spark):
    from genespark.functions.special import hypergeom_tail

    exact = lambda x, N, K, n: sum(math.comb(K, k) * math.comb(N - K, n - k) for k in range(x, min(K, n) + 1)) / math.comb(N, n)
    for args in ((3, 20, 7, 9), (0, 20, 7, 9), (7, 20, 7, 9), (40, 500, 100, 120)):
        assert hypergeom_tail(*args) == pytest.approx(exact(*args), rel=1e-9)


def test_zscore_of_unknown_is_zero(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "f double")
    assert sorted(r.z for r in popgen.zscore_column(df, "f").collect()) == [-1.0, 0.0, 1.0]


def test_spacing_drops_both_close_sites(spark):
    df = spark.createDataFrame([(1, 100), (1, 105), (1, 300)], "chrom int, pos long")
    assert [r.pos for r in variants.snp_min_spacing(df, 50).collect()] == [300]


def test_few_calls_give_unknown_homozygosity(spark):
    rows = [(s, 1, s + 1, 0, "S0", "P0", 2) for s in range(9)] + [(s, 1, s + 101, 0, "S0", "P0", 2 if s % 2 else None) for s in range(40)]
    w = variants.roh_windows(spark.createDataFrame(rows, SCHEMA), 100, 100)
    got = {r.start: (r.n, r.miss, r.roh) for r in w.collect()}
    assert got == {0: (9, 0, None), 100: (20, 20, None)}


@pytest.mark.parametrize("rows_known", [False, True])
@pytest.mark.parametrize("window, step", [(50, 4), (10, 25), (20, 20)])
def test_windows_by_tiles(spark, monkeypatch, rows_known, window, step):
    monkeypatch.setattr(tiling, "TASK_ROWS", 50, raising=False)
    monkeypatch.setattr(variants, "WINDOW_TILE", 2, raising=False)
    rows = [(RNG.choice(["S1", "S2", None]), RNG.choice([1, 2, None]), p, RNG.choice([0, 1, 2, None]), RNG.randint(3, 70)) for p in RNG.sample(range(1, 1500), 800)]
    rows += rows[:100] + [("S1", 1, None, 0, 10), ("S3", 1, None, 0, 10)]
    df = spark.createDataFrame(rows, "sample string, chrom int, pos long, gt int, dp int").repartition(3)
    ends = spark.createDataFrame([(1, 1403), (3, 9)], "chrom int, length long")
    known = {"rows": len(rows)} if rows_known else {}
    got = variants.sliding_homozygosity(df, window, step, 5, 60, ends, **known)
    unit = math.gcd(window, step)
    good = [(s, c, p and (p - 1) // unit, g) for s, c, p, g, d in rows if g is not None and 5 <= d <= 60]
    want = []
    for s, c in {r[:2] for r in good}:
        at = [(u, g) for t, d, u, g in good if (t, d) == (s, c) and u is not None]
        for k in range(max(0, (max(u for u, _ in at) - window // unit + 1) * unit // step if at else 0) + 1):
            inside = [g for u, g in at if k * step <= u * unit < k * step + window] if s and c else []
            end = k * step + window
            want.append((s, c, k * step, min(end, 1403) if c == 1 else end, len(inside), sum(g != 1 for g in inside)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    if rows_known:
        assert len(rows) // 50 + 1 == 19 and "hashpartitioning(sample, chrom, _tile, 19)" in re.sub(r"#\d+L?", "", got._jdf.queryExecution().executedPlan().toString())


def test_calls_are_dealt_out_by_their_rows(spark, tmp_path, monkeypatch):
    from genespark.plans import views

    monkeypatch.setattr(tiling, "TASK_ROWS", 100, raising=False)
    flags = ["", "A", "AB", "N", "NA", "R", None]
    rows = [(RNG.choice([*range(150), None]), RNG.choice([1, 2, None]), RNG.choice(flags), RNG.choice([0.0, 0.05, None]), float(RNG.randint(1, 50)), 0.01 * RNG.randint(0, 8)) for _ in range(1500)]
    schema = "l_orderkey long, l_linenumber int, l_returnflag string, l_discount double, l_quantity double, l_tax double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    groups = {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r[2:])
    want = {}
    for key, rs in groups.items():
        flag = min((f for f, *_ in rs if f is not None), default=None)
        least = min((m for _, m, *_ in rs if m is not None), default=None)
        want[key] = ({"A": 0, "N": 1}.get(flag, 2) if least else None, sum(int(q) for *_, q, _ in rs), round(sum(t for *_, t in rs) * 1000))
    calls = views.calls(spark, str(tmp_path))
    assert {(r.site_id, r.idx): (r.gt, r.dp, r.qual) for r in calls.collect()} == want
    assert calls.rdd.getNumPartitions() == 16


def test_spaced_topologies(spark):
    rows = [(s, 1, s * 10, i, n, n, (0, 0, 2)[i]) for s in range(10) for i, n in enumerate("abc")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("qual", F.lit(30.0)).withColumn("ref", F.lit("A")).withColumn("alt", F.lit("C"))
    got = {r.spacing: (r.ab, r.bc, r.ac) for r in popgen.topology_counts(df, ("a", "b", "c"), (0, 20, 25)).collect()}
    assert got == {0: (10, 0, 0), 20: (5, 0, 0), 25: (4, 0, 0)}
