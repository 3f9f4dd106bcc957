import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from genespark.functions import special
from genespark.operators import glm
from genespark.operators import metadata as D
from genespark.operators import methylation as M
from genespark.operators import stats as T
from genespark.operators import tiling, variants

RNG = random.Random(9)


def test_autocovariance_by_all_pairs(spark):
    pos = sorted(RNG.sample(range(3000), 700))
    rows = [("a", p, RNG.random()) for p in pos] + [("b", p, RNG.random()) for p in pos[:300]]
    df = spark.createDataFrame(rows, "chrom string, pos long, level double").repartition(3)
    got = {r.lag: (r.n, r.cov, r.cor) for r in M.meth_autocovariance(df, max_dist=200, least=5, tile=512).collect()}
    v = np.array([r[2] for r in rows])
    m, var = v.mean(), v.var(ddof=1)
    acc = {}
    for c in "ab":
        part = [(p, x) for ch, p, x in rows if ch == c]
        for i, (p, x) in enumerate(part):
            for q, y in part[i + 1 :]:
                if q - p < 200:
                    acc.setdefault((q - p) // 10 * 10, []).append((x - m) * (y - m))
    want = {k: xs for k, xs in acc.items() if k > 0}
    assert set(got) == set(want)
    for k, xs in want.items():
        assert got[k][0] == len(xs)
        assert math.isclose(got[k][1], sum(xs) / (len(xs) - 1), abs_tol=1e-10)
        assert math.isclose(got[k][2], got[k][1] / var, abs_tol=1e-12)


def test_pileup_with_gaps_and_clips(spark):
    # one forward read over a reference with a deletion: positions behind it shift by two
    ref = spark.createDataFrame([("c", "ACGTTCGCA")], "name string, seq string")
    cols = "chrom string, pos0 int, cigar string, rev boolean, s1 string, s2 string, q1 string, q2 string"
    aln = spark.createDataFrame([("c", 1, "2M2D2M", False, "CGCG", "GCGC", "IIII", "II!I")], cols)
    pairs = {r.pos0: r.pair for r in M.aligned_pairs(aln, min_base_quality=20).collect()}
    assert pairs == {1: "CC", 2: "GG", 6: "GG"}
    cyt = {(r.pos0, r.strand): r.context for r in M.reference_cytosines(ref, size=4).collect()}
    assert cyt == {(1, "+"): "CGT", (2, "-"): "CGT", (5, "+"): "CGC", (6, "-"): "CGA", (7, "+"): "CAN"}


def test_jeffreys_and_special_functions(spark):
    # published values: Jeffreys 95% interval of 0/10 upper bound, and symmetric 5/10
    lo, hi = special.beta_quantile(5.5, 5.5, [0.025, 0.975])
    assert math.isclose(lo + hi, 1.0, abs_tol=1e-9) and math.isclose(lo, 0.2235287, abs_tol=1e-6)
    assert math.isclose(float(special.beta_quantile(0.5, 10.5, 0.975)), 0.2171963, abs_tol=1e-5)
    assert math.isclose(float(special.gamma_upper(0.5, 10.8276 / 2)), 0.001, rel_tol=1e-3)
    assert math.isclose(float(special.gamma_upper(2.0, 0.3)), math.exp(-0.3) * 1.3, rel_tol=1e-9)
    for a, b, x in ((1, 3, 0.2), (4, 2, 0.7), (30, 5, 0.9)):
        n = a + b - 1
        exact = sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1))
        assert math.isclose(float(special.betainc(a, b, x)), exact, rel_tol=1e-9)


def test_sex_calls(spark):
    # even dosage is female, half the X is male, in between is undecided
    rows = [(s, c, n, l) for s, nx in (("f", 1000), ("m", 500), ("u", 700)) for c, n, l in (("X", nx, 100), ("1", 9000, 900))]
    df = spark.createDataFrame(rows, "sample string, contig string, nreads long, len long")
    got = {r["sample"]: (r.sex, round(r.rx, 2)) for r in D.sex_read_dosage(df, ["X"], intervals=True).collect()}
    assert got["f"] == ("F", 1.0) and got["m"][0] == "M" and got["u"][0] == "U" and 0.6 < got["u"][1] < 0.8


def test_known_sex_row(spark):
    # read counts and dosage of a published sample table row
    nx, na, lx, la = 4000, 100000, 149, 2500
    df = spark.createDataFrame([("s", "X", nx, lx), ("s", "1", na, la)], "sample string, contig string, nreads long, len long")
    r = D.sex_read_dosage(df, ["X"]).first()
    p0, p1 = lx / (lx + 2 * la), lx / (lx + la)
    llr = nx * math.log(p0 / p1) + na * math.log((1 - p0) / (1 - p1))
    assert math.isclose(r.llr, llr) and math.isclose(r.rx, nx / (nx + na) / (2 * p0 if llr > 0 else p1))


def logistic(x, y):
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ b))
    return b, np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x), -2 * np.sum(np.log(np.where(y == 1, p, 1 - p)))


def test_logistic_model_and_likelihood_ratio(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-0.7 * x + 0.3))).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    b, cov, dev = logistic(np.c_[x, np.ones(300)], y)
    got = {r.term: r for r in T.logistic_model(df, "y", ["x"]).collect()}
    assert math.isclose(got["x"].estimate, b[0], rel_tol=1e-5) and math.isclose(got["intercept"].estimate, b[1], rel_tol=1e-5)
    assert math.isclose(got["x"].std_error, math.sqrt(cov[0, 0]), rel_tol=1e-4)
    r = T.likelihood_ratio_table(df, "y", {"x": ["x"]}).first()
    p0 = y.mean()
    null = -2 * np.sum(np.log(np.where(y == 1, p0, 1 - p0)))
    assert math.isclose(r.deviance, null - dev, rel_tol=1e-6) and r.df == 1 and 0 < r.p < 1
    fit = T.predicted_interval(df, "y", "x", [0.5]).first()
    se = math.sqrt(np.array([0.5, 1]) @ cov @ np.array([0.5, 1]))
    assert math.isclose(fit.upper, 1 / (1 + math.exp(-(b @ [0.5, 1] + 2 * se))), rel_tol=1e-4)
    poly, names = T.with_powers(df, "x", 2)
    assert names == ["x", "x_2"] and T.logistic_model(poly, "y", names).count() == 3


def test_all_models_in_one_pass(spark, partitions):
    rng = np.random.default_rng(6)
    n = 400
    a, b, g = rng.normal(50, 3, n), rng.normal(0, 1e-3, n), rng.integers(0, 3, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 * (a - 50) + 500 * b + 0.5 * (g == 1))))).astype(int)
    rows = [(float(p), float(q), "uvw"[k], int(r), i) for i, (p, q, k, r) in enumerate(zip(a, b, g, y))]
    rows += [(None, 1.0, "u", 1, -1), (1.0, 1.0, "u", None, -2), (1.0, 1.0, None, 1, -3)]
    df = spark.createDataFrame(rows, "a double, b double, g string, y int, i long")
    models = [(), ("a",), ("a", "b", "a:b"), ("g", "b")]
    fits = glm.fit_all(df, "y", models, ("true", "i % 2 = 0", "i > 1000"))
    order = [l for _, l in sorted((-int(np.sum(g == k)), l) for k, l in enumerate("uvw"))][:-1]
    for cond, m in (("true", np.ones(n, bool)), ("i % 2 = 0", np.arange(n) % 2 == 0)):
        one = np.ones(n)
        designs = [[one], [a, one], [a, b, a * b, one], [*[(np.array(list("uvw"))[g] == l).astype(float) for l in order], b, one]]
        for terms, x in zip(models, designs):
            x = np.c_[tuple(x)][m]
            want, cov, dev = logistic_scaled(x, y[m])
            fit = fits[cond, terms]
            assert fit.rows == m.sum() and fit.rank == x.shape[1] and math.isclose(fit.deviance, dev, rel_tol=1e-9)
            np.testing.assert_allclose(fit.beta, want, rtol=1e-4, atol=1e-6)
            np.testing.assert_allclose(np.sqrt(np.diag(fit.cov)), np.sqrt(np.diag(cov)), rtol=1e-4)
    assert fits["true", ("g", "b")].names == [*[f"g_{l}" for l in order], "b", "intercept"]
    assert fits["i > 1000", ("a",)].rows == 0 and fits["i > 1000", ("a",)].rank == 0


def logistic_scaled(x, y):
    """As ``logistic``, on scaled columns so that it stays in range."""
    m, s = np.r_[x[:, :-1].mean(axis=0), 0.0], np.r_[x[:, :-1].std(axis=0), 1.0]
    b, cov, dev = logistic((x - m) / s, y)
    back = np.diag(1 / s)
    back[-1, :] -= m / s
    return back @ b, back @ cov @ back.T, dev


def test_separated_and_repeated_columns(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i >= 10), 7.0) for i in range(20)], "a double, b double, y double, c double")
    apart = glm.fit_all(df, "y", [("a",)])["true", ("a",)]
    assert apart.deviance < 1e-6
    df = df.withColumn("y", ((F.col("a") * 7) % 3 > 1).cast("double"))
    fits = glm.fit_all(df, "y", [("a",), ("a", "b"), ("c",), ()])
    assert fits["true", ("a", "b")].rank == 2 and fits["true", ("c",)].rank == 1
    assert math.isclose(fits["true", ("a", "b")].deviance, fits["true", ("a",)].deviance, rel_tol=1e-9)
    assert math.isclose(fits["true", ("c",)].deviance, fits["true", ()].deviance, rel_tol=1e-9)


def test_distance_of_distributions_with_heavy_values(spark, partitions):
    rng = random.Random(12)
    rows = [(i, "a" if rng.random() < 0.4 else "b", float(rng.choice([3, 3, 3, 7, 7, *range(60)]))) for i in range(700)] + [(900, "a", None)]
    df = spark.createDataFrame(rows, "id long, g string, x double")
    known = [r for r in rows if r[2] is not None]
    a, b = [r[2] for r in known if r[1] == "a"], [r[2] for r in known if r[1] == "b"]
    want = sum((sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) ** 2 for _, _, x in known)
    results = [T.cramer_von_mises_test(df, "id", "x", "g", "a", replicates=40, size=size).first() for size in (16, 50, 4096)]
    for r in results:
        assert math.isclose(r.statistic, want, rel_tol=1e-9) and r.replicates == 40
    # the labels depend on the row only, so the units do not change the p value, and labels dealt at random are no outlier
    assert len({r.p for r in results}) == 1 and results[0].p > 0.0


def test_labels_are_dealt_evenly():
    ids = np.arange(5000, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    got = T._first_group(ids, np.zeros(5000, bool), 0.3, 64, 1)
    assert not got[:, 0].any()
    share = got[:, 1:].mean(axis=0)
    assert np.all(np.abs(share - 0.3) < 5 * math.sqrt(0.21 / 5000))
    between = np.corrcoef(got[:, 1:], rowvar=False) - np.eye(64)
    assert np.abs(between).max() < 6 / math.sqrt(5000)


def test_permutation_tests_find_a_shift(spark, partitions):
    rows = [(i, "a" if i % 2 else "b", float(i % 2) * 3 + RNG.random(), RNG.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    r = T.cramer_von_mises_test(df, "id", "x", "g", "a", replicates=30).first()
    assert math.isclose(r.statistic, sum((i / 30) ** 2 for i in range(1, 31)) * 1 + sum((1 - i / 30) ** 2 for i in range(1, 31))) and r.p == 0.0
    k = T.mmd_kernel_test(df, "id", "x", "y", "g", "a", [1.0, 5.0], replicates=30, block=16).first()
    best = -9.0
    for s in (1.0, 5.0):
        t = sum((1 / 30 if a[1] == "a" else -1 / 30) * (1 / 30 if b[1] == "a" else -1 / 30) * math.exp(-math.hypot(a[2] - b[2], a[3] - b[3]) / s)
                for a in rows for b in rows if a[0] != b[0])
        best = max(best, t)
    assert math.isclose(k.statistic, best, rel_tol=1e-9) and k.p == 0.0


def test_kernel_test_on_shared_places(spark, partitions):
    # some places hold many rows, the others one
    rows = [(i, "a" if i % 3 else "b", float(i % 5), 0.5) for i in range(40)] + [(i, "a" if i % 2 else "b", float(RNG.random()) * 9, float(RNG.random())) for i in range(40, 90)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    m, n, seed = sum(r[1] == "a" for r in rows), len(rows), 3
    labels = {(r.id, r.rep): r.in_first for r in T.permuted_labels(df, "id", "g", "a", 6, seed).collect()}
    reps = df.select("id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("rep"))
    for r in tiling.hash_rank(reps, ["rep"], ["id", "rep"], seed, "k").collect():
        assert labels[r.id, r.rep] == (r["k"] <= m if r.rep else rows[r.id][1] == "a")
    assert all(sum(labels[i, rep] for i in range(n)) == m for rep in range(7))

    def statistic(rep):
        w = [1 / m if labels[i, rep] else -1 / (n - m) for i in range(n)]
        return max(sum(w[i] * w[j] * math.exp(-math.hypot(a[2] - b[2], a[3] - b[3]) / s) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j) for s in (1.0, 5.0))

    got = T.mmd_kernel_test(df, "id", "x", "y", "g", "a", [1.0, 5.0], replicates=6, seed=seed, block=8).first()
    seen = statistic(0)
    assert math.isclose(got.statistic, seen, rel_tol=1e-9) and math.isclose(got.p, sum(statistic(r) > seen for r in range(1, 7)) / 6)


def test_kernel_test_without_a_coordinate_is_null(spark):
    rows = [(i, "a" if i % 2 else "b", None if i == 7 else float(i), 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    assert T.mmd_kernel_test(df, "id", "x", "y", "g", "a", [1.0], replicates=3, block=8).first().statistic is None


def test_methylation_view_groups_once(spark, tmp_path):
    from genespark.plans import views

    rows = [(p, s, f) for p in (1, 2, 3, 5, 6, 11, None) for s in (1, 6, 38, None) for f in ("R", "N", "R", None)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {}
    for p, s, f in rows:
        start = None if p is None or s is None else p * 40 + s % 37
        key = (None if s is None else s % 5 + 1, start, "+" if p is not None and p % 2 == 0 else "-", "CHH" if p is None else ("CpG", "CHG", "CHH")[p % 3])
        n = want.setdefault(key, [0, 0])
        n[f == "R"] += 1
    m = views.meth(spark, str(tmp_path))
    assert {(r.chrom, r.start, r.strand, r.context): [r.c, r.mc] for r in m.collect()} == want
    assert m._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("hashpartitioning") == 1


def test_methylation_shuffles_widen_with_the_rows(spark, tmp_path, monkeypatch):
    from genespark.plans import views

    monkeypatch.setattr(tiling, "TASK_ROWS", 100, raising=False)
    rows = [(p, s, "RN"[(p + s) % 2]) for p in range(100) for s in range(20)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    m = views.meth(spark, str(tmp_path))
    assert m.rdd.getNumPartitions() == 21
    assert m.agg(F.sum("c"), F.sum("mc"), F.count("start")).first() == (1000, 1000, len({(s % 5, p * 40 + s) for p, s, _ in rows}))
    levels = m.select("chrom", F.col("start").alias("pos"), (F.col("mc") / (F.col("c") + F.col("mc"))).alias("level"))
    acf = M.meth_autocovariance(levels, max_dist=100, least=5, tile=512)
    plan = acf._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chrom, start, 21)" in re.sub(r"#\d+L?", "", plan) and "hashpartitioning(chrom, _tile, 21)" in re.sub(r"#\d+L?", "", plan)
    assert [r.n for r in acf.collect()] == [r.n for r in M.meth_autocovariance(levels, max_dist=100, least=5, tile=4096).collect()]


def test_autocovariance_query_goes_to_ten_thousand(spark, tmp_path):
    from genespark.plans import load

    rng = random.Random(3)
    rows = [(p, s, rng.choice("RN")) for p in range(300) for s in range(20) for _ in range(2)]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_returnflag string").write.parquet(path)
    got = {r.lag: (r.n, r.cov, r.cor) for r in load().QUERIES["meth_autocovariance"](spark, str(tmp_path)).collect()}
    places = {}
    for p, s, f in rows:
        places.setdefault((s % 5, p * 40 + s % 37), []).append(f == "R")
    chrom, pos = np.array(list(places)).T
    level = np.array([np.mean(x) for x in places.values()])
    dev, n, total = level - level.mean(), np.zeros(1000), np.zeros(1000)
    for c in range(5):
        at, d = pos[chrom == c], dev[chrom == c]
        a, b = np.nonzero((at[None, :] > at[:, None]) & (at[None, :] - at[:, None] < 10_000))
        lag = (at[b] - at[a]) // 10
        n += np.bincount(lag, minlength=1000)
        total += np.bincount(lag, d[a] * d[b], minlength=1000)
    assert n[1:].min() > 100 and sorted(got) == list(range(10, 10_000, 10))
    for k, (m, cov, cor) in got.items():
        want = total[k // 10] / (m - 1)
        assert m == n[k // 10] and math.isclose(cov, want, abs_tol=1e-6) and math.isclose(cor, want / level.var(ddof=1), abs_tol=1e-6)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{path}/*.parquet'")
    said = {lag: (m, cov, cor) for lag, m, cov, cor in con.execute(load().ORACLES["meth_autocovariance"]).fetchall()}
    assert set(said) == set(got)
    for k, (m, cov, cor) in said.items():
        assert got[k][0] == m and math.isclose(got[k][1], cov, abs_tol=2e-6) and math.isclose(got[k][2], cor, abs_tol=2e-6)


def test_row_median_and_conflicts(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (None, None, None), (2.0, 4.0, 9.0)], "a double, b double, c double")
    assert [r.m for r in df.select(D.row_median(F.col("a"), F.col("b"), F.col("c")).alias("m")).collect()] == [3.0, None, 4.0]
    assert df.select(D.na(F.col("a"), 2.0).alias("v")).filter("v is null").count() == 2


def test_majority_haploid_calls_and_draws(spark, partitions):
    rows = [(i, "s", 1, 5, 2) for i in range(50)] + [(i + 50, "s", 2, 9, 0) for i in range(5)]
    df = spark.createDataFrame(rows, "site_id long, sample string, gt int, dp_ref int, dp_alt int")
    assert {r.gt for r in variants.haploidise(df, "majority").collect()} == {2}
    drawn = sorted((r.site_id, r.gt) for r in variants.haploidise(df).collect())
    assert {g for _, g in drawn} == {0, 2}
    assert drawn == sorted((r.site_id, r.gt) for r in variants.haploidise(df.repartition(6)).collect())


def test_rolling_tail(spark):
    df = spark.createDataFrame([("s", "1", p, d) for p, d in ((1, 4), (2, 0), (3, 6))], "sample string, chrom string, pos long, dp int")
    plain = {r.s: r.n for r in variants.rolling_depth_histogram(df, 2).collect()}
    assert plain == {4: 2, 6: 1}
    tail = {r.s: r.n for r in variants.rolling_depth_histogram(df, 2, tail=True).collect()}
    assert tail == {4: 2, 6: 2}


def test_model_selection_weights(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), float(b), float(rng.random() < 1 / (1 + math.exp(-2 * a)))) for a, b in rng.normal(size=(120, 2))], "a double, b double, y double")
    rank, averaged = T.model_selection(df, "y", ["a", "b"])
    rows = rank.orderBy("aic").collect()
    assert len(rows) == 5 and math.isclose(sum(r.weight for r in rows), 1.0) and math.isclose(rows[-1].cumulative, 1.0)
    assert averaged.count() >= 0


def test_insert_size_needs_reads_on_every_contig(spark):
    df = spark.createDataFrame([("a", "1", 10, 6), ("a", "2", 20, 6), ("b", "1", 10, 60)], "sample string, chrom string, length int, n int")
    assert {r["sample"] for r in D.insert_size_stats(df, ["1", "2"], 5).collect()} == {"a"}
    with pytest.raises(AssertionError):
        assert D.insert_size_stats(df, ["1", "2"], 50).count()


def test_dosage_clusters_and_components(spark):
    rng = np.random.default_rng(8)
    rx = np.r_[rng.normal(0.5, 0.03, 20), rng.normal(1.0, 0.03, 30)]
    df = spark.createDataFrame([(f"s{i}", float(x)) for i, x in enumerate(rx)], "sample string, rx double")
    got = {r["sample"]: (r.hard, r.soft) for r in D.sex_cluster(df).collect()}
    m, f = rx[:20], rx[20:]
    for i, x in enumerate(rx):
        hard = "M" if i < 20 else "F"
        soft = "M" if x < m.mean() + 1.6448536 * m.std() else "F" if x > f.mean() - 1.6448536 * f.std() else None
        assert got[f"s{i}"] == (hard, soft)
    reads = rng.integers(500, 1500, size=(12, 4))
    rows = [(f"s{i}", f"c{j}", int(reads[i, j]), 100 + 10 * j) for i in range(12) for j in range(4)]
    pcs, explained = D.dosage_pca(spark.createDataFrame(rows, "sample string, contig string, nreads long, len long"), [f"c{j}" for j in range(4)], 2)
    length = np.array([100 + 10 * j for j in range(4)])
    dose = (reads / reads.sum(axis=1, keepdims=True)) / (length / length.sum())
    values, vectors = np.linalg.eigh(np.cov(dose, rowvar=False))
    np.testing.assert_allclose(explained, values[::-1][:2] / values.sum(), rtol=1e-6)
    got = np.array([r.pc for r in sorted(pcs.collect(), key=lambda r: int(r["sample"][1:]))])
    np.testing.assert_allclose(np.abs(got[:, 0]), np.abs(dose @ vectors[:, -1]), rtol=1e-6)


def test_components_of_many_contigs_with_gaps(spark):
    rng = np.random.default_rng(3)
    sex = rng.integers(0, 2, 15)
    reads = rng.poisson(200 * (1 + (np.arange(40) < 6) * sex[:, None]) * (1 + 0.3 * rng.random((15, 1)) * (np.arange(40) % 5 == 0)))
    there = rng.random((15, 40)) < 0.95
    length = 100 + np.arange(40)
    rows = [(f"s{i}", f"c{j}", int(reads[i, j]), int(length[j])) for i in range(15) for j in range(40) if there[i, j]]
    df = spark.createDataFrame(rows, "sample string, contig string, nreads long, len long")
    pcs, explained = D.dosage_pca(df, k=2, tol=1e-11)
    r, l = reads * there, length * there
    dose = np.where(there, (r / r.sum(axis=1, keepdims=True)) / np.where(there, l / l.sum(axis=1, keepdims=True), 1), 0)
    values, vectors = np.linalg.eigh(np.cov(dose, rowvar=False))
    np.testing.assert_allclose(explained, values[::-1][:2] / values.sum(), rtol=1e-6)
    got = np.array([x.pc for x in sorted(pcs.collect(), key=lambda x: int(x["sample"][1:]))])
    np.testing.assert_allclose(np.abs(got), np.abs(dose @ vectors[:, ::-1][:, :2]), rtol=1e-3, atol=1e-3)


def test_alike_samples_have_no_components(spark):
    df = spark.createDataFrame([(f"s{i}", c, 10, 100) for i in range(4) for c in "ab"], "sample string, contig string, nreads long, len long")
    pcs, explained = D.dosage_pca(df)
    assert explained == [] and [r.pc for r in pcs.collect()] == [[]] * 4
    with pytest.raises(ValueError):
        D.dosage_pca(df.filter("sample = 's1'"))


def test_tails_at_large_counts():
    from genespark.functions import special

    for n in (10**4, 10**6, 10**8, 10**9):
        half = math.exp(special.lgamma(n + 1) - 2 * special.lgamma(n / 2 + 1) - n * math.log(2)) if n < 10**6 else math.sqrt(2 / (math.pi * n))
        got = float(special.betainc(n // 2, n - n // 2 + 1, 0.5))
        assert math.isclose(got, 0.5 + half / 2, abs_tol=1e-6)
    for k, n, p in ((3, 10, 0.2), (0.5, 3.5, 0.7), (40, 100, 0.41), (700, 1000, 0.69)):
        a, b, steps = k, n - k + 1, 400_000
        grid = (np.arange(steps) + 0.5) / steps
        dens = np.exp((a - 1) * np.log(grid) + (b - 1) * np.log1p(-grid) + special.lgamma(a + b) - special.lgamma(a) - special.lgamma(b))
        assert math.isclose(float(special.betainc(a, b, p)), float(dens[grid < p].sum() / steps), rel_tol=2e-3, abs_tol=1e-5)
    # many large counts in one batch: no round leaves all of them at the last digit
    a = np.array([5e4, 3e5, 1e6, 1e7, 1e8])[:, None] * np.array([0.01, 0.33, 0.5]) + 0.5
    b = np.array([5e4, 3e5, 1e6, 1e7, 1e8])[:, None] + 1 - a
    for p, z in ((0.025, -1.959964), (0.975, 1.959964)):
        q = special.beta_quantile(a, b, p)
        mean, sd = a / (a + b), np.sqrt(a * b / (a + b + 1)) / (a + b)
        assert np.allclose(special.betainc(a, b, q), p, rtol=0, atol=1e-9) and np.allclose((q - mean) / sd, z, atol=0.06)
        assert np.allclose(special.betainc(b, a, 1 - q), 1 - p, rtol=0, atol=1e-9)
    assert math.isclose(float(special.gamma_upper(50_000.0, 50_000.0)), 0.5 - 1 / (3 * math.sqrt(2 * math.pi * 50_000)), abs_tol=1e-6)
    # hypergeometric: far tails, both sides of the mode, and counts whose terms would not fit into memory
    assert math.isclose(special.hypergeom_tail(3, 50, 10, 12), sum(math.comb(10, k) * math.comb(40, 12 - k) for k in range(3, 11)) / math.comb(50, 12), rel_tol=1e-10)
    assert math.isclose(special.hypergeom_tail(1, 50, 10, 12), 1 - math.comb(40, 12) / math.comb(50, 12), rel_tol=1e-10)
    assert math.isclose(special.hypergeom_tail(25 * 10**7, 10**9, 5 * 10**8, 5 * 10**8), 0.5, abs_tol=1e-4)


def test_site_and_material_words(spark):
    df = spark.createDataFrame([("meta-x",), ("metax",), ("left_petrous_bone",), ("cranium",), ("Skull",), ("left Hum.",), (None,)], "t string")
    got = [r.m for r in df.select(D.material_class(F.col("t")).alias("m")).collect()]
    assert got == ["Foot", "Foot", "Petrosal", None, "OtherCrania", "Leg", None]


def test_density_is_zero_without_breakpoints(spark):
    fai = spark.createDataFrame([("a", 100), ("b", 60)], "chrom string, length long")
    t = variants.recombination_density(spark.createDataFrame([("a", 5)], "chrom string, pos long"), fai, 10, 20)
    got = {(r.chrom, r.mid): r.density for r in t.collect()}
    assert got["a", 10] == 0.5 and set(v for (c, _), v in got.items() if c == "b") == {0.0}
    with pytest.raises(ValueError):
        variants.recombination_density(fai, fai, 10, 25)
