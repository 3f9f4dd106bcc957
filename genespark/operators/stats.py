"""Histograms, regressions, rank correlation, generalised linear models and permutation tests."""

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genespark.functions.special import binom_sf, chi2_sf, jeffreys, student_two_sided
from genespark.operators import glm, tiling
from genespark.scratch import stash

# --- tables ---------------------------------------------------------------------------------------


def interval_summary(df, low_columns, high_columns):
    """Row-wise minimum and maximum, then mean, median and 2.5 / 97.5 percentiles of each."""
    t = df.select(F.least(*low_columns).cast("double").alias("low"), F.greatest(*high_columns).cast("double").alias("high"))
    t = t.select(F.explode(F.array(F.struct(F.lit("low").alias("stat"), F.col("low").alias("x")), F.struct(F.lit("high").alias("stat"), F.col("high").alias("x")))).alias("e")).select("e.*")
    q = tiling.exact_quantiles(t, ["stat"], "x", [0.025, 0.5, 0.975]).toDF("stat", "lower", "median", "upper")
    return t.groupBy("stat").agg(F.avg("x").alias("mean")).join(q, "stat")


def column_histogram(df, value, bins=30, integer=False, density=False):
    """Equal-width bins over the range (the last one closed), or one bin per integer."""
    t = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    if integer:
        h = t.groupBy(F.floor("x").cast("double").alias("left")).agg(F.count(F.lit(1)).alias("n")).withColumn("right", F.col("left") + 1)
    else:
        r = t.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")))
        t = t.withColumn("_r", r.scalar())
        width = (F.col("_r.hi") - F.col("_r.lo")) / bins
        k = F.coalesce(F.least(F.floor(F.try_divide(F.col("x") - F.col("_r.lo"), width)), F.lit(bins - 1)), F.lit(0))
        t = t.select(k.alias("k"), F.col("_r.lo").alias("lo"), width.alias("w"))
        h = t.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("w").alias("w"))
        h = h.select((F.col("lo") + F.col("k") * F.col("w")).alias("left"), (F.col("lo") + (F.col("k") + 1) * F.col("w")).alias("right"), "n")
    if density:
        h = h.withColumn("density", F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy()) * (F.col("right") - F.col("left"))))  # one row per bin
    return h


def grouped_values(df, x, y, probs=(0.25, 0.5, 0.75)):
    """Count and exact quantiles of y for each x."""
    q = tiling.exact_quantiles(df, [x], y, probs)
    return df.filter(F.col(y).isNotNull()).groupBy(x).agg(F.count(y).alias("n")).join(q, x)


def normalise_histogram(hist, n="n", by=("sample",)):
    total = hist.groupBy(*by).agg(F.sum(n).alias("_t"))
    return hist.join(total, list(by)).withColumn("share", F.col(n) / F.col("_t")).drop("_t")


def length_weighted_histogram(pairs):
    """(count, length) rows, as from a counted list, summed per length."""
    return pairs.groupBy("length").agg(F.sum("count").alias("n"))


def linear_trend(df, x, y, by=()):
    """Slope, intercept, r and two-sided p of a straight line."""
    fx, fy = F.col(x).cast("double"), F.col(y).cast("double")
    a = df.groupBy(*by).agg(F.regr_slope(fy, fx).alias("slope"), F.regr_intercept(fy, fx).alias("intercept"), F.corr(fx, fy).alias("r"), F.count(F.lit(1)).alias("n"))
    dof = (F.col("n") - 2).cast("double")
    t = F.col("r") * F.sqrt(F.try_divide(dof, 1 - F.col("r") * F.col("r")))
    return a.withColumn("_t", F.coalesce(t, F.lit(0.0))).withColumn("p", F.when(dof > 0, student_two_sided("_t", F.greatest(dof, F.lit(1.0))))).drop("_t")


def family_allele_freq(calls, loci=None):
    """Allele count, alleles, frequency and Jeffreys interval per locus and family; bounds are found once per count and total."""
    t = calls if loci is None else calls.join(loci, ["chrom", "pos"], "left_semi")
    a = t.groupBy("chrom", "pos", "fid").agg(F.coalesce(F.sum("gt"), F.lit(0)).alias("ac"), (2 * F.count("gt")).alias("n"))
    lo, hi = jeffreys(F.col("ac").cast("double"), F.col("n").cast("double"))
    bounds = a.select("ac", "n").distinct().withColumn("lower", lo).withColumn("upper", hi)
    return a.withColumn("af", F.try_divide("ac", "n")).join(bounds, ["ac", "n"]).select(*a.columns, "af", "lower", "upper")


# --- comparing D runs -----------------------------------------------------------------------------


def mirrored(dstats):
    """Every row and its mirror (P1 and P2 swapped, signs flipped); of repeats the earliest line stays."""
    own = F.struct("p1", "p2", "p3", "d", "z")
    back = F.struct(F.col("p2").alias("p1"), F.col("p1").alias("p2"), "p3", (-F.col("d")).alias("d"), (-F.col("z")).alias("z"))
    t = dstats.select("line_no", F.posexplode(F.array(own, back)).alias("_side", "r")).select("line_no", "_side", "r.*")
    first = F.min_by(F.struct("d", "z"), F.struct("line_no", "_side"))
    return t.groupBy("p1", "p2", "p3").agg(first.alias("r")).select("p1", "p2", "p3", "r.d", "r.z")


def canonical(dstats):
    """One orientation per triple (P1 < P2), first line wins."""
    flip = F.col("p1") > F.col("p2")
    sign = F.when(flip, -1.0).otherwise(1.0)
    t = dstats.select(
        "line_no", F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2"), "p3", (F.col("d") * sign).alias("d"), (F.col("z") * sign).alias("z"))
    return t.groupBy("p1", "p2", "p3").agg(F.min_by(F.struct("d", "z"), "line_no").alias("r")).select("p1", "p2", "p3", "r.*")


def dstat_run_compare(first, second):
    """The triples two runs share, in one orientation."""
    b = canonical(second).select("p1", "p2", "p3", F.col("d").alias("d2"), F.col("z").alias("z2"))
    return canonical(first).withColumnRenamed("d", "d1").withColumnRenamed("z", "z1").join(b, ["p1", "p2", "p3"])


def sign_flip_outliers(compared, z=3.0):
    return compared.filter((F.col("d1") * F.col("d2") < 0) & (F.abs("z1") > z) & (F.abs("z2") > z))


def top_populations(outliers, k=10):
    """Populations that take part in most outliers."""
    n = outliers.select(F.explode(F.array("p1", "p2", "p3")).alias("population")).groupBy("population").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "population").limit(k)


def spearman(df, x, y):
    """Rank correlation with mid-ranks for ties."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    t = both.join(tiling.rank_table(both, [], x, "_rx"), x).join(tiling.rank_table(both, [], y, "_ry"), y)
    return t.agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


# --- models ---------------------------------------------------------------------------------------


def binomial_sign_test(df, column, success="M", failure="F"):
    """One-sided exact test that successes are more frequent than one half."""
    a = df.agg(F.count_if(F.col(column) == success).alias("k"), F.count_if(F.col(column).isin(success, failure)).alias("n"))
    return a.withColumn("p", binom_sf(F.col("k").cast("double"), F.col("n").cast("double"), F.lit(0.5)))


def _formula(y, terms):
    return f"{y} ~ {' + '.join(terms) if terms else '1'}"


def _design(df, y, terms):
    from pyspark.ml.feature import RFormula

    model = RFormula(formula=_formula(y, terms), featuresCol="_x", labelCol="_y").fit(df)
    out = model.transform(df)
    attrs = out.schema["_x"].metadata.get("ml_attr", {}).get("attrs", {})
    names = [a["name"] for a in sorted(itertools.chain.from_iterable(attrs.values()), key=lambda a: a["idx"])]
    return out, names


def with_powers(df, x, degree):
    """Columns x, x_2, ... for a polynomial term."""
    names = [x]
    for k in range(2, degree + 1):
        df = df.withColumn(f"{x}_{k}", F.pow(F.col(x), k))
        names.append(f"{x}_{k}")
    return df, names


def logistic_model(df, y, terms):
    """Estimate, standard error, z and p of each coefficient (a handful of rows)."""
    fit = glm.fit_all(df, y, [tuple(terms)])["true", tuple(terms)]
    rows = []
    for name, b, v in zip(fit.names, fit.beta, np.diag(fit.cov)):
        se = math.sqrt(max(v, 0.0))
        z = float(b) / se if se > 0 else None
        rows.append((name, float(b), se, z, None if z is None else glm.two_sided(z)))
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, z double, p double")


def predicted_interval(df, y, x, at, width=2.0):
    """Fitted probability and its Wald interval at given values of one continuous predictor."""
    fit = glm.fit_all(df, y, [(x,)])["true", (x,)]
    (slope, level), cov = fit.beta, fit.cov
    grid = df.sparkSession.createDataFrame([(float(v),) for v in at], "x double")
    eta = F.lit(float(level)) + F.lit(float(slope)) * F.col("x")
    se = F.sqrt(F.lit(float(cov[1, 1])) + F.lit(2 * float(cov[0, 1])) * F.col("x") + F.lit(float(cov[0, 0])) * F.col("x") * F.col("x"))
    inv = lambda e: 1 / (1 + F.exp(-e))
    return grid.select("x", inv(eta).alias("fit"), inv(eta - width * se).alias("lower"), inv(eta + width * se).alias("upper"))


def likelihood_ratio_table(df, y, models, subsets=None):
    """Degrees of freedom, deviance and p of each model against the intercept alone, for each subset of the data.

    All models and subsets are fitted together, so the number of jobs is that of the rounds of one fit.
    """
    subsets = subsets or {"all": "true"}
    fits = glm.fit_all(df, y, [(), *[tuple(t) for t in models.values()]], tuple(subsets.values()))
    rows = []
    for label, cond in subsets.items():
        null = fits[cond, ()]
        for name, terms in models.items():
            fit = fits[cond, tuple(terms)]
            rows.append((label, name, float(fit.rank - null.rank), null.deviance - fit.deviance, float(fit.rows - fit.rank), fit.deviance))
    t = df.sparkSession.createDataFrame(rows, "data string, model string, df double, deviance double, resid_df double, resid_dev double")
    return t.withColumn("p", F.when(F.col("df") > 0, chi2_sf("deviance", F.greatest("df", F.lit(1.0)))))


def linear_model(df, y, terms):
    """Ordinary least squares coefficients with standard errors, t and p."""
    from pyspark.ml.regression import LinearRegression

    data, names = _design(df, y, terms)
    model = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal").fit(data)
    s = model.summary
    rows = zip([*names, "intercept"], [*[float(c) for c in model.coefficients], float(model.intercept)], s.coefficientStandardErrors, s.tValues, s.pValues)
    return df.sparkSession.createDataFrame([(n, *(float(v) for v in r)) for n, *r in rows], "term string, estimate double, std_error double, t double, p double")


def centre(df, *columns, log=False):
    """Subtract the mean (of the logarithm)."""
    value = lambda c: F.ln(F.col(c)) if log else F.col(c).cast("double")
    means = df.agg(F.struct(*[F.avg(value(c)).alias(c) for c in columns]))
    df = df.withColumn("_m", means.scalar())
    for c in columns:
        df = df.withColumn(c, value(c) - F.col("_m")[c])
    return df.drop("_m")


def model_selection(df, y, predictors, interactions=True, upto=0.95):
    """AIC ranking of all sub-models (interactions only with both main effects) and the averaged coefficients.

    The number of models depends on the predictors named, not on the data; they are fitted together, one job a round.
    """
    pairs = list(itertools.combinations(predictors, 2)) if interactions else []
    models = []
    for k in range(len(predictors) + 1):
        for main in itertools.combinations(predictors, k):
            allowed = [p for p in pairs if p[0] in main and p[1] in main]
            for j in range(len(allowed) + 1):
                models += [(*main, *[f"{a}:{b}" for a, b in inter]) for inter in itertools.combinations(allowed, j)]
    fitted = glm.fit_all(df, y, models)
    fits = [(_formula(y, m), fitted["true", m].aic, dict(zip(fitted["true", m].names, map(float, fitted["true", m].beta)))) for m in models]
    spark = df.sparkSession
    rank = spark.createDataFrame([(f, a) for f, a, _ in fits], "model string, aic double")
    best = min(a for _, a, _ in fits)
    rank = rank.withColumn("delta", F.col("aic") - best)
    rank = rank.withColumn("weight", F.exp(-F.col("delta") / 2) / F.sum(F.exp(-F.col("delta") / 2)).over(W.partitionBy()))
    rank = rank.withColumn("cumulative", F.sum("weight").over(W.orderBy("aic", "model").rowsBetween(W.unboundedPreceding, 0)))
    coef = spark.createDataFrame([(f, n, v) for f, _, c in fits for n, v in c.items()], "model string, term string, estimate double")
    kept = coef.join(rank.filter(F.col("cumulative") <= upto).select("model", "weight"), "model")
    averaged = kept.groupBy("term").agg((F.sum(F.col("weight") * F.col("estimate")) / F.sum("weight")).alias("estimate"))
    return rank, averaged


# --- permutation tests ----------------------------------------------------------------------------


def _label_cuts(df, id_, group, first, replicates, seed, shift=56):
    """(rep, cut): the hash and id of the last row that a replicate deals to the first group.

    The rows are ranked by a hash of id and replicate, and the first group keeps its size.  Counts by the leading bits of the
    hash find the place of that rank; only the rows that share its bits, four in a thousand, are put in order.
    """
    h = F.xxhash64(F.col(id_), F.col("rep"), F.lit(seed))
    dealt = df.select(id_, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).select(id_, "rep", h.alias("_h"), F.shiftright(h, shift).alias("_tile"))
    before = W.partitionBy("rep").orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)  # one row per value of the leading bits
    size = df.agg(F.count_if(F.col(group) == first).alias("m"))
    tiles = dealt.groupBy("rep", "_tile").agg(F.count(F.lit(1)).alias("_n")).withColumn("_need", size.scalar() - F.coalesce(F.sum("_n").over(before), F.lit(0)))
    tiles = tiles.filter((F.col("_need") > 0) & (F.col("_need") <= F.col("_n"))).select("rep", "_tile", "_need")
    near = dealt.join(F.broadcast(tiles), ["rep", "_tile"])  # one row per replicate
    place = F.row_number().over(W.partitionBy("rep").orderBy("_h", id_))
    return near.withColumn("_l", place).filter(F.col("_l") == F.col("_need")).select("rep", F.struct("_h", F.col(id_).alias("_id")).alias("cut"))


def _dealt_first(id_, rep, seed, cut):
    """Whether a replicate deals the row to the first group, from the replicate's cut (NULL: nobody is in it)."""
    h = F.xxhash64(F.col(id_), rep, F.lit(seed))
    return F.coalesce((h < cut["_h"]) | ((h == cut["_h"]) & (F.col(id_) <= cut["_id"])), F.lit(False))


def permuted_labels(df, id_, group, first, replicates, seed=1):
    """(id, rep, in_first): replicate 0 holds the real labels, the others hash shuffles of the same sizes."""
    cuts = _label_cuts(df, id_, group, first, replicates, seed)
    reps = df.select(id_, (F.col(group) == first).alias("_real"), F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("rep"))
    t = reps.join(F.broadcast(cuts), "rep", "left")
    return t.select(id_, "rep", F.when(F.col("rep") == 0, F.col("_real")).otherwise(_dealt_first(id_, F.col("rep"), seed, F.col("cut"))).alias("in_first"))


def _p_value(stats):
    """Observed statistic (replicate 0) and the share of replicates beyond it."""
    seen = stats.filter("rep = 0").agg(F.max("t")).scalar()
    return stats.filter("rep > 0").agg(F.count_if(F.col("t") > seen).alias("_k"), F.count(F.lit(1)).alias("replicates")).select(
        seen.alias("statistic"), "replicates", (F.col("_k") / F.col("replicates")).alias("p"))


def _first_group(ids, real, share, replicates, seed):
    """Labels of some rows under every replicate: the real ones, then one hash per (row, replicate) below the share."""
    x = ids[:, None] ^ (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values: the finisher of splitmix64
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.concatenate([real[:, None], (x >> np.uint64(11)).astype(float) * 2.0**-53 < share], axis=1)


def cramer_von_mises_test(df, id_, value, group, first, replicates=1000, seed=1, size=4096):
    """Sum of squared differences of the two distribution functions over all points, with a permutation p.

    A replicate deals every row to the first group with that group's share, by a hash of id and replicate, and the statistic
    uses the sizes that came out; given those sizes all dealings are equally likely.  Labels are made inside the tasks, so no
    row is copied per replicate: a unit of ``size`` neighbouring values, or a part of a value that many rows hold, reports one
    count a replicate; the counts are summed along the units, and each unit adds up its squares from there.  Rows without a
    value are left out; a group without rows makes the statistic NULL.
    """
    known = df.filter(F.col(value).isNotNull()).select(F.xxhash64(id_).alias("_id"), F.col(value).alias("_v"), F.coalesce(F.col(group) == first, F.lit(False)).alias("_real"))
    place = tiling.cumulative_counts(known, [], "_v")
    # light values share a unit; a heavy one is a unit of its own, before the light ones that end in its tile
    heavy = F.col("n") >= size
    place = place.select("_v", F.col("cum").alias("_at"), F.col("n").alias("_n"), (2 * F.floor(F.col("cum") / size) + F.when(heavy, 0).otherwise(1)).alias("unit"))
    parts = F.when(heavy, F.pmod(F.col("_id"), F.ceil(F.col("n") / size))).otherwise(0)
    t = known.join(place.withColumn("n", F.col("_n")), "_v").select("_id", "_real", "_at", "_n", "unit", parts.cast("long").alias("_part"))
    share = known.agg(F.avg(F.col("_real").cast("double")))
    t = t.withColumn("_share", share.scalar())

    def dealt(pdf):
        return _first_group(pdf["_id"].to_numpy().view(np.uint64), pdf["_real"].to_numpy(dtype=bool), pdf["_share"].to_numpy()[:, None], replicates, seed)

    def count(pdf):
        got = np.zeros(replicates + 1, dtype=np.int64)
        for i in range(0, len(pdf), 512):
            got += dealt(pdf.iloc[i : i + 512]).sum(axis=0)
        return pd.DataFrame({"unit": pdf["unit"].iloc[0], "rep": np.arange(replicates + 1, dtype=np.int32), "_a": got})

    counts = t.groupBy("unit", "_part").applyInPandas(count, "unit long, rep int, _a long").groupBy("unit", "rep").agg(F.sum("_a").alias("_a"))
    counts = stash(counts)
    run = tiling.running_sum(counts, ["rep"], "unit", {"ca": F.col("_a")}, size=1 << 10)
    ends = counts.groupBy("rep").agg(F.sum("_a").alias("_first"))
    run = run.join(ends, "rep").select("unit", "rep", "ca", "_a", "_first")
    n = known.agg(F.count(F.lit(1)))
    of_heavy = run.filter("unit % 2 = 0").join(place.filter("unit % 2 = 0").select("unit", "_at", "_n"), "unit").withColumn("_all", n.scalar())
    diff = F.try_divide(F.col("ca"), F.col("_first")) - F.try_divide(F.col("_at") - F.col("ca"), F.col("_all") - F.col("_first"))
    heavy_parts = of_heavy.select("rep", (F.col("_n") * diff * diff).alias("t"))

    def squares(rows, before):
        rows, before = rows.sort_values("_at"), before.sort_values("rep")
        at, all_ = rows["_at"].to_numpy(dtype=float), float(rows["_all"].iloc[0])
        first_ = before["_first"].to_numpy(dtype=float)
        ca = (before["ca"] - before["_a"]).to_numpy(dtype=float)
        ends_ = np.r_[np.flatnonzero(np.diff(at)), len(at) - 1]
        total, begin = np.zeros(replicates + 1), 0
        with np.errstate(divide="ignore", invalid="ignore"):
            while begin < len(ends_):
                here = ends_[begin : begin + 512]  # the last rows of up to 512 values
                start = 0 if begin == 0 else ends_[begin - 1] + 1
                inside = np.cumsum(dealt(rows.iloc[start : here[-1] + 1]), axis=0)[here - start]
                c = ca + inside
                d = c / first_ - (at[here][:, None] - c) / (all_ - first_)
                total += (np.diff(np.r_[start - 1, here])[:, None] * d * d).sum(axis=0)
                ca, begin = c[-1], begin + 512
        return pd.DataFrame({"rep": np.arange(replicates + 1, dtype=np.int32), "t": total})

    light = t.filter("unit % 2 = 1").withColumn("_all", n.scalar())
    light_parts = light.groupBy("unit").cogroup(run.filter("unit % 2 = 1").groupBy("unit")).applyInPandas(squares, "rep int, t double")
    return _p_value(heavy_parts.unionByName(light_parts).groupBy("rep").agg(F.nanvl(F.sum("t"), F.lit(None)).alias("t")))


def mmd_kernel_test(df, id_, x, y, group, first, sigmas, replicates=1000, kernel="Laplacian", distance="euclidean", seed=1, block=4096):
    """Maximum mean discrepancy over a grid of kernel widths, with a permutation p.

    Ids are unique; a row without one counts for the sizes only.  Rows of one place are one point, which knows how many of its
    rows every replicate deals to the first group, so no row is copied per replicate.  Points are cut into blocks; one task
    builds the kernel of a pair of blocks and folds it with the weights of all replicates at once, so it returns one number
    per replicate and width and no pair is written out.  The work grows with the square of the different places, what is
    shuffled with that square over ``block``.  A missing coordinate makes the statistic NULL.
    """
    df = tiling.spread(df.select(id_, x, y, group), id_)  # every row is hashed once per replicate, so small files are dealt out
    cuts = _label_cuts(df, id_, group, first, replicates, seed)
    cuts = cuts.agg(F.map_from_entries(F.collect_list(F.struct("rep", "cut"))).alias("m")).select(F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: F.try_element_at("m", r)).alias("cuts"))
    sizes = df.agg(F.struct(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) != first).alias("b")))
    rows = df.filter(F.col(id_).isNotNull()).select(id_, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), (F.col(group) == first).alias("_real")).withColumn("_cuts", cuts.scalar())
    dealt = [F.count_if("_real"), *[F.count_if(_dealt_first(id_, F.lit(r), seed, F.get("_cuts", F.lit(r - 1)))) for r in range(1, replicates + 1)]]
    pts = rows.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_n"), *[c.alias(f"_f{r}") for r, c in enumerate(dealt)])
    pts = stash(pts.select("_x", "_y", "_n", F.array(*[f"_f{r}" for r in range(replicates + 1)]).alias("_f")))
    # few places are cut finer, so that there are tasks enough
    n = F.count(F.lit(1))
    n_blocks = pts.agg(F.greatest(F.lit(1), F.ceil(n / block), F.least(F.lit(16), F.ceil(n / 256))).cast("int").alias("k"))
    t = pts.withColumn("_k", n_blocks.scalar()).withColumn("_b", F.pmod(F.xxhash64("_x", "_y"), F.col("_k")).cast("int"))
    t = t.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).withColumn("_s", sizes.scalar())
    t = t.select("_x", "_y", "_n", "_f", "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), F.col("_s.a").alias("_first"), F.col("_s.b").alias("_rest"))

    def dist(a, b):
        if distance == "great_circle":
            la, lo = np.radians(a[:, 0]), np.radians(a[:, 1])
            lb, lp = np.radians(b[:, 0]), np.radians(b[:, 1])
            c = np.sin(la)[:, None] * np.sin(lb) + np.cos(la)[:, None] * np.cos(lb) * np.cos(lo[:, None] - lp)
            return 6371.0 * np.arccos(np.clip(c, -1, 1))
        return np.hypot(a[:, 0][:, None] - b[:, 0], a[:, 1][:, None] - b[:, 1])

    def weights(pdf):
        """Of the points under every replicate, and the sums of the squared weights of their rows."""
        f = np.stack(pdf["_f"].to_numpy()).astype(float)
        rest = pdf["_n"].to_numpy(dtype=float)[:, None] - f
        share = [np.divide(v, size, out=np.zeros_like(v), where=v > 0) for v, size in ((f, pdf["_first"].iloc[0]), (rest, pdf["_rest"].iloc[0]))]
        squares = sum(np.divide(v.sum(axis=0), float(size), out=np.zeros(v.shape[1]), where=v.any(axis=0)) for v, size in zip(share, (pdf["_first"].iloc[0], pdf["_rest"].iloc[0])))
        return share[0] - share[1], squares

    def fold(pdf):
        i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
        left, right = pdf[pdf["_b"] == i], pdf[pdf["_b"] == j]
        if left.empty or right.empty:
            return pd.DataFrame({"rep": [], "sigma": [], "part": []})
        a, b = left[["_x", "_y"]].to_numpy(), right[["_x", "_y"]].to_numpy()
        (wa, squares), (wb, _) = weights(left), weights(right)
        parts = np.zeros((len(sigmas), wa.shape[1]))
        for begin in range(0, len(a), 256):
            here = slice(begin, begin + 256)
            d = dist(a[here], b)
            if i == j:
                d[np.arange(len(d)), begin + np.arange(len(d))] = 0.0
            for k, s in enumerate(sigmas):
                parts[k] += np.einsum("ir,ir->r", wa[here], (np.exp(-(d * d) / (s * s)) if kernel == "Gaussian" else np.exp(-d / s)) @ wb)
        parts = parts - squares if i == j else 2.0 * parts  # no row is paired with itself
        reps = np.arange(wa.shape[1], dtype=np.int32)
        return pd.concat([pd.DataFrame({"rep": reps, "sigma": float(s), "part": p}) for s, p in zip(sigmas, parts)])

    parts = tiling.spread(t, "_i", "_j").groupBy("_i", "_j").applyInPandas(fold, "rep int, sigma double, part double")
    missing = pts.agg(F.count_if(F.col("_x").isNull() | F.col("_y").isNull() | F.isnan("_x") | F.isnan("_y")))
    stats = parts.groupBy("rep", "sigma").agg(F.sum("part").alias("t")).groupBy("rep").agg(F.max("t").alias("t"))
    return _p_value(stash(stats.withColumn("t", F.when(missing.scalar() == 0, F.col("t")))))
