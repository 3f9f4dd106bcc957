"""Sample metadata: look-ups, merges, classification, sex calls."""

import math
from functools import reduce

from pyspark.sql import functions as F

from genespark.functions.special import jeffreys

# What may stand before and after a keyword, and the site and material classes by keyword, tried in this order.
BEFORE = r"(^|\s|[(-_.,])"
AFTER = r"([)-_.,]|\s|$)"
SITE_CAVE = r"[Cc]ave"
SITE_HUMAN = r"[Ss]tampede [Ss]ite|[Hh]unting"
MATERIALS = [
    ("Astragalus", r"[Aa]strag(alus)?|[Aa]stralagus|[Tt]alus"),
    ("Petrosal", r"[Pp]etr(ous)?|[Pp]etrosal"),
    ("OtherCrania", r"[Bb]ulla|[Cc]rania|[Ss]kull|[Mm]andible|[Mm]axilla([re])?"),
    ("Leg", r"[Hh]um(er(o)?us)?|[Rr]ad(ius)?|[Tt]ib(ia)?|[Ff]emur|[Uu]lna|[Ll]eg"),
    ("Foot", r"[Ff]oot|[Mm]etapod(ial)?|[Mm]etacar(pal|pus)?|[Mm]etatar(sal|sus)?|mx|mt|mc|meta(-)?x"),
    ("Horn", r"[Hh]orn(core)?(s?)"),
    ("Tooth", r"[Tt]ooth"),
    ("Vertebra", r"[Vv]ert(ebra(e)?)?|[Ss]pine|[Aa]tlas"),
    ("FlatBone", r"[Pp]elvi[sc]|[Ss]capula"),
]
CRANIAL = ("Petrosal", "OtherCrania", "Horn", "Tooth")

EARTH_RADIUS_KM = 6371.0


# --- scalar rules ---------------------------------------------------------------------------------


def _mentions(texts, keywords):
    pattern = f"{BEFORE}({keywords}){AFTER}"
    return reduce(lambda a, b: a | b, [F.coalesce(t.rlike(pattern), F.lit(False)) for t in texts])


def site_class(*texts):
    return F.when(_mentions(texts, SITE_CAVE), "Cave").when(_mentions(texts, SITE_HUMAN), "Anthropogenic").otherwise("Sediment")


def material_class(*texts):
    out = None
    for name, keywords in MATERIALS:
        hit = _mentions(texts, keywords)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def body_part(material):
    return F.when(material.isin(*CRANIAL), "Crania").when(material.isNotNull(), "Postcrania")


def wrap_longitude(lon):
    return F.when(lon < -15, lon + 360).otherwise(lon)


def clean_age(text):
    return F.regexp_replace(F.trim(text), "(cal)?BP$", "").try_cast("int")


def age_from_sample_name(name):
    """Last underscore-separated field; INF means infinitely old and anything else unreadable is NULL."""
    last = F.element_at(F.split(name, "_"), -1)
    return F.when(F.upper(last) == "INF", float("inf")).otherwise(last.try_cast("double"))


def split_binomial(name, sep="_"):
    parts = F.split(name, sep)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def date_class(year):
    y = F.when(year >= 1500, year)
    return F.when(y <= 1940, "<1940").when(y <= 1960, "1940-1960").when(y <= 2020, ">1960")


def lon_class(lon):
    return F.when((lon > -20) & (lon <= 60), "EU").when(lon > 60, "AM")


def great_circle_km(lat1, lon1, lat2, lon2):
    """Spherical law of cosines, clamped."""
    r = F.radians
    c = F.sin(r(lat1)) * F.sin(r(lat2)) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.cos(r(lon1) - r(lon2))
    return EARTH_RADIUS_KM * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def euclidean(a1, b1, a2, b2):
    return F.sqrt((a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2))


def conflict_to_null(a, b):
    """Two sources: NULL where they disagree, otherwise whichever is known."""
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), None).otherwise(F.coalesce(a, b))


def row_median(*cols):
    """Median of the known values of a row."""
    known = F.array_sort(F.filter(F.array(*cols), lambda x: x.isNotNull()))
    n = F.size(known)
    at = lambda i: F.get(known, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0)


def na(col, *sentinels):
    return F.when(~col.isin(*sentinels), col)


# --- table operations -----------------------------------------------------------------------------


def multi_key_lookup(rows, db, trusted):
    """Find each row's entry by coordinate, else rs id, else ss id.

    A row goes when its look-ups name different entries, or when one of its entries was named by an earlier
    row (by line number); rows without a trusted record do not take part.
    """
    def keyed(key, name):
        return db.filter(" and ".join(f"{k} is not null" for k in key)).groupBy(*key).agg(F.max("entry").alias(name))

    t = rows.join(trusted, "snp_num")
    for key, name in ((["chrom", "pos"], "e1"), (["rs"], "e2"), (["ss"], "e3")):
        t = t.join(keyed(key, name), key, "left")
    t = t.withColumn("entry", F.coalesce("e1", "e2", "e3")).filter("entry is not null")
    named = t.select("line_no", F.explode(F.array_distinct(F.array_compact(F.array("e1", "e2", "e3")))).alias("e"))
    firsts = named.groupBy("e").agg(F.min("line_no").alias("first"))
    reused = named.join(firsts, "e").filter("line_no > first").select("line_no").distinct()
    agree = "(e1 is null or e2 is null or e1 = e2) and (e2 is null or e3 is null or e2 = e3) and (e1 is null or e3 is null or e1 = e3)"
    return t.filter(F.expr(agree)).join(reused, "line_no", "left_anti").drop("e1", "e2", "e3")


def coalesce_duplicates(df, key, order, columns, aliases=None):
    """One row per key: per column the first known value in row order; aliases map duplicate names first."""
    if aliases is not None:
        df = df.join(aliases, key, "left").withColumn(key, F.coalesce("alias", key)).drop("alias")
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))
    return df.groupBy(key).agg(*[first(c).alias(c) for c in columns])


def sample_table_merge(*tables, key="sample"):
    return reduce(lambda a, b: a.join(b, key), tables)


def elevation_join(samples, elevation):
    """Elevation by exact equality of the coordinate texts."""
    return samples.join(elevation.select("lat", "lon", "elevation"), ["lat", "lon"], "left")


def trait_integration(first, second, counts, *extra, key=("genus", "species")):
    """Full join of two trait tables, inner join with the counts, left joins with the rest."""
    key = list(key)
    out = first.join(second, key, "full").join(counts, key)
    return reduce(lambda a, b: a.join(b, key, "left"), extra, out)


def group_consensus_fill(df, group, column, overrides=None):
    """Fill a missing value from the group when the group's known values agree; overrides win."""
    known = df.groupBy(group).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    t = df.join(known, group, "left")
    fill = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col(column))
    if overrides:
        table = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
        fill = F.coalesce(F.try_element_at(table, F.col(group)), fill)
    return t.withColumn(column, fill).drop("_lo", "_hi")


def name_map_join(df, names, *columns):
    """Rename populations: a two-column table (name, label)."""
    for c in columns:
        m = names.select(F.col("name").alias(c), F.col("label").alias("_label"))
        df = df.join(m, c, "left").withColumn(c, F.coalesce("_label", c)).drop("_label")
    return df


def museum_sex_ratio(specimens, least=100, by=("genus", "species")):
    """Males, females, ratio and Jeffreys interval per species with enough specimens."""
    t = specimens.groupBy(*by).agg(F.count_if(F.col("sex") == "M").alias("m"), F.count_if(F.col("sex") == "F").alias("f"))
    t = t.filter(F.col("m") + F.col("f") >= least)
    lo, hi = jeffreys(F.col("m").cast("double"), (F.col("m") + F.col("f")).cast("double"))
    return t.withColumn("ratio", F.col("m") / (F.col("m") + F.col("f"))).withColumn("lower", lo).withColumn("upper", hi)


def trait_medians(df, value, by=("genus", "species")):
    """Median of a trait per species (exact)."""
    from genespark.operators.tiling import exact_quantiles

    return exact_quantiles(df, list(by), value, [0.5]).withColumnRenamed("q0", "median")


# --- sex from read counts -------------------------------------------------------------------------


def contig_sets_agree(idxstats):
    """Samples whose contigs are not exactly those of the whole table."""
    all_contigs = idxstats.select("contig").distinct().agg(F.count(F.lit(1)).alias("n"))
    own = idxstats.select("sample", "contig").distinct().groupBy("sample").agg(F.count(F.lit(1)).alias("contigs"))
    return own.filter(F.col("contigs") != all_contigs.scalar())


def sex_read_dosage(idxstats, x_contigs, min_reads=0, intervals=False):
    """X and autosomal reads and lengths per sample, relative dosage and the likelihood-ratio sex call.

    The binomial coefficient cancels in the ratio, so the test is closed form; 10.8276 is the chi-square
    quantile of one degree of freedom at 0.001.
    """
    x = F.col("contig").isin(list(x_contigs))
    s = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    t = idxstats.groupBy("sample").agg(
        s("nreads", x).alias("nx"), s("nreads", ~x).alias("na"), s("len", x).alias("lx"), s("len", ~x).alias("la")
    ).filter(F.expr(f"nx + na >= {min_reads} and nx + na > 0 and lx > 0 and la > 0"))
    t = t.withColumn("_p0", F.expr("lx / (lx + 2 * la)")).withColumn("_p1", F.expr("lx / (lx + la)"))
    t = t.withColumn("llr", F.expr("nx * ln(_p0 / _p1) + na * ln((1 - _p0) / (1 - _p1))"))
    expected = F.when(F.col("llr") > 0, 2 * F.col("_p0")).otherwise(F.col("_p1"))
    t = t.withColumn("_e", expected).withColumn("rx", F.expr("nx / (nx + na)") / F.col("_e"))
    call = F.when(2 * F.col("llr") > 10.8276, "M").when(-2 * F.col("llr") > 10.8276, "F").otherwise("U")
    t = t.withColumn("sex", F.when((F.col("rx") > 0.6) & (F.col("rx") < 0.8), "U").otherwise(call))
    if intervals:
        lo, hi = jeffreys(F.col("nx").cast("double"), (F.col("nx") + F.col("na")).cast("double"), 0.99)
        t = t.withColumn("rx_low", lo / F.col("_e")).withColumn("rx_high", hi / F.col("_e"))
    return t.drop("_p0", "_p1", "_e")


def sex_ratio_normal_ci(idxstats):
    """X share of reads with its normal interval, and the shares expected from contig lengths."""
    auto, x = F.col("contig").rlike("^([Cc]hr)?[1-9][0-9]?$"), F.col("contig").rlike("^([Cc]hr)?X$")
    s = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    t = idxstats.groupBy("sample").agg(s("nreads", x).alias("nx"), s("len", x).alias("lx"), s("nreads", auto).alias("na"), s("len", auto).alias("la"))
    t = t.filter("nx + na > 0").withColumn("erx", F.expr("lx / (lx + la)")).withColumn("rx", F.expr("nx / (nx + na)"))
    t = t.withColumn("se", F.expr("sqrt(rx * (1 - rx) / (nx + na))"))
    return t.withColumn("half_erx", F.expr("0.5 * erx")).withColumn("low", F.expr("rx - 1.96 * se")).withColumn("high", F.expr("rx + 1.96 * se"))


def sex_cluster(table, rx="rx", start=1.0, most=10_000):
    """Two-centroid k-means on the dosage, then normal bounds (95th and 5th percentile) for a soft call.

    The dosages (one number a sample) are kept; each round is one aggregate of four numbers, until the split stops
    moving. Not coming to rest is an error.
    """
    dosages = table.select(rx).filter(F.col(rx).isNotNull()).persist()
    m, f = 0.5 * start, start
    for _ in range(most):
        male = F.abs(F.col(rx) - m) <= F.abs(F.col(rx) - f)
        row = dosages.agg(F.avg(F.when(male, F.col(rx))).alias("m"), F.avg(F.when(~male, F.col(rx))).alias("f")).first()
        new = (m if row["m"] is None else row["m"], f if row["f"] is None else row["f"])
        if all(math.isclose(x, y, rel_tol=1e-12) for x, y in zip(new, (m, f))):
            break
        m, f = new
    else:
        raise ArithmeticError("the two clusters did not come to rest")
    dosages.unpersist()
    male = F.abs(F.col(rx) - m) <= F.abs(F.col(rx) - f)
    spread = table.agg(F.struct(
        F.coalesce(F.stddev_pop(F.when(male, F.col(rx))), F.lit(0.0)).alias("m"), F.coalesce(F.stddev_pop(F.when(~male, F.col(rx))), F.lit(0.0)).alias("f")))
    z95 = 1.6448536269514722  # standard normal quantile at 0.95
    t = table.withColumn("_s", spread.scalar())
    soft = F.when(F.col(rx) < m + z95 * F.col("_s.m"), "M").when(F.col(rx) > f - z95 * F.col("_s.f"), "F")
    return t.withColumn("hard", F.when(male, "M").otherwise("F")).withColumn("soft", soft).drop("_s")


def age_stratification(table, age="age", sex="hard"):
    """One-sided z test: is the male share higher among samples at or above the median age?"""
    from genespark.operators.tiling import cumulative_counts

    known = table.filter(F.col(age).isNotNull())
    n = known.agg(F.count(F.lit(1)).alias("n"))
    cum = cumulative_counts(known, [], age)
    mid = cum.filter(F.col("cum") > F.floor(n.scalar() / 2) + 1).agg(F.min(age).alias("mid"))
    old = F.col(age) >= mid.scalar()
    c = lambda o, s: F.count_if((old if o else ~old) & (F.col(sex) == s))
    a = known.agg(c(False, "M").alias("young_m"), c(False, "F").alias("young_f"), c(True, "M").alias("old_m"), c(True, "F").alias("old_f"))
    a = a.withColumn("_n1", F.expr("young_m + young_f")).withColumn("_n2", F.expr("old_m + old_f"))
    a = a.withColumn("_p1", F.try_divide("young_m", "_n1")).withColumn("_p2", F.try_divide("old_m", "_n2"))
    a = a.withColumn("_p", F.expr("(_p1 * _n2 + _p2 * _n1) / (_n1 + _n2)"))
    z = F.try_divide(F.col("_p2") - F.col("_p1"), F.sqrt(F.col("_p") * (1 - F.col("_p")) * (F.try_divide(F.lit(1.0), F.col("_n1")) + F.try_divide(F.lit(1.0), F.col("_n2")))))
    return a.withColumn("z", z).drop("_n1", "_n2", "_p1", "_p2", "_p")


def dosage_pca(idxstats, contigs=None, k=2, extra=8, rounds=100, tol=1e-9, seed=1):
    """Principal components of the contig dosages (share of reads over share of length), and their shares of the variance.

    A sample without a contig has dosage 0 there.  Samples and contigs stay rows, whatever their numbers: a block of
    ``k + extra`` random directions over the contigs is multiplied by the covariance through two joins a round and
    made orthonormal again by its small Gram matrix, the only thing that reaches the driver, until the first ``k`` variances
    stand still.  Signs of components are arbitrary.  Returns ``sample, pc`` (array) and the shares; fewer than ``k`` come
    back where the data have fewer directions (none where all samples are alike); directions that do not settle are an error.
    """
    import numpy as np

    from genespark.scratch import release, stash

    total = idxstats.groupBy("sample").agg(F.sum("nreads").alias("_n"), F.sum("len").alias("_l"))
    d = idxstats if contigs is None else idxstats.filter(F.col("contig").isin(list(contigs)))
    d = d.join(total, "sample").select("sample", "contig", F.coalesce(F.try_divide(F.col("nreads") / F.col("_n"), F.col("len") / F.col("_l")), F.lit(0.0)).alias("x"))
    d = stash(d.groupBy("sample", "contig").agg(F.first("x").alias("x")))
    n = total.count()
    mean = d.groupBy("contig").agg((F.sum("x") / n).alias("m"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    whole = mean.agg(F.sum(F.col("xx") - n * F.col("m") * F.col("m")).alias("t"), F.sum("xx").alias("xx"), F.count(F.lit(1)).alias("c")).first()
    if not whole["c"] or n < 2:
        raise ValueError("components need two samples and a contig")
    if whole["t"] <= 1e-14 * whole["xx"]:
        return total.select("sample", F.array().cast("array<double>").alias("pc")), []
    q = min(k + extra, whole["c"])
    block = lambda name: [F.col(name)[i] for i in range(q)]
    listed = lambda cols: F.array(*cols)
    gram = lambda t, name: t.agg(*[F.sum(F.col(name)[i] * F.col(name)[j]) for i in range(q) for j in range(i, q)]).first()

    def square(row, size):
        g, it = np.zeros((size, size)), iter(row)
        for i in range(size):
            for j in range(i, size):
                g[i, j] = g[j, i] = next(it) or 0.0
        return g

    def turned(name, matrix):
        return listed([sum((F.lit(float(matrix[i, j])) * F.col(name)[i] for i in range(1, matrix.shape[0])), F.lit(float(matrix[0, j])) * F.col(name)[0]) for j in range(matrix.shape[1])])

    def summed(t, key, name):
        # x times the block, summed by the key, without a row per direction
        return t.groupBy(key).agg(*[F.sum(F.col("x") * c).alias(f"_s{i}") for i, c in enumerate(block(name))]).select(key, listed([F.col(f"_s{i}") for i in range(q)]).alias(name))

    draws = [F.xxhash64("contig", F.lit(seed), F.lit(i)) / float(1 << 63) for i in range(q)]
    v, last = stash(mean.select("contig", "m", listed(draws).alias("w"))), None
    for _ in range(rounds):
        # orthonormal directions; those that the data lack vanish
        values, vectors = np.linalg.eigh(square(gram(v, "w"), q))
        keep = values > 1e-13 * max(values.max(), 1e-300)
        q = int(keep.sum())
        v = v.select("contig", "m", turned("w", vectors[:, keep] / np.sqrt(values[keep])).alias("w"))
        shift = v.agg(*[F.sum(F.col("m") * c) for c in block("w")]).first()
        u = summed(d.join(v.select("contig", "w"), "contig"), "sample", "w")
        u = stash(u.select("sample", listed([c - F.lit(float(s)) for c, s in zip(block("w"), shift)]).alias("w")))
        spread, rotation = np.linalg.eigh(square(gram(u, "w"), q))
        top = spread[::-1][:k]
        if last is not None and len(last) == len(top) and np.all(np.abs(top - last) <= tol * max(top.max(), 1e-300)):
            break
        last = top
        v = stash(summed(d.join(u, "sample"), "contig", "w").join(mean.select("contig", "m"), "contig").select("contig", "m", "w"))
        release(u)
    else:
        raise ArithmeticError("the components did not settle")
    first = rotation[:, ::-1][:, : len(top)]
    moved = [float(x) for x in np.array(shift, dtype=float) @ first]
    scores = turned("w", first)
    pcs = u.select("sample", F.transform(F.arrays_zip(scores.alias("a"), F.array(*[F.lit(x) for x in moved]).alias("b")), lambda e: e["a"] + e["b"]).alias("pc"))
    return pcs, [float(x) / whole["t"] if whole["t"] else 0.0 for x in top]


# --- insert sizes ---------------------------------------------------------------------------------


def insert_size_stats(hist, contigs, min_reads=500):
    """Weighted mean and sd of length per sample and contig, for samples with enough reads on every contig."""
    t = hist.filter(F.col("chrom").isin(list(contigs))).groupBy("sample", "chrom").agg(
        F.sum("n").alias("n"), F.sum(F.col("length") * F.col("n")).alias("_s"), F.sum(F.col("length") * F.col("length") * F.col("n")).alias("_q")
    )
    ok = t.groupBy("sample").agg(F.min("n").alias("_min"), F.count(F.lit(1)).alias("_c")).filter((F.col("_min") > min_reads) & (F.col("_c") == len(contigs)))
    t = t.join(ok.select("sample"), "sample", "left_semi")
    mean = F.col("_s") / F.col("n")
    var = F.try_divide(F.col("_q") - F.col("n") * mean * mean, F.col("n") - 1)
    return t.select("sample", "chrom", "n", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"))
