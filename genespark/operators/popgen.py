"""Allele frequencies, D and F statistics, Fst and shared-allele patterns.

Genotypes are long: ``site_id, chrom, pos, sample, grp, gt`` with gt = copies of the reference allele or
NULL.  All population statistics start from one aggregate per site, and every tuple of populations under
test is evaluated from that one row, so the number of tests does not change the number of scans.
"""

from pyspark.sql import functions as F

from genespark.functions.draws import draw
from genespark.functions.special import hypergeom_sf, lnfact
from genespark.operators import tiling


def allele_freq_by_group(gts):
    """Per (site, group): individuals called, allele sum, frequency, heterozygosity and consensus allele."""
    a = gts.filter("gt is not null").groupBy("site_id", "grp").agg(F.count("gt").alias("n"), F.sum("gt").alias("s"))
    return a.select("*", *_derived(F.col("n"), F.col("s")))


def _derived(n, s):
    alleles = 2 * n
    return [
        (s / n).alias("af"),
        (s / alleles).alias("freq"),
        F.try_divide(s * (alleles - s), alleles * (alleles - 1)).alias("het"),
        _consensus(n, s).alias("consensus"),
    ]


def _consensus(n, s):
    return F.when(s > n, 1).when(s < n, 0)


def site_groups(gts, groups, keep=()):
    """One row per site with n_i, s_i (sum of gt) and h_i (heterozygotes) for each listed group."""
    aggs = []
    for i, g in enumerate(groups):
        mine = F.col("grp") == g
        aggs += [
            F.count(F.when(mine, F.col("gt"))).alias(f"n_{i}"),
            F.coalesce(F.sum(F.when(mine, F.col("gt"))), F.lit(0)).alias(f"s_{i}"),
            F.count_if(mine & (F.col("gt") == 1)).alias(f"h_{i}"),
        ]
    return gts.filter(F.col("grp").isin(list(groups))).groupBy("site_id", *keep).agg(*aggs)


def tuple_sites(gts, tuples, keep=()):
    """Sites x population tuples: role columns n1,s1,n2,s2,...; only sites where every role has a call."""
    groups = sorted({g for t in tuples.values() for g in t})
    wide = site_groups(gts, groups, keep)
    at = {g: i for i, g in enumerate(groups)}
    structs = []
    for name, t in tuples.items():
        fields = [F.lit(name).alias("test")]
        for r, g in enumerate(t, 1):
            fields += [F.col(f"n_{at[g]}").alias(f"n{r}"), F.col(f"s_{at[g]}").alias(f"s{r}")]
        structs.append(F.struct(*fields))
    long = wide.select("site_id", *keep, F.explode(F.array(*structs)).alias("q")).select("site_id", *keep, "q.*")
    k = len(next(iter(tuples.values())))
    return long.filter(F.expr(" and ".join(f"n{r} > 0" for r in range(1, k + 1))))


def _af(r, scale):
    return F.try_divide(F.col(f"s{r}"), F.col(f"n{r}") * (2 if scale == "allele" else 1))


def _het(r):
    n, s = 2 * F.col(f"n{r}"), F.col(f"s{r}")
    return F.try_divide(s * (n - s), n * (n - 1))


def _dstat_terms():
    w, x, y, z = (_af(r, "allele") for r in range(1, 5))
    return (w - x) * (y - z), (w + x - 2 * w * x) * (y + z - 2 * y * z)


def d_statistic(gts, quads):
    """D per quadruple with covered, BABA and ABBA site counts; D is 0 when the denominator is 0."""
    num, den = _dstat_terms()
    t = tuple_sites(gts, quads).withColumn("num", num).withColumn("den", den)
    a = t.groupBy("test").agg(
        F.sum("num").alias("num"),
        F.sum("den").alias("den"),
        F.count(F.lit(1)).alias("covered"),
        F.count_if(F.col("num") > 0).alias("baba"),
        F.count_if(F.col("num") < 0).alias("abba"),
    )
    return a.select("test", F.coalesce(F.try_divide("num", "den"), F.lit(0.0)).alias("d"), "covered", "baba", "abba")


def f2(gts, pairs, scale="copies"):
    a, b = _af(1, scale), _af(2, scale)
    term = (a - b) * (a - b) - F.try_divide(_het(1), 2 * F.col("n1")) - F.try_divide(_het(2), 2 * F.col("n2"))
    return tuple_sites(gts, pairs).groupBy("test").agg(F.avg(term).alias("f2"), F.count(F.lit(1)).alias("sites"))


def f3(gts, triples, scale="copies"):
    x, a, b = (_af(r, scale) for r in (1, 2, 3))
    term = (x - a) * (x - b) - F.try_divide(_het(1), 2 * F.col("n1"))
    return tuple_sites(gts, triples).groupBy("test").agg(F.avg(term).alias("f3"), F.count(F.lit(1)).alias("sites"))


def f4(gts, quads, scale="copies"):
    a, b, c, d = (_af(r, scale) for r in (1, 2, 3, 4))
    return tuple_sites(gts, quads).groupBy("test").agg(
        F.avg((a - b) * (c - d)).alias("f4"), F.count(F.lit(1)).alias("sites")
    )


def _with_consensus(t, k=4):
    for r in range(1, k + 1):
        t = t.withColumn(f"c{r}", _consensus(F.col(f"n{r}"), F.col(f"s{r}")))
    return t.filter(F.expr(" and ".join(f"c{r} is not null" for r in range(1, k + 1))))


def consensus_pattern_counts(gts, quads):
    """Which single population (or pair) differs, on consensus alleles."""
    t = _with_consensus(tuple_sites(gts, quads))
    odd = lambda *other: F.count_if(F.expr(
        " and ".join(f"c{r} {'<>' if r in other else '='} c{base}" for base in [next(b for b in (4, 3, 2, 1) if b not in other)]
                     for r in (1, 2, 3, 4) if r != base)))
    return t.groupBy("test").agg(
        odd(2).alias("babb"), odd(1).alias("abbb"), odd(3).alias("aaba"), odd(1, 2).alias("aabb"), F.count(F.lit(1)).alias("sites")
    )


def shared_derived(gts, quads, method="consensus"):
    """Sites where W shares X's allele (AABB) or not (BABB) given the outgroup pattern (?,A,B,B).

    ``consensus`` compares consensus alleles, ``f2`` unbiased squared distances (a negative distance that the
    decision needs skips the site), ``abs`` absolute frequency differences.
    """
    t = tuple_sites(gts, quads)
    if method == "consensus":
        t = _with_consensus(t).filter("c3 = c4 and c2 <> c3")
        return t.withColumn("pattern", F.when(F.expr("c1 = c2"), "AABB").otherwise("BABB")).select("site_id", "test", "pattern")
    name = {1: "w", 2: "x", 3: "y", 4: "z"}
    for i in range(1, 5):
        for j in range(i + 1, 5):
            d = _af(i, "copies") - _af(j, "copies")
            if method == "abs":
                v = F.abs(d)
            else:
                v = d * d - F.try_divide(_het(i), 2 * F.col(f"n{i}")) - F.try_divide(_het(j), 2 * F.col(f"n{j}"))
            t = t.withColumn(name[i] + name[j], v)
    # Y and Z are the closest of the three to each other
    t = t.filter("yz >= 0 and yz < least(xy, xz)")
    pairs = "greatest(wx, yz) < least(wy, wz)"  # W with X and Y with Z, rather than across
    if method == "abs":
        t = t.withColumn("pattern", F.when(F.expr(f"{pairs} and wx < xy"), "AABB").otherwise("BABB"))
        return t.select("site_id", "test", "pattern")
    usable = "least(wx, wy, wz) >= 0"
    alone = "least(wx, xy, xz) > greatest(wy, wz)"  # X is far from all, W is near Y and Z
    pattern = F.when(F.expr(f"{usable} and {pairs} and wx < least(xy, xz)"), "AABB").when(F.expr(f"{usable} and {alone}"), "BABB")
    return t.withColumn("pattern", pattern).filter("pattern is not null").select("site_id", "test", "pattern")


def _pair_rows(per_site, tests, col):
    """Per site, the states of every pair of tests; tests are few and named by the caller."""
    wide = per_site.groupBy("site_id").agg(*[F.max(F.when(F.col("test") == t, F.col(col))).alias(f"v{i}") for i, t in enumerate(tests)])
    pairs = [
        F.struct(F.lit(tests[i]).alias("test1"), F.lit(tests[j]).alias("test2"), F.col(f"v{i}").alias("a"), F.col(f"v{j}").alias("b"))
        for i in range(len(tests)) for j in range(i + 1, len(tests))
    ]
    return wide.select("site_id", F.explode(F.array(*pairs)).alias("p")).select("site_id", "p.*")


def d_statistic_agreement(gts, quads):
    """Pairs of tests: sites where both say BABA, both ABBA, they disagree, or only one is informative."""
    num, _ = _dstat_terms()
    status = tuple_sites(gts, quads).withColumn("st", F.signum(num).cast("int"))
    p = _pair_rows(status, list(quads), "st")
    count = lambda e: F.count_if(F.expr(e))
    return p.groupBy("test1", "test2").agg(
        count("a is not null").alias("covered1"), count("a <> 0").alias("informative1"),
        count("b is not null").alias("covered2"), count("b <> 0").alias("informative2"),
        count("a > 0").alias("baba1"), count("a < 0").alias("abba1"),
        count("b > 0").alias("baba2"), count("b < 0").alias("abba2"),
        count("a > 0 and b > 0").alias("baba_agree"), count("a < 0 and b < 0").alias("abba_agree"),
        count("a * b < 0").alias("disagree"),
        count("(a <> 0 and coalesce(b, 0) = 0) or (b <> 0 and coalesce(a, 0) = 0)").alias("uninformative"),
    )


def shared_derived_overlap(gts, quads, method="consensus"):
    """Overlap of AABB sets of two tests over sites informative in both, with the hypergeometric upper tail."""
    p = _pair_rows(shared_derived(gts, quads, method), list(quads), "pattern").filter("a is not null and b is not null")
    count = lambda e: F.count_if(F.expr(e))
    o = p.groupBy("test1", "test2").agg(
        F.count(F.lit(1)).alias("informative"),
        count("a = 'AABB'").alias("aabb1"), count("b = 'AABB'").alias("aabb2"),
        count("a = 'BABB'").alias("babb1"), count("b = 'BABB'").alias("babb2"),
        count("a = 'AABB' and b = 'AABB'").alias("aabb_aabb"), count("a = 'AABB' and b = 'BABB'").alias("aabb_babb"),
        count("a = 'BABB' and b = 'AABB'").alias("babb_aabb"), count("a = 'BABB' and b = 'BABB'").alias("babb_babb"),
    )
    return o.withColumn("p", hypergeom_sf("aabb_aabb", "informative", "aabb1", "aabb2"))


# --- blocks and jackknife -------------------------------------------------------------------------

# The eight site patterns by the alleles of the four populations (either allele as A).
PATTERNS = {
    "aaaa": (0, 0, 0, 0), "aaab": (0, 0, 0, 1), "aaba": (0, 0, 1, 0), "abaa": (0, 1, 0, 0),
    "baaa": (1, 0, 0, 0), "bbaa": (1, 1, 0, 0), "abba": (0, 1, 1, 0), "baba": (1, 0, 1, 0),
}


def with_blocks(gts, size, mode="grid"):
    """Block start per site: fixed grid, or greedy blocks anchored at the first site past the last block."""
    if mode == "grid":
        return gts.withColumn("block", (F.floor(F.col("pos") / size) * size).cast("long"))
    anchors = tiling.greedy_anchors(gts, ["chrom"], "pos", size).withColumnRenamed("anchor", "block")
    return gts.join(anchors, ["chrom", "pos"])


def abba_baba_blocks(gts, quads, size=5_000_000, mode="grid", patterns="draw", seed=1):
    """Per (block, quadruple): pattern counts, sites, F4 sum, D denominator and branch-corrected F4.

    Only homozygous calls count.  ``patterns='draw'`` samples one allele per polymorphic population;
    ``'expected'`` adds each pattern's probability instead.
    """
    homo = with_blocks(gts.filter("gt in (0, 2)"), size, mode).withColumn("gt", (F.col("gt") / 2).cast("int"))
    t = tuple_sites(homo, quads, keep=("chrom", "block"))
    p = [F.try_divide(F.col(f"s{r}"), F.col(f"n{r}")) for r in range(1, 5)]
    if patterns == "draw":
        for r in range(1, 5):
            one = draw(F.col(f"n{r}"), seed, "site_id", "test", F.lit(r)) < F.col(f"s{r}")
            t = t.withColumn(f"a{r}", one.cast("int"))
        shape = lambda v: F.when(_match([F.col(f"a{r}") for r in range(1, 5)], v), 1).otherwise(0)
    else:
        shape = lambda v: _chance(p, v) + _chance(p, [1 - x for x in v])
    a, b, c, d = p
    sums = [F.sum(shape(v)).alias(n) for n, v in PATTERNS.items()]
    out = t.groupBy("chrom", "block", "test").agg(
        *sums,
        F.count(F.lit(1)).alias("nsites"),
        F.sum((a - b) * (c - d)).alias("f4sum"),
        F.sum((a + b - 2 * a * b) * (c + d - 2 * c * d)).alias("ddensum"),
        F.sum(((a - b * c * d) - (b - a * c * d)) * ((c - a * b * d) - (d - a * b * c))).alias("_bn"),
        F.sum(a * b * c * d).alias("_bd"),
    )
    return out.withColumn("f4bc", F.when(F.col("_bd") != 0, F.col("_bn") / F.col("_bd")).otherwise(0.0)).drop("_bn", "_bd")


def _match(cols, v):
    same = [c == x for c, x in zip(cols, v)]
    flip = [c == 1 - x for c, x in zip(cols, v)]
    allof = lambda cs: cs[0] & cs[1] & cs[2] & cs[3]
    return allof(same) | allof(flip)


def _chance(p, v):
    out = F.lit(1.0)
    for q, x in zip(p, v):
        out = out * (q if x else 1 - q)
    return out


def block_jackknife(blocks):
    """Leave-one-block-out mean, standard deviation and Z of six statistics per quadruple."""
    names = [*PATTERNS, "nsites", "f4sum", "ddensum", "f4bc"]
    totals = blocks.groupBy("test").agg(*[F.sum(n).alias(f"t_{n}") for n in names])
    j = blocks.join(totals, "test").select("test", "t_nsites", "t_abba", "t_baba", *[(F.col(f"t_{n}") - F.col(n)).alias(n) for n in names])
    j = j.filter("abba + baba <> 0 and ddensum <> 0")
    over = lambda e: F.when(F.col("aaaa") != 0, F.expr(e) / F.col("aaaa")).otherwise(0.0)
    j = (
        j.withColumn("w", F.col("nsites") / F.col("t_nsites"))
        .withColumn("bc", over("(aaba - aaab) * (abaa - baaa)"))
        .withColumn("bca", over("aaba * abaa + aaab * baaa"))
        .withColumn("bcb", over("aaba * baaa + aaab * abaa"))
    )
    ratio = lambda num, den: F.try_divide(F.expr(num), F.expr(den))
    stats = {
        "d": ratio("abba - baba", "abba + baba"),
        "dbc": ratio("abba - baba - bc", "abba + baba - bca - bcb"),
        "d2": ratio("f4sum", "ddensum"),
        "d2bc": ratio("f4sum - f4bc", "ddensum"),
        "f4": ratio("f4sum", "nsites"),
        "f4bc": ratio("f4sum - f4bc", "nsites"),
    }
    j = j.select("test", "t_abba", "t_baba", "t_nsites", "w", F.explode(F.array(*[
        F.struct(F.lit(n).alias("stat"), c.cast("double").alias("x")) for n, c in stats.items()])).alias("e"))
    j = j.select("*", "e.*").drop("e").filter("x is not null")
    means = j.groupBy("test", "stat").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum(F.col("w") * F.col("x")).alias("wx"),
        F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("wxx"),
        F.max("t_abba").alias("abba"), F.max("t_baba").alias("baba"), F.max("t_nsites").alias("nsites"),
    )
    n = F.col("blocks")
    m = F.when(n > 1, F.col("wx") / (n - 1))
    centred = F.greatest(F.lit(0.0), F.col("wxx") - 2 * F.col("mean") * F.col("wx") + F.col("mean") * F.col("mean") * F.col("sw"))
    sd = F.sqrt(centred * (n - 1) / n)
    out = means.withColumn("mean", m).withColumn("sd", sd)
    return out.withColumn("z", F.when(F.col("sd") != 0, F.col("mean") / F.col("sd"))).select(
        "test", "stat", "blocks", "mean", "sd", "z", "abba", "baba", "nsites"
    )


# --- polarisation, Fst, population tests ----------------------------------------------------------


def polarising_sites(gts, individuals, regex_a, regex_b, least=0.5):
    """Sites fixed for different alleles in two groups named by regular expressions."""
    side = F.when(F.col("grp").rlike(regex_a), "a").when(F.col("grp").rlike(regex_b), "b")
    sizes = individuals.withColumn("side", side).agg(
        F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb")
    ).select(F.struct("na", "nb").alias("sizes"))
    g = gts.withColumn("side", side).filter("side is not null")
    a = lambda s, e: F.when(F.col("side") == s, e)
    per = g.groupBy("site_id").agg(
        F.count(a("a", F.col("gt"))).alias("na"), F.count(a("b", F.col("gt"))).alias("nb"),
        F.sum(a("a", F.col("gt"))).alias("sa"), F.sum(a("b", F.col("gt"))).alias("sb"),
    )
    per = per.withColumn("sizes", sizes.scalar()).filter(
        (F.col("na") >= least * F.col("sizes.na")) & (F.col("nb") >= least * F.col("sizes.nb"))
    )
    polar = "(coalesce(sa, 0) = 2 * na and coalesce(sb, 0) = 0) or (coalesce(sb, 0) = 2 * nb and coalesce(sa, 0) = 0)"
    return per.select("site_id", F.expr(polar).alias("polarising"))


def _theta(n, ac, h):
    """Weir and Cockerham's estimator from per-population allele totals, allele counts and heterozygotes.

    0 where one allele is fixed; NULL where the estimator is undefined.
    """
    r = len(n)
    div = F.try_divide
    total, hets, alleles = sum(n[1:], n[0]), sum(h[1:], h[0]), sum(ac[1:], ac[0])
    p = div(alleles, total)
    inds = total / 2
    sq = sum([x * x for x in n[1:]], n[0] * n[0]) / 4
    nbar = inds / r
    nc = (inds - div(sq, inds)) / (r - 1)
    hbar = div(hets, inds)
    s2 = F.lit(0.0)
    for x, a in zip(n, ac):
        s2 = s2 + x * (div(a, x) - p) * (div(a, x) - p)
    s2 = div(s2, (r - 1) * nbar) / 2
    inner = p * (1 - p) - s2 * (r - 1.0) / r
    a = div(nbar, nc) * (s2 - div(inner - hbar / 4, nbar - 1))
    b = div(nbar, nbar - 1) * (inner - div(hbar * (2 * nbar - 1), 4 * nbar))
    theta = div(a, a + b + hbar / 2)
    known = F.least(*n) > 0
    fixed = (alleles == 0) | (alleles == total)
    return F.when(fixed, 0.0).when(known & (nbar > 1) & (nc != 0), theta)


def fst_weir_cockerham(gts, groups):
    w = site_groups(gts, groups)
    r = range(len(groups))
    n, s, h = ([F.col(f"{c}_{i}") * m for i in r] for c, m in (("n", 2), ("s", 1), ("h", 1)))
    return w.select("site_id", _theta(n, s, h).alias("fst"))


def fst_jackknife(gts, groups, drop="two"):
    """Mean and 95% interval of Fst with one sample left out of each of two groups (or of one group).

    Leaving out a sample changes the counts only through its genotype, so the replicates of a site fall into
    at most nine classes per pair of groups, weighted by how many sample pairs they stand for.
    """
    r = len(groups)
    aggs = []
    for i, g in enumerate(groups):
        aggs += [F.count_if((F.col("grp") == g) & (F.col("gt") == v)).alias(f"k_{i}_{v}") for v in (0, 1, 2)]
    w = gts.filter(F.col("grp").isin(list(groups))).groupBy("site_id").agg(*aggs)
    for i in range(r):
        k = [F.col(f"k_{i}_{v}") for v in (0, 1, 2)]
        w = w.withColumn(f"n_{i}", 2 * (k[0] + k[1] + k[2])).withColumn(f"s_{i}", k[1] + 2 * k[2]).withColumn(f"h_{i}", k[1])
    if drop == "two":
        cases = [((i, u), (j, v)) for i in range(r - 1) for j in range(r) if j != i for u in (0, 1, 2) for v in (0, 1, 2)]
    else:
        cases = [((i, u),) for i in range(r) for u in (0, 1, 2)]
    structs = []
    for case in cases:
        weight = F.lit(1)
        for i, v in case:
            weight = weight * F.col(f"k_{i}_{v}")
        gone = dict(case)
        fields = [weight.cast("long").alias("w")]
        for i in range(r):
            v = gone.get(i)
            fields += [
                (F.col(f"n_{i}") - (0 if v is None else 2)).alias(f"n{i}"),
                (F.col(f"s_{i}") - (v or 0)).alias(f"s{i}"),
                (F.col(f"h_{i}") - (1 if v == 1 else 0)).alias(f"h{i}"),
            ]
        structs.append(F.struct(*fields))
    t = w.select("site_id", F.explode(F.array(*structs)).alias("e")).select("site_id", "e.*").filter("w > 0")
    n, s, h = ([F.col(f"{c}{i}") for i in range(r)] for c in "nsh")
    t = t.withColumn("f", _theta(n, s, h)).filter("f is not null")
    a = t.groupBy("site_id").agg(
        F.sum("w").alias("replicates"), F.sum(F.expr("w * f")).alias("wf"), F.sum(F.expr("w * f * f")).alias("wff")
    )
    m = F.col("replicates")
    a = a.withColumn("mean", F.col("wf") / m)
    var = F.greatest(F.lit(0.0), F.col("wff") - m * F.col("mean") * F.col("mean")) * (m - 1) / m
    half = 1.97 * F.sqrt(var)
    return a.select("site_id", "replicates", F.col("mean").alias("fst_mean"), (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def population_loglik(gts, groups):
    """Log-likelihood of the groups' allele counts under the pooled frequency, relative to the expected counts."""
    w = site_groups(gts, groups)
    r = range(len(groups))
    ac = sum([F.col(f"s_{i}") for i in r][1:], F.col("s_0"))
    tot = 2 * sum([F.col(f"n_{i}") for i in r][1:], F.col("n_0"))
    w = w.withColumn("_p", F.try_divide(ac, tot)).filter("_p is not null")
    p = F.col("_p")
    out = F.lit(0.0)
    for i in r:
        n, k = 2 * F.col(f"n_{i}"), F.col(f"s_{i}")

        def lp(x, n=n):
            comb = lnfact(n.cast("double")) - lnfact(x.cast("double")) - lnfact((n - x).cast("double"))
            return comb + F.when(x > 0, x * F.ln(p)).otherwise(0.0) + F.when(n - x > 0, (n - x) * F.ln(1 - p)).otherwise(0.0)

        best = F.greatest(lp(F.floor(n * p)), lp(F.ceil(n * p)))
        out = out + F.when((n > 0) & (p > 0) & (p < 1), lp(k) - best).otherwise(0.0)
    return w.select("site_id", out.alias("loglik"))


# --- three-genome topologies ----------------------------------------------------------------------

TRANSITIONS = "(ref in ('C', 'T') and alt in ('C', 'T')) or (ref in ('A', 'G') and alt in ('A', 'G'))"


def topology_counts(gts, trio, spacings=(0,), min_qual=25, ignore_transitions=False):
    """Sites where two of three genomes share an allele, all homozygous, thinned to each spacing in turn."""
    a, b, c = trio
    val = lambda s: F.max(F.when(F.col("sample") == s, F.col("gt")))
    ok = gts.filter(F.col("sample").isin(a, b, c) & F.col("gt").isin(0, 2) & (F.col("qual") >= min_qual))
    if ignore_transitions:
        ok = ok.filter(~F.expr(TRANSITIONS))
    w = ok.groupBy("site_id", "chrom", "pos").agg(val(a).alias("a"), val(b).alias("b"), val(c).alias("c"))
    w = w.filter("a is not null and b is not null and c is not null and not (a = b and b = c)")
    out = None
    for ld in spacings:
        kept = w
        if ld > 0:
            anchors = tiling.greedy_anchors(w, ["chrom"], "pos", ld - 1).filter("anchor = pos").drop("anchor")
            kept = w.join(anchors, ["chrom", "pos"], "left_semi")
        n = kept.agg(
            F.count_if(F.expr("a = b")).alias("ab"), F.count_if(F.expr("b = c")).alias("bc"), F.count_if(F.expr("a = c")).alias("ac")
        ).withColumn("spacing", F.lit(ld))
        out = n if out is None else out.unionByName(n)
    return out


def topology_counts_af(gts, trio, min_qual=25, ct_only=True):
    """Most parsimonious pairing of three groups by squared frequency differences; sites with any heterozygote go."""
    skip = "(ref in ('C', 'T') and alt in ('C', 'T'))" if ct_only else TRANSITIONS
    w = site_groups(gts.filter(~F.expr(skip) & (F.col("qual") >= min_qual)), trio).filter(
        "h_0 + h_1 + h_2 = 0 and n_0 > 0 and n_1 > 0 and n_2 > 0"
    )
    f = [F.try_divide(F.col(f"s_{i}"), 2 * F.col(f"n_{i}")) for i in range(3)]
    sq = lambda i, j: (f[i] - f[j]) * (f[i] - f[j])
    w = w.withColumn("ab", sq(0, 1)).withColumn("bc", sq(1, 2)).withColumn("ac", sq(0, 2))
    return w.agg(
        F.count_if(F.expr("ab < bc and ab < ac")).alias("ab"),
        F.count_if(F.expr("bc < ab and bc < ac")).alias("bc"),
        F.count_if(F.expr("ac < ab and ac < bc")).alias("ac"),
        F.count_if(F.expr("not (ab < bc and ab < ac) and not (bc < ab and bc < ac) and not (ac < ab and ac < bc)")).alias("none"),
    )


def zscore_column(df, value, out="z"):
    """(x - mean) / population sd over the known values; unknown values get 0."""
    known = F.when(~F.isnan(value), F.col(value))
    moments = df.agg(F.struct(F.avg(known).alias("m"), F.stddev_pop(known).alias("s")))
    t = df.withColumn("_ms", moments.scalar())
    return t.withColumn(out, F.coalesce(F.try_divide(known - F.col("_ms.m"), F.col("_ms.s")), F.lit(0.0))).drop("_ms")


# --- result tables --------------------------------------------------------------------------------


def d_significance(dstats):
    """Error = 3 |D / Z| and whether |D| exceeds it."""
    err = 3 * F.abs(F.col("d") / F.col("z"))
    return dstats.withColumn("error", err).withColumn("significant", F.abs("d") > err)


def best_topology(dstats):
    """Of the three arrangements of a triple, the one with the smallest |D|; ties by population names."""
    triple = F.concat_ws(",", F.array_sort(F.array("p1", "p2", "p3")))
    first = F.struct(F.abs("d").alias("_a"), "p1", "p2", "p3", "d", "z")
    best = dstats.withColumn("triple", triple).groupBy("triple").agg(F.min(first).alias("b"))
    return best.select("triple", "b.p1", "b.p2", "b.p3", "b.d", "b.z")


def parsimonious_topology(dstats):
    """Of the arrangements of a triple, those whose ABBA and BABA counts are not the largest count of the triple."""
    triple = F.concat_ws(",", F.array_sort(F.array("p1", "p2", "p3")))
    t = dstats.withColumn("triple", triple)
    top = t.groupBy("triple").agg(F.max(F.greatest("abba", "baba")).alias("top"))
    return t.join(top, "triple").filter("abba < top and baba < top").drop("top")


def sort_by_loglik(tests):
    """Least likely sites first (a distributed range sort)."""
    return tests.orderBy("loglik", "site_id")
