"""Filters, merges and counts over variant calls, one row per (site, sample)."""

import math
from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genespark.functions.draws import draw
from genespark.operators import tiling

# --- filters --------------------------------------------------------------------------------------


def column_in_set(df, column, values, keep=True):
    """Rows whose column is (or is not) in a one-column table; rows without the column are dropped either way."""
    known = df.filter(F.col(column).isNotNull())
    names = values.select(F.col(values.columns[0]).alias(column)).distinct()
    return known.join(names, column, "left_semi" if keep else "left_anti")


def clean_numeric_column(df, column, out="value"):
    """Numbers of a text column; rows that hold no finite number are dropped."""
    num = F.col(column).try_cast("double")
    return df.withColumn(out, num).filter(F.col(out).isNotNull() & ~F.isnan(out) & (F.abs(out) < float("inf")))


def depth_of(ad):
    return F.aggregate(ad, F.lit(0), lambda a, x: a + x)


def filter_depth_set(variants, depths, ad="ad"):
    """BED rows of the sites whose total allele depth is in a table of accepted depths."""
    t = variants.withColumn("dp", depth_of(F.col(ad)))
    kept = t.join(depths.select("dp").distinct(), "dp", "left_semi")
    return kept.select("chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))


def depth_set_from_edf(het_by_depth, low=0.05, high=0.99, most=0.5):
    """Depths with the lowest heterozygosity that together hold the wanted share of sites.

    One row per depth goes in, so the windows run over at most the largest depth.
    """
    t = het_by_depth.filter("dp >= 2")
    below = W.orderBy("dp").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("_total", F.sum("nsites").over(W.partitionBy())).withColumn("_before", F.coalesce(F.sum("nsites").over(below), F.lit(0)))
    t = t.filter((F.col("_before") + F.col("nsites") > low * F.col("_total")) & (F.col("_before") <= high * F.col("_total")))
    t = t.withColumn("rate", F.col("hets") / F.col("nsites"))
    ranked = W.orderBy("rate", "dp").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("_seen", F.coalesce(F.sum("nsites").over(ranked), F.lit(0)) / F.col("_total"))
    return t.filter(F.col("_seen") <= most).select("dp", "nsites", "rate")


def snp_min_spacing(sites, distance, size=tiling.TILE):
    """Sites at least ``distance`` from both neighbours on the chromosome."""
    t = tiling.with_neighbour(sites, ["chrom"], "pos", "pos", "_prev", size)
    t = tiling.with_neighbour(t, ["chrom"], "pos", "pos", "_next", size, side="next")
    far = lambda gap: gap.isNull() | (gap >= distance)
    return t.filter(far(F.col("pos") - F.col("_prev")) & far(F.col("_next") - F.col("pos"))).drop("_prev", "_next")


def is_transition(scope="all"):
    ct = F.col("ref").isin("C", "T") & F.col("alt").isin("C", "T") & (F.col("ref") != F.col("alt"))
    ag = F.col("ref").isin("A", "G") & F.col("alt").isin("A", "G") & (F.col("ref") != F.col("alt"))
    return ct if scope == "ct_only" else ct | ag


def drop_transitions(variants, scope="all", as_missing=False):
    if as_missing:
        return variants.withColumn("gt", F.when(~is_transition(scope), F.col("gt")))
    return variants.filter(~is_transition(scope))


def biallelic_snps_only(variants, alts="alts"):
    one = F.try_element_at(F.col(alts), F.lit(1))
    return variants.filter((F.size(alts) == 1) & (F.length("ref") == 1) & (F.length(one) == 1) & (one != "."))


def site_filters(gts, monomorphic=True, singleton=False, uninformative=True):
    """Drop sites without calls, with one allele only, or with a single odd sample."""
    s = gts.groupBy("site_id").agg(F.coalesce(F.sum("gt"), F.lit(0)).alias("s"), (2 * F.count("gt")).alias("n"))
    conds = []
    if uninformative:
        conds.append("n > 0")
    if monomorphic:
        conds.append("s <> 0 and s <> n")
    if singleton:
        conds.append("s <> 2 and s <> n - 2")
    good = s.filter(F.expr(" and ".join(f"({c})" for c in conds))).select("site_id")
    return gts.join(good, "site_id", "left_semi")


def select_individuals(gts, wanted):
    """Subset and reorder individuals by a second individual table (sample, idx)."""
    new = wanted.select("sample", F.col("idx").alias("_new"))
    return gts.join(new, "sample").withColumn("idx", F.col("_new")).drop("_new")


def thin_sites(sites, distance, size=tiling.TILE):
    """Greedy thinning: a site goes if it is closer than ``distance`` to the last one kept."""
    kept = tiling.greedy_anchors(sites, ["chrom"], "pos", distance - 1, size).filter("anchor = pos")
    return sites.join(kept.select("chrom", "pos"), ["chrom", "pos"], "left_semi")


def depth_quality_filter(calls, min_qual=0, depth=None, min_depth=None, max_depth=None):
    """Quality threshold and a depth band; ``depth`` stands for the band depth/2 .. 2 depth."""
    lo = depth / 2 if depth else (min_depth or 0)
    hi = depth * 2 if depth else max_depth
    ok = (F.col("qual") >= min_qual) & (F.col("dp") >= lo)
    return calls.filter(ok & (F.col("dp") <= hi) if hi is not None else ok)


def regex_population_filter(dstats, p1=(), p2=(), p3=()):
    """Rows where each listed population column matches any of its expressions."""
    for col, exps in (("p1", p1), ("p2", p2), ("p3", p3)):
        if exps:
            dstats = dstats.filter(reduce(lambda a, b: a | b, [F.col(col).rlike(e) for e in exps]))
    return dstats


def het_snps(calls):
    return calls.filter((F.length("ref") == 1) & (F.length("alt") == 1) & (F.col("gt") == 1))


def non_snps(calls):
    return calls.filter((F.length("ref") != 1) | (F.length("alt") != 1))


def haploidise(calls, mode="random", seed=1):
    """Heterozygotes become one allele at random, missing, or the allele with more reads (ties at random)."""
    coin = draw(F.lit(2), seed, "site_id", "sample") * 2
    if mode == "missing":
        het = F.lit(None).cast("int")
    elif mode == "majority":
        het = F.when(F.col("dp_ref") > F.col("dp_alt"), 2).when(F.col("dp_ref") < F.col("dp_alt"), 0).otherwise(coin)
    else:
        het = coin
    return calls.withColumn("gt", F.when(F.col("gt") == 1, het).otherwise(F.col("gt")).cast("int"))


# --- joins and merges -----------------------------------------------------------------------------


def loci_semi_join(variants, loci):
    return variants.join(loci.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")


def merge_call_sets(records, max_depth=None, majority=False, seed=1, drop_transitions_too=False,
                    monomorphic=False, singleton=False, uninformative=False):
    """Merge call sets by position into pseudo-haploid genotypes (2 = reference, 0 = alternative, NULL).

    ``records``: chrom, pos, ref, alt ('.' if none), filter, sample, dp_ref, dp_alt.  A position with two
    different alternatives or a non-SNP is dropped; a sample without a record there is simply absent.
    """
    alt = F.when(F.col("alt") != ".", F.col("alt"))
    snp = (F.length("ref") == 1) & (alt.isNull() | (F.length("alt") == 1))
    total = F.col("dp_ref") + F.col("dp_alt")
    pick = F.when(draw(total, seed, "chrom", "pos", "sample") < F.col("dp_ref"), 2).otherwise(0)
    if majority:
        pick = F.when(F.col("dp_ref") > F.col("dp_alt"), 2).when(F.col("dp_ref") < F.col("dp_alt"), 0).otherwise(pick)
    call = (
        F.when(alt.isNull(), F.when(F.col("dp_ref") > 0, 2))
        .when(F.col("dp_ref") == 0, F.when(F.col("dp_alt") > 0, 0))
        .when(total > F.col("_max"), None)
        .otherwise(pick)
    )
    if max_depth is not None:
        r = records.join(max_depth.select("sample", F.col("max_dp").alias("_max")), "sample", "left")
    else:
        r = records.withColumn("_max", F.lit(None).cast("long"))
    r = r.withColumn("gt", call.cast("int")).drop("_max")
    site = r.groupBy("chrom", "pos").agg(
        F.min(alt).alias("_lo"), F.max(alt).alias("_hi"), F.min("ref").alias("site_ref"), F.bool_and(snp).alias("_snp"),
        F.coalesce(F.sum("gt"), F.lit(0)).alias("_s"), (2 * F.count("gt")).alias("_n"),
    ).filter("_snp and (_lo is null or _lo = _hi)")
    if monomorphic:
        site = site.filter("_hi is not null and _s <> 0 and _s <> _n")
    if singleton:
        site = site.filter("_s <> 2 and _s <> _n - 2")
    if uninformative:
        site = site.filter("_n > 0")
    site = site.select("chrom", "pos", F.col("site_ref").alias("ref"), F.coalesce("_hi", F.lit("X")).alias("alt"))
    if drop_transitions_too:
        site = site.filter(~is_transition())
    return r.drop("ref", "alt").join(site, ["chrom", "pos"])


def pass_filter(records, drop=None, only_pass=False):
    """Drop records with a FILTER entry, or keep PASS (and unset) only."""
    if drop:
        records = records.filter(~F.array_contains(F.split("filter", ";"), drop))
    return records.filter(F.col("filter").isin("PASS", ".")) if only_pass else records


def consensus_ref_alt(calls):
    """Reference and alternative per position over all samples; disagreement or absence becomes X."""
    alt = F.when(F.col("alt") != ".", F.col("alt"))
    a = calls.groupBy("chrom", "pos").agg(F.max_by("ref", "sample").alias("ref"), F.min(alt).alias("lo"), F.max(alt).alias("hi"))
    known = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("X")
    return a.select("chrom", "pos", F.coalesce("ref", F.lit("X")).alias("ref"), known.alias("alt"))


def in_every_set(calls, n, key=("chrom", "pos"), source="source"):
    """Positions present in all n call sets (pre-aggregated per set, so repeats inside one set count once)."""
    once = calls.select(*key, source).distinct()
    return once.groupBy(*key).agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") == n).drop("sets")


def ascertain_snps(outgroups, sample_calls, n):
    """Homozygous reference in all n outgroups and heterozygous in the sample."""
    fixed = in_every_set(outgroups.filter("gt = 2"), n, source="sample")
    return sample_calls.filter("gt = 1").join(fixed, ["chrom", "pos"], "left_semi")


def call_set_consensus(*sets):
    """Calls all callers agree on, by position and alleles."""
    key = ["chrom", "pos", "ref", "alt"]
    return reduce(lambda a, b: a.join(b.select(*key).distinct(), key, "left_semi"), sets[1:], sets[0])


# --- counts ---------------------------------------------------------------------------------------


def genotype_counts(calls, by=("sample",)):
    """Homozygous reference, heterozygous, homozygous alternative and total per group."""
    c = lambda g: F.count_if(F.col("gt") == g)
    return calls.groupBy(*by).agg(c(2).alias("hom_ref"), c(1).alias("het"), c(0).alias("hom_alt"), F.count("gt").alias("total"))


def genotype_counts_by_min_depth(calls, depths=(1, 2, 3, 4, 5), missing="hom_ref"):
    """Genotype counts at depth >= x for each x; missing calls count as homozygous reference or are dropped."""
    gt = F.coalesce("gt", F.lit(2)) if missing == "hom_ref" else F.col("gt")
    per = calls.filter(gt.isNotNull()).groupBy("sample", F.least("dp", F.lit(max(depths))).alias("dp")).agg(
        *[F.count_if(gt == g).alias(f"g{g}") for g in (0, 1, 2)]
    )
    out = per.withColumn("min_dp", F.explode(F.array(*[F.lit(x) for x in depths]))).filter("dp >= min_dp")
    out = out.groupBy("sample", "min_dp").agg(F.sum("g2").alias("hom_ref"), F.sum("g1").alias("het"), F.sum("g0").alias("hom_alt"))
    return out.withColumn("total", F.expr("hom_ref + het + hom_alt"))


def snp_type_counts(calls):
    """REF>ALT table over the union of SNPs, with its class."""
    union = calls.select("chrom", "pos", "ref", "alt").distinct()
    kind = F.when(is_transition(), "Ti").otherwise("Tv")
    return union.groupBy("ref", "alt", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def snp_set_sizes(calls):
    """Distinct SNPs per sample and chromosome with totals, and the union over samples."""
    chrom = F.col("chrom").cast("string").alias("chrom")
    own = calls.select("sample", chrom, "pos", "ref", "alt").distinct()
    union = own.select(F.lit("union").alias("sample"), "chrom", "pos", "ref", "alt").distinct()
    every = own.unionByName(union)
    sizes = every.rollup("sample", "chrom").agg(F.count(F.lit(1)).alias("n")).filter("sample is not null")
    return sizes.select("sample", F.coalesce("chrom", F.lit("total")).alias("chrom"), "n")


def depth_histogram(calls, max_depth=None, dp="dp"):
    """Dense table of sites per depth, from 0 to the deepest (or below a given limit): count, share, mean and variance of quality."""
    t = calls.filter(F.col(dp).isNotNull() if max_depth is None else F.col(dp) < max_depth)
    h = t.groupBy(F.col(dp).cast("long").alias("dp")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("qual").alias("qual_mean"), F.var_pop("qual").alias("qual_var")
    )
    total = h.agg(F.sum("n").alias("t"))
    dense = tiling.dense_from_zero(h, "dp", max_depth).join(h, "dp", "left")
    return dense.fillna(0, ["n"]).fillna(0.0, ["qual_mean", "qual_var"]).withColumn("share", F.col("n") / total.scalar())


def value_distribution(calls, columns=("qual", "dp", "gt")):
    """Histogram of each listed column in one pass."""
    pair = [F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in columns]
    return calls.select(F.explode(F.array(*pair)).alias("e")).select("e.*").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def site_total_depth(calls):
    return calls.groupBy("chrom", "pos").agg(F.sum("dp").alias("total"), F.max("dp").alias("deepest"))


def max_depth_per_sample(calls):
    return calls.groupBy("sample").agg(F.max("dp").alias("max_dp"))


def samples_covered(calls, loci):
    """How many loci are covered by 0, 1, 2, ... samples."""
    per = calls.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("samples"))
    n = loci.select("chrom", "pos").distinct().join(per, ["chrom", "pos"], "left").fillna(0, ["samples"])
    return n.groupBy("samples").agg(F.count(F.lit(1)).alias("n"))


def mismatch_rate(calls, min_qual=0, depth=None, contigs=None, mode="expected", seed=1):
    """Share of sites where one pseudo-read differs from the reference: drawn, or its exact expectation."""
    t = depth_quality_filter(calls, min_qual, depth)
    if contigs is not None:
        t = t.join(contigs.select("chrom").distinct(), "chrom", "left_semi")
    total = F.col("dp_ref") + F.col("dp_alt")
    if mode == "expected":
        mm = F.coalesce(F.try_divide("dp_alt", total), F.lit(0.0))
    else:
        drawn = draw(F.greatest(total, F.lit(1)), seed, "site_id", "sample") >= F.col("dp_ref")
        mm = F.when((F.col("dp_alt") > 0) & drawn, 1).otherwise(0)
    return t.groupBy("sample").agg(F.sum(mm).alias("mm"), F.count(F.lit(1)).alias("sites"), F.avg(mm).alias("rate"))


def heterozygosity_by_depth(calls, max_dp=None, mode="expected", seed=1):
    """Sites and heterozygous sites per total depth (below a limit if one is given), from two reads drawn (with replacement) at each site."""
    s = calls.groupBy("site_id").agg(F.sum("dp_ref").alias("r"), F.sum("dp_alt").alias("a"))
    s = s.withColumn("dp", F.col("r") + F.col("a")).filter(F.col("dp") > 0)
    s = s if max_dp is None else s.filter(F.col("dp") < max_dp)
    if mode == "expected":
        het = 2.0 * F.col("r") * F.col("a") / (F.col("dp") * F.col("dp"))
    else:
        read = lambda k: draw(F.col("dp"), seed, "site_id", F.lit(k)) < F.col("r")
        het = F.when(read(0) != read(1), 1).otherwise(0)
    return s.groupBy("dp").agg(F.count(F.lit(1)).alias("nsites"), F.sum(het).alias("hets"))


# --- windows along the chromosome -----------------------------------------------------------------


def rolling_depth_histogram(depths, width, keys=("sample", "chrom"), tail=False, size=tiling.TILE, bucket=1 << 16):
    """Histogram of the trailing depth sum over ``width`` records; zero sums are skipped.

    ``tail`` adds the sums that shrink behind the last record of each chromosome.
    """
    keys = list(keys)
    d = depths.select(*keys, "pos", F.greatest(F.coalesce("dp", F.lit(0)), F.lit(0)).alias("dp"))
    roll = tiling.rolling_rows(d, keys, "pos", width, {"s": F.sum("dp")}, size, bucket).select(keys[0], "s")
    if tail:
        numbered = tiling.row_numbers(d, keys, "pos", "_rn", size)
        last = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        end = numbered.join(last, keys).filter(F.col("_rn") > F.col("_n") - width)  # at most ``width`` per chromosome
        w = W.partitionBy(*keys).orderBy(F.col("_rn").desc()).rowsBetween(W.unboundedPreceding, 0)
        roll = roll.unionByName(end.withColumn("s", F.sum("dp").over(w)).filter("_rn > greatest(1, _n - %d + 1)" % width).select(keys[0], "s"))
    return roll.filter("s > 0").groupBy(keys[0], "s").agg(F.count(F.lit(1)).alias("n"))


#: Windows of one tile, as a multiple of the windows that share a unit: what is copied over tile borders is a share of one in so many.
WINDOW_TILE = 64


def sliding_windows(sites, counts, window, step, keys=("chrom",), contigs=None, rows=0):
    """Sums per window [k step, k step + window) over 0-based positions, dense from 0 to the last full window.

    The unit is the greatest length that divides both window and step. Sites are first summed per unit, which shuffles one
    row per (key, unit); each unit then goes to the tile of consecutive windows that hold it (two at a border) and adds
    to them there. With ``rows``, the rows that the sites come from, units hold few sites: these go to their tiles
    at once, and the shuffle is as wide as that number asks. With ``contigs`` (chrom, length) the last windows end where
    their contig does.
    """
    keys = list(keys)
    unit = math.gcd(window, step)
    per, stride = window // unit, step // unit
    tile = WINDOW_TILE * -(-per // stride)
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    at = tiling.tile_of(F.col("pos") - 1, unit)
    low = F.greatest(zero, F.ceil((F.col("_c") - per + 1) / stride).cast("long"))
    high = F.floor(F.col("_c") / stride).cast("long")
    summed = lambda t, *by: t.groupBy(*keys, *by).agg(*[F.sum(n).alias(n) for n in counts])

    chunk = sites.select(*keys, at.alias("_c"), *[c.cast("long").alias(n) for n, c in counts.items()]).dropna(subset=keys)
    if not rows:
        chunk = summed(chunk, "_c")
    held = chunk.filter(low <= high)  # a step longer than the window skips units
    held = held.withColumn("_tile", F.explode(F.sequence(tiling.tile_of(low, tile), tiling.tile_of(high, tile)))).withColumn("_last", none)
    last = F.greatest(zero, F.floor((F.col("_top") - per + 1) / stride).cast("long"))
    grid = sites.groupBy(*keys).agg(F.max(at).alias("_top")).select(*keys, last.alias("_last"))
    grid = grid.withColumn("_tile", F.explode(F.sequence(zero, tiling.tile_of("_last", tile)))).withColumn("_c", none)
    t = held.unionByName(grid.withColumns({n: zero for n in counts}))

    t = tiling.spread(t, *keys, "_tile", rows=rows)
    if rows:
        t = summed(t, "_tile", "_c", "_last")
    in_grid = F.col("_last").isNotNull()
    begin = F.col("_tile") * tile
    first_k = F.when(in_grid, begin).otherwise(F.greatest(low, begin))
    last_k = F.least(F.when(in_grid, F.col("_last")).otherwise(high), begin + (tile - 1))
    t = t.select(*keys, "_tile", *counts, in_grid.alias("_in"), F.explode(F.sequence(first_k, last_k)).alias("_k"))
    out = t.groupBy(*keys, "_tile", "_k").agg(*[F.sum(n).alias(n) for n in counts], F.max("_in").alias("_in")).filter("_in")
    end = F.col("_k") * step + window
    if contigs is not None:
        out = out.join(contigs.select("chrom", F.col("length").alias("_length")), "chrom", "left")
        end = F.least(end, F.col("_length"))
    return out.select(*keys, (F.col("_k") * step).alias("start"), end.alias("end"), *counts)


def sliding_homozygosity(calls, window=5_000_000, step=200_000, min_depth=0, max_depth=1 << 30, contigs=None, rows=0):
    """Sites and homozygous sites of each sample per window, inside a depth band."""
    t = calls.filter(F.col("gt").isNotNull() & F.col("dp").between(min_depth, max_depth))
    return sliding_windows(t, {"n": F.lit(1), "hom": F.col("gt") != 1}, window, step, ("sample", "chrom"), contigs, rows)


def shared_homozygosity(calls, samples, window=5_000_000, step=200_000, bands=None):
    """Sites where all listed samples are called within their depth bands, and those where they share one allele."""
    band = F.lit(True)
    for s, (lo, hi) in (bands or {}).items():
        band = band & ((F.col("sample") != s) | F.col("dp").between(lo, hi))
    t = calls.filter(F.col("sample").isin(list(samples)) & F.col("gt").isNotNull() & band)
    per = t.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("_n"), F.min("gt").alias("_lo"), F.max("gt").alias("_hi"))
    per = per.filter(F.col("_n") == len(samples))
    same = (F.col("_lo") == F.col("_hi")) & (F.col("_lo") != 1)
    return sliding_windows(per, {"n": F.lit(1), "hom": same}, window, step)


def roh_windows(gts, window, step, least=10, missing=1 / 3):
    """Homozygous share per sample and window; NULL with few calls or too many missing."""
    counts = {"n": F.col("gt").isNotNull(), "het": F.coalesce(F.col("gt") == 1, F.lit(False)), "miss": F.col("gt").isNull()}
    w = sliding_windows(gts, counts, window, step, ("sample", "chrom"))
    bad = (F.col("n") < least) | (F.try_divide("miss", F.expr("miss + n")) > missing)
    return w.withColumn("roh", F.when(~F.coalesce(bad, F.lit(True)), (F.col("n") - F.col("het")) / F.col("n")))


def sample_het_miss(gts):
    """Percent heterozygous among calls and percent missing, per sample."""
    a = gts.groupBy("sample", "grp").agg(F.count_if(F.col("gt") == 1).alias("h"), F.count("gt").alias("n"), F.count(F.lit(1)).alias("all"))
    return a.select("sample", "grp", F.try_divide(100 * F.col("h"), "n").alias("het_pct"),
                    (100 * (F.col("all") - F.col("n")) / F.col("all")).alias("miss_pct"))


def coverage_quantiles(hist, probs, value="dp", n="n", inclusive=False):
    """First depth where the share of sites below (or up to) it exceeds each probability.

    A histogram has one row per depth, so its running sum stays small.
    """
    before = W.orderBy(value).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    t = hist.withColumn("_c", F.coalesce(F.sum(n).over(before), F.lit(0)) / F.sum(n).over(W.partitionBy()))
    t = t.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    return t.filter(F.col("_c") > F.col("prob")).groupBy("prob").agg(F.min(value).alias("depth"))


def recombination_density(breakpoints, fai, step, window):
    """Moving average over window / step of the share of a chromosome's breakpoints per step; 0 without breakpoints."""
    if window % step:
        raise ValueError("the window must hold a whole number of steps")
    per = window // step
    counts = breakpoints.groupBy("chrom", tiling.tile_of("pos", step).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    steps = F.ceil(F.col("length") / step).cast("long")
    grid = fai.select("chrom", "length", F.explode(F.sequence(F.lit(0).cast("long"), steps - 1)).alias("k"))
    total = counts.groupBy("chrom").agg(F.sum("n").alias("_t"))
    t = grid.join(counts, ["chrom", "k"], "left").fillna(0, ["n"]).join(total, "chrom", "left")
    ahead = W.partitionBy("chrom").orderBy("k").rowsBetween(0, per - 1)  # one row per step of the contig
    t = t.withColumn("density", F.avg(F.coalesce(F.col("n") / F.col("_t"), F.lit(0.0))).over(ahead))
    full = F.col("k") <= F.ceil(F.col("length") / step) - per
    return t.filter(full).select("chrom", (F.col("k") * step + window // 2).alias("mid"), "density")


def run_length_encoding(observed, af, min_depth=0, max_depth=1 << 30, size=tiling.TILE):
    """Runs of equal (state, alternative alleles, alleles) along each chromosome, with gap runs.

    ``observed``: chrom, pos, gt (0, 1, 2 alternatives or NULL), dp of one sample at every called position.
    State is -1 where the sample is missing or outside the depth band.
    """
    ok = F.col("dp").between(min_depth, max_depth) & F.col("gt").isNotNull()
    t = observed.select("chrom", "pos", F.when(ok, F.col("gt")).otherwise(-1).alias("state"))
    t = t.join(af, ["chrom", "pos"], "left").fillna(0, ["n_alt", "n_total"])
    t = tiling.with_neighbour(t, ["chrom"], "pos", "pos", "_prev", size)
    own = t.select("chrom", "pos", F.lit(1).alias("len"), "state", F.col("n_alt").cast("long").alias("n_alt"), F.col("n_total").cast("long").alias("n_total"))
    gap = F.col("pos") - F.coalesce("_prev", F.lit(0)) - 1
    gaps = t.filter(gap > 0).select(
        "chrom", (F.coalesce("_prev", F.lit(0)) + 1).alias("pos"), gap.alias("len"), F.lit(-1).alias("state"),
        F.lit(0).cast("long").alias("n_alt"), F.lit(0).cast("long").alias("n_total"),
    )
    both = own.unionByName(gaps).withColumn("_key", F.concat_ws(",", "state", "n_alt", "n_total"))
    both = tiling.with_neighbour(both, ["chrom"], "pos", "_key", "_before", size)
    runs = tiling.islands(both, ["chrom"], "pos", F.col("_before") == F.col("_key"), "run", size)
    return runs.groupBy("chrom", "run").agg(
        F.min("pos").alias("start"), F.sum("len").alias("span"), F.first("state").alias("state"),
        F.first("n_alt").alias("n_alt"), F.first("n_total").alias("n_total"),
    )
