"""Cytosine methylation: counts, conversion, autocovariance and pileup from read pairs."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from genespark.functions.draws import draw
from genespark.functions.special import beta_cdf
from genespark.operators import tiling
from genespark.operators.sequences import chunks
from genespark.sinks.formats import context_class


def meth_count_table(meth, most=None):
    """Sites per (methylated, unmethylated) pair, below a limit of coverage if one is given."""
    t = meth if most is None else meth.filter(F.col("c") + F.col("mc") < most)
    return t.groupBy(F.col("mc").alias("methylated"), F.col("c").alias("unmethylated")).agg(F.count(F.lit(1)).alias("n"))


def meth_sum_replicates(*tables, key=("chrom", "start", "end", "strand")):
    """Add the counts of replicates; a position may be missing in any of them."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    out = both.groupBy(*key).agg(F.sum("c").alias("c"), F.sum("mc").alias("mc"))
    return out.withColumn("depth", F.col("c") + F.col("mc")).withColumn("percent", F.try_divide(100 * F.col("mc"), "depth"))


def conversion_stats(meth, by=()):
    """Counts per context (trinucleotide or class) and the overall conversion percentage."""
    cls = F.coalesce(context_class(F.col("context")), F.col("context"))
    pick = lambda c, k: F.coalesce(F.sum(F.when(cls == k, F.col(c))), F.lit(0))
    aggs = [pick(c, k).alias(f"{k.lower()}_{c}") for c in ("c", "mc") for k in ("CpG", "CHG", "CHH")]
    total = lambda c: F.expr(f"cpg_{c} + chg_{c} + chh_{c}")
    a = meth.groupBy(*by).agg(*aggs)
    return a.withColumn("conversion", F.try_divide(100 * total("c"), total("c") + total("mc")))


def mapping_stats(depths, genome_size, lengths, dp="dp", length="length"):
    """Covered share, depth mean and sd over covered sites and over the genome, read length mean and sd."""
    g = float(genome_size)
    d = depths.filter(F.col(dp) > 0).agg(
        F.count(F.lit(1)).alias("covered"), F.sum(dp).alias("_s"), F.sum(F.col(dp) * F.col(dp)).alias("_q")
    )
    n = F.col("covered")
    d = d.select(
        "covered", (100 * n / g).alias("percent_covered"), (F.col("_s") / n).alias("depth_mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / n - F.pow(F.col("_s") / n, 2))).alias("depth_sd"), (F.col("_s") / g).alias("genome_depth_mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / g - F.pow(F.col("_s") / g, 2))).alias("genome_depth_sd"),
    )
    r = lengths.agg(F.struct(F.count(F.lit(1)).alias("reads"), F.avg(length).alias("length_mean"), F.stddev_samp(length).alias("length_sd")))
    return d.withColumn("_r", r.scalar()).select("*", "_r.*").drop("_r")


def metrics_totals(lines):
    """Totals of the folding metrics: pairs, folded pairs, pairs with complete hairpins."""
    last = F.element_at(F.split(F.trim("value"), r"\s+"), -1).try_cast("long")
    before_last = F.element_at(F.split(F.trim("value"), r"\s+"), -2).try_cast("long")
    has = lambda p: F.col("value").rlike(p)
    return lines.agg(
        F.sum(F.when(has("^Total read pairs"), last)).alias("total_pairs"),
        F.sum(F.when(has("folded read pairs"), before_last)).alias("folded"),
        F.sum(F.when(has("read pairs with complete"), last)).alias("complete_hairpins"),
    )


# --- autocovariance -------------------------------------------------------------------------------


def _lag_sums(max_dist, bin_size, tile, pos):
    """Grouped-map: products and pair counts per lag bin inside one tile and its halo, by convolution."""
    size = 1 << (tile + max_dist).bit_length()

    def run(pdf):
        t = int(pdf["_tile"].iloc[0])
        at = pdf[pos].to_numpy() - t * tile
        own = at < tile
        signals = []
        for v in (pdf["_v"].to_numpy(), pdf["_c"].to_numpy(dtype=float)):
            a, b = np.zeros(size), np.zeros(size)
            np.add.at(a, at[own], v[own])
            np.add.at(b, at, v)
            signals.append(np.fft.irfft(np.conj(np.fft.rfft(a)) * np.fft.rfft(b), size)[:max_dist])
        bins = np.arange(max_dist) // bin_size
        total = np.bincount(bins, signals[0])
        pairs = np.bincount(bins, np.rint(signals[1]))
        keep = pairs > 0
        lag = np.arange(len(total)) * bin_size
        return pd.DataFrame({"lag": lag[keep], "n": pairs[keep].astype(np.int64), "total": total[keep]})

    return run


def meth_autocovariance(levels, value="level", pos="pos", max_dist=10_000, bin_size=10, least=100, tile=1 << 18):
    """Covariance and correlation of methylation by distance, from the first bin on until one is too thin.

    The pairs within a distance are never written out: a tile of positions with a halo of ``max_dist`` is
    correlated with itself, which gives the sum over all its pairs at every distance.
    """
    moments = levels.agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(F.lit(1)).alias("n")).first()
    mean, var = [F.lit(moments[c]).cast("double") for c in ("m", "v")]
    t = levels.select("chrom", F.col(pos).cast("long").alias(pos), (F.col(value) - mean).alias("_v"))
    t = t.groupBy("chrom", pos).agg(F.sum("_v").alias("_v"), F.count(F.lit(1)).alias("_c"))
    own = tiling.tile_of(pos, tile)
    halo = (F.col(pos) % tile < max_dist) & (own > 0)
    halved = t.withColumn("_tile", F.explode(F.when(halo, F.array(own - 1, own)).otherwise(F.array(own))))
    run = _lag_sums(max_dist, bin_size, tile, pos)
    parts = tiling.spread(halved, "chrom", "_tile", rows=moments["n"]).groupBy("chrom", "_tile").applyInPandas(run, "lag long, n long, total double")
    lags = parts.groupBy("lag").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter(F.col("lag") > 0)
    grid = levels.sparkSession.range(1, max_dist // bin_size).select((F.col("id") * bin_size).alias("lag"))
    full = grid.join(lags, "lag", "left").fillna(0, ["n"])
    stop = full.filter(F.col("n") <= least).agg(F.min("lag"))
    out = full.filter((F.col("n") > least) & (F.col("lag") < F.coalesce(stop.scalar(), F.lit(max_dist))))
    out = out.withColumn("cov", F.col("total") / (F.col("n") - 1))
    return out.select("lag", "n", "cov", (F.col("cov") / var).alias("cor"))


# --- extraction and summaries ---------------------------------------------------------------------


def meth_pca_extract(meth, strand, min_coverage=1):
    """Percent methylation of numbered chromosomes on one strand at a minimum coverage."""
    n = F.col("c") + F.col("mc")
    t = meth.filter(F.col("chrom").cast("string").rlike("^(chr)?[0-9]") & (F.col("strand") == strand) & (n >= min_coverage))
    return t.select("chrom", "start", (100 * F.col("mc") / n).alias("percent"))


def meth_pca_table(extracts):
    """Positions present in every sample, one column per sample (named by the dictionary)."""
    out = None
    for name, t in extracts.items():
        one = t.select("chrom", "start", F.col("percent").alias(name))
        out = one if out is None else out.join(one, ["chrom", "start"])
    return out


def bin_methylation_summary(bins, coverages=(5, 3, 0), probs=(0.25, 0.5, 0.75)):
    """Exact quartiles of the bin levels per chromosome and coverage threshold."""
    t = bins.withColumn("min_coverage", F.explode(F.array(*[F.lit(c) for c in coverages]))).filter(F.col("coverage") >= F.col("min_coverage"))
    return tiling.exact_quantiles(t, ["chrom", "min_coverage"], "level", probs)


def meth_level_mixture(counts, grid, max_depth=1 << 30, least=1):
    """Mean posterior distribution function of the methylation level per depth, on a grid of levels."""
    depth = F.col("methylated") + F.col("unmethylated")
    t = counts.filter((depth <= max_depth) & (F.col("n") >= least)).withColumn("depth", depth)
    t = t.withColumn("x", F.explode(F.array(*[F.lit(float(x)) for x in grid])))
    t = t.withColumn("_f", beta_cdf(F.col("methylated") + 1.0, F.col("unmethylated") + 1.0, "x"))
    return t.groupBy("depth", "x").agg((F.sum(F.col("n") * F.col("_f")) / F.sum("n")).alias("cdf"))


# --- read pairs -----------------------------------------------------------------------------------


def _complement(base):
    return F.translate(base, "ACGT", "TGCA")


def cigar_blocks(cigar):
    """(operation, length, query offset, reference offset) of each CIGAR element."""
    ops = F.arrays_zip(
        F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1)).alias("n"),
        F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2)).alias("op"),
    )
    empty = F.array().cast("array<struct<op:string,n:int,q:int,r:int>>")
    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("r"), empty.alias("out"))

    def step(acc, x):
        n = x["n"].cast("int")
        query = F.when(x["op"].isin("M", "I", "S", "=", "X"), n).otherwise(0)
        ref = F.when(x["op"].isin("M", "D", "N", "=", "X"), n).otherwise(0)
        item = F.struct(x["op"].alias("op"), n.alias("n"), acc["q"].alias("q"), acc["r"].alias("r"))
        return F.struct((acc["q"] + query).alias("q"), (acc["r"] + ref).alias("r"), F.concat(acc["out"], F.array(item)).alias("out"))

    return F.aggregate(ops, start, step, lambda acc: acc["out"])


def aligned_pairs(aln, min_base_quality=0, min_5=0, min_3=0):
    """One row per aligned base of a folded read: chrom, pos0, the pair of bases on the two strands.

    Columns: chrom, pos0, cigar, rev, s1, s2, q1, q2 (first and second strand as sequenced, with qualities).
    """
    head = F.coalesce(F.regexp_extract("cigar", r"^(\d+)H", 1).try_cast("int"), F.lit(0))
    tail = F.coalesce(F.regexp_extract("cigar", r"(\d+)H$", 1).try_cast("int"), F.lit(0))
    span = F.length("s1") - head - tail
    letters = F.arrays_zip(*[F.split(c, "").alias(c) for c in ("s1", "s2", "q1", "q2")])
    kept = F.slice(letters, F.when(F.col("rev"), tail).otherwise(head) + 1, span)
    # in reference direction, without hard-clipped bases: entry i is query base i
    t = aln.select(
        "chrom", "pos0", "rev", span.alias("_span"), F.when(F.col("rev"), F.reverse(kept)).otherwise(kept).alias("_z"),
        cigar_blocks(F.col("cigar")).alias("_blocks"),
    )
    t = t.select("chrom", "pos0", "rev", "_span", "_z", F.explode("_blocks").alias("_b")).filter(F.col("_b.op").isin("M", "=", "X"))
    t = t.select("chrom", "pos0", "rev", "_span", "_b", F.posexplode(F.slice("_z", F.col("_b.q") + 1, F.col("_b.n"))).alias("_k", "z"))
    q = F.col("_b.q") + F.col("_k")
    good = (F.ascii("z.q1") >= 33 + min_base_quality) & (F.ascii("z.q2") >= 33 + min_base_quality)
    t = t.filter(good & (q >= min_5) & (F.col("_span") - q >= min_3))
    pair = F.when(F.col("rev"), F.concat(_complement(F.col("z.s2")), F.col("z.s1"))).otherwise(F.concat(F.col("z.s1"), _complement(F.col("z.s2"))))
    return t.select("chrom", (F.col("pos0") + F.col("_b.r") + F.col("_k")).alias("pos0"), pair.alias("pair"))


def reference_cytosines(contigs, size=1 << 20):
    """Every C and G of the reference with its strand and trinucleotide context (N beyond the ends).

    contigs: (name, seq), or pieces from ``fasta_pieces`` with this ``size`` and two bases before and after.
    """
    if "piece" in contigs.columns:
        lead = F.when(F.col("offset") == 0, "NN").otherwise("")
        t = contigs.select("name", "offset", F.concat(lead, F.upper("piece"), F.lit("NN")).alias("piece"))
    else:
        t = chunks(contigs.select("name", F.concat(F.lit("NN"), F.upper("seq"), F.lit("NN")).alias("seq")), 4, size)
    t = t.select("name", "offset", F.posexplode(F.regexp_extract_all("piece", F.lit("(?=(.{5}))"), F.lit(1))).alias("i", "w"))
    mid = F.substring("w", 3, 1)
    fwd = F.substring("w", 3, 3)
    rev = F.reverse(_complement(F.substring("w", 1, 3)))
    t = t.filter((F.col("i") < size) & mid.isin("C", "G"))
    return t.select(
        F.col("name").alias("chrom"), (F.col("offset") + F.col("i")).alias("pos0"), F.when(mid == "C", "+").otherwise("-").alias("strand"),
        F.when(mid == "C", fwd).otherwise(rev).alias("context"),
    )


def methylation_pileup(pairs, cytosines):
    """Depth, converted and methylated counts per reference cytosine (either strand)."""
    counts = pairs.groupBy("chrom", "pos0").agg(
        F.count(F.lit(1)).alias("depth"), *[F.count_if(F.col("pair") == p).alias(p) for p in ("TG", "CG", "GT", "GC")]
    )
    t = counts.join(cytosines, ["chrom", "pos0"])
    plus = F.col("strand") == "+"
    return t.select(
        "chrom", F.col("pos0").alias("start"), (F.col("pos0") + 1).alias("end"), "strand", "depth",
        F.when(plus, F.col("TG")).otherwise(F.col("GT")).alias("c"), F.when(plus, F.col("CG")).otherwise(F.col("GC")).alias("mc"), "context",
    )


def pair_contexts_within(aln, context=10, min_base_quality=0):
    """Base pairs by distance from the 5' end and, for reads that reached the hairpin, from the 3' end.

    Reads with more than one CIGAR element or shorter than twice the context are left out.
    """
    n = F.length("seq")
    t = aln.filter((n >= 2 * context) & F.col("cigar").rlike(r"^\d+M$")).withColumn("_n", n)
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.lit(context - 1))).alias("x"))
    ends = F.array(
        F.struct(F.lit("5p").alias("end"), (F.lit(context) + F.col("x")).alias("at"), F.when(F.col("rev"), F.col("_n") - F.col("x") - 1).otherwise(F.col("x")).alias("s")),
        F.struct(F.lit("3p").alias("end"), (F.lit(context) - F.col("x") - 1).alias("at"), F.when(F.col("rev"), F.col("x")).otherwise(F.col("_n") - F.col("x") - 1).alias("s")),
    )
    t = t.select("*", F.explode(ends).alias("e")).filter((F.col("e.end") == "5p") | F.col("hairpin"))
    c = lambda col: F.substring(F.col(col), F.col("e.s") + 1, F.lit(1))
    pair = F.when(F.col("rev"), F.concat(_complement(c("s2")), c("s1"))).otherwise(F.concat(c("s1"), _complement(c("s2"))))
    good = (F.ascii(c("q1")) >= 33 + min_base_quality) & (F.ascii(c("q2")) >= 33 + min_base_quality)
    return t.filter(good).groupBy(F.col("e.end").alias("end"), F.col("e.at").alias("at"), pair.alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def pair_contexts_flanking(aln, pairs, context=10, mode="expected", seed=1):
    """Base pairs outside the read ends, taken from the other reads piled up there.

    Each flanking position contributes one pair: drawn among the reads that cover it, or the share of every
    pair (``expected``).
    """
    pile = pairs.groupBy("chrom", "pos0", "pair").agg(F.count(F.lit(1)).alias("n"))
    per = pile.groupBy("chrom", "pos0").agg(F.sum("n").alias("dp"), F.sort_array(F.collect_list(F.struct("pair", "n"))).alias("p"))  # 16 pairs at most
    n = F.length("seq")
    x = F.explode(F.sequence(F.lit(0), F.lit(context - 1))).alias("x")
    t = aln.filter((n >= 2 * context) & F.col("cigar").rlike(r"^\d+M$")).select("chrom", "pos0", "rev", "hairpin", n.alias("_n"), x)
    five = F.when(F.col("rev"), F.col("pos0") + F.col("_n") + context - F.col("x") - 1).otherwise(F.col("pos0") - context + F.col("x"))
    three = F.when(F.col("rev"), F.col("pos0") - F.col("x") - 1).otherwise(F.col("pos0") + F.col("_n") + F.col("x"))
    ends = F.array(
        F.struct(F.lit("5p").alias("end"), F.col("x").alias("at"), five.alias("pos0")),
        F.struct(F.lit("3p").alias("end"), (F.lit(context) + F.col("x")).alias("at"), three.alias("pos0")),
    )
    t = t.select("chrom", "rev", "hairpin", F.explode(ends).alias("e")).filter((F.col("e.end") == "5p") | F.col("hairpin"))
    # many reads share a flank: count them before looking the position up
    t = t.groupBy("chrom", F.col("e.pos0").alias("pos0"), "rev", F.col("e.end").alias("end"), F.col("e.at").alias("at")).agg(F.count(F.lit(1)).alias("reads"))
    t = t.join(per, ["chrom", "pos0"])
    flip = lambda p: F.when(F.col("rev"), F.reverse(p)).otherwise(p)
    if mode == "expected":
        e = t.select("end", "at", "rev", "reads", "dp", F.inline("p"))
        return e.groupBy("end", "at", flip(F.col("pair")).alias("pair")).agg(F.sum(F.col("reads") * F.col("n") / F.col("dp")).alias("n"))
    t = t.withColumn("_d", draw(F.col("dp"), seed, "chrom", "pos0"))
    upto = lambda acc, s: F.struct((acc["c"] + s["n"]).alias("c"), F.when(acc["hit"].isNull() & (acc["c"] + s["n"] > F.col("_d")), s["pair"]).otherwise(acc["hit"]).alias("hit"))
    hit = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("string").alias("hit")), upto)["hit"]
    return t.withColumn("pair", flip(hit)).groupBy("end", "at", "pair").agg(F.sum("reads").alias("n"))


def normalise_pairs(counts):
    """Shares of the pairs at each place."""
    total = counts.groupBy("end", "at").agg(F.sum("n").alias("_t"))
    return counts.join(total, ["end", "at"]).withColumn("share", F.col("n") / F.col("_t")).drop("_t")
