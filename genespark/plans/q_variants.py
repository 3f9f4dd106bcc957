"""Filters, merges, counts and windows over calls."""

from pyspark.sql import functions as F

from genespark.operators import intervals, tiling, variants
from genespark.plans import views as v
from genespark.plans.registry import query
from genespark.plans.views import GENO, r6, rnd, sql

PILE = ", pile AS (SELECT *, dp - dp * (2 - coalesce(gt, 2)) // 2 AS dp_ref, dp * (2 - coalesce(gt, 2)) // 2 AS dp_alt FROM genotypes)"


def pile(spark, d):
    alt = F.expr("dp * (2 - coalesce(gt, 2)) div 2")
    return v.genotypes(spark, d).withColumn("dp_alt", alt.cast("int")).withColumn("dp_ref", (F.col("dp") - F.col("dp_alt")))


def site_calls(spark, d):
    """Sites that have any call, one row each."""
    return v.sites(spark, d)


@query("genotype_counts", sql(GENO, """
SELECT sample, count(*) FILTER (gt = 2) AS hom_ref, count(*) FILTER (gt = 1) AS het, count(*) FILTER (gt = 0) AS hom_alt, count(gt) AS total
FROM genotypes WHERE qual >= 20 AND dp >= 5 GROUP BY sample"""))
def _(spark, d):
    return variants.genotype_counts(variants.depth_quality_filter(v.genotypes(spark, d), 20, min_depth=5))


@query("genotype_counts_by_group", sql("calls", """
SELECT grp, count(*) FILTER (gt = 2) AS hom_ref, count(*) FILTER (gt = 1) AS het, count(*) FILTER (gt = 0) AS hom_alt, count(gt) AS total
FROM calls GROUP BY grp"""))
def _(spark, d):
    return variants.genotype_counts(v.calls(spark, d), ["grp"])


@query("genotype_counts_by_min_depth", sql("calls", """, x AS (SELECT unnest([1, 2, 3, 4, 5]) AS min_dp)
SELECT sample, min_dp, count(*) FILTER (coalesce(gt, 2) = 2) AS hom_ref, count(*) FILTER (gt = 1) AS het, count(*) FILTER (gt = 0) AS hom_alt, count(*) AS total
FROM calls JOIN x ON least(dp, 5) >= min_dp GROUP BY 1, 2"""))
def _(spark, d):
    return variants.genotype_counts_by_min_depth(v.calls(spark, d))


@query("column_in_set", sql("", """SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)"""))
def _(spark, d):
    keep = v.table(spark, d, "part").filter("p_size < 10").select("p_partkey")
    return variants.column_in_set(v.table(spark, d, "lineitem"), "l_partkey", keep).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("column_not_in_set", sql("", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)"""))
def _(spark, d):
    keep = v.table(spark, d, "part").filter("p_size < 40").select("p_partkey")
    return variants.column_in_set(v.table(spark, d, "lineitem"), "l_partkey", keep, False).select("l_orderkey", "l_linenumber", "l_quantity")


@query("clean_numeric_column", sql("", """SELECT event_id, value FROM events WHERE event_type <> 'error' AND value IS NOT NULL"""))
def _(spark, d):
    raw = F.when(F.col("event_type") == "error", F.element_at(F.array(F.lit("NaN"), F.lit("inf"), F.lit("n/a")), (F.col("event_id") % 3 + 1).cast("int"))).otherwise(F.col("value").cast("string"))
    return variants.clean_numeric_column(v.table(spark, d, "events").select("event_id", raw.alias("raw")), "raw").select("event_id", "value")


@query("filter_depth_set", sql(GENO, """SELECT chrom, pos - 1 AS "start", pos AS "end" FROM genotypes WHERE dp IN (SELECT p_size FROM part)"""))
def _(spark, d):
    t = pile(spark, d).withColumn("ad", F.array("dp_ref", "dp_alt"))
    return variants.filter_depth_set(t, v.table(spark, d, "part").select(F.col("p_size").alias("dp")))


HETDP = ", hd AS (SELECT dp, count(*) AS nsites, sum(2.0 * r * a / (dp * dp)) AS hets FROM (SELECT site_id, sum(dp_ref) AS r, sum(dp_alt) AS a, sum(dp_ref) + sum(dp_alt) AS dp FROM pile GROUP BY 1) WHERE dp > 0 AND dp < 1024 GROUP BY dp)"


@query("heterozygosity_by_depth", sql(GENO, f"{PILE}{HETDP} SELECT CAST(dp AS BIGINT) AS dp, nsites, round(hets * dp * dp) AS scaled_hets FROM hd"))
def _(spark, d):
    t = variants.heterozygosity_by_depth(pile(spark, d))
    return t.select("dp", "nsites", F.round(F.col("hets") * F.col("dp") * F.col("dp")).alias("scaled_hets"))


@query("heterozygosity_by_depth_drawn")
def _(spark, d):
    return variants.heterozygosity_by_depth(pile(spark, d), mode="draw")


@query("depth_set_from_edf", sql(GENO, f"""{PILE}{HETDP}, t AS (SELECT *, sum(nsites) OVER () AS total, coalesce(sum(nsites) OVER (ORDER BY dp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hd WHERE dp >= 2),
u AS (SELECT *, round(hets / nsites, 9) AS rate FROM t WHERE before + nsites > 0.05 * total AND before <= 0.99 * total),
w AS (SELECT *, coalesce(sum(nsites) OVER (ORDER BY rate, dp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / total AS seen FROM u)
SELECT CAST(dp AS BIGINT) AS dp, nsites FROM w WHERE seen <= 0.5"""))
def _(spark, d):
    h = variants.heterozygosity_by_depth(pile(spark, d))
    h = h.withColumn("hets", F.round(F.col("hets") / F.col("nsites"), 9) * F.col("nsites"))
    return variants.depth_set_from_edf(h).select("dp", "nsites")


@query("snp_min_spacing", sql("sites", """
SELECT site_id, chrom, pos FROM (SELECT *, lag(pos) OVER w AS p, lead(pos) OVER w AS n FROM sites WINDOW w AS (PARTITION BY chrom ORDER BY pos))
WHERE coalesce(pos - p >= 400, true) AND coalesce(n - pos >= 400, true)"""))
def _(spark, d):
    return variants.snp_min_spacing(v.sites(spark, d), 400).select("site_id", "chrom", "pos")


@query("drop_transitions", sql(GENO, """SELECT site_id, idx, gt FROM genotypes
WHERE NOT ((ref IN ('C', 'T') AND alt IN ('C', 'T')) OR (ref IN ('A', 'G') AND alt IN ('A', 'G')))"""))
def _(spark, d):
    return variants.drop_transitions(v.genotypes(spark, d)).select("site_id", "idx", "gt")


@query("transitions_to_missing", sql(GENO, """SELECT site_id, idx, CASE WHEN ref IN ('C', 'T') AND alt IN ('C', 'T') THEN NULL ELSE gt END AS gt FROM genotypes"""))
def _(spark, d):
    return variants.drop_transitions(v.genotypes(spark, d), "ct_only", True).select("site_id", "idx", "gt")


@query("biallelic_snps_only", sql("sites", """SELECT site_id, ref, alt FROM sites WHERE site_id % 7 <> 0 AND site_id % 11 <> 0 AND site_id % 13 <> 0"""))
def _(spark, d):
    alts = F.when(F.col("site_id") % 7 == 0, F.array("alt", "ref")).when(F.col("site_id") % 11 == 0, F.array(F.concat("alt", "alt"))).otherwise(F.array("alt"))
    ref = F.when(F.col("site_id") % 13 == 0, F.concat("ref", "ref")).otherwise(F.col("ref"))
    t = v.sites(spark, d).withColumn("alts", alts).withColumn("ref", ref)
    return variants.biallelic_snps_only(t).select("site_id", "ref", "alt")


@query("site_filters", sql(GENO, """SELECT site_id, idx, gt FROM genotypes WHERE site_id IN (
SELECT site_id FROM genotypes GROUP BY site_id HAVING count(gt) > 0 AND sum(gt) <> 0 AND sum(gt) <> 2 * count(gt) AND sum(gt) <> 2 AND sum(gt) <> 2 * count(gt) - 2)"""))
def _(spark, d):
    return variants.site_filters(v.genotypes(spark, d), singleton=True).select("site_id", "idx", "gt")


@query("select_individuals", sql("calls", "SELECT site_id, 8 - idx AS idx, sample, gt FROM calls WHERE idx > 2"))
def _(spark, d):
    wanted = v.individuals(spark, d).filter("idx > 2").withColumn("idx", 8 - F.col("idx"))
    return variants.select_individuals(v.calls(spark, d), wanted).select("site_id", "idx", "sample", "gt")


@query("thin_sites", sql("", """WITH RECURSIVE s AS (SELECT CAST(o_custkey % 5 + 1 AS INTEGER) AS chrom, o_orderkey * 100 + 1 AS pos FROM orders),
nx AS MATERIALIZED (SELECT a.chrom, a.pos, b.pos AS nxt FROM s a ASOF LEFT JOIN s b ON a.chrom = b.chrom AND a.pos + 2500 <= b.pos),
k AS (SELECT chrom, min(pos) AS pos FROM s GROUP BY chrom UNION ALL SELECT k.chrom, nx.nxt FROM k JOIN nx USING (chrom, pos) WHERE nx.nxt IS NOT NULL)
SELECT chrom, pos FROM k"""))
def _(spark, d):
    return variants.thin_sites(v.sites(spark, d), 2500).select("chrom", "pos")


@query("greedy_blocks", sql("", """WITH RECURSIVE s AS (SELECT CAST(o_custkey % 5 + 1 AS INTEGER) AS chrom, o_orderkey * 100 + 1 AS pos FROM orders),
nx AS MATERIALIZED (SELECT a.chrom, a.pos, b.pos AS nxt FROM s a ASOF LEFT JOIN s b ON a.chrom = b.chrom AND a.pos + 50000 < b.pos),
k AS (SELECT chrom, min(pos) AS pos FROM s GROUP BY chrom UNION ALL SELECT k.chrom, nx.nxt FROM k JOIN nx USING (chrom, pos) WHERE nx.nxt IS NOT NULL)
SELECT s.chrom, k.pos AS block, s.pos FROM s ASOF JOIN k ON s.chrom = k.chrom AND s.pos >= k.pos"""))
def _(spark, d):
    return tiling.greedy_anchors(v.sites(spark, d), ["chrom"], "pos", 50_000).select("chrom", F.col("anchor").alias("block"), "pos")


@query("depth_quality_band", sql("calls", "SELECT site_id, idx, dp, qual FROM calls WHERE qual >= 30 AND dp BETWEEN 15 AND 60"))
def _(spark, d):
    return variants.depth_quality_filter(v.calls(spark, d), 30, depth=30).select("site_id", "idx", "dp", "qual")


@query("regex_population_filter", sql("", """SELECT p_partkey, p_brand AS p1, p_type AS p2 FROM part
WHERE (p_brand LIKE 'Brand#1%' OR p_brand LIKE '%3') AND p_type LIKE 'ECO%'"""))
def _(spark, d):
    t = v.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("p1"), F.col("p_type").alias("p2"), F.lit("o").alias("p3"))
    return variants.regex_population_filter(t, ["^Brand#1", "3$"], ["^ECO"]).drop("p3")


INDEL = "CASE WHEN site_id % 9 = 0 THEN ref || repeat('A', CAST(site_id % 5 + 1 AS INTEGER)) ELSE ref END"


@query("het_snps", sql(GENO, "SELECT site_id, idx FROM genotypes WHERE gt = 1 AND site_id % 9 <> 0"))
def _(spark, d):
    return variants.het_snps(v.genotypes(spark, d).withColumn("ref", F.expr(INDEL))).select("site_id", "idx")


@query("non_snps", sql(GENO, f"SELECT site_id, idx, {INDEL} AS ref FROM genotypes WHERE site_id % 9 = 0"))
def _(spark, d):
    return variants.non_snps(v.genotypes(spark, d).withColumn("ref", F.expr(INDEL))).select("site_id", "idx", "ref")


@query("haploidise_missing", sql("calls", "SELECT site_id, idx, CASE WHEN gt <> 1 THEN gt END AS gt FROM calls"))
def _(spark, d):
    return variants.haploidise(v.calls(spark, d), "missing").select("site_id", "idx", "gt")


@query("haploidise_random")
def _(spark, d):
    return variants.haploidise(v.calls(spark, d)).select("site_id", "idx", "gt")


@query("loci_semi_join", sql(GENO, """SELECT site_id, idx, gt FROM genotypes WHERE (chrom, pos) IN (SELECT o_custkey % 5 + 1, o_orderkey * 100 + 1 FROM orders WHERE o_orderstatus = 'P')"""))
def _(spark, d):
    loci = v.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(
        (F.col("o_custkey") % 5 + 1).cast("int").alias("chrom"), (F.col("o_orderkey") * 100 + 1).alias("pos"))
    return variants.loci_semi_join(v.genotypes(spark, d), loci).select("site_id", "idx", "gt")


RECORDS = f"""{PILE}, rec AS (SELECT chrom, pos, ref, CASE WHEN dp_alt = 0 THEN '.' WHEN (site_id + idx) % 17 = 0 THEN CASE alt WHEN 'A' THEN 'C' ELSE 'A' END ELSE alt END AS alt, sample, dp_ref, dp_alt, site_id FROM pile),
site AS (SELECT chrom, pos, any_value(ref) AS ref, coalesce(max(alt) FILTER (alt <> '.'), 'X') AS alt FROM rec GROUP BY 1, 2 HAVING count(DISTINCT alt) FILTER (alt <> '.') <= 1)"""


def records(spark, d):
    odd = F.when(F.col("alt") == "A", "C").otherwise("A")
    alt = F.when(F.col("dp_alt") == 0, ".").when((F.col("site_id") + F.col("idx")) % 17 == 0, odd).otherwise(F.col("alt"))
    return pile(spark, d).withColumn("alt", alt)


@query("merge_call_sets_majority", sql(GENO, f"""{RECORDS}
SELECT chrom, pos, site.ref, site.alt, sample, CASE WHEN rec.alt = '.' THEN CASE WHEN dp_ref > 0 THEN 2 END WHEN dp_ref = dp_alt THEN 1 WHEN dp_ref > dp_alt THEN 2 ELSE 0 END AS gt
FROM rec JOIN site USING (chrom, pos)"""))
def _(spark, d):
    m = variants.merge_call_sets(records(spark, d), majority=True)
    # a tie is drawn: 0 or 2 both show as 1, which no majority gives
    tie = F.expr("dp_ref = dp_alt and dp_alt > 0 and gt in (0, 2)")
    return m.select("chrom", "pos", "ref", "alt", "sample", F.when(tie, 1).otherwise(F.col("gt")).alias("gt"))


@query("merge_call_sets_filtered")
def _(spark, d):
    r = records(spark, d)
    m = variants.merge_call_sets(r, variants.max_depth_per_sample(r).withColumn("max_dp", F.col("max_dp") - 20), monomorphic=True, singleton=True, uninformative=True, drop_transitions_too=True)
    return m.select("chrom", "pos", "ref", "alt", "sample", "gt")


@query("consensus_ref_alt", sql(GENO, f"""{RECORDS}
SELECT chrom, pos, any_value(ref) AS ref, CASE WHEN count(DISTINCT alt) FILTER (alt <> '.') = 1 THEN max(alt) FILTER (alt <> '.') ELSE 'X' END AS alt FROM rec GROUP BY chrom, pos"""))
def _(spark, d):
    return variants.consensus_ref_alt(records(spark, d))


@query("in_every_set", sql(GENO, "SELECT chrom, pos FROM genotypes WHERE grp IN ('P1', 'P2', 'P3') GROUP BY 1, 2 HAVING count(DISTINCT grp) = 3"))
def _(spark, d):
    return variants.in_every_set(v.genotypes(spark, d).filter("grp in ('P1', 'P2', 'P3')"), 3, source="grp")


@query("ascertain_snps", sql(GENO, """SELECT site_id, chrom, pos FROM genotypes WHERE idx = 1 AND gt = 1 AND site_id IN (
SELECT site_id FROM genotypes WHERE idx IN (2, 3) AND gt = 2 GROUP BY site_id HAVING count(*) = 2)"""))
def _(spark, d):
    g = v.genotypes(spark, d)
    return variants.ascertain_snps(g.filter("idx in (2, 3)"), g.filter("idx = 1"), 2).select("site_id", "chrom", "pos")


@query("call_set_consensus", sql(GENO, """SELECT site_id, chrom, pos FROM genotypes a WHERE idx = 1 AND EXISTS (SELECT 1 FROM genotypes b WHERE b.site_id = a.site_id AND b.idx = 2)
 AND EXISTS (SELECT 1 FROM genotypes b WHERE b.site_id = a.site_id AND b.idx = 3)"""))
def _(spark, d):
    g = v.genotypes(spark, d)
    return variants.call_set_consensus(*[g.filter(F.col("idx") == i) for i in (1, 2, 3)]).select("site_id", "chrom", "pos")


@query("snp_type_counts", sql(GENO, """SELECT ref, alt, CASE WHEN ref || alt IN ('CT', 'TC', 'AG', 'GA') THEN 'Ti' ELSE 'Tv' END AS kind, count(*) AS n
FROM (SELECT DISTINCT chrom, pos, ref, alt FROM genotypes WHERE gt < 2) GROUP BY 1, 2, 3"""))
def _(spark, d):
    return variants.snp_type_counts(v.genotypes(spark, d).filter("gt < 2"))


@query("snp_set_sizes", sql(GENO, """, o AS (SELECT DISTINCT sample, CAST(chrom AS VARCHAR) AS chrom, pos FROM genotypes WHERE gt < 2),
e AS (SELECT * FROM o UNION ALL SELECT DISTINCT 'union', chrom, pos FROM o)
SELECT sample, chrom, count(*) AS n FROM e GROUP BY 1, 2 UNION ALL SELECT sample, 'total', count(*) FROM e GROUP BY 1"""))
def _(spark, d):
    return variants.snp_set_sizes(v.genotypes(spark, d).filter("gt < 2"))


@query("depth_histogram", sql("calls", f""", h AS (SELECT dp, count(*) AS n, avg(qual) AS m, var_pop(qual) AS vv FROM calls GROUP BY dp)
SELECT r.range AS dp, coalesce(n, 0) AS n, {rnd('coalesce(n, 0) / (SELECT count(dp) FROM calls)')} AS share,
 {rnd('coalesce(m, 0)')} AS qual_mean, {rnd('coalesce(vv, 0)')} AS qual_var FROM (SELECT unnest(range(0, (SELECT max(dp) FROM calls) + 1)) AS range) r LEFT JOIN h ON h.dp = r.range"""))
def _(spark, d):
    h = variants.depth_histogram(v.calls(spark, d))
    return h.select("dp", "n", *[r6(F.col(c)).alias(c) for c in ("share", "qual_mean", "qual_var")])


@query("qual_and_depth_distribution", sql("calls", """SELECT 'qual' AS field, qual AS value, count(*) AS n FROM calls GROUP BY qual
UNION ALL SELECT 'dp', CAST(dp AS DOUBLE), count(*) FROM calls GROUP BY dp UNION ALL SELECT 'gt', CAST(coalesce(2 - gt, 0) AS DOUBLE), count(*) FROM calls GROUP BY coalesce(2 - gt, 0)"""))
def _(spark, d):
    return variants.value_distribution(v.calls(spark, d).withColumn("gt", F.coalesce(2 - F.col("gt"), F.lit(0))))


@query("site_total_depth", sql(GENO, "SELECT chrom, pos, CAST(sum(dp) AS BIGINT) AS total, max(dp) AS deepest FROM genotypes GROUP BY 1, 2"))
def _(spark, d):
    return variants.site_total_depth(v.genotypes(spark, d))


@query("max_depth_per_sample", sql("calls", "SELECT sample, max(dp) AS max_dp FROM calls GROUP BY sample"))
def _(spark, d):
    return variants.max_depth_per_sample(v.calls(spark, d))


@query("samples_covered", sql(GENO, """SELECT samples, count(*) AS n FROM (SELECT s.chrom, s.pos, count(g.idx) AS samples FROM sites s LEFT JOIN genotypes g USING (chrom, pos) GROUP BY 1, 2) GROUP BY samples"""))
def _(spark, d):
    return variants.samples_covered(v.genotypes(spark, d), v.sites(spark, d))


@query("mismatch_rate", sql(GENO, f"""{PILE} SELECT sample, {rnd('sum(coalesce(dp_alt / nullif(dp_ref + dp_alt, 0), 0))')} AS mm, count(*) AS sites, {rnd('avg(coalesce(dp_alt / nullif(dp_ref + dp_alt, 0), 0))')} AS rate
FROM pile WHERE qual >= 10 AND dp BETWEEN 10 AND 40 GROUP BY sample"""))
def _(spark, d):
    m = variants.mismatch_rate(pile(spark, d), 10, 20)
    return m.select("sample", "sites", r6(F.col("mm")).alias("mm"), r6(F.col("rate")).alias("rate"))


@query("mismatch_rate_drawn")
def _(spark, d):
    return variants.mismatch_rate(pile(spark, d), 10, 20, mode="draw")


@query("rolling_depth_histogram", sql(GENO, """SELECT sample, CAST(s AS BIGINT) AS s, count(*) AS n FROM (
SELECT sample, sum(dp) OVER (PARTITION BY sample, chrom ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s FROM genotypes) WHERE s > 0 GROUP BY 1, 2"""))
def _(spark, d):
    return variants.rolling_depth_histogram(v.genotypes(spark, d), 10)


WIN, STEP = 200_000, 50_000


def grid_sql(keys, chunk):
    k = ", ".join(keys)
    return f""", c AS ({chunk}), grid AS (SELECT {k}, unnest(range(0, greatest(0, last - {WIN // STEP} + 1) + 1)) AS k FROM (SELECT {k}, max(c) AS last FROM c GROUP BY {k})),
w AS (SELECT {', '.join('grid.' + x for x in keys)}, grid.k * {STEP} AS "start", grid.k * {STEP} + {WIN} AS "end", c.* EXCLUDE ({k}, c) FROM grid LEFT JOIN c ON {' AND '.join(f'grid.{x} = c.{x}' for x in keys)} AND c.c >= grid.k AND c.c < grid.k + {WIN // STEP})"""


@query("sliding_homozygosity", sql(GENO, grid_sql(["sample", "chrom"], f"SELECT sample, chrom, (pos - 1) // {STEP} AS c, count(*) AS n, count(*) FILTER (gt <> 1) AS hom FROM genotypes WHERE gt IS NOT NULL AND dp BETWEEN 5 AND 60 GROUP BY 1, 2, 3") + """
SELECT sample, chrom, "start", "end", CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(coalesce(sum(hom), 0) AS BIGINT) AS hom FROM w GROUP BY 1, 2, 3, 4"""))
def _(spark, d):
    return variants.sliding_homozygosity(v.genotypes(spark, d), WIN, STEP, 5, 60)


@query("shared_homozygosity", sql(GENO, grid_sql(["chrom"], f"""SELECT chrom, (pos - 1) // {STEP} AS c, count(*) AS n, count(*) FILTER (lo = hi AND lo <> 1) AS hom FROM (
 SELECT chrom, pos, min(gt) AS lo, max(gt) AS hi FROM genotypes WHERE sample IN ('S1', 'S2') AND gt IS NOT NULL AND (sample <> 'S1' OR dp BETWEEN 5 AND 60) GROUP BY 1, 2 HAVING count(*) = 2) GROUP BY 1, 2""") + """
SELECT chrom, "start", "end", CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(coalesce(sum(hom), 0) AS BIGINT) AS hom FROM w GROUP BY 1, 2, 3"""))
def _(spark, d):
    return variants.shared_homozygosity(v.genotypes(spark, d), ["S1", "S2"], WIN, STEP, {"S1": (5, 60)})


@query("roh_windows", sql(GENO, grid_sql(["sample", "chrom"], f"SELECT sample, chrom, (pos - 1) // {STEP} AS c, count(gt) AS n, count(*) FILTER (gt = 1) AS het, count(*) FILTER (gt IS NULL) AS miss FROM genotypes GROUP BY 1, 2, 3") + f""",
s AS (SELECT sample, chrom, "start", "end", CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(coalesce(sum(het), 0) AS BIGINT) AS het, CAST(coalesce(sum(miss), 0) AS BIGINT) AS miss FROM w GROUP BY 1, 2, 3, 4)
SELECT *, {rnd('CASE WHEN n >= 10 AND miss / (miss + n) <= 1.0 / 3 THEN (n - het) / n END')} AS roh FROM s"""))
def _(spark, d):
    return variants.roh_windows(v.genotypes(spark, d), WIN, STEP).withColumn("roh", r6(F.col("roh")))


@query("sample_het_miss", sql("calls", f"SELECT sample, grp, {rnd('100.0 * count(*) FILTER (gt = 1) / count(gt)')} AS het_pct, {rnd('100.0 * count(*) FILTER (gt IS NULL) / count(*)')} AS miss_pct FROM calls GROUP BY 1, 2"))
def _(spark, d):
    t = variants.sample_het_miss(v.calls(spark, d))
    return t.select("sample", "grp", r6(F.col("het_pct")).alias("het_pct"), r6(F.col("miss_pct")).alias("miss_pct"))


@query("coverage_quantiles", sql("calls", """, h AS (SELECT dp, coalesce(sum(count(*)) OVER (ORDER BY dp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(count(*)) OVER () AS c FROM calls GROUP BY dp),
p AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.99])::DOUBLE AS prob) SELECT prob, min(dp) AS depth FROM h JOIN p ON c > prob GROUP BY prob"""))
def _(spark, d):
    h = v.calls(spark, d).groupBy("dp").agg(F.count(F.lit(1)).alias("n"))
    return variants.coverage_quantiles(h, [0.1, 0.25, 0.5, 0.75, 0.9, 0.99])


@query("sliding_homozygosity_uneven", sql(GENO, """, u AS (SELECT sample, chrom, (pos - 1) // 2000 AS c, count(*) AS n, count(*) FILTER (gt <> 1) AS hom FROM genotypes WHERE gt IS NOT NULL AND dp BETWEEN 5 AND 60 GROUP BY 1, 2, 3),
grid AS (SELECT sample, chrom, unnest(range(0, CAST(greatest(0, floor((last - 24) / 2.0)) AS BIGINT) + 1)) AS k FROM (SELECT sample, chrom, max(c) AS last FROM u GROUP BY 1, 2)),
ends AS (SELECT chrom, max(pos) AS length FROM sites GROUP BY chrom)
SELECT grid.sample, grid.chrom, k * 4000 AS "start", least(k * 4000 + 50000, length) AS "end", CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(coalesce(sum(hom), 0) AS BIGINT) AS hom
FROM grid JOIN ends ON ends.chrom = grid.chrom LEFT JOIN u ON u.sample = grid.sample AND u.chrom = grid.chrom AND u.c >= k * 2 AND u.c < k * 2 + 25 GROUP BY ALL"""))
def _(spark, d):
    ends = v.sites(spark, d).groupBy("chrom").agg(F.max("pos").alias("length"))
    rows = v.table(spark, d, "lineitem").count()
    return variants.sliding_homozygosity(v.genotypes(spark, d), 50_000, 4_000, 5, 60, ends, rows)


@query("recombination_density", sql("sites", f""", fai AS (SELECT chrom, max(pos) + 500 AS length FROM sites GROUP BY chrom),
g AS (SELECT chrom, length, unnest(range(0, CAST(ceil(length / 20000) AS BIGINT))) AS k FROM fai),
n AS (SELECT g.chrom, g.k, length, count(s.pos) AS n FROM g LEFT JOIN sites s ON s.chrom = g.chrom AND s.pos // 20000 = g.k GROUP BY 1, 2, 3),
r AS (SELECT *, avg(n / t) OVER (PARTITION BY chrom ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS density FROM (SELECT *, sum(n) OVER (PARTITION BY chrom) AS t FROM n))
SELECT chrom, k * 20000 + 50000 AS mid, {rnd('density', 9)} AS density FROM r WHERE k <= ceil(length / 20000) - 5"""))
def _(spark, d):
    s = v.sites(spark, d)
    fai = s.groupBy("chrom").agg((F.max("pos") + 500).alias("length"))
    return variants.recombination_density(s, fai, 20_000, 100_000).withColumn("density", r6(F.col("density"), 9))


@query("run_length_encoding", sql(GENO, """, o AS (SELECT chrom, pos, CASE WHEN gt IS NULL OR dp NOT BETWEEN 5 AND 60 THEN -1 ELSE 2 - gt END AS state FROM genotypes WHERE idx = 1),
af AS (SELECT chrom, pos, 2 * count(gt) - sum(gt) AS n_alt, 2 * count(gt) AS n_total FROM genotypes WHERE grp = 'P3' AND gt IS NOT NULL GROUP BY 1, 2),
t AS (SELECT chrom, pos, state, coalesce(n_alt, 0) AS n_alt, coalesce(n_total, 0) AS n_total, coalesce(lag(pos) OVER (PARTITION BY chrom ORDER BY pos), 0) AS prev FROM o LEFT JOIN af USING (chrom, pos)),
b AS (SELECT chrom, pos, 1 AS len, state, n_alt, n_total FROM t UNION ALL SELECT chrom, prev + 1, pos - prev - 1, -1, 0, 0 FROM t WHERE pos - prev > 1),
f AS (SELECT *, CASE WHEN (state, n_alt, n_total) = lag((state, n_alt, n_total)) OVER (PARTITION BY chrom ORDER BY pos) THEN 0 ELSE 1 END AS opens FROM b),
r AS (SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY pos) AS run FROM f)
SELECT chrom, CAST(run AS BIGINT) AS run, min(pos) AS "start", CAST(sum(len) AS BIGINT) AS span, any_value(state) AS state, CAST(any_value(n_alt) AS BIGINT) AS n_alt, CAST(any_value(n_total) AS BIGINT) AS n_total FROM r GROUP BY 1, 2"""))
def _(spark, d):
    g = v.genotypes(spark, d)
    mine = g.filter("idx = 1").withColumn("gt", 2 - F.col("gt"))
    af = g.filter("grp = 'P3' and gt is not null").groupBy("chrom", "pos").agg((2 * F.count("gt") - F.sum("gt")).alias("n_alt"), (2 * F.count("gt")).alias("n_total"))
    return variants.run_length_encoding(mine, af, 5, 60)


# --- intervals ------------------------------------------------------------------------------------


@query("region_filter", sql("sites intervals", """SELECT site_id, chrom, pos FROM sites s WHERE EXISTS (SELECT 1 FROM intervals i WHERE i.chrom = s.chrom AND s.pos > i."start" AND s.pos <= i."end")"""))
def _(spark, d):
    return intervals.region_filter(v.sites(spark, d), v.intervals(spark, d), unique=True).select("site_id", "chrom", "pos")


@query("interval_annotation", sql("sites intervals", """SELECT site_id, coalesce(name, '') AS gene FROM (
SELECT s.site_id, i.name, row_number() OVER (PARTITION BY s.site_id ORDER BY i."start", i."end", i.name) AS k
FROM sites s LEFT JOIN intervals i ON i.chrom = s.chrom AND s.pos >= i."start" AND s.pos < i."end") WHERE k = 1"""))
def _(spark, d):
    return intervals.interval_annotation(v.sites(spark, d), v.intervals(spark, d), unique=True).select("site_id", "gene")


@query("interval_mask", sql(GENO + " blocks", """, m AS (SELECT site_id, idx, CASE WHEN EXISTS (SELECT 1 FROM blocks b WHERE b.sample = g.sample AND b.chrom = g.chrom AND g.pos BETWEEN b."start" AND b."end") THEN NULL ELSE gt END AS gt FROM genotypes g)
SELECT * FROM m WHERE site_id IN (SELECT site_id FROM m WHERE gt IS NOT NULL)"""))
def _(spark, d):
    return intervals.interval_mask(v.genotypes(spark, d), v.blocks(spark, d)).select("site_id", "idx", "gt")


@query("window_anti_join", sql("sites", """, indel AS (SELECT chrom, pos, site_id % 5 + 2 AS len FROM sites WHERE site_id % 9 = 0)
SELECT site_id, chrom, pos FROM sites s WHERE site_id % 9 <> 0 AND NOT EXISTS (SELECT 1 FROM indel i WHERE i.chrom = s.chrom AND s.pos > i.pos - 1 - i.len - 300 AND s.pos <= i.pos + i.len + 300)"""))
def _(spark, d):
    s = v.sites(spark, d)
    indels = s.filter("site_id % 9 = 0").withColumn("length", F.col("site_id") % 5 + 2)
    return intervals.window_anti_join(s.filter("site_id % 9 <> 0"), indels, 300).select("site_id", "chrom", "pos")


@query("flank_windows", sql("sites", """, fai AS (SELECT chrom, max(pos) AS length FROM sites GROUP BY chrom)
SELECT chrom, greatest(0, pos - 1 - 60) AS "start", least(length, pos + 60) AS "end", pos FROM sites JOIN fai USING (chrom)"""))
def _(spark, d):
    s = v.sites(spark, d)
    return intervals.flank_windows(s, s.groupBy("chrom").agg(F.max("pos").alias("length")), 60)


@query("bed_map_aggregate", sql("meth", f"""SELECT chrom, ("start" // 1000) * 1000 AS bin_start, ("start" // 1000) * 1000 + 1000 AS bin_end, count(*) AS n, {rnd('sum(x)')} AS total, {rnd('avg(x)')} AS mean,
 {rnd('min(x)')} AS low, {rnd('max(x)')} AS high, {rnd('median(x)')} AS median FROM (SELECT *, mc / (c + mc) AS x FROM meth) GROUP BY 1, 2, 3"""))
def _(spark, d):
    m = v.meth(spark, d).withColumn("x", F.col("mc") / (F.col("c") + F.col("mc")))
    b = intervals.bin_aggregate(m, "x", 1000)
    return b.select("chrom", "bin_start", "bin_end", "n", *[r6(F.col(c)).alias(c) for c in ("total", "mean", "low", "high", "median")])


@query("interval_aggregate_overlapping", sql("meth", f""", iv AS (SELECT DISTINCT CAST(p_partkey % 5 + 1 AS INTEGER) AS chrom, p_partkey * 10 AS "start", p_partkey * 10 + p_size * 40 AS "end" FROM part)
SELECT iv.chrom, iv."start", iv."end", count(m.mc) AS n, CAST(sum(m.mc) AS BIGINT) AS total, {rnd('avg(m.mc)')} AS mean, min(m.mc) AS low, max(m.mc) AS high
FROM iv LEFT JOIN meth m ON m.chrom = iv.chrom AND m."start" >= iv."start" AND m."start" < iv."end" GROUP BY 1, 2, 3"""))
def _(spark, d):
    k = F.col("p_partkey")
    iv = v.table(spark, d, "part").select((k % 5 + 1).cast("int").alias("chrom"), (k * 10).alias("start"), (k * 10 + F.col("p_size") * 40).alias("end")).distinct()
    m = v.meth(spark, d).select("chrom", F.col("start").alias("pos0"), "mc")
    return intervals.interval_aggregate(iv, m, "mc").fillna(0, ["n"]).withColumn("mean", r6(F.col("mean")))


@query("interval_aggregate", sql("meth", f""", iv AS (SELECT CAST(p_partkey % 5 + 1 AS INTEGER) AS chrom, p_partkey * 40 AS "start", p_partkey * 40 + p_size AS "end" FROM part)
SELECT iv.chrom, iv."start", iv."end", count(m.mc) AS n, CAST(sum(m.mc) AS BIGINT) AS total, {rnd('avg(m.mc)')} AS mean, min(m.mc) AS low, max(m.mc) AS high
FROM iv LEFT JOIN meth m ON m.chrom = iv.chrom AND m."start" >= iv."start" AND m."start" < iv."end" GROUP BY 1, 2, 3"""))
def _(spark, d):
    k = F.col("p_partkey")
    iv = v.table(spark, d, "part").select((k % 5 + 1).cast("int").alias("chrom"), (k * 40).alias("start"), (k * 40 + F.col("p_size")).alias("end"))
    m = v.meth(spark, d).select("chrom", F.col("start").alias("pos0"), "mc")
    return intervals.interval_aggregate(iv, m, "mc").fillna(0, ["n"]).withColumn("mean", r6(F.col("mean")))


@query("target_window_coverage", sql(GENO, f""", dep AS (SELECT chrom, pos, sum(dp) AS dp FROM genotypes GROUP BY 1, 2), t AS (SELECT CAST(p_partkey % 5 + 1 AS INTEGER) AS chrom, p_partkey * 700 + 1 AS target FROM part)
SELECT t.chrom, target, CAST(coalesce(sum(dp), 0) AS BIGINT) AS area, count(*) FILTER (dp > 0) AS nonzero, CAST(coalesce(max(dp) FILTER (pos = target), 0) AS BIGINT) AS target_depth,
 CAST(coalesce(max(dp), 0) AS BIGINT) AS max_depth, {rnd('avg(dp)')} AS mean_depth, {rnd('stddev_samp(dp)')} AS sd_depth
FROM t LEFT JOIN dep ON dep.chrom = t.chrom AND abs(dep.pos - target) <= 500 GROUP BY 1, 2"""))
def _(spark, d):
    dep = variants.site_total_depth(v.genotypes(spark, d)).select("chrom", "pos", F.col("total").alias("dp"))
    k = F.col("p_partkey")
    t = v.table(spark, d, "part").select((k % 5 + 1).cast("int").alias("chrom"), (k * 700 + 1).alias("pos"))
    out = intervals.target_window_coverage(dep, t, 1000)
    return out.select("chrom", "target", "area", "nonzero", "target_depth", "max_depth", r6(F.col("mean_depth")).alias("mean_depth"), r6(F.col("sd_depth")).alias("sd_depth"))


@query("mappability_window", sql("sites", f""", seg AS (SELECT CAST(p_partkey % 5 + 1 AS INTEGER) AS chrom, p_partkey * 700 AS "start", p_partkey * 700 + p_size * 50 AS "end", p_size / 50.0 AS score FROM part),
w AS (SELECT site_id, chrom, pos - 1 AS "start", pos + 1999 AS "end" FROM sites)
SELECT site_id, {rnd('coalesce(sum((least(w."end", s."end") - greatest(w."start", s."start")) * score), 0) / 2000')} AS mappability
FROM w LEFT JOIN seg s ON s.chrom = w.chrom AND s."start" < w."end" AND s."end" > w."start" GROUP BY site_id"""))
def _(spark, d):
    seg = v.intervals(spark, d).join(v.table(spark, d, "part").select(F.concat(F.lit("G"), "p_partkey").alias("name"), (F.col("p_size") / 50.0).alias("score")), "name")
    w = v.sites(spark, d).select("site_id", "chrom", (F.col("pos") - 1).alias("start"), (F.col("pos") + 1999).alias("end"))
    return intervals.mappability_window(w, seg).select("site_id", r6(F.col("mappability")).alias("mappability"))
