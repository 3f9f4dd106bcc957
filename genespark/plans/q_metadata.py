"""Metadata, sex calls, histograms, regressions and tests."""

from pyspark.sql import functions as F

from genespark.functions.special import jeffreys
from genespark.operators import metadata as D, stats as T
from genespark.plans import views as v
from genespark.plans.q_formats import dstat_lines
from genespark.plans.registry import query
from genespark.plans.views import GENO, r6, rnd, sql
from genespark.sources import formats as R

CUST = """cust AS (SELECT c_custkey AS id, 'C' || c_custkey AS sample, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'M' ELSE 'F' END AS sex, c_nationkey % 60 AS lat,
 (c_custkey * 7) % 300 - 150 AS lon, c_acctbal AS bal, c_nationkey AS nation FROM customer)"""


def cust(spark, d):
    return v.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("C"), "c_custkey").alias("sample"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "M").otherwise("F").alias("sex"),
        (F.col("c_nationkey") % 60).alias("lat"), ((F.col("c_custkey") * 7) % 300 - 150).alias("lon"), F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nation"))


def with_cust(body):
    return f"WITH {CUST} {body}"


def jeffreys_sql(counts, level=0.95, steps=20_000):
    """CTE ``bounds(k, n, lower, upper)`` for distinct counts: with x = sin(t)^2 the density is smooth, summed on a fine grid."""
    h = f"(pi() / 2 / {steps})"
    peak = "CASE WHEN k > 0 THEN k * ln(k / n) ELSE 0 END + CASE WHEN k < n THEN (n - k) * ln((n - k) / n) ELSE 0 END"
    # the cell that holds the quantile, with the slope of the density in it and the end term of the midpoint rule
    inside = lambda q: f"({q} * tot - (c - w) - (w - w0) / 24) / w"
    at = lambda q: f"max(CASE WHEN c >= {q} * tot AND c - w < {q} * tot THEN pow(sin({h} * (i + {inside(q)} + (w1 - w0) / 4 / w * {inside(q)} * (1 - {inside(q)}))), 2) END)"
    tail = (1 - level) / 2
    return f"""grid AS (SELECT k, n, i, exp(2 * k * ln(sin({h} * (i + 0.5))) + 2 * (n - k) * ln(cos({h} * (i + 0.5))) - ({peak})) AS w
 FROM (SELECT DISTINCT CAST(k AS DOUBLE) AS k, CAST(n AS DOUBLE) AS n FROM {counts}), (SELECT unnest(range({steps})) AS i)),
cum AS (SELECT k, n, i, w, lag(w, 1, w) OVER o AS w0, lead(w, 1, w) OVER o AS w1, sum(w) OVER o AS c, sum(w) OVER (PARTITION BY k, n) AS tot FROM grid WINDOW o AS (PARTITION BY k, n ORDER BY i)),
bounds AS (SELECT k, n, {at(tail)} AS "lower", {at(1 - tail)} AS "upper" FROM cum GROUP BY 1, 2)"""


@query("sex_read_dosage", sql("idxstats", f""", s AS (SELECT sample, CAST(coalesce(sum(nreads) FILTER (contig = 'chrX'), 0) AS BIGINT) AS nx, CAST(coalesce(sum(nreads) FILTER (contig <> 'chrX'), 0) AS BIGINT) AS na,
 CAST(coalesce(sum(len) FILTER (contig = 'chrX'), 0) AS BIGINT) AS lx, CAST(coalesce(sum(len) FILTER (contig <> 'chrX'), 0) AS BIGINT) AS la FROM idxstats GROUP BY sample),
p AS (SELECT *, lx / (lx + 2 * la) AS p0, lx / (lx + la) AS p1 FROM s WHERE lx > 0 AND la > 0), l AS (SELECT *, nx * ln(p0 / p1) + na * ln((1 - p0) / (1 - p1)) AS llr FROM p),
r AS (SELECT *, nx / (nx + na) / CASE WHEN llr > 0 THEN 2 * p0 ELSE p1 END AS rx FROM l)
SELECT sample, nx, na, lx, la, {rnd('llr')} AS llr, {rnd('rx')} AS rx, CASE WHEN rx > 0.6 AND rx < 0.8 THEN 'U' WHEN 2 * llr > 10.8276 THEN 'M' WHEN -2 * llr > 10.8276 THEN 'F' ELSE 'U' END AS sex FROM r"""))
def _(spark, d):
    t = D.sex_read_dosage(v.idxstats(spark, d), ["chrX"])
    return t.withColumn("llr", r6(F.col("llr"))).withColumn("rx", r6(F.col("rx")))


@query("sex_read_dosage_intervals")
def _(spark, d):
    return D.sex_read_dosage(v.idxstats(spark, d), ["chrX"], intervals=True)


@query("sex_ratio_normal_ci", sql("idxstats", f""", s AS (SELECT sample, coalesce(sum(nreads) FILTER (contig = 'chrX'), 0) AS nx, coalesce(sum(nreads) FILTER (contig <> 'chrX'), 0) AS na,
 coalesce(sum(len) FILTER (contig = 'chrX'), 0) AS lx, coalesce(sum(len) FILTER (contig <> 'chrX'), 0) AS la FROM idxstats GROUP BY sample)
SELECT sample, {rnd('nx / (nx + na)')} AS rx, {rnd('0.5 * lx / (lx + la)')} AS half_erx, {rnd('nx / (nx + na) - 1.96 * sqrt(nx / (nx + na) * (1 - nx / (nx + na)) / (nx + na))')} AS low FROM s"""))
def _(spark, d):
    t = D.sex_ratio_normal_ci(v.idxstats(spark, d))
    return t.select("sample", *[r6(F.col(c)).alias(c) for c in ("rx", "half_erx", "low")])


@query("contig_sets_agree", """WITH x AS (SELECT DISTINCT user_id, event_id % 13 AS contig FROM events)
SELECT 'U' || user_id AS sample, count(*) AS contigs FROM x GROUP BY user_id HAVING count(*) <> (SELECT count(DISTINCT contig) FROM x)""")
def _(spark, d):
    e = v.table(spark, d, "events").select(F.concat(F.lit("U"), "user_id").alias("sample"), F.concat(F.lit("chr"), F.col("event_id") % 13).alias("contig"))
    return D.contig_sets_agree(e)


@query("sex_cluster", sql("idxstats", f""", s AS (SELECT sample, sum(CASE WHEN contig = 'chrX' THEN nreads ELSE 0 END) AS nx, sum(CASE WHEN contig <> 'chrX' THEN nreads ELSE 0 END) AS na,
 sum(CASE WHEN contig = 'chrX' THEN len ELSE 0 END) AS lx, sum(CASE WHEN contig <> 'chrX' THEN len ELSE 0 END) AS la FROM idxstats GROUP BY sample),
l AS (SELECT *, nx * ln(lx / (lx + 2 * la) / (lx / (lx + la))) + na * ln((1 - lx / (lx + 2 * la)) / (1 - lx / (lx + la))) AS llr FROM s WHERE lx > 0 AND la > 0),
t AS (SELECT sample, nx / (nx + na) / CASE WHEN llr > 0 THEN 2 * (lx / (lx + 2 * la)) ELSE lx / (lx + la) END AS rx FROM l),
it AS (SELECT 0 AS i, CAST(0.5 AS DOUBLE) AS m, CAST(1.0 AS DOUBLE) AS f UNION ALL
 SELECT i + 1, coalesce(avg(CASE WHEN abs(rx - m) <= abs(rx - f) THEN rx END), m), coalesce(avg(CASE WHEN abs(rx - m) > abs(rx - f) THEN rx END), f) FROM it, t WHERE i < 100 GROUP BY i, m, f),
h AS (SELECT sample, rx, m, f, CASE WHEN abs(rx - m) <= abs(rx - f) THEN 'M' ELSE 'F' END AS hard FROM t, it WHERE i = 100),
w AS (SELECT coalesce(stddev_pop(rx) FILTER (hard = 'M'), 0) AS wm, coalesce(stddev_pop(rx) FILTER (hard = 'F'), 0) AS wf FROM h)
SELECT sample, {rnd('rx')} AS rx, hard, CASE WHEN rx < m + 1.6448536269514722 * wm THEN 'M' WHEN rx > f - 1.6448536269514722 * wf THEN 'F' END AS soft FROM h, w""").replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    t = D.sex_cluster(D.sex_read_dosage(v.idxstats(spark, d), ["chrX"]))
    return t.select("sample", r6(F.col("rx")).alias("rx"), "hard", "soft")


@query("age_stratification", with_cust(f""", m AS (SELECT min(age) AS mid FROM (SELECT bal AS age, row_number() OVER (ORDER BY bal) AS r, count(*) OVER () AS n FROM cust) WHERE r > n // 2 + 1),
c AS (SELECT count(*) FILTER (bal < mid AND sex = 'M') AS young_m, count(*) FILTER (bal < mid AND sex = 'F') AS young_f, count(*) FILTER (bal >= mid AND sex = 'M') AS old_m, count(*) FILTER (bal >= mid AND sex = 'F') AS old_f FROM cust, m),
p AS (SELECT *, young_m / (young_m + young_f) AS p1, old_m / (old_m + old_f) AS p2, young_m + young_f AS n1, old_m + old_f AS n2 FROM c), h AS (SELECT *, (p1 * n2 + p2 * n1) / (n1 + n2) AS ph FROM p)
SELECT young_m, young_f, old_m, old_f, {rnd('(p2 - p1) / sqrt(ph * (1 - ph) * (1.0 / n1 + 1.0 / n2))')} AS z FROM h"""))
def _(spark, d):
    t = D.age_stratification(cust(spark, d), "bal", "sex")
    return t.withColumn("z", r6(F.col("z")))


@query("dosage_pca")
def _(spark, d):
    pcs, _ = D.dosage_pca(v.idxstats(spark, d), k=2)
    return pcs.select("sample", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))


DOSES = """, tot AS (SELECT sample, sum(nreads) AS tn, sum(len) AS tl FROM idxstats GROUP BY 1),
x AS (SELECT s.sample, c.contig, coalesce(i.nreads / tn / (i.len / tl), 0) AS x FROM tot s CROSS JOIN (SELECT DISTINCT contig FROM idxstats) c LEFT JOIN idxstats i ON i.sample = s.sample AND i.contig = c.contig)"""


@query("dosage_pca_norms", sql("idxstats", f"{DOSES} SELECT sample, {rnd('sum((x - m) * (x - m))')} AS norm FROM x JOIN (SELECT contig, avg(x) AS m FROM x GROUP BY 1) USING (contig) GROUP BY 1"))
def _(spark, d):
    # all components together keep every sample's distance from the mean (directions without variance are not among them)
    pcs, _ = D.dosage_pca(v.idxstats(spark, d), k=6)
    t = pcs.select("sample", F.posexplode("pc").alias("j", "x"))
    t = t.join(t.groupBy("j").agg(F.avg("x").alias("m")), "j")
    return t.groupBy("sample").agg(r6(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m")))).alias("norm"))


@query("dosage_pca_spectrum", sql("idxstats", f"""{DOSES}, c AS (SELECT a.contig AS p, b.contig AS q, covar_samp(a.x, b.x) AS c FROM x a JOIN x b USING (sample) GROUP BY 1, 2)
SELECT {rnd('sum(c) FILTER (p = q)', 7)} AS trace, {rnd('sum(c * c)', 7)} AS squares FROM c"""))
def _(spark, d):
    # scores have the eigenvalues of the covariance as variances: their sum is its trace, their squares sum to its squared norm
    pcs, _ = D.dosage_pca(v.idxstats(spark, d), k=6)
    t = pcs.select(F.posexplode("pc").alias("j", "x")).groupBy("j").agg(F.var_samp("x").alias("l"))
    return t.agg(r6(F.sum("l"), 7).alias("trace"), r6(F.sum(F.col("l") * F.col("l")), 7).alias("squares"))


ISIZE = """iz AS (SELECT 'S' || l_linenumber AS sample, CAST(l_orderkey % 4 AS VARCHAR) AS chrom, CAST(l_quantity AS BIGINT) AS length, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)"""


def isize(spark, d):
    return v.table(spark, d, "lineitem").groupBy(
        F.concat(F.lit("S"), "l_linenumber").alias("sample"), (F.col("l_orderkey") % 4).cast("string").alias("chrom"), F.col("l_quantity").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


@query("insert_size_stats", f"""WITH {ISIZE}, s AS (SELECT sample, chrom, sum(n) AS n, sum(length * n) / sum(n) AS mean, sum(length * length * n) AS q FROM iz GROUP BY 1, 2)
SELECT sample, chrom, CAST(n AS BIGINT) AS n, {rnd('mean')} AS mean, {rnd('sqrt((q - n * mean * mean) / (n - 1))', 5)} AS sd FROM s""")
def _(spark, d):
    t = D.insert_size_stats(isize(spark, d), ["0", "1", "2", "3"], 100)
    return t.withColumn("mean", r6(F.col("mean"))).withColumn("sd", r6(F.col("sd"), 5))


@query("linear_trend", f"""SELECT 'S' || l_linenumber AS sample, {rnd('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {rnd('regr_intercept(l_extendedprice, l_quantity)', 3)} AS intercept, {rnd('corr(l_extendedprice, l_quantity)')} AS r, count(*) AS n FROM lineitem GROUP BY 1""")
def _(spark, d):
    t = T.linear_trend(v.table(spark, d, "lineitem").withColumn("sample", F.concat(F.lit("S"), "l_linenumber")), "l_quantity", "l_extendedprice", ["sample"])
    return t.select("sample", r6(F.col("slope"), 4).alias("slope"), r6(F.col("intercept"), 3).alias("intercept"), r6(F.col("r")).alias("r"), "n")


@query("interval_summary", f"""WITH t AS (SELECT least(l_quantity, l_discount * 100) AS low, greatest(l_quantity, l_tax * 1000) AS high FROM lineitem), u AS (SELECT 'low' AS stat, low AS x FROM t UNION ALL SELECT 'high', high FROM t)
SELECT stat, {rnd('avg(x)')} AS mean, {rnd('quantile_cont(x, 0.025)')} AS "lower", {rnd('quantile_cont(x, 0.5)')} AS median, {rnd('quantile_cont(x, 0.975)')} AS "upper" FROM u GROUP BY stat""")
def _(spark, d):
    t = v.table(spark, d, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("d"), (F.col("l_tax") * 1000).alias("t"))
    s = T.interval_summary(t, ["l_quantity", "d"], ["l_quantity", "t"])
    return s.select("stat", *[r6(F.col(c)).alias(c) for c in ("mean", "lower", "median", "upper")])


@query("column_histogram", f"""WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), k AS (SELECT least(CAST(floor((l_quantity - lo) / ((hi - lo) / 30)) AS BIGINT), 29) AS k, (hi - lo) / 30 AS w, lo FROM lineitem, r)
SELECT {rnd('lo + k * w')} AS "left", {rnd('lo + (k + 1) * w')} AS "right", count(*) AS n, {rnd('count(*) / sum(count(*)) OVER () / w')} AS density FROM k GROUP BY k, w, lo""")
def _(spark, d):
    h = T.column_histogram(v.table(spark, d, "lineitem"), "l_quantity", density=True)
    return h.select(r6(F.col("left")).alias("left"), r6(F.col("right")).alias("right"), "n", r6(F.col("density")).alias("density"))


@query("integer_histogram", """SELECT CAST(floor(value) AS DOUBLE) AS "left", CAST(floor(value) + 1 AS DOUBLE) AS "right", count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY floor(value)""")
def _(spark, d):
    return T.column_histogram(v.table(spark, d, "events"), "value", integer=True).select("left", "right", "n")


@query("grouped_values", f"""SELECT l_linenumber, count(l_extendedprice) AS n, {rnd('quantile_cont(l_extendedprice, 0.25)', 4)} AS q0, {rnd('quantile_cont(l_extendedprice, 0.5)', 4)} AS q1, {rnd('quantile_cont(l_extendedprice, 0.75)', 4)} AS q2 FROM lineitem GROUP BY 1""")
def _(spark, d):
    t = T.grouped_values(v.table(spark, d, "lineitem"), "l_linenumber", "l_extendedprice")
    return t.select("l_linenumber", "n", *[r6(F.col(c), 4).alias(c) for c in ("q0", "q1", "q2")])


@query("normalise_histogram", f"WITH {ISIZE} SELECT sample, chrom, length, n, {rnd('n / sum(n) OVER (PARTITION BY sample)')} AS share FROM iz")
def _(spark, d):
    return T.normalise_histogram(isize(spark, d)).withColumn("share", r6(F.col("share")))


@query("length_weighted_histogram", "SELECT CAST(l_quantity AS BIGINT) AS length, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return T.length_weighted_histogram(v.table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("length"), F.col("l_linenumber").alias("count")))


@query("family_allele_freq", sql(GENO, f"SELECT chrom, pos, grp AS fid, CAST(coalesce(sum(gt), 0) AS BIGINT) AS ac, 2 * count(gt) AS n, {rnd('sum(gt) / (2 * count(gt))')} AS af FROM genotypes GROUP BY 1, 2, 3"))
def _(spark, d):
    t = T.family_allele_freq(v.genotypes(spark, d).withColumnRenamed("grp", "fid"))
    return t.select("chrom", "pos", "fid", "ac", "n", r6(F.col("af")).alias("af"))


@query("family_allele_bounds", sql(GENO, f""", a AS (SELECT chrom, pos, grp AS fid, CAST(coalesce(sum(gt), 0) AS BIGINT) AS k, 2 * count(gt) AS n FROM genotypes GROUP BY 1, 2, 3), {jeffreys_sql("(SELECT k, n FROM a WHERE n > 0)")}
SELECT chrom, pos, fid, {rnd('"lower"', 5)} AS "lower", {rnd('"upper"', 5)} AS "upper" FROM a JOIN bounds USING (k, n)"""))
def _(spark, d):
    t = T.family_allele_freq(v.genotypes(spark, d).withColumnRenamed("grp", "fid")).filter("n > 0")
    return t.select("chrom", "pos", "fid", r6(F.col("lower"), 5).alias("lower"), r6(F.col("upper"), 5).alias("upper"))


@query("jeffreys_interval", with_cust(f""", a AS (SELECT nation, CAST(count(*) FILTER (sex = 'M') AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM cust GROUP BY 1), {jeffreys_sql("a")}
SELECT nation, k, n, {rnd('"lower"', 5)} AS "lower", {rnd('"upper"', 5)} AS "upper" FROM a JOIN bounds USING (k, n)"""))
def _(spark, d):
    t = cust(spark, d).groupBy("nation").agg(F.count_if(F.col("sex") == "M").cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    lo, hi = jeffreys(F.col("k"), F.col("n"))
    return t.withColumn("lower", r6(lo, 5)).withColumn("upper", r6(hi, 5))


# --- D runs ---------------------------------------------------------------------------------------

DRUN = """raw AS (SELECT p_partkey + 1 AS line_no, 'P' || (p_partkey % 11) AS p1, 'P' || ((p_partkey + 3) % 11) AS p2, 'P' || ((p_partkey + 6) % 11) AS p3, round((p_size - 25) / 100.0, 4) AS d FROM part),
ca AS (SELECT least(p1, p2) AS p1, greatest(p1, p2) AS p2, p3, arg_min(CASE WHEN p1 > p2 THEN -d ELSE d END, line_no) AS d FROM raw GROUP BY 1, 2, 3)"""


def drun(spark, d, which):
    lines = dstat_lines(spark, d).filter(F.col("file") == which)
    return R.parse_dstats(lines)


@query("dstat_run_compare", f"WITH {DRUN} SELECT p1, p2, p3, {rnd('d')} AS d1, {rnd('-d')} AS d2 FROM ca")
def _(spark, d):
    t = T.dstat_run_compare(drun(spark, d, "a.tsv"), drun(spark, d, "b.tsv"))
    return t.select("p1", "p2", "p3", r6(F.col("d1")).alias("d1"), r6(F.col("d2")).alias("d2"))


@query("mirrored_dstats", f"""WITH {DRUN}, m AS (SELECT line_no, 0 AS side, p1, p2, p3, d FROM raw UNION ALL SELECT line_no, 1, p2, p1, p3, -d FROM raw)
SELECT p1, p2, p3, {rnd('arg_min(d, line_no * 2 + side)')} AS d FROM m GROUP BY 1, 2, 3""")
def _(spark, d):
    return T.mirrored(drun(spark, d, "a.tsv")).select("p1", "p2", "p3", r6(F.col("d")).alias("d"))


@query("top_outlier_populations", f"""WITH {DRUN}, o AS (SELECT * FROM ca WHERE d <> 0 AND abs(d * 50) > 3) SELECT population, count(*) AS n FROM (SELECT unnest([p1, p2, p3]) AS population FROM o) GROUP BY 1 ORDER BY n DESC, population LIMIT 10""")
def _(spark, d):
    t = T.dstat_run_compare(drun(spark, d, "a.tsv"), drun(spark, d, "b.tsv"))
    return T.top_populations(T.sign_flip_outliers(t))


@query("spearman", f"""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT {rnd('corr(a, b)')} AS rho, count(*) AS n FROM r""")
def _(spark, d):
    return T.spearman(v.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").withColumn("rho", r6(F.col("rho")))


@query("name_map_join", f"""WITH {DRUN}, nm(name, label) AS (VALUES ('P1', 'One'), ('P2', 'Two')) SELECT coalesce(a.label, p1) AS p1, coalesce(b.label, p2) AS p2, p3 FROM raw LEFT JOIN nm a ON a.name = p1 LEFT JOIN nm b ON b.name = p2""")
def _(spark, d):
    names = v.table(spark, d, "region").filter("r_regionkey in (1, 2)").select(F.concat(F.lit("P"), "r_regionkey").alias("name"), F.when(F.col("r_regionkey") == 1, "One").otherwise("Two").alias("label"))
    return D.name_map_join(drun(spark, d, "a.tsv"), names, "p1", "p2").select("p1", "p2", "p3")


# --- metadata -------------------------------------------------------------------------------------


@query("multi_key_lookup", """WITH rows AS (SELECT o_orderkey AS line_no, o_orderkey AS snp_num, o_custkey % 5 AS chrom, o_orderkey * 10 AS pos, 'rs' || (o_orderkey % 4000) AS rs, CASE WHEN o_custkey % 3 = 0 THEN 'ss' || (o_orderkey % 4000) END AS ss FROM orders),
db AS (SELECT p_partkey AS entry, p_size % 5 AS chrom, p_partkey * 10 AS pos, 'rs' || p_partkey AS rs, 'ss' || (p_partkey // 2 * 2) AS ss FROM part),
tr AS (SELECT o_orderkey AS snp_num FROM orders WHERE o_orderstatus <> 'F'),
c AS (SELECT chrom, pos, max(entry) AS e1 FROM db GROUP BY 1, 2), r AS (SELECT rs, max(entry) AS e2 FROM db GROUP BY 1), s AS (SELECT ss, max(entry) AS e3 FROM db GROUP BY 1),
t AS (SELECT line_no, e1, e2, e3, coalesce(e1, e2, e3) AS entry FROM rows JOIN tr USING (snp_num) LEFT JOIN c USING (chrom, pos) LEFT JOIN r USING (rs) LEFT JOIN s USING (ss)),
n AS (SELECT line_no, unnest([e1, e2, e3]) AS e FROM t WHERE entry IS NOT NULL), f AS (SELECT e, min(line_no) AS first FROM n WHERE e IS NOT NULL GROUP BY e)
SELECT line_no, entry FROM t WHERE entry IS NOT NULL AND coalesce(e1 = e2, true) AND coalesce(e2 = e3, true) AND coalesce(e1 = e3, true) AND NOT EXISTS (SELECT 1 FROM n JOIN f USING (e) WHERE n.line_no = t.line_no AND f.first < n.line_no)""")
def _(spark, d):
    k = F.col("o_orderkey")
    o = v.table(spark, d, "orders")
    rows = o.select(k.alias("line_no"), k.alias("snp_num"), (F.col("o_custkey") % 5).alias("chrom"), (k * 10).alias("pos"), F.concat(F.lit("rs"), k % 4000).alias("rs"), F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("ss"), k % 4000)).alias("ss"))
    p = F.col("p_partkey")
    db = v.table(spark, d, "part").select(p.alias("entry"), (F.col("p_size") % 5).cast("long").alias("chrom"), (p * 10).alias("pos"), F.concat(F.lit("rs"), p).alias("rs"), F.concat(F.lit("ss"), F.floor(p / 2) * 2).alias("ss"))
    trusted = o.filter("o_orderstatus <> 'F'").select(k.alias("snp_num"))
    return D.multi_key_lookup(rows, db, trusted).select("line_no", "entry")


@query("coalesce_duplicates", """SELECT l_suppkey AS sample, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) FILTER (l_discount > 0.05) AS a, arg_min(l_tax, l_orderkey * 10 + l_linenumber) FILTER (l_tax > 0) AS b
FROM (SELECT l_suppkey, l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount, min(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1""")
def _(spark, d):
    t = v.table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_discount").alias("di"), F.min("l_tax").alias("t"))
    t = t.select(F.col("l_suppkey").alias("sample"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), F.when(F.col("di") > 0.05, F.col("q")).alias("a"), F.when(F.col("t") > 0, F.col("t")).alias("b"))
    return D.coalesce_duplicates(t, "sample", "line_no", ["a", "b"])


@query("sample_table_merge", """SELECT c_custkey AS sample, c_acctbal, n.total, m.last FROM customer JOIN (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) n ON n.k = c_custkey
JOIN (SELECT o_custkey AS k, max(o_orderkey) AS last FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) m ON m.k = c_custkey""".replace("n.total", "round(n.total, 2) + 0.0 AS total"))
def _(spark, d):
    o = v.table(spark, d, "orders")
    c = v.table(spark, d, "customer").select(F.col("c_custkey").alias("sample"), "c_acctbal")
    a = o.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("sample")).agg(r6(F.sum("o_totalprice"), 2).alias("total"))
    b = o.filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("sample")).agg(F.max("o_orderkey").alias("last"))
    return D.sample_table_merge(c, a, b)


@query("elevation_join", with_cust("SELECT id, lat, lon, el FROM (SELECT id, CAST(lat AS VARCHAR) AS lat, CAST(lon AS VARCHAR) AS lon, CAST(nation * 10 AS BIGINT) AS el FROM cust)"))
def _(spark, d):
    c = cust(spark, d).select("id", F.col("lat").cast("string").alias("lat"), F.col("lon").cast("string").alias("lon"))
    lons = cust(spark, d).select(F.col("lon").cast("string").alias("lon")).distinct()
    n = v.table(spark, d, "nation").select((F.col("n_nationkey") % 60).cast("string").alias("lat"), (F.col("n_nationkey") * 10).cast("long").alias("elevation"))
    e = c.select("lat", "lon").distinct().join(n, "lat").join(lons, "lon")
    return D.elevation_join(c, e).select("id", "lat", "lon", F.col("elevation").alias("el"))


@query("trait_integration", """WITH a AS (SELECT p_brand AS genus, p_type AS species, max(p_size) AS x FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2), b AS (SELECT p_brand AS genus, p_type AS species, min(p_size) AS y FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1, 2),
c AS (SELECT p_brand AS genus, p_type AS species, count(*) AS n FROM part GROUP BY 1, 2), e AS (SELECT p_brand AS genus, p_type AS species, max(p_retailprice) AS z FROM part WHERE p_size > 45 GROUP BY 1, 2)
SELECT genus, species, x, y, n, z, list_aggregate(list_filter([CAST(x AS DOUBLE), CAST(y AS DOUBLE), z], lambda q: q IS NOT NULL), 'median') AS med FROM a FULL JOIN b USING (genus, species) JOIN c USING (genus, species) LEFT JOIN e USING (genus, species)""")
def _(spark, d):
    p = v.table(spark, d, "part").withColumn("genus", F.col("p_brand")).withColumn("species", F.col("p_type"))
    g = lambda t, agg: t.groupBy("genus", "species").agg(agg)
    t = D.trait_integration(
        g(p.filter("p_partkey % 3 <> 0"), F.max("p_size").alias("x")), g(p.filter("p_partkey % 3 <> 1"), F.min("p_size").alias("y")),
        g(p, F.count(F.lit(1)).alias("n")), g(p.filter("p_size > 45"), F.max("p_retailprice").alias("z")))
    dbl = lambda c: F.col(c).cast("double")
    return t.withColumn("med", D.row_median(dbl("x"), dbl("y"), dbl("z")))


@query("conflict_to_null", "SELECT l_orderkey, l_linenumber, l_shipdate, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN NULL ELSE coalesce(a, b) END AS x FROM (SELECT *, CASE WHEN l_quantity > 20 THEN l_returnflag = 'A' END AS a, CASE WHEN l_quantity < 40 THEN l_linestatus = 'F' END AS b FROM lineitem)")
def _(spark, d):
    a = F.when(F.col("l_quantity") > 20, F.col("l_returnflag") == "A")
    b = F.when(F.col("l_quantity") < 40, F.col("l_linestatus") == "F")
    return v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", D.conflict_to_null(a, b).alias("x"))


@query("group_consensus_fill", """WITH t AS (SELECT s_suppkey, s_suppkey % 30 AS genus, CASE WHEN s_nationkey % 2 = 0 THEN 'O' || (s_suppkey % 30 % 4 + CASE WHEN s_suppkey % 30 = 5 THEN s_suppkey % 4 ELSE 0 END) END AS ord FROM supplier),
g AS (SELECT genus, min(ord) AS lo, max(ord) AS hi FROM t GROUP BY 1) SELECT s_suppkey, CASE WHEN genus = 7 THEN 'Fixed' WHEN lo = hi THEN lo ELSE ord END AS ord FROM t JOIN g USING (genus)""")
def _(spark, d):
    k = F.col("s_suppkey")
    extra = F.when(k % 30 == 5, k % 4).otherwise(0)
    t = v.table(spark, d, "supplier").select("s_suppkey", (k % 30).alias("genus"), F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("O"), k % 30 % 4 + extra)).alias("ord"))
    return D.group_consensus_fill(t, "genus", "ord", {7: "Fixed"}).select("s_suppkey", "ord")


SPEC = "spec AS (SELECT p_brand AS genus, p_type AS species, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 'M' ELSE 'F' END AS sex, l_quantity AS mass FROM lineitem JOIN part ON p_partkey = l_partkey)"


def specimens(spark, d):
    p = v.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("genus"), F.col("p_type").alias("species"))
    sex = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0, "M").otherwise("F")
    return v.table(spark, d, "lineitem").join(p, "l_partkey").select("genus", "species", sex.alias("sex"), F.col("l_quantity").alias("mass"))


@query("museum_sex_ratio", f"WITH {SPEC} SELECT genus, species, count(*) FILTER (sex = 'M') AS m, count(*) FILTER (sex = 'F') AS f, {rnd(chr(39).join(['count(*) FILTER (sex = ', 'M', ') / count(*)']))} AS ratio FROM spec GROUP BY 1, 2 HAVING count(*) >= 100")
def _(spark, d):
    return D.museum_sex_ratio(specimens(spark, d)).select("genus", "species", "m", "f", r6(F.col("ratio")).alias("ratio"))


@query("museum_sex_bounds", f"""WITH {SPEC}, a AS (SELECT genus, species, count(*) FILTER (sex = 'M') AS k, count(*) AS n FROM spec GROUP BY 1, 2 HAVING count(*) >= 100), {jeffreys_sql("a")}
SELECT genus, species, {rnd('"lower"', 5)} AS "lower", {rnd('"upper"', 5)} AS "upper" FROM a JOIN bounds USING (k, n)""")
def _(spark, d):
    t = D.museum_sex_ratio(specimens(spark, d))
    return t.select("genus", "species", r6(F.col("lower"), 5).alias("lower"), r6(F.col("upper"), 5).alias("upper"))


@query("trait_medians", f"WITH {SPEC} SELECT genus, species, median(mass) AS median FROM spec GROUP BY 1, 2")
def _(spark, d):
    return D.trait_medians(specimens(spark, d), "mass")


@query("scalar_metadata_rules", with_cust(f"""SELECT id, CASE WHEN lon < -15 THEN lon + 360 ELSE lon END AS lon, CASE WHEN id % 4 = 3 THEN NULL ELSE CAST(id AS INTEGER) END AS age, CASE WHEN id % 5 = 0 THEN 'inf' WHEN id % 5 = 1 THEN NULL ELSE CAST(id AS VARCHAR) END AS name_age,
 CASE WHEN lon > -20 AND lon <= 60 THEN 'EU' WHEN lon > 60 THEN 'AM' END AS lon_class, CASE WHEN id % 700 + 1400 < 1500 THEN NULL WHEN id % 700 + 1400 <= 1940 THEN '<1940' WHEN id % 700 + 1400 <= 1960 THEN '1940-1960' WHEN id % 700 + 1400 <= 2020 THEN '>1960' END AS date_class FROM cust"""))
def _(spark, d):
    c = cust(spark, d)
    k = F.col("id")
    text = F.when(k % 4 == 0, F.concat(k, F.lit("calBP"))).when(k % 4 == 1, F.concat(k, F.lit("BP"))).when(k % 4 == 2, k.cast("string")).otherwise(">50000")
    name = F.concat(F.lit("A_b_"), F.when(k % 5 == 0, "INF").when(k % 5 == 1, "x").otherwise(k.cast("string")))
    age = D.age_from_sample_name(name)
    shown = F.when(age.isNull(), None).when(age > 1e300, "inf").otherwise(F.least(age, F.lit(1e15)).cast("long").cast("string"))
    return c.select("id", D.wrap_longitude(F.col("lon")).alias("lon"), D.clean_age(text).alias("age"), shown.alias("name_age"), D.lon_class(F.col("lon")).alias("lon_class"), D.date_class(k % 700 + 1400).alias("date_class"))


@query("material_class", sql("", """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'Petrosal' WHEN 1 THEN 'Leg' WHEN 2 THEN 'Foot' WHEN 3 THEN 'Horn' WHEN 4 THEN 'Vertebra' WHEN 6 THEN 'Petrosal' WHEN 7 THEN 'Foot' END AS material, CASE WHEN p_partkey % 9 IN (0, 3, 6) THEN 'Crania' WHEN p_partkey % 9 NOT IN (5, 8) THEN 'Postcrania' END AS part,
 CASE p_partkey % 3 WHEN 0 THEN 'Cave' WHEN 1 THEN 'Anthropogenic' ELSE 'Sediment' END AS site FROM part"""))
def _(spark, d):
    k = F.col("p_partkey")
    word = F.element_at(F.array(*[F.lit(x) for x in ("left petrous bone", "Humerus (prox.)", "metacarpal", "Horncores", "verte, vertebra", "unknown", "left_petrous_bone", "meta-x", "cranium")]), (k % 9 + 1).cast("int"))
    place = F.element_at(F.array(*[F.lit(x) for x in ("Big Cave, entrance", "old hunting ground", "river gravel")]), (k % 3 + 1).cast("int"))
    m = D.material_class(word, F.col("p_name"))
    return v.table(spark, d, "part").select("p_partkey", m.alias("material"), D.body_part(m).alias("part"), D.site_class(place).alias("site"))


@query("split_binomial", "SELECT p_partkey, split_part(p_name, ' ', 1) AS genus, split_part(p_name, ' ', 2) AS species FROM part")
def _(spark, d):
    g, s = D.split_binomial(F.col("p_name"), " ")
    return v.table(spark, d, "part").select("p_partkey", g.alias("genus"), s.alias("species"))


@query("distance_columns", with_cust(f"""SELECT id, {rnd('6371.0 * acos(greatest(-1.0, least(1.0, sin(radians(lat)) * sin(radians(nation + 10)) + cos(radians(lat)) * cos(radians(nation + 10)) * cos(radians(lon) - radians(20.0)))))', 3)} AS km,
 {rnd('sqrt((lat - nation - 1) * (lat - nation - 1) + (lon - 20.0) * (lon - 20.0))')} AS flat FROM cust"""))
def _(spark, d):
    c = cust(spark, d)
    dbl = lambda e: F.expr(e).cast("double")
    km = D.great_circle_km(F.col("lat"), F.col("lon"), F.col("nation") + 10, F.lit(20.0))
    return c.select("id", r6(km, 3).alias("km"), r6(D.euclidean(dbl("lat"), dbl("lon"), dbl("nation + 1"), F.lit(20.0))).alias("flat"))


# --- tests and models -----------------------------------------------------------------------------


@query("binomial_sign_test", with_cust(f""", a AS (SELECT count(*) FILTER (sex = 'M') AS k, count(*) AS n FROM cust)
SELECT k, n, round(coalesce(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))), 0), 5) + 0.0 AS p FROM (SELECT k, n, unnest(range(k, n + 1)) AS i FROM a) GROUP BY 1, 2"""))
def _(spark, d):
    return T.binomial_sign_test(cust(spark, d), "sex").withColumn("p", r6(F.col("p"), 5))


def labelled(spark, d):
    t = v.table(spark, d, "documents").join(v.table(spark, d, "labels"), "doc_id")
    return t.select(F.col("quality").cast("double").alias("y"), (F.col("n_chars") / 1000.0).alias("x"), F.col("toxic").cast("double").alias("z"), "source", "lang")


@query("logistic_model")
def _(spark, d):
    return T.logistic_model(labelled(spark, d), "y", ["x", "z"])


LABELLED = """lab AS (SELECT CAST(quality AS DOUBLE) AS y, n_chars / 1000.0 AS x, CAST(toxic AS DOUBLE) AS z, lang FROM documents JOIN labels USING (doc_id))"""


@query("logistic_fitted_moments", f"""WITH {LABELLED}, k AS (SELECT * FROM lab WHERE y IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL)
SELECT 'intercept' AS term, {rnd('sum(y)', 3)} AS total FROM k UNION ALL SELECT 'x', {rnd('sum(y * x)', 3)} FROM k UNION ALL SELECT 'z', {rnd('sum(y * z)', 3)} FROM k""")
def _(spark, d):
    # the score equations: at the maximum, fitted and observed sums agree for every column
    rows = labelled(spark, d).dropna(subset=["y", "x", "z"])
    b = T.logistic_model(rows, "y", ["x", "z"]).agg(F.map_from_entries(F.collect_list(F.struct("term", "estimate"))).alias("b"))
    t = rows.withColumn("b", b.scalar())
    t = t.withColumn("p", 1 / (1 + F.exp(-(F.col("b.intercept") + F.col("b.x") * F.col("x") + F.col("b.z") * F.col("z")))))
    columns = {"intercept": F.lit(1.0), "x": F.col("x"), "z": F.col("z")}
    sums = t.agg(F.array(*[F.struct(F.lit(n).alias("term"), F.sum(F.col("p") * c).alias("total")) for n, c in columns.items()]).alias("e"))
    return sums.select(F.explode("e").alias("e")).select("e.term", r6(F.col("e.total"), 3).alias("total"))


def loglik_sql(k, n):
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({k} / {n}) ELSE 0 END + CASE WHEN {k} < {n} THEN ({n} - {k}) * ln(({n} - {k}) / {n}) ELSE 0 END)"


@query("likelihood_ratio_groups", f"""WITH {LABELLED}, s AS (SELECT 'all' AS data, * FROM lab UNION ALL SELECT 'short', * FROM lab WHERE x < 2),
g AS (SELECT data, lang, count(*) AS n, sum(y) AS k FROM s WHERE y IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2), e AS (SELECT data, sum({loglik_sql('k', 'n')}) AS l, count(*) AS levels, sum(n) AS n, sum(k) AS k FROM g GROUP BY 1)
SELECT data, CAST(levels - 1 AS DOUBLE) AS df, {rnd(f"2 * (l - {loglik_sql('k', 'n')})", 5)} AS deviance, CAST(n - levels AS DOUBLE) AS resid_df, {rnd('-2 * l', 5)} AS resid_dev FROM e""")
def _(spark, d):
    t = T.likelihood_ratio_table(labelled(spark, d), "y", {"lang": ["lang"]}, {"all": "true", "short": "x < 2"})
    return t.select("data", "df", r6(F.col("deviance"), 5).alias("deviance"), "resid_df", r6(F.col("resid_dev"), 5).alias("resid_dev"))


@query("logistic_interval")
def _(spark, d):
    return T.predicted_interval(labelled(spark, d), "y", "x", [0.5, 1.0, 5.0])


@query("likelihood_ratio_table")
def _(spark, d):
    return T.likelihood_ratio_table(labelled(spark, d), "y", {"x": ["x"], "lang": ["lang"]}, {"all": "true", "short": "x < 2"})


@query("linear_model", f"""SELECT 'l_quantity' AS term, {rnd('regr_slope(l_extendedprice, l_quantity)', 3)} AS estimate FROM lineitem UNION ALL SELECT 'intercept', {rnd('regr_intercept(l_extendedprice, l_quantity)', 2)} FROM lineitem""")
def _(spark, d):
    t = T.linear_model(v.table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return t.select("term", F.when(F.col("term") == "intercept", r6(F.col("estimate"), 2)).otherwise(r6(F.col("estimate"), 3)).alias("estimate"))


@query("centre_log", f"SELECT o_orderkey, {rnd('ln(o_totalprice) - avg(ln(o_totalprice)) OVER ()')} AS x FROM orders")
def _(spark, d):
    t = T.centre(v.table(spark, d, "orders"), "o_totalprice", log=True)
    return t.select("o_orderkey", r6(F.col("o_totalprice")).alias("x"))


@query("model_selection")
def _(spark, d):
    return T.model_selection(labelled(spark, d), "y", ["x", "z"])[0]


def saturated_sql(name, by):
    """AIC of a model that fits every cell of ``by`` by its own share."""
    return f"""SELECT '{name}' AS model, {rnd('2.0 * count(*) - 2 * sum(l)', 5)} AS aic FROM (SELECT {loglik_sql('k', 'n')} AS l FROM (SELECT count(*) AS n, sum(y) AS k FROM e GROUP BY {by}))"""


@query("model_selection_cells", f"""WITH {LABELLED}, e AS (SELECT y, z, CAST(lang = 'en' AS INTEGER) AS en FROM lab WHERE y IS NOT NULL AND z IS NOT NULL AND lang IS NOT NULL)
{saturated_sql('y ~ 1', '()')} UNION ALL {saturated_sql('y ~ z', 'z')} UNION ALL {saturated_sql('y ~ en', 'en')} UNION ALL {saturated_sql('y ~ z + en + z:en', 'z, en')}""")
def _(spark, d):
    # the sub-models with a closed form: all but the one without the interaction
    t = labelled(spark, d).withColumn("en", (F.col("lang") == "en").cast("double"))
    rank = T.model_selection(t, "y", ["z", "en"])[0]
    return rank.filter("model <> 'y ~ z + en'").select("model", r6(F.col("aic"), 5).alias("aic"))


@query("cramer_von_mises_test")
def _(spark, d):
    return T.cramer_von_mises_test(cust(spark, d), "id", "bal", "sex", "M", replicates=100)


CVM = with_cust(f""", n AS (SELECT count(*) FILTER (sex = 'M') AS a, count(*) FILTER (sex <> 'M') AS b FROM cust),
e AS (SELECT count(*) FILTER (sex = 'M') OVER (ORDER BY bal) AS ca, count(*) FILTER (sex <> 'M') OVER (ORDER BY bal) AS cb FROM cust)
SELECT {rnd('sum((ca / a - cb / b) * (ca / a - cb / b))', 5)} AS statistic FROM e, n""")


@query("cramer_von_mises_statistic", CVM)
def _(spark, d):
    return T.cramer_von_mises_test(cust(spark, d), "id", "bal", "sex", "M", replicates=1).select(r6(F.col("statistic"), 5).alias("statistic"))


@query("mmd_kernel_test")
def _(spark, d):
    return T.mmd_kernel_test(cust(spark, d), "id", "lat", "lon", "sex", "M", [10.0, 50.0, 200.0], replicates=100)


@query("mmd_kernel_statistic", with_cust(f""", n AS (SELECT count(*) FILTER (sex = 'M') AS a, count(*) FILTER (sex <> 'M') AS b FROM cust), s AS (SELECT unnest([10.0, 50.0, 200.0]) AS s),
k AS (SELECT s, sum(CASE WHEN x.sex = 'M' THEN 1.0 / a ELSE -1.0 / b END * CASE WHEN y.sex = 'M' THEN 1.0 / a ELSE -1.0 / b END * exp(-sqrt((x.lat - y.lat) * (x.lat - y.lat) + (x.lon - y.lon) * (x.lon - y.lon)) / s)) AS t FROM cust x JOIN cust y ON x.id <> y.id, n, s GROUP BY s)
SELECT round(max(t), 7) + 0.0 AS statistic FROM k"""))
def _(spark, d):
    t = T.mmd_kernel_test(cust(spark, d), "id", "lat", "lon", "sex", "M", [10.0, 50.0, 200.0], replicates=1)
    return t.select(r6(F.col("statistic"), 7).alias("statistic"))
