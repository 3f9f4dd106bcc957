"""Frequencies, D and F statistics, Fst, blocks, pairs."""

from pyspark.sql import functions as F

from genespark.operators import pairs, popgen
from genespark.plans import views as v
from genespark.plans.registry import query
from genespark.plans.views import GENO, r6, rnd, sql

QUADS = {"t1": ("P1", "P2", "P3", "P4"), "t2": ("P2", "P3", "P1", "P4"), "t3": ("P3", "P1", "P2", "P4")}
GROUPS = ["P1", "P2", "P3", "P4"]
BLOCK = 200_000

_cols = ", ".join(
    f"count(gt) FILTER (grp = '{g}') AS n_{i}, coalesce(sum(gt) FILTER (grp = '{g}'), 0) AS s_{i}, "
    f"count(*) FILTER (grp = '{g}' AND gt = 1) AS h_{i}"
    for i, g in enumerate(GROUPS)
)
WIDE = f"wide AS (SELECT site_id, {_cols} FROM genotypes GROUP BY site_id)"
_tests = " UNION ALL ".join(
    f"SELECT '{t}' AS test, site_id, "
    + ", ".join(f"CAST(n_{GROUPS.index(g)} AS DOUBLE) AS n{r}, CAST(s_{GROUPS.index(g)} AS DOUBLE) AS s{r}" for r, g in enumerate(q, 1))
    + " FROM wide WHERE "
    + " AND ".join(f"n_{GROUPS.index(g)} > 0" for g in q)
    for t, q in QUADS.items()
)
TESTS = f", {WIDE}, tests AS ({_tests})"
DTERMS = """, terms AS (SELECT *, (w - x) * (y - z) AS num, (w + x - 2 * w * x) * (y + z - 2 * y * z) AS den
  FROM (SELECT *, s1 / (2 * n1) AS w, s2 / (2 * n2) AS x, s3 / (2 * n3) AS y, s4 / (2 * n4) AS z FROM tests))"""
CONS = ", cons AS (SELECT * FROM (SELECT *, " + ", ".join(
    f"CASE WHEN s{r} > n{r} THEN 1 WHEN s{r} < n{r} THEN 0 END AS c{r}" for r in range(1, 5)
) + " FROM tests) WHERE c1 + c2 + c3 + c4 IS NOT NULL)"


@query("allele_freq_by_group", sql(GENO, f"""
SELECT site_id, grp, count(gt) AS n, CAST(sum(gt) AS BIGINT) AS s, {rnd('sum(gt) / count(gt)')} AS af,
       {rnd('sum(gt) / (2 * count(gt))')} AS freq,
       {rnd('sum(gt) * (2.0 * count(gt) - sum(gt)) / (2.0 * count(gt) * (2 * count(gt) - 1))')} AS het,
       CASE WHEN sum(gt) > count(gt) THEN 1 WHEN sum(gt) < count(gt) THEN 0 END AS consensus
FROM genotypes WHERE gt IS NOT NULL GROUP BY site_id, grp"""))
def _(spark, d):
    a = popgen.allele_freq_by_group(v.genotypes(spark, d))
    return a.select("site_id", "grp", "n", "s", *[r6(F.col(c)).alias(c) for c in ("af", "freq", "het")], "consensus")


@query("d_statistic", sql(GENO, f"""{TESTS}{DTERMS}
SELECT test, {rnd('CASE WHEN sum(den) <> 0 THEN sum(num) / sum(den) ELSE 0 END')} AS d, count(*) AS covered,
       count(*) FILTER (num > 0) AS baba, count(*) FILTER (num < 0) AS abba FROM terms GROUP BY test"""))
def _(spark, d):
    return popgen.d_statistic(v.genotypes(spark, d), QUADS).withColumn("d", r6(F.col("d")))


@query("d_statistic_agreement", sql(GENO, f"""{TESTS}{DTERMS},
w AS (SELECT site_id, {', '.join(f"max(sign(num)) FILTER (test = '{t}') AS {t}" for t in QUADS)} FROM terms GROUP BY site_id),
p AS (SELECT 't1' test1, 't2' test2, t1 a, t2 b FROM w UNION ALL SELECT 't1', 't3', t1, t3 FROM w UNION ALL SELECT 't2', 't3', t2, t3 FROM w)
SELECT test1, test2, count(a) AS covered1, count(*) FILTER (a <> 0) AS informative1, count(b) AS covered2,
  count(*) FILTER (b <> 0) AS informative2, count(*) FILTER (a > 0) AS baba1, count(*) FILTER (a < 0) AS abba1,
  count(*) FILTER (b > 0) AS baba2, count(*) FILTER (b < 0) AS abba2, count(*) FILTER (a > 0 AND b > 0) AS baba_agree,
  count(*) FILTER (a < 0 AND b < 0) AS abba_agree, count(*) FILTER (a * b < 0) AS disagree,
  count(*) FILTER ((a <> 0 AND coalesce(b, 0) = 0) OR (b <> 0 AND coalesce(a, 0) = 0)) AS uninformative
FROM p GROUP BY test1, test2"""))
def _(spark, d):
    return popgen.d_statistic_agreement(v.genotypes(spark, d), QUADS)


HETS = {r: f"(s{r} * (2 * n{r} - s{r}) / (2 * n{r} * (2 * n{r} - 1)))" for r in range(1, 5)}


def f2_sql(test, i, j):
    het = lambda r: f"s_{r} * (2.0 * n_{r} - s_{r}) / (2.0 * n_{r} * (2 * n_{r} - 1)) / (2 * n_{r})"
    return f"SELECT '{test}' AS test, s_{i} / n_{i} - s_{j} / n_{j} AS d, {het(i)} + {het(j)} AS h FROM wide WHERE n_{i} > 0 AND n_{j} > 0"


@query("f2", sql(GENO, f""", {WIDE}, t AS ({' UNION ALL '.join(f2_sql(t, *[GROUPS.index(p) for p in q[:2]]) for t, q in QUADS.items())})
SELECT test, {rnd('avg(d * d - h)')} AS f2, count(*) AS sites FROM t GROUP BY test"""))
def _(spark, d):
    return popgen.f2(v.genotypes(spark, d), {t: q[:2] for t, q in QUADS.items()}).withColumn("f2", r6(F.col("f2")))


@query("f3", sql(GENO, f""", {WIDE}, t AS (
 SELECT 't1' AS test, s_2 / n_2 AS x, s_0 / n_0 AS a, s_3 / n_3 AS b, s_2 * (2.0 * n_2 - s_2) / (2.0 * n_2 * (2 * n_2 - 1)) / (2 * n_2) AS h
 FROM wide WHERE n_0 > 0 AND n_2 > 0 AND n_3 > 0 UNION ALL
 SELECT 't2', s_2 / n_2, s_1 / n_1, s_3 / n_3, s_2 * (2.0 * n_2 - s_2) / (2.0 * n_2 * (2 * n_2 - 1)) / (2 * n_2)
 FROM wide WHERE n_1 > 0 AND n_2 > 0 AND n_3 > 0)
SELECT test, {rnd('avg((x - a) * (x - b) - h)')} AS f3, count(*) AS sites FROM t GROUP BY test"""))
def _(spark, d):
    return popgen.f3(v.genotypes(spark, d), {"t1": ("P3", "P1", "P4"), "t2": ("P3", "P2", "P4")}).withColumn("f3", r6(F.col("f3")))


@query("f4", sql(GENO, f"""{TESTS}
SELECT test, {rnd('avg((s1/n1 - s2/n2) * (s3/n3 - s4/n4))')} AS f4, count(*) AS sites FROM tests GROUP BY test"""))
def _(spark, d):
    return popgen.f4(v.genotypes(spark, d), QUADS).withColumn("f4", r6(F.col("f4")))


@query("consensus_pattern_counts", sql(GENO, f"""{TESTS}{CONS}, p AS (SELECT test, CAST(c1 AS VARCHAR) || c2 || c3 || c4 AS p FROM cons)
SELECT test, count(*) FILTER (p IN ('0100', '1011')) AS babb, count(*) FILTER (p IN ('1000', '0111')) AS abbb,
  count(*) FILTER (p IN ('0010', '1101')) AS aaba, count(*) FILTER (p IN ('0011', '1100')) AS aabb, count(*) AS sites
FROM p GROUP BY test"""))
def _(spark, d):
    return popgen.consensus_pattern_counts(v.genotypes(spark, d), QUADS)


@query("shared_derived_consensus", sql(GENO, f"""{TESTS}{CONS}
SELECT site_id, test, CASE WHEN c1 = c2 THEN 'AABB' ELSE 'BABB' END AS pattern FROM cons WHERE c3 = c4 AND c2 <> c3"""))
def _(spark, d):
    return popgen.shared_derived(v.genotypes(spark, d), QUADS)


_names = {1: "w", 2: "x", 3: "y", 4: "z"}


def _dist(kind):
    out = []
    for i in range(1, 5):
        for j in range(i + 1, 5):
            diff = f"(s{i}/n{i} - s{j}/n{j})"
            e = f"abs({diff})" if kind == "abs" else f"{diff} * {diff} - {HETS[i]} / (2 * n{i}) - {HETS[j]} / (2 * n{j})"
            out.append(f"{e} AS {_names[i]}{_names[j]}")
    return ", dist AS (SELECT *, " + ", ".join(out) + " FROM tests)"


_near = "yz < wz AND yz < wy AND wx < wy AND wx < wz AND wx < xy AND wx < xz"
_far = "wx > wy AND wx > wz AND xy > wy AND xy > wz AND xz > wy AND xz > wz"


@query("shared_derived_f2", sql(GENO, f"""{TESTS}{_dist('f2')}, ok AS (SELECT * FROM dist WHERE yz >= 0 AND xz >= 0 AND yz < xz AND xy >= 0 AND yz < xy)
SELECT site_id, test, CASE WHEN {_near} THEN 'AABB' ELSE 'BABB' END AS pattern FROM ok
WHERE wz >= 0 AND wx >= 0 AND wy >= 0 AND (({_near}) OR ({_far}))"""))
def _(spark, d):
    return popgen.shared_derived(v.genotypes(spark, d), QUADS, "f2")


@query("shared_derived_abs", sql(GENO, f"""{TESTS}{_dist('abs')}
SELECT site_id, test, CASE WHEN yz < wz AND yz < wy AND wx < wy AND wx < wz AND wx < xy THEN 'AABB' ELSE 'BABB' END AS pattern FROM dist WHERE yz < xz AND yz < xy"""))
def _(spark, d):
    return popgen.shared_derived(v.genotypes(spark, d), QUADS, "abs")


WS = {"a1": ("S1", "S2", "S3", "S4"), "a2": ("S5", "S2", "S3", "S4"), "a3": ("S6", "S2", "S3", "S4")}
_cons = lambda i: f"max(CASE WHEN gt > 1 THEN 1 WHEN gt < 1 THEN 0 END) FILTER (idx = {i})"


@query("shared_derived_overlap", sql(GENO, f""", cons AS (SELECT site_id, {', '.join(f'{_cons(i)} AS c{i}' for i in range(1, 7))} FROM genotypes GROUP BY site_id),
w AS ({' UNION ALL '.join(f"SELECT '{x}' AS test1, '{y}' AS test2, c{i} = c2 AS a, c{j} = c2 AS b FROM cons WHERE c3 = c4 AND c2 <> c3 AND c{i} IS NOT NULL AND c{j} IS NOT NULL" for x, y, i, j in (('a1', 'a2', 1, 5), ('a1', 'a3', 1, 6), ('a2', 'a3', 5, 6)))}),
o AS (SELECT test1, test2, count(*) AS informative, count(*) FILTER (a) AS aabb1, count(*) FILTER (b) AS aabb2,
 count(*) FILTER (NOT a) AS babb1, count(*) FILTER (NOT b) AS babb2,
 count(*) FILTER (a AND b) AS aabb_aabb, count(*) FILTER (a AND NOT b) AS aabb_babb,
 count(*) FILTER (NOT a AND b) AS babb_aabb, count(*) FILTER (NOT a AND NOT b) AS babb_babb FROM w GROUP BY 1, 2),
tail AS (SELECT test1, test2, sum(exp(lgamma(aabb1 + 1) - lgamma(k + 1) - lgamma(aabb1 - k + 1)
   + lgamma(informative - aabb1 + 1) - lgamma(aabb2 - k + 1) - lgamma(informative - aabb1 - aabb2 + k + 1)
   - lgamma(informative + 1) + lgamma(aabb2 + 1) + lgamma(informative - aabb2 + 1))) AS p
 FROM (SELECT *, unnest(range(greatest(aabb_aabb, aabb1 + aabb2 - informative), least(aabb1, aabb2) + 1)) AS k FROM o) GROUP BY 1, 2)
SELECT o.*, round(tail.p, 5) + 0.0 AS p FROM o JOIN tail USING (test1, test2)"""))
def _(spark, d):
    g = v.genotypes(spark, d).withColumn("grp", F.col("sample"))
    return popgen.shared_derived_overlap(g, WS).withColumn("p", r6(F.col("p"), 5))


def _expected(pattern):
    a = " * ".join(f"p{r}" if x else f"(1 - p{r})" for r, x in enumerate(pattern, 1))
    b = " * ".join(f"(1 - p{r})" if x else f"p{r}" for r, x in enumerate(pattern, 1))
    return f"sum({a} + {b})"


_homo = ", ".join(
    f"count(*) FILTER (grp = '{g}') AS n_{i}, count(*) FILTER (grp = '{g}' AND gt = 2) AS s_{i}" for i, g in enumerate(GROUPS)
)
BLOCKS = f""", homo AS (SELECT site_id, chrom, CAST(floor(pos / {BLOCK}) * {BLOCK} AS BIGINT) AS block, {_homo}
   FROM genotypes WHERE gt IN (0, 2) GROUP BY 1, 2, 3),
hq AS ({' UNION ALL '.join(f"SELECT '{t}' AS test, chrom, block, " + ', '.join(f's_{GROUPS.index(g)} / n_{GROUPS.index(g)} AS p{r}' for r, g in enumerate(q, 1)) + ' FROM homo WHERE ' + ' AND '.join(f'n_{GROUPS.index(g)} > 0' for g in q) for t, q in QUADS.items())}),
blk AS (SELECT chrom, block, test, {', '.join(f'{_expected(p)} AS {n}' for n, p in popgen.PATTERNS.items())}, count(*) AS nsites,
 sum((p1 - p2) * (p3 - p4)) AS f4sum, sum((p1 + p2 - 2 * p1 * p2) * (p3 + p4 - 2 * p3 * p4)) AS ddensum,
 CASE WHEN sum(p1 * p2 * p3 * p4) <> 0 THEN sum(((p1 - p2 * p3 * p4) - (p2 - p1 * p3 * p4)) * ((p3 - p1 * p2 * p4) - (p4 - p1 * p2 * p3))) / sum(p1 * p2 * p3 * p4) ELSE 0 END AS f4bc
 FROM hq GROUP BY 1, 2, 3)"""
BCOLS = [*popgen.PATTERNS, "f4sum", "ddensum", "f4bc"]


@query("abba_baba_blocks", sql(GENO, f"""{BLOCKS}
SELECT chrom, block, test, nsites, {', '.join(f'{rnd(c)} AS {c}' for c in BCOLS)} FROM blk"""))
def _(spark, d):
    b = popgen.abba_baba_blocks(v.genotypes(spark, d), QUADS, BLOCK, patterns="expected")
    return b.select("chrom", "block", "test", "nsites", *[r6(F.col(c)).alias(c) for c in BCOLS])


#: Blocks from the first site past the last one's start + WIDE, over the homozygous sites.
WIDE = 5_000_000
GREEDY = f""", gs AS (SELECT DISTINCT chrom, pos FROM genotypes WHERE gt IN (0, 2)),
nx AS MATERIALIZED (SELECT a.chrom, a.pos, b.pos AS nxt FROM gs a ASOF LEFT JOIN gs b ON a.chrom = b.chrom AND a.pos + {WIDE} < b.pos),
k AS (SELECT chrom, min(pos) AS pos FROM gs GROUP BY chrom UNION ALL SELECT k.chrom, nx.nxt FROM k JOIN nx USING (chrom, pos) WHERE nx.nxt IS NOT NULL),
gb AS (SELECT gs.chrom, gs.pos, k.pos AS block FROM gs ASOF JOIN k ON gs.chrom = k.chrom AND gs.pos >= k.pos)""" + BLOCKS.replace(
    f"CAST(floor(pos / {BLOCK}) * {BLOCK} AS BIGINT) AS block", "block"
).replace("FROM genotypes WHERE", "FROM genotypes JOIN gb USING (chrom, pos) WHERE")


@query("abba_baba_blocks_greedy", sql(GENO, f"""{GREEDY}
SELECT chrom, block, test, nsites, {', '.join(f'{rnd(c)} AS {c}' for c in BCOLS)} FROM blk""").replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, d):
    b = popgen.abba_baba_blocks(v.genotypes(spark, d), QUADS, WIDE, mode="greedy", patterns="expected")
    return b.select("chrom", "block", "test", "nsites", *[r6(F.col(c)).alias(c) for c in BCOLS])


@query("abba_baba_blocks_drawn")
def _(spark, d):
    return popgen.abba_baba_blocks(v.genotypes(spark, d), QUADS, BLOCK)


_j = [*popgen.PATTERNS, "nsites", "f4sum", "ddensum", "f4bc"]
_stats = {
    "d": "(abba - baba) / (abba + baba)",
    "dbc": "(abba - baba - bc) / nullif(abba + baba - bca - bcb, 0)",
    "d2": "f4sum / ddensum",
    "d2bc": "(f4sum - f4bc) / ddensum",
    "f4": "f4sum / nsites",
    "f4bc": "(f4sum - f4bc) / nsites",
}


@query("abba_jackknife", sql(GENO, f"""{BLOCKS},
j AS (SELECT test, {', '.join(f'sum({c}) OVER q - {c} AS {c}' for c in _j)}, sum(nsites) OVER q AS t_nsites FROM blk WINDOW q AS (PARTITION BY test)),
k AS (SELECT *, nsites / t_nsites AS w,
  CASE WHEN aaaa <> 0 THEN (aaba - aaab) * (abaa - baaa) / aaaa ELSE 0 END AS bc,
  CASE WHEN aaaa <> 0 THEN (aaba * abaa + aaab * baaa) / aaaa ELSE 0 END AS bca,
  CASE WHEN aaaa <> 0 THEN (aaba * baaa + aaab * abaa) / aaaa ELSE 0 END AS bcb FROM j WHERE abba + baba <> 0 AND ddensum <> 0),
s AS ({' UNION ALL '.join(f"SELECT test, w, '{n}' AS stat, {e} AS x FROM k" for n, e in _stats.items())}),
m AS (SELECT test, stat, count(*) AS blocks, sum(w * x) / (count(*) - 1) AS mean FROM s GROUP BY 1, 2)
SELECT test, stat, any_value(m.blocks) AS blocks, {rnd('any_value(m.mean)')} AS mean,
  {rnd('sqrt(sum(w * (x - m.mean) * (x - m.mean)) * (any_value(m.blocks) - 1) / any_value(m.blocks))')} AS sd
FROM s JOIN m USING (test, stat) GROUP BY 1, 2"""))
def _(spark, d):
    b = popgen.abba_baba_blocks(v.genotypes(spark, d), QUADS, BLOCK, patterns="expected")
    return popgen.block_jackknife(b).select("test", "stat", "blocks", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"))


@query("polarising_sites", sql(GENO + " individuals", """, k AS (SELECT count(*) FILTER (grp IN ('P1', 'P2')) AS na, count(*) FILTER (grp IN ('P3', 'P4')) AS nb FROM individuals),
s AS (SELECT site_id, count(gt) FILTER (grp IN ('P1', 'P2')) AS a, count(gt) FILTER (grp IN ('P3', 'P4')) AS b,
  coalesce(sum(gt) FILTER (grp IN ('P1', 'P2')), 0) AS sa, coalesce(sum(gt) FILTER (grp IN ('P3', 'P4')), 0) AS sb FROM genotypes GROUP BY 1)
SELECT site_id, (sa = 2 * a AND sb = 0) OR (sb = 2 * b AND sa = 0) AS polarising FROM s, k WHERE a >= 0.5 * na AND b >= 0.5 * nb"""))
def _(spark, d):
    return popgen.polarising_sites(v.genotypes(spark, d), v.individuals(spark, d), "^P[12]$", "^P[34]$")


def _theta_sql(r, n="n", s="s", h="h"):
    i = range(r)
    tot = "+".join(f"{n}{k}" for k in i)
    return f"""CASE WHEN alleles = 0 OR alleles = {tot} THEN 0.0 WHEN least({', '.join(f'{n}{k}' for k in i)}) > 0 AND nbar > 1 AND nc <> 0
      THEN a / nullif(a + b + hbar / 2, 0) END"""


def _theta_steps(src, r):
    i = range(r)
    tot = "(" + "+".join(f"n{k}" for k in i) + ")"
    return f"""
 t1 AS (SELECT *, {'+'.join(f's{k}' for k in i)} AS alleles, {tot} / 2.0 AS inds, ({'+'.join(f'n{k}*n{k}' for k in i)}) / 4.0 AS sq,
    ({'+'.join(f'h{k}' for k in i)}) AS hets, ({'+'.join(f's{k}' for k in i)}) / nullif({tot}, 0) AS p FROM {src}),
 t2 AS (SELECT *, inds / {r} AS nbar, (inds - sq / nullif(inds, 0)) / {r - 1} AS nc, hets / nullif(inds, 0) AS hbar FROM t1),
 t3 AS (SELECT *, ({'+'.join(f'n{k} * (s{k} / nullif(n{k}, 0) - p) * (s{k} / nullif(n{k}, 0) - p)' for k in i)}) / nullif({r - 1} * nbar, 0) / 2 AS ssq FROM t2),
 t4 AS (SELECT *, (nbar / nullif(nc, 0)) * (ssq - (p * (1 - p) - ssq * {r - 1}.0 / {r} - hbar / 4) / nullif(nbar - 1, 0)) AS a,
    (nbar / nullif(nbar - 1, 0)) * (p * (1 - p) - ssq * {r - 1}.0 / {r} - hbar * (2 * nbar - 1) / nullif(4 * nbar, 0)) AS b FROM t3),
 t5 AS (SELECT *, {_theta_sql(r)} AS f FROM t4)"""


FST = f""", {WIDE}, src AS (SELECT site_id, {', '.join(f'CAST(2 * n_{i} AS DOUBLE) AS n{i}, CAST(s_{i} AS DOUBLE) AS s{i}, CAST(h_{i} AS DOUBLE) AS h{i}' for i in range(4))} FROM wide),
{_theta_steps('src', 4)}"""


@query("fst_weir_cockerham", sql(GENO, f"{FST} SELECT site_id, {rnd('f')} AS fst FROM t5"))
def _(spark, d):
    f = popgen.fst_weir_cockerham(v.genotypes(spark, d), GROUPS)
    return f.select("site_id", r6(F.col("fst")).alias("fst"))


_g3 = ["P2", "P3", "P4"]
_k = ", ".join(f"count(*) FILTER (grp = '{g}' AND gt = {x}) AS k_{i}_{x}" for i, g in enumerate(_g3) for x in (0, 1, 2))


@query("fst_jackknife", sql(GENO, f""",
smp AS (SELECT site_id, CAST(substr(grp, 2) AS INTEGER) - 2 AS g, idx, gt FROM genotypes WHERE grp IN ('P2', 'P3', 'P4') AND gt IS NOT NULL),
tot AS (SELECT site_id, {', '.join(f'count(*) FILTER (g = {i}) AS c{i}, coalesce(sum(gt) FILTER (g = {i}), 0) AS a{i}, count(*) FILTER (g = {i} AND gt = 1) AS e{i}' for i in range(3))} FROM smp GROUP BY 1),
rep AS (SELECT x.site_id, x.g AS gi, x.gt AS u, y.g AS gk, y.gt AS w FROM smp x JOIN smp y ON x.site_id = y.site_id AND x.g <> y.g AND x.g < 2),
src AS (SELECT site_id, {', '.join(f'CAST(2 * (c{i} - (gi = {i})::INT - (gk = {i})::INT) AS DOUBLE) AS n{i}, CAST(a{i} - CASE WHEN gi = {i} THEN u ELSE 0 END - CASE WHEN gk = {i} THEN w ELSE 0 END AS DOUBLE) AS s{i}, CAST(e{i} - CASE WHEN gi = {i} AND u = 1 THEN 1 ELSE 0 END - CASE WHEN gk = {i} AND w = 1 THEN 1 ELSE 0 END AS DOUBLE) AS h{i}' for i in range(3))} FROM rep JOIN tot USING (site_id)),
{_theta_steps('src', 3)}
SELECT site_id, count(*) AS replicates, round(avg(f), 5) + 0.0 AS fst_mean FROM t5 WHERE f IS NOT NULL GROUP BY site_id"""))
def _(spark, d):
    f = popgen.fst_jackknife(v.genotypes(spark, d), _g3)
    return f.select("site_id", "replicates", r6(F.col("fst_mean"), 5).alias("fst_mean"))


@query("population_loglik", sql(GENO, f""", {WIDE}, t AS (SELECT *, (s_0 + s_1 + s_2 + s_3) / (2.0 * (n_0 + n_1 + n_2 + n_3)) AS p FROM wide WHERE n_0 + n_1 + n_2 + n_3 > 0),
g AS ({' UNION ALL '.join(f'SELECT site_id, p, 2 * n_{i} AS n, s_{i} AS k FROM t' for i in range(4))}),
l AS (SELECT *, CAST(floor(n * p) AS BIGINT) AS lo, CAST(ceil(n * p) AS BIGINT) AS hi FROM g),
e AS (SELECT site_id, CASE WHEN n > 0 AND p > 0 AND p < 1 THEN
   {{}} - greatest({{}}, {{}}) ELSE 0 END AS x FROM l)
SELECT site_id, {rnd('sum(x)', 5)} AS loglik FROM e GROUP BY site_id""".format(*[
    f"(lgamma(n + 1) - lgamma({x} + 1) - lgamma(n - {x} + 1) + {x} * ln(p) + (n - {x}) * ln(1 - p))" for x in ("k", "lo", "hi")])))
def _(spark, d):
    t = popgen.population_loglik(v.genotypes(spark, d), GROUPS)
    return popgen.sort_by_loglik(t).select("site_id", r6(F.col("loglik"), 5).alias("loglik"))


@query("topology_counts", sql(GENO, """, w AS (SELECT site_id, chrom, pos, max(gt) FILTER (sample = 'S1') AS a, max(gt) FILTER (sample = 'S2') AS b, max(gt) FILTER (sample = 'S3') AS c
  FROM genotypes WHERE gt IN (0, 2) AND qual >= 25 GROUP BY 1, 2, 3)
SELECT count(*) FILTER (a = b) AS ab, count(*) FILTER (b = c) AS bc, count(*) FILTER (a = c) AS ac, 0 AS spacing
FROM w WHERE a + b + c IS NOT NULL AND NOT (a = b AND b = c)"""))
def _(spark, d):
    return popgen.topology_counts(v.genotypes(spark, d), ("S1", "S2", "S3"))


@query("topology_counts_spaced", sql(GENO, """, w AS MATERIALIZED (SELECT site_id, chrom, pos, max(gt) FILTER (sample = 'S1') AS a, max(gt) FILTER (sample = 'S2') AS b, max(gt) FILTER (sample = 'S3') AS c
  FROM genotypes WHERE gt IN (0, 2) AND qual >= 25 GROUP BY 1, 2, 3 HAVING a + b + c IS NOT NULL AND NOT (a = b AND b = c)),
sp(ld) AS (VALUES (10000), (100000)),
nx AS MATERIALIZED (SELECT x.ld, x.chrom, x.pos, y.pos AS nxt FROM (SELECT ld, chrom, pos, pos + ld AS want FROM w, sp) x ASOF LEFT JOIN w y ON x.chrom = y.chrom AND x.want <= y.pos),
k AS (SELECT ld, chrom, min(pos) AS pos FROM w, sp GROUP BY 1, 2 UNION ALL SELECT k.ld, k.chrom, nx.nxt FROM k JOIN nx USING (ld, chrom, pos) WHERE nx.nxt IS NOT NULL),
u AS (SELECT ld, a, b, c FROM k JOIN w USING (chrom, pos) UNION ALL SELECT 0, a, b, c FROM w)
SELECT count(*) FILTER (a = b) AS ab, count(*) FILTER (b = c) AS bc, count(*) FILTER (a = c) AS ac, CAST(ld AS INTEGER) AS spacing FROM u GROUP BY ld""").replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, d):
    return popgen.topology_counts(v.genotypes(spark, d), ("S1", "S2", "S3"), (0, 10_000, 100_000))


@query("topology_counts_af", sql(GENO, """, w AS (SELECT site_id, sum(gt) FILTER (grp = 'P2') / (2.0 * count(gt) FILTER (grp = 'P2')) AS a,
  sum(gt) FILTER (grp = 'P3') / (2.0 * count(gt) FILTER (grp = 'P3')) AS b, sum(gt) FILTER (grp = 'P4') / (2.0 * count(gt) FILTER (grp = 'P4')) AS c
  FROM genotypes WHERE qual >= 25 AND NOT (ref IN ('C', 'T') AND alt IN ('C', 'T')) AND grp IN ('P2', 'P3', 'P4')
  GROUP BY 1 HAVING count(*) FILTER (gt = 1) = 0),
t AS (SELECT (a-b)*(a-b) AS ab, (b-c)*(b-c) AS bc, (a-c)*(a-c) AS ac FROM w WHERE a + b + c IS NOT NULL)
SELECT count(*) FILTER (ab < bc AND ab < ac) AS ab, count(*) FILTER (bc < ab AND bc < ac) AS bc, count(*) FILTER (ac < ab AND ac < bc) AS ac,
 count(*) FILTER (NOT (ab < bc AND ab < ac) AND NOT (bc < ab AND bc < ac) AND NOT (ac < ab AND ac < bc)) AS "none" FROM t"""))
def _(spark, d):
    return popgen.topology_counts_af(v.genotypes(spark, d), ["P2", "P3", "P4"])


@query("zscore_column", sql(GENO, f"""{FST}
SELECT site_id, {rnd('coalesce((f - avg(f) OVER ()) / nullif(stddev_pop(f) OVER (), 0), 0)')} AS z FROM t5"""))
def _(spark, d):
    f = popgen.fst_weir_cockerham(v.genotypes(spark, d), GROUPS)
    return popgen.zscore_column(f, "fst").select("site_id", r6(F.col("z")).alias("z"))


DS = f""", {WIDE}, tri AS ({' UNION ALL '.join(f"SELECT site_id, '{a}' AS p1, '{b}' AS p2, '{c}' AS p3, n_{GROUPS.index(a)} AS n1, n_{GROUPS.index(b)} AS n2, n_{GROUPS.index(c)} AS n3, n_3 AS n4, s_{GROUPS.index(a)} AS s1, s_{GROUPS.index(b)} AS s2, s_{GROUPS.index(c)} AS s3, s_3 AS s4 FROM wide" for a, b, c in (('P1', 'P2', 'P3'), ('P2', 'P3', 'P1'), ('P3', 'P1', 'P2')))})"""


@query("best_topology", sql(GENO, f"""{TESTS}{DTERMS}, ds AS (SELECT test, sum(num) / sum(den) AS d FROM terms GROUP BY test)
SELECT 'P1,P2,P3' AS triple, CASE test WHEN 't1' THEN 'P1' WHEN 't2' THEN 'P2' ELSE 'P3' END AS p1, {rnd('d')} AS d
FROM ds ORDER BY abs(d) LIMIT 1"""))
def _(spark, d):
    ds = popgen.d_statistic(v.genotypes(spark, d), QUADS)
    named = ds.select("d", F.lit(1.0).alias("z"), *[F.element_at(F.create_map(*[F.lit(x) for t, q in QUADS.items() for x in (t, q[i])]), F.col("test")).alias(f"p{i + 1}") for i in range(3)])
    return popgen.best_topology(named).select("triple", "p1", r6(F.col("d")).alias("d"))


@query("parsimonious_topology", sql(GENO, f"""{TESTS}{DTERMS}, ds AS (SELECT test, count(*) FILTER (num < 0) AS abba, count(*) FILTER (num > 0) AS baba FROM terms GROUP BY test)
SELECT test, abba, baba FROM ds WHERE greatest(abba, baba) < (SELECT max(greatest(abba, baba)) FROM ds)"""))
def _(spark, d):
    ds = popgen.d_statistic(v.genotypes(spark, d), QUADS)
    named = ds.select("*", *[F.element_at(F.create_map(*[F.lit(x) for t, q in QUADS.items() for x in (t, q[i])]), F.col("test")).alias(f"p{i + 1}") for i in range(3)])
    return popgen.parsimonious_topology(named).select("test", "abba", "baba")


@query("d_significance", sql(GENO, f"""{BLOCKS},
j AS (SELECT test, (sum(f4sum) OVER q - f4sum) / (sum(ddensum) OVER q - ddensum) AS x, (sum(nsites) OVER q - nsites) / sum(nsites) OVER q AS w FROM blk WINDOW q AS (PARTITION BY test)),
m AS (SELECT test, count(*) AS n, sum(w * x) / (count(*) - 1) AS mean FROM j GROUP BY 1),
z AS (SELECT test, any_value(m.mean) AS d, sqrt(sum(w * (x - m.mean) * (x - m.mean)) * (any_value(n) - 1) / any_value(n)) AS sd FROM j JOIN m USING (test) GROUP BY 1)
SELECT test, {rnd('d')} AS d, {rnd('3 * abs(sd)')} AS error, abs(d) > 3 * abs(sd) AS significant FROM z"""))
def _(spark, d):
    b = popgen.abba_baba_blocks(v.genotypes(spark, d), QUADS, BLOCK, patterns="expected")
    j = popgen.block_jackknife(b).filter("stat = 'd2'").select("test", F.col("mean").alias("d"), "z")
    return popgen.d_significance(j).select("test", r6(F.col("d")).alias("d"), r6(F.col("error")).alias("error"), "significant")


# --- pairs ----------------------------------------------------------------------------------------


@query("pairwise_distance", sql(GENO, """
SELECT a.sample AS i, b.sample AS j, count(*) FILTER (a.gt <> b.gt) AS differ, count(*) AS comparable,
  round(count(*) FILTER (a.gt <> b.gt) / count(*), 6) + 0.0 AS distance
FROM genotypes a JOIN genotypes b ON a.site_id = b.site_id AND a.idx < b.idx WHERE a.gt IN (0, 2) AND b.gt IN (0, 2) GROUP BY 1, 2"""))
def _(spark, d):
    return pairs.pairwise_distance(v.genotypes(spark, d), individuals=v.individuals(spark, d)).withColumn("distance", r6(F.col("distance")))


@query("pairwise_distance_blocks", sql(GENO, f"""
SELECT a.chrom, CAST(floor(a.pos / {BLOCK}) * {BLOCK} AS BIGINT) AS block, a.sample AS i, b.sample AS j,
  count(*) FILTER (a.gt <> b.gt) AS differ, count(*) AS comparable, round(count(*) FILTER (a.gt <> b.gt) / count(*), 6) + 0.0 AS distance
FROM genotypes a JOIN genotypes b ON a.site_id = b.site_id AND a.idx < b.idx WHERE a.gt IN (0, 2) AND b.gt IN (0, 2) GROUP BY 1, 2, 3, 4"""))
def _(spark, d):
    return pairs.pairwise_distance(v.genotypes(spark, d), block=BLOCK, individuals=v.individuals(spark, d)).withColumn("distance", r6(F.col("distance")))


IMPACT = "CASE site_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'LOW' ELSE 'MODIFIER' END"


@query("pairwise_distance_by_impact", sql(GENO, f"""
SELECT a.sample AS i, b.sample AS j, {IMPACT.replace('site_id', 'a.site_id')} AS class, CAST(sum(abs(a.gt - b.gt)) AS BIGINT) AS weight, count(*) AS comparable
FROM genotypes a JOIN genotypes b ON a.site_id = b.site_id AND a.idx < b.idx WHERE a.gt IS NOT NULL AND b.gt IS NOT NULL GROUP BY 1, 2, 3"""))
def _(spark, d):
    g = v.genotypes(spark, d).withColumn("class", F.expr(IMPACT))
    return pairs.pairwise_distance_by_class(g, "class", individuals=v.individuals(spark, d))


@query("rank_pairs", sql(GENO, """
SELECT i, j, row_number() OVER (ORDER BY w / n, i, j) AS place FROM (
SELECT a.sample AS i, b.sample AS j, sum(abs(a.gt - b.gt)) AS w, count(*) AS n
FROM genotypes a JOIN genotypes b ON a.site_id = b.site_id AND a.idx < b.idx WHERE a.gt IS NOT NULL AND b.gt IS NOT NULL GROUP BY 1, 2)"""))
def _(spark, d):
    return pairs.rank_pairs(pairs.pairwise_distance_by_class(v.genotypes(spark, d).withColumn("class", F.lit("all")), "class", individuals=v.individuals(spark, d))).select("i", "j", "place")


@query("impact_shares", sql(GENO, f""", p AS (
SELECT a.sample AS i, b.sample AS j, {IMPACT.replace('site_id', 'a.site_id')} AS class, sum(abs(a.gt - b.gt)) AS w, count(*) AS n
FROM genotypes a JOIN genotypes b ON a.site_id = b.site_id AND a.idx < b.idx WHERE a.gt IS NOT NULL AND b.gt IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT *, sum(w) OVER (PARTITION BY i, j) AS tw, sum(n) OVER (PARTITION BY i, j) AS tn FROM p)
SELECT i, j, class, {rnd('w / tw')} AS share FROM t WHERE tw / tn <= 0.9"""))
def _(spark, d):
    g = v.genotypes(spark, d).withColumn("class", F.expr(IMPACT))
    return pairs.impact_shares(pairs.pairwise_distance_by_class(g, "class", individuals=v.individuals(spark, d)), 0.9).select("i", "j", "class", r6(F.col("share")).alias("share"))


@query("percentile_bin_means", sql("calls", f""", q AS (SELECT quantile_cont(CAST(dp AS DOUBLE), [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM calls),
b AS (SELECT unnest([1, 2, 3, 4]) AS bin, q FROM q)
SELECT bin, count(*) AS n, {rnd('avg(qual)')} AS mean FROM calls JOIN b ON dp > q[bin] AND dp < q[bin + 1] GROUP BY bin"""))
def _(spark, d):
    t = v.calls(spark, d).select(F.col("dp").cast("double").alias("x"), F.col("qual").alias("y"))
    return pairs.percentile_bin_means(t, "x", "y", [0.0, 0.25, 0.5, 0.75, 1.0]).withColumn("mean", r6(F.col("mean")))


@query("max_impact", sql("", """
SELECT doc_id, CASE max(CASE w WHEN 'HIGH' THEN 4 WHEN 'MODERATE' THEN 3 WHEN 'LOW' THEN 2 ELSE 1 END) WHEN 4 THEN 'HIGH' WHEN 3 THEN 'MODERATE' WHEN 2 THEN 'LOW' ELSE 'MODIFIER' END AS impact
FROM (SELECT doc_id, CASE WHEN length(x) % 97 = 0 THEN 'HIGH' WHEN length(x) % 31 = 0 THEN 'MODERATE' WHEN length(x) % 7 = 0 THEN 'LOW' ELSE 'MODIFIER' END AS w
  FROM (SELECT doc_id, unnest(string_split(text, '.')) AS x FROM documents)) GROUP BY doc_id"""))
def _(spark, d):
    words = F.split("text", r"\.")
    cls = lambda x: F.when(F.length(x) % 97 == 0, "HIGH").when(F.length(x) % 31 == 0, "MODERATE").when(F.length(x) % 7 == 0, "LOW").otherwise("MODIFIER")
    ann = F.array_join(F.transform(words, lambda x: F.concat(F.lit("T|effect|"), cls(x), F.lit("|gene"))), ",")
    t = v.table(spark, d, "documents").select("doc_id", F.concat(F.lit("DP=1;ANN="), ann, F.lit(";AC=2")).alias("info"))
    return t.select("doc_id", pairs.max_impact("info").alias("impact"))


@query("cadd_lookup", sql("sites", """, ann AS (SELECT o_custkey % 5 + 1 AS chrom, o_orderkey * 100 + 1 AS pos, floor(o_totalprice / 1000) AS score FROM orders)
SELECT site_id, score FROM sites LEFT JOIN ann USING (chrom, pos)"""))
def _(spark, d):
    o = v.table(spark, d, "orders").select(
        (F.col("o_custkey") % 5 + 1).cast("int").alias("chrom"), (F.col("o_orderkey") * 100 + 1).alias("pos"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score"), F.col("o_orderkey").alias("line_no"))
    return pairs.score_lookup(v.sites(spark, d), o).select("site_id", "score")
