"""Parsers and writers, run over text that Spark derives from the driver tables."""

import uuid

from pyspark.sql import functions as F

from genespark.functions import coords
from genespark.operators import variants
from genespark.plans import views as v
from genespark.plans.q_variants import pile
from genespark.plans.registry import query
from genespark.plans.views import GENO, r6, rnd, sql
from genespark.scratch import shared_folder
from genespark.sinks import formats as K
from genespark.sources import formats as R
from genespark.sources.lines import read_lines, read_numbered

TAB = "\t"


def cat(*cols):
    return F.concat_ws(TAB, *cols)


def one_file(df, value, line_no=None, file="a.txt"):
    cols = [value.alias("value"), F.lit(file).alias("file")]
    return df.select(*cols, *([line_no.cast("long").alias("line_no")] if line_no is not None else []))


def vcf_lines(spark, d):
    """One VCF 'file' per population with its samples in order; missing calls are ./. with trailing fields dropped."""
    g = pile(spark, d)
    gt = F.when(F.col("gt").isNull(), "./.").when(F.col("gt") == 2, "0/0").when(F.col("gt") == 1, "0/1").otherwise("1/1")
    cell = F.when(F.col("gt").isNull(), gt).otherwise(F.concat_ws(":", gt, F.col("dp"), F.concat_ws(",", "dp_ref", "dp_alt")))
    names = v.individuals(spark, d).agg(F.array_sort(F.collect_list("sample")).alias("n"))
    site = g.groupBy("site_id", "chrom", "pos", "ref", "alt").agg(F.map_from_entries(F.collect_list(F.struct("sample", cell))).alias("m"), F.max("qual").alias("q"))
    site = site.withColumn("n", names.scalar())
    cells = F.transform("n", lambda s: F.coalesce(F.try_element_at("m", s), F.lit("./.")))
    body = one_file(site, cat(F.concat(F.lit("chr"), "chrom"), "pos", F.concat(F.lit("rs"), "site_id"), "ref", "alt", F.col("q").cast("string"), F.lit("PASS"), F.lit("."), F.lit("GT:DP:AD"), F.array_join(cells, TAB)))
    head = one_file(names, cat(F.lit("#CHROM"), *[F.lit(x) for x in "POS ID REF ALT QUAL FILTER INFO FORMAT".split()], F.array_join("n", TAB)))
    meta = one_file(names, F.lit("##fileformat=VCFv4.2"))
    return meta.unionByName(head).unionByName(body)


@query("parse_vcf", sql(GENO, """SELECT CAST(chrom AS VARCHAR) AS chrom, pos, ref, alt, sample, gt, CASE WHEN gt IS NOT NULL THEN dp END AS dp FROM genotypes
UNION ALL SELECT CAST(s.chrom AS VARCHAR), s.pos, s.ref, s.alt, i.sample, NULL, NULL FROM (SELECT DISTINCT site_id, chrom, pos, ref, alt FROM genotypes) s, (SELECT DISTINCT 'S' || l_linenumber AS sample FROM lineitem) i
WHERE NOT EXISTS (SELECT 1 FROM genotypes g WHERE g.site_id = s.site_id AND g.sample = i.sample)"""))
def _(spark, d):
    g = R.vcf_genotypes(R.parse_vcf(vcf_lines(spark, d)))
    return g.select("chrom", "pos", "ref", "alt", "sample", "gt", "dp")


@query("vcf_samples", sql("individuals", "SELECT idx - 1 AS idx, sample FROM individuals"))
def _(spark, d):
    return R.vcf_samples(vcf_lines(spark, d)).select("idx", "sample")


def eigen_tables(spark, d):
    s = v.sites(spark, d).withColumn("snpid", F.concat(F.lit("rs"), "site_id"))
    return s, v.calls(spark, d), v.individuals(spark, d)


@query("geno_lines", sql(GENO + " individuals", """, grid AS (SELECT s.site_id, i.idx FROM sites s, individuals i)
SELECT site_id, string_agg(coalesce(CAST(gt AS VARCHAR), '9'), '' ORDER BY idx) AS line FROM grid LEFT JOIN calls USING (site_id, idx) GROUP BY site_id"""))
def _(spark, d):
    s, g, i = eigen_tables(spark, d)
    return K.geno_lines(s, g, i).select("site_id", "line")


@query("geno_lines_complete", sql(GENO, """SELECT site_id, string_agg(CAST(gt AS VARCHAR), '' ORDER BY idx) AS line FROM calls WHERE idx IN (1, 2) AND site_id IN (
SELECT site_id FROM calls WHERE idx IN (1, 2) AND gt IS NOT NULL GROUP BY 1 HAVING count(*) = 2) GROUP BY site_id"""))
def _(spark, d):
    s, g, i = eigen_tables(spark, d)
    return K.geno_lines(s, g.filter("idx < 3"), i.filter("idx < 3"), exclude_missing=True).select("site_id", "line")


@query("snp_lines", sql("sites", r"""SELECT 'rs' || site_id || chr(9) || chrom || chr(9) || '0.0' || chr(9) || pos || chr(9) || ref || chr(9) || alt AS line FROM sites"""))
def _(spark, d):
    return K.snp_lines(eigen_tables(spark, d)[0], six=True).select("line")


@query("ind_lines", sql("individuals", "SELECT idx, sample || chr(9) || 'U' || chr(9) || grp AS line FROM individuals"))
def _(spark, d):
    return K.ind_lines(v.individuals(spark, d))


@query("eigenstrat_round_trip", sql(GENO + " individuals", """SELECT 'rs' || s.site_id AS snpid, CAST(s.chrom AS VARCHAR) AS chrom, s.pos, i.sample, i.grp, gt
FROM sites s CROSS JOIN individuals i LEFT JOIN calls c ON c.site_id = s.site_id AND c.idx = i.idx"""))
def _(spark, d):
    s, g, i = eigen_tables(spark, d)
    geno = R.parse_geno(K.geno_lines(s, g, i).select(F.col("site_id").alias("line_no"), F.col("line").alias("value")))
    snp = R.parse_snp(K.snp_lines(s, six=True).select(F.col("site_id").alias("line_no"), F.col("line").alias("value")))
    ind = R.parse_ind(K.ind_lines(i).select((F.col("idx") - 1).alias("line_no"), F.col("line").alias("value")))
    return R.join_eigenstrat(geno, snp, ind).select("snpid", "chrom", "pos", "sample", "grp", "gt")


@query("positional_join", sql("", "SELECT o_orderkey AS line_no, o_custkey AS a, o_totalprice AS b FROM orders"))
def _(spark, d):
    o = v.table(spark, d, "orders")
    return R.positional_join(o.select(F.col("o_orderkey").alias("line_no"), F.col("o_custkey").alias("a")), o.select(F.col("o_orderkey").alias("line_no"), F.col("o_totalprice").alias("b")))


@query("flip_genotypes", sql("calls", "SELECT site_id, idx, 2 - gt AS gt FROM calls"))
def _(spark, d):
    return K.flip_genotypes(v.calls(spark, d)).select("site_id", "idx", "gt")


@query("missingness", sql("calls", "SELECT site_id, idx, CASE WHEN gt IS NULL THEN 1 ELSE 0 END AS missing FROM calls"))
def _(spark, d):
    return K.missingness(v.calls(spark, d)).select("site_id", "idx", "missing")


NAMES = """CASE c_custkey % 6 WHEN 0 THEN 'rep_' || c_mktsegment || '_' || c_custkey WHEN 1 THEN 'XY_A1_' || c_mktsegment || '_z' WHEN 2 THEN 'X1_C_' || c_custkey WHEN 3 THEN 'pool_lig_' || c_custkey WHEN 4 THEN c_mktsegment ELSE '10ul_' || c_mktsegment || '_a_b' END"""


@query("group_from_name", sql("", """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_mktsegment || '_z' WHEN 2 THEN 'X1_C_' || c_custkey WHEN 3 THEN 'lig' WHEN 4 THEN c_mktsegment ELSE c_mktsegment || '_a' END AS grp FROM customer""".replace("WHEN 3 THEN 'lig'", "WHEN 3 THEN 'lig'")))
def _(spark, d):
    t = v.table(spark, d, "customer").select("c_custkey", F.expr(NAMES).alias("name"))
    return t.select("c_custkey", K.group_from_name(F.col("name")).alias("grp"))


def frag_sql(char, missing, width, where="true", sites="sites"):
    return f"""{{}}rk AS (SELECT site_id, row_number() OVER (ORDER BY chrom, pos) - 1 AS rank FROM {sites}),
people AS (SELECT DISTINCT idx, sample, grp FROM genotypes WHERE {where}),
cells AS (SELECT p.idx, p.sample, p.grp, rank, rank // {width} AS fragment, coalesce({char}, '{missing}') AS ch FROM people p CROSS JOIN rk LEFT JOIN genotypes g ON g.site_id = rk.site_id AND g.idx = p.idx),
frags AS (SELECT idx, sample, grp, fragment, string_agg(ch, '' ORDER BY rank) AS text FROM cells GROUP BY 1, 2, 3, 4)""".format(", ")


_iupac = "CASE gt WHEN 2 THEN ref WHEN 0 THEN alt WHEN 1 THEN CASE least(ref, alt) || greatest(ref, alt) WHEN 'AC' THEN 'M' WHEN 'AG' THEN 'R' WHEN 'AT' THEN 'W' WHEN 'CG' THEN 'S' WHEN 'CT' THEN 'Y' ELSE 'K' END END"


@query("to_phylip_numeric", sql(GENO, f"""{frag_sql('CAST(gt AS VARCHAR)', '?', 60)}
SELECT -1 AS idx, -1 AS fragment, ' ' || (SELECT count(*) FROM people) || ' ' || (SELECT count(*) FROM sites) AS line UNION ALL
SELECT idx, fragment, CASE WHEN fragment = 0 THEN sample || ' ' || text ELSE text END FROM frags"""))
def _(spark, d):
    return K.to_phylip(v.genotypes(spark, d), v.sites(spark, d))


@query("to_phylip_iupac", sql(GENO, f"""{frag_sql(_iupac, 'N', 60)}
SELECT -1 AS idx, -1 AS fragment, ' ' || (SELECT count(*) FROM people) || ' ' || (SELECT count(*) FROM sites) AS line UNION ALL
SELECT idx, fragment, CASE WHEN fragment = 0 THEN sample || ' ' || text ELSE text END FROM frags"""))
def _(spark, d):
    return K.to_phylip(v.genotypes(spark, d), v.sites(spark, d), numeric=False)


POLY = ", poly AS (SELECT * FROM sites WHERE site_id IN (SELECT site_id FROM genotypes WHERE gt IS NOT NULL GROUP BY 1 HAVING sum(gt) > 0 AND sum(gt) < 2 * count(gt)))"


@query("to_phylip_polymorphic", sql(GENO, f"""{POLY}{frag_sql(_iupac, 'N', 60, sites='poly')}
SELECT -1 AS idx, -1 AS fragment, ' ' || (SELECT count(*) FROM people) || ' ' || (SELECT count(*) FROM poly) AS line UNION ALL
SELECT idx, fragment, CASE WHEN fragment = 0 THEN sample || ' ' || text ELSE text END FROM frags"""))
def _(spark, d):
    return K.to_phylip(v.genotypes(spark, d), v.sites(spark, d), numeric=False, drop_monomorphic=True)


@query("to_multifasta", sql(GENO, f"""{POLY}{frag_sql(_iupac, 'N', 60, sites='poly')}
SELECT idx, -1 AS fragment, '>' || sample AS line FROM people UNION ALL SELECT idx, fragment, text FROM frags"""))
def _(spark, d):
    return K.to_multifasta(v.genotypes(spark, d), v.sites(spark, d))


@query("invariant_counts", sql(GENO, """SELECT CASE WHEN s = 0 THEN alt ELSE ref END AS base, count(*) AS n FROM (SELECT site_id, any_value(ref) AS ref, any_value(alt) AS alt, sum(gt) AS s, 2 * count(gt) AS n
FROM genotypes WHERE gt IS NOT NULL GROUP BY 1) WHERE s = 0 OR s = n GROUP BY 1"""))
def _(spark, d):
    return K.invariant_counts(v.genotypes(spark, d))


@query("to_genotype_fasta", sql(GENO, f"""{frag_sql('CAST(gt AS VARCHAR)', '9', 60)}
SELECT idx, -1 AS fragment, '>' || sample || '_' || grp AS line FROM people UNION ALL SELECT idx, fragment, text FROM frags"""))
def _(spark, d):
    return K.to_genotype_fasta(v.genotypes(spark, d), v.sites(spark, d))


@query("to_genepop", sql(GENO, f"""{frag_sql("CASE gt WHEN 0 THEN ' 0202' WHEN 1 THEN ' 0102' WHEN 2 THEN ' 0101' END", ' 0000', 60)}
SELECT DISTINCT grp, -1 AS idx, -1 AS fragment, 'Pop' AS line FROM people UNION ALL SELECT grp, idx, fragment, CASE WHEN fragment = 0 THEN grp || ',' || text ELSE text END FROM frags"""))
def _(spark, d):
    return K.to_genepop(v.genotypes(spark, d), v.sites(spark, d))


@query("to_nexus", sql(GENO, f"""{frag_sql('CAST(2 - gt AS VARCHAR)', '?', 60)}
SELECT idx, fragment, CASE WHEN fragment = 0 THEN sample || ' ' || text ELSE text END AS line FROM frags
UNION ALL SELECT 0, fragment, CASE WHEN fragment = 0 THEN 'ref ' ELSE '' END || repeat('0', count(*)::INT) FROM (SELECT rank // 60 AS fragment FROM rk) GROUP BY fragment"""))
def _(spark, d):
    return K.to_nexus(v.genotypes(spark, d), v.sites(spark, d), reference="ref")


@query("to_nexus_nucleotide")
def _(spark, d):
    return K.to_nexus(v.genotypes(spark, d), v.sites(spark, d), nucleotide=True)


@query("to_treemix", sql(GENO, f"""SELECT s.chrom, s.pos, s.site_id, {" || ' ' || ".join(f"coalesce(sum(gt) FILTER (grp = '{g}'), 0) || ',' || (2 * count(gt) FILTER (grp = '{g}') - coalesce(sum(gt) FILTER (grp = '{g}'), 0))" for g in ('P1', 'P2', 'P3', 'P4'))} AS line
FROM sites s LEFT JOIN calls c USING (site_id) GROUP BY 1, 2, 3"""))
def _(spark, d):
    return K.to_treemix(v.genotypes(spark, d), ["P1", "P2", "P3", "P4"], v.sites(spark, d))


@query("parse_bed", sql("", """SELECT CAST(p_size % 5 AS VARCHAR) AS chrom, p_partkey // 3 + 1 AS pos, 's' || min(p_partkey) AS snpid FROM part GROUP BY 1, 2"""))
def _(spark, d):
    p = v.table(spark, d, "part")
    pos = F.floor(F.col("p_partkey") / 3) + 1
    return R.parse_bed(one_file(p, cat(F.concat(F.lit("chr"), F.col("p_size") % 5), pos - 1, pos, F.concat(F.lit("s"), "p_partkey")), F.col("p_partkey"))).select("chrom", "pos", "snpid")


@query("parse_snp_chip", sql("", """SELECT o_orderkey AS snp_num, i AS idx, 'B' || i AS sample, CASE (o_custkey + i) % 4 WHEN 3 THEN NULL ELSE 2 - (o_custkey + i) % 4 END AS gt FROM orders, (SELECT unnest(range(6)) AS i)"""))
def _(spark, d):
    o = v.table(spark, d, "orders")
    code = lambda i: F.element_at(F.array(*[F.lit(x) for x in "012?"]), ((F.col("o_custkey") + i) % 4 + 1).cast("int"))
    body = one_file(o, cat(F.col("o_orderkey"), *[code(i) for i in range(6)]), F.col("o_orderkey") + 1)
    head = one_file(v.table(spark, d, "region").filter("r_regionkey = 0"), cat(F.lit("snp"), *[F.lit(f"B{i}") for i in range(6)]), F.lit(0))
    return K.recode_snp_chip(R.parse_snp_chip(head.unionByName(body))).select("snp_num", F.col("idx").cast("long").alias("idx"), "sample", F.col("gt").cast("long").alias("gt"))


@query("parse_fasta", sql("reads", "SELECT name, 'len=' || length(seq) AS comment, seq FROM reads"))
def _(spark, d):
    r = v.reads(spark, d)
    body = F.regexp_replace("seq", "(.{1,60})", "$1\n")
    t = one_file(r, F.concat(F.when(F.col("doc_id") == 0, ">").otherwise(""), "name", F.lit(" len="), F.length("seq"), F.lit("\n"), body))
    return R.parse_fasta(t).select("name", "comment", "seq")


@query("parse_fastq", sql("reads", "SELECT name, 'c' || doc_id AS comment, seq, repeat('I', length(seq)) AS qual FROM reads"))
def _(spark, d):
    r = v.reads(spark, d)
    parts = F.array(F.concat(F.lit("@"), "name", F.lit(" c"), "doc_id"), F.col("seq"), F.lit("+"), F.expr("repeat('I', length(seq))"))
    t = r.select("doc_id", F.posexplode(parts).alias("i", "value"))
    lines = t.select("value", F.lit("a.fq").alias("file"), (F.col("doc_id") * 4 + F.col("i")).alias("line_no"))
    return R.parse_fastq(lines).select("name", "comment", "seq", "qual")


@query("parse_sam", sql("", """SELECT 'q' || l_orderkey || '.' || l_linenumber AS qname, CAST(l_suppkey % 4096 AS INTEGER) AS flag, 'chr' || (l_partkey % 5) AS rname, l_partkey AS pos, CAST(l_quantity AS INTEGER) AS mapq,
 CAST(l_quantity AS INTEGER) AS len, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 0 END AS tags FROM lineitem"""))
def _(spark, d):
    t = v.table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    seq = F.expr("repeat('A', int(l_quantity))")
    tags = F.when(F.col("l_linenumber") % 2 == 0, "\tNM:i:0\tMD:Z:1").otherwise("")
    line = F.concat(cat(F.concat(F.lit("q"), "l_orderkey", F.lit("."), "l_linenumber"), F.col("l_suppkey") % 4096, F.concat(F.lit("chr"), F.col("l_partkey") % 5), "l_partkey", q, F.concat(q, F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), seq, F.lit("*")), tags)
    head = one_file(v.table(spark, d, "nation"), F.concat(F.lit("@SQ\tSN:"), "n_name"))
    return R.parse_sam(head.unionByName(one_file(t, line))).select("qname", "flag", "rname", "pos", "mapq", F.length("seq").alias("len"), F.size("opt").alias("tags"))


@query("gff_to_bed", sql("", """SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'GB' || n_nationkey ELSE 'chr' || n_nationkey END AS chrom, p_partkey * 10 AS "start", p_partkey * 10 + p_size AS "end", p_brand AS type
FROM part JOIN nation ON n_nationkey = p_partkey % 25 WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')"""))
def _(spark, d):
    p = v.table(spark, d, "part")
    gff = one_file(p, cat(F.concat(F.lit("NC"), F.col("p_partkey") % 25), F.lit("x"), "p_brand", F.col("p_partkey") * 10 + 1, F.col("p_partkey") * 10 + F.col("p_size"), F.lit("."), F.lit("+"), F.lit("."), F.lit("ID=1")))
    k = F.col("n_nationkey")
    rep = one_file(v.table(spark, d, "nation"), cat("n_name", F.lit("r"), F.when(k % 3 == 0, "na").otherwise(F.concat(F.lit("chr"), k)), F.lit("t"), F.concat(F.lit("GB"), k), F.lit("="), F.concat(F.lit("NC"), k)))
    return K.gff_to_bed(R.parse_gff3(gff), R.parse_assembly_report(rep), ["Brand#1", "Brand#2", "Brand#3"])


@query("dbsnp_id_index", sql("", """, e AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0)
SELECT id, 'rs' || k AS rs, CAST(k % 29 + 1 AS VARCHAR) AS chrom, k * 10 AS pos, 'A' AS ref, 'G' AS alt FROM (SELECT k, unnest(['rs' || k, 'ss' || k, 'ss9' || k]) AS id FROM e)"""))
def _(spark, d):
    k = F.col("p_partkey")
    text = F.concat_ws(
        "\n", F.concat(F.lit("rs"), k, F.lit(" | Bos taurus | 9913 | "), F.when(k % 7 == 0, "in-del").otherwise("snp"), F.lit(" | genotype=NO")),
        F.concat(F.lit("ss"), k, F.lit(" | X | y")), F.concat(F.lit("ss9"), k, F.lit(" | X | z")), F.lit("SNP | alleles='A/G' | het=? | se(het)=?"),
        F.lit("CTG | assembly=Other_1 | chr=9 | chr-pos=5"),
        F.when(k % 5 != 0, F.concat(F.lit("CTG | assembly=Mine_2 | chr="), k % 29 + 1, F.lit(" | chr-pos="), k * 10)))
    e = R.parse_dbsnp_flat(one_file(v.table(spark, d, "part"), text), "Mine_2")
    return R.dbsnp_id_index(e).select("id", "rs", "chrom", "pos", "ref", "alt")


@query("parse_idxstats", sql("idxstats", "SELECT sample, contig, len, nreads FROM idxstats WHERE contig <> 'chr1' AND len >= 160000000"))
def _(spark, d):
    t = v.idxstats(spark, d)
    lines = t.select(cat("contig", "len", "nreads", F.lit("0")).alias("value"), F.concat(F.lit("/x/"), "sample", F.lit(".idxstats")).alias("file"))
    return R.parse_idxstats(lines, 160_000_000, exclude=["chr1"])


@query("flagstat_table", sql("", """, s AS (SELECT c_nationkey AS k, count(*) AS n, count(*) FILTER (c_acctbal > 5000) AS m FROM customer GROUP BY 1)
SELECT 'N' || k AS sample, n AS total, m AS mapped FROM s"""))
def _(spark, d):
    c = v.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 5000).alias("m"))
    rows = F.array(F.concat("n", F.lit(" + 0 in total (QC-passed reads + QC-failed reads)")), F.concat("m", F.lit(" + 0 mapped ("), F.round(100 * F.col("m") / F.col("n"), 2), F.lit("% : N/A)")))
    lines = c.select(F.explode(rows).alias("value"), F.concat(F.lit("d/N"), "c_nationkey", F.lit(".flagstats")).alias("file"))
    return R.flagstat_table(R.parse_flagstat(lines), ["total", "mapped"])


def dstat_lines(spark, d):
    p = v.table(spark, d, "part")
    k = F.col("p_partkey")
    pop = lambda i: F.concat(F.lit("P"), (k + i * 3) % 11)
    val = F.round((F.col("p_size") - 25) / 100.0, 4)
    a = one_file(p, cat(pop(0), pop(1), pop(2), F.lit("1"), F.lit("2"), val, F.lit("0"), F.lit("0"), val * 50), k + 1, "a.tsv")
    b = one_file(p, cat(pop(0), pop(1), pop(2), F.lit("O"), val, val * 50, F.lit("1"), F.lit("2"), F.lit("3")), k + 1, "b.tsv")
    r = v.table(spark, d, "region").filter("r_regionkey = 0")
    ha = one_file(r, cat(*[F.lit(x) for x in ("H1", "H2", "H3", "ABBA", "BABA", "D", "j", "se", "Z")]), F.lit(0), "a.tsv")
    hb = one_file(r, cat(*[F.lit(x) for x in ("P1", "P2", "P3", "P4", "D", "Z", "BABA", "ABBA", "n")]), F.lit(0), "b.tsv")
    return a.unionByName(b).unionByName(ha).unionByName(hb)


@query("parse_dstats", sql("", f"""SELECT 'P' || (p_partkey % 11) AS p1, 'P' || ((p_partkey + 3) % 11) AS p2, 'P' || ((p_partkey + 6) % 11) AS p3, {rnd('s * round((p_size - 25) / 100.0, 4)')} AS d, {rnd('s * round((p_size - 25) / 100.0, 4) * 50')} AS z
FROM part, (VALUES (1), (-1)) t(s)"""))
def _(spark, d):
    t = R.parse_dstats(dstat_lines(spark, d))
    return t.select("p1", "p2", "p3", r6(F.col("d")).alias("d"), r6(F.col("z")).alias("z"))


@query("methylkit_round_trip", sql("meth", "SELECT CAST(chrom AS VARCHAR) AS chrom, \"start\", \"end\", strand, c + mc AS depth, c, mc FROM meth"))
def _(spark, d):
    lines = K.methylkit_lines(v.meth(spark, d)).select(F.col("line").alias("value"))
    return R.parse_methylkit(lines)


@query("to_methylkit", sql("meth", """SELECT context, chrom || '.' || ("start" + 1) || chr(9) || chrom || chr(9) || ("start" + 1) || chr(9) || CASE strand WHEN '-' THEN 'R' ELSE 'F' END || chr(9) || (c + mc) || chr(9) || printf('%.2f', 100.0 * mc / (c + mc)) || chr(9) || printf('%.2f', 100.0 * c / (c + mc)) AS line FROM meth"""))
def _(spark, d):
    return K.methylkit_lines(v.meth(spark, d)).select("context", "line")


@query("to_pileometh", sql("meth", """SELECT context, chrom || chr(9) || "start" || chr(9) || "end" || chr(9) || (100 * mc // (c + mc)) || chr(9) || mc || chr(9) || c AS line FROM meth"""))
def _(spark, d):
    return K.pileometh_lines(v.meth(spark, d)).select("context", "line")


@query("pileometh_round_trip", sql("meth", 'SELECT CAST(chrom AS VARCHAR) AS chrom, "start", "end", mc, c FROM meth'))
def _(spark, d):
    return R.parse_pileometh(K.pileometh_lines(v.meth(spark, d)).select(F.col("line").alias("value")))


@query("context_class", sql("reads", """, t AS (SELECT substr(seq, i, 3) AS k FROM (SELECT seq, unnest(range(1, length(seq) - 1)) AS i FROM reads))
SELECT CASE WHEN k[1:2] = 'CG' THEN 'CpG' WHEN k[3] = 'G' THEN 'CHG' ELSE 'CHH' END AS context, count(*) AS n FROM t WHERE k[1] = 'C' GROUP BY 1"""))
def _(spark, d):
    from genespark.functions.sequence import kmers
    t = v.reads(spark, d).select(F.explode(kmers(F.col("seq"), 3)).alias("k"))
    return t.withColumn("context", K.context_class(F.col("k"))).filter("context is not null").groupBy("context").agg(F.count(F.lit(1)).alias("n"))


STRANDS = """, p AS (SELECT p_partkey % 5 AS chrom, p_partkey * 10 AS s, CASE p_partkey % 3 WHEN 0 THEN 'CpG' WHEN 1 THEN 'CHG' ELSE 'CHH' END AS context, p_size % 3 AS pc, p_size % 4 AS pmc, p_size % 5 AS nc, p_size % 7 AS nmc FROM part)"""


def strand_pairs(spark, d):
    k = F.col("p_partkey")
    ctx = F.when(k % 3 == 0, "CpG").when(k % 3 == 1, "CHG").otherwise("CHH")
    s = F.col("p_size")
    return v.table(spark, d, "part").select((k % 5).alias("chrom"), (k * 10).alias("start"), (k * 10 + 1).alias("end"), ctx.alias("context"), (s % 3).alias("pc"), (s % 4).alias("pmc"), (s % 5).alias("nc"), (s % 7).alias("nmc"))


@query("both_strands", sql("", STRANDS + """
SELECT chrom, context, '+' AS strand, s AS "start", pc AS c, pmc AS mc, s + 1 AS "end" FROM p WHERE pc + pmc > 0 UNION ALL
SELECT chrom, context, '-', s + o, nc, nmc, s + o + 1 FROM (SELECT *, CASE context WHEN 'CpG' THEN 1 WHEN 'CHG' THEN 2 ELSE 0 END AS o FROM p) WHERE nc + nmc > 0 AND (context <> 'CHH' OR pc + pmc = 0)"""))
def _(spark, d):
    return K.both_strands(strand_pairs(spark, d))


@query("merged_strands", sql("", STRANDS + """, m AS (SELECT chrom, s AS "start", s + 1 AS "end", context, CASE WHEN context <> 'CHH' THEN pc + nc WHEN pc + pmc > 0 THEN pc ELSE nc END AS c, CASE WHEN context <> 'CHH' THEN pmc + nmc WHEN pc + pmc > 0 THEN pmc ELSE nmc END AS mc FROM p)
SELECT * FROM m WHERE c + mc > 0"""))
def _(spark, d):
    return K.merged_strands(strand_pairs(spark, d))


@query("parse_methlist", sql("meth", 'SELECT CAST(chrom AS VARCHAR) AS chrom, "start", "end", strand, c + mc AS depth, c, mc, context FROM meth'))
def _(spark, d):
    m = v.meth(spark, d)
    return R.parse_methlist(one_file(m, cat("chrom", "start", "end", "strand", F.col("c") + F.col("mc"), "c", "mc", "context")))


@query("parse_dss", sql("meth", f"""SELECT chrom, "start" + 1 AS pos, c + mc AS n, mc AS x, {rnd('mc / (c + mc)')} AS level FROM meth WHERE chrom < 5"""))
def _(spark, d):
    m = v.meth(spark, d)
    name = F.when(F.col("chrom") == 5, "chrX").otherwise(F.concat(F.lit("chr"), "chrom"))
    return R.parse_dss(one_file(m, cat(name, F.col("start") + 1, F.col("c") + F.col("mc"), "mc"))).withColumn("level", r6(F.col("level")))


@query("parse_typed_columns", sql("", "SELECT CAST(p_size AS BIGINT) AS a, p_retailprice AS b, p_brand AS c FROM part WHERE p_partkey >= 3"))
def _(spark, d):
    p = v.table(spark, d, "part")
    lines = one_file(p, F.concat_ws(" \t", "p_partkey", "p_brand", "p_size", F.col("p_retailprice").cast("string")), F.col("p_partkey"))
    return R.parse_typed_columns(lines, {"a": (2, "long"), "b": (3, "double"), "c": (1, "string")}, skip=3)


@query("parse_evec", sql("", f"SELECT 'S' || vec_id AS sample, 'L' || label AS grp, {rnd('CAST(embedding[1] AS DOUBLE)', 7)} AS pc1, {rnd('CAST(embedding[3] AS DOUBLE)', 7)} AS pc3 FROM embeddings"))
def _(spark, d):
    e = v.table(spark, d, "embeddings")
    row = F.concat_ws("  ", F.lit(""), F.concat(F.lit("S"), "vec_id"), F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 7).cast("string")), " "), F.concat(F.lit("L"), "label"))
    head = one_file(v.table(spark, d, "region").filter("r_regionkey = 0"), F.lit("  #eigvals: 3.1 2.0"))
    t = R.parse_evec(head.unionByName(one_file(e, row)))
    return t.select("sample", "grp", r6(F.col("coords")[0], 7).alias("pc1"), r6(F.col("coords")[2], 7).alias("pc3"))


@query("parse_segments", sql("", """SELECT CAST(p_size AS INTEGER) AS tree, CAST(p_partkey % 5 AS VARCHAR) AS chrom, p_partkey * 10 AS "start", p_partkey * 10 + 9 AS "end", p_retailprice AS score FROM part"""))
def _(spark, d):
    k = F.col("p_partkey")
    line = F.concat_ws(" ", F.concat(F.lit("cactus"), "p_size"), F.concat(F.lit("chr"), k % 5, F.lit(":")), k * 10, F.lit("-"), k * 10 + 9, F.lit("length: 10"), F.concat(F.lit("score="), F.col("p_retailprice").cast("string")))
    p = v.table(spark, d, "part")
    return R.parse_segments(one_file(p, line).unionByName(one_file(p, F.concat(F.lit("# "), "p_name"))))


@query("parse_hist", sql("", "SELECT p_partkey AS value, CAST(p_size AS BIGINT) AS n FROM part"))
def _(spark, d):
    p = v.table(spark, d, "part")
    fits = one_file(v.table(spark, d, "region"), F.concat(F.lit("#m;a="), "r_regionkey"), F.col("r_regionkey"))
    return R.parse_hist(fits.unionByName(one_file(p, F.col("p_size").cast("string"), F.col("p_partkey") + 5)))


@query("parse_hist_fits", sql("", "SELECT 'm' || r_regionkey AS model, 'a' AS name, CAST(r_regionkey AS DOUBLE) AS value FROM region UNION ALL SELECT 'm' || r_regionkey, 'b', r_regionkey + 0.5 FROM region"))
def _(spark, d):
    k = F.col("r_regionkey")
    return R.parse_hist_fits(one_file(v.table(spark, d, "region"), F.concat(F.lit("#m"), k, F.lit(";a="), k, F.lit(";b="), k + 0.5), k))


@query("parse_hybrid_blocks", sql("", """SELECT printf('%06d', s_suppkey) AS sample, CAST(CASE WHEN s_suppkey % 29 + 1 > 22 THEN s_suppkey % 29 + 11 ELSE s_suppkey % 29 + 1 END AS INTEGER) AS chrom, s_suppkey * 100 AS "start", s_suppkey * 100 + 50 AS "end" FROM supplier"""))
def _(spark, d):
    k = F.col("s_suppkey")
    line = cat(F.lit("3"), F.concat(F.lit("id"), F.format_string("%06d", k)), k % 29 + 1, F.lit("p"), k * 100, k * 100 + 50, F.lit("1"))
    return R.parse_hybrid_blocks(one_file(v.table(spark, d, "supplier"), line, k + 1))


@query("parse_nt_pairs", sql("", f"""SELECT 'CTX5p' AS "end", CAST(s_suppkey AS INTEGER) AS pos, p AS pair, (s_suppkey + o) % 7 AS n, {rnd("coalesce((s_suppkey + o) % 7 / nullif(s_suppkey % 7 + (s_suppkey + 1) % 7 + (s_suppkey + 2) % 7, 0), 0)")} AS share FROM supplier, (VALUES ('AA', 0), ('AC', 1), ('AG', 2)) t(p, o)"""))
def _(spark, d):
    k = F.col("s_suppkey")
    head = one_file(v.table(spark, d, "region").filter("r_regionkey = 0"), F.lit("#CTX5p\tpos\tAA\tAC\tAG"))
    body = one_file(v.table(spark, d, "supplier"), cat(F.lit("CTX5p"), k, k % 7, (k + 1) % 7, (k + 2) % 7))
    return R.parse_nt_pairs(head.unionByName(body)).withColumn("share", r6(F.col("share")))


@query("parse_admixture_q", sql("", f"""SELECT 'C' || c_custkey AS sample, k, {rnd('CASE k WHEN 0 THEN a WHEN 1 THEN 0.5 ELSE 0.5 - a END')} AS q, {rnd('CASE k WHEN 0 THEN a WHEN 1 THEN a + 0.5 ELSE 1.0 END')} AS cumulative
FROM (SELECT c_custkey, (c_custkey % 50) / 100.0 AS a FROM customer), (SELECT unnest(range(3)) AS k)"""))
def _(spark, d):
    c = v.table(spark, d, "customer")
    a = (F.col("c_custkey") % 50) / 100.0
    lines = one_file(c, F.concat_ws(" ", a.cast("string"), F.lit("0.5"), F.round(0.5 - a, 2).cast("string")), F.col("c_custkey"))
    ind = c.select(F.col("c_custkey").cast("int").alias("idx"), F.concat(F.lit("C"), "c_custkey").alias("sample"))
    t = R.parse_admixture_q(lines, ind)
    return t.select("sample", F.col("k").cast("long").alias("k"), r6(F.col("q")).alias("q"), r6(F.col("cumulative")).alias("cumulative"))


@query("chrom_codes", sql("", """, c AS (SELECT p_partkey, CASE p_partkey % 31 WHEN 0 THEN 'X' WHEN 30 THEN 'MT' ELSE CAST(p_partkey % 31 AS VARCHAR) END AS chrom FROM part)
SELECT p_partkey, chrom, CASE chrom WHEN 'X' THEN 30 WHEN 'MT' THEN 90 ELSE CAST(chrom AS INTEGER) END AS code, CASE WHEN chrom = 'MT' THEN 'M' WHEN chrom = 'X' THEN NULL WHEN CAST(chrom AS INTEGER) < 23 THEN chrom WHEN chrom = '23' THEN 'X' WHEN chrom = '24' THEN 'Y' END AS name FROM c""".replace("CASE WHEN chrom = 'MT' THEN 'M' WHEN chrom = 'X' THEN NULL WHEN CAST(chrom AS INTEGER) < 23", "CASE WHEN chrom = 'MT' THEN 'M' WHEN chrom = 'X' THEN NULL WHEN TRY_CAST(chrom AS INTEGER) < 23")))
def _(spark, d):
    k = F.col("p_partkey") % 31
    chrom = F.when(k == 0, "X").when(k == 30, "MT").otherwise(k.cast("string"))
    t = v.table(spark, d, "part").select("p_partkey", chrom.alias("chrom"))
    t = t.withColumn("code", coords.chrom_code(F.col("chrom")))
    return t.withColumn("name", coords.chrom_name(F.col("code").cast("string")))


@query("natural_sort_rank", sql("", """SELECT c AS chrom, row_number() OVER (ORDER BY TRY_CAST(c AS INTEGER) NULLS LAST, c) AS place FROM (SELECT DISTINCT CASE WHEN p_partkey % 13 = 0 THEN 'X' WHEN p_partkey % 13 = 1 THEN 'MT' ELSE CAST(p_partkey % 30 AS VARCHAR) END AS c FROM part)"""))
def _(spark, d):
    from pyspark.sql import Window as W
    k = F.col("p_partkey")
    c = F.when(k % 13 == 0, "X").when(k % 13 == 1, "MT").otherwise((k % 30).cast("string"))
    t = v.table(spark, d, "part").select(c.alias("chrom")).distinct()
    return t.withColumn("place", F.row_number().over(W.orderBy(*coords.natural_key(F.col("chrom")))).cast("long"))


@query("version_key", sql("", "SELECT s_suppkey, printf('s%010d.%010d', s_suppkey, s_suppkey % 7) AS key FROM supplier"))
def _(spark, d):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("s"), k, F.lit("."), k % 7)
    return v.table(spark, d, "supplier").select("s_suppkey", coords.version_key(name).alias("key"))


@query("parse_size", sql("", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000 WHEN 2 THEN p_size * 1000000 ELSE p_size * 500 END::BIGINT AS bases FROM part"""))
def _(spark, d):
    k = F.col("p_partkey") % 4
    s = F.col("p_size")
    text = F.when(k == 0, s.cast("string")).when(k == 1, F.concat(s, F.lit("k"))).when(k == 2, F.concat(s, F.lit("Mb"))).otherwise(F.concat((s * 0.5).cast("string"), F.lit("kb")))
    return v.table(spark, d, "part").select("p_partkey", coords.parse_size(text).alias("bases"))


@query("parse_posterior_log", sql("", "SELECT CAST(p_size AS DOUBLE) AS tdiv, p_retailprice AS tiso FROM part"))
def _(spark, d):
    p = v.table(spark, d, "part")
    head = one_file(v.table(spark, d, "region").filter("r_regionkey = 0"), F.lit("state\ttiso\tx\ttdiv"), F.lit(1))
    note = one_file(v.table(spark, d, "region").filter("r_regionkey = 1"), F.lit("# run"), F.lit(0))
    body = one_file(p, cat("p_partkey", F.col("p_retailprice").cast("string"), F.lit("0"), "p_size"), F.col("p_partkey") + 2)
    return R.parse_posterior_log(note.unionByName(head).unionByName(body), ["tdiv", "tiso"]).drop("line_no")


@query("split_fold_tag", sql("reads", "SELECT 'q' || doc_id AS qname, seq AS s1, reverse(seq) AS s2, repeat('I', length(seq)) AS q1, repeat('!', length(seq)) AS q2, doc_id % 2 = 1 AS rev FROM reads"))
def _(spark, d):
    r = v.reads(spark, d)
    n = F.length("seq")
    q = lambda c: F.expr(f"repeat('{c}', length(seq))")
    tag = F.concat(F.lit("XF:Z:"), F.concat_ws("|", "seq", F.reverse("seq"), q("I"), q("!")))
    line = cat(F.concat(F.lit("q"), "doc_id"), F.col("doc_id") % 2 * 16, F.lit("c"), F.lit("5"), F.lit("60"), F.concat(n, F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), F.col("seq"), q("I"), F.lit("NM:i:0"), tag)
    return R.split_fold_tag(R.parse_sam(one_file(r, line))).select("qname", "s1", "s2", "q1", "q2", "rev")


# --- through files --------------------------------------------------------------------------------


def new_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("numbered_gzip_lines", sql("", """SELECT o_orderkey // 4096 AS k, row_number() OVER (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey) - 1 AS line_no, o_orderkey || ' ' || o_orderstatus AS value FROM orders"""))
def _(spark, d):
    # a gzip file for every 4096 keys, all read in one go; numbers start again in each file
    o = v.table(spark, d, "orders").withColumn("k", F.floor(F.col("o_orderkey") / 4096)).repartition("k").sortWithinPartitions("k", "o_orderkey")
    path = new_folder(spark, "numbered")
    o.select("k", F.concat_ws(" ", "o_orderkey", "o_orderstatus").alias("value")).write.partitionBy("k").option("compression", "gzip").text(path)
    t = read_numbered(spark, [path])
    return t.select(F.regexp_extract("file", "/k=([0-9]+)/", 1).cast("long").alias("k"), "line_no", "value")


@query("concatenated_sample_files", sql("idxstats", "SELECT sample, contig, len, nreads FROM idxstats"))
def _(spark, d):
    # one file a sample, read together; the sample is the name of the file's folder
    path = new_folder(spark, "samples")
    lines = v.idxstats(spark, d).select("sample", cat("contig", "len", "nreads", F.lit("0")).alias("value"))
    lines.repartition("sample").write.partitionBy("sample").text(path)
    t = read_lines(spark, [path])
    return R.parse_idxstats(t.withColumn("file", F.concat(F.regexp_extract("file", "/sample=([^/]+)/", 1), F.lit(".idxstats"))))


@query("fai_file", sql("", "SELECT CAST(p_partkey AS VARCHAR) AS chrom, CAST(p_size * 1000 AS BIGINT) AS length FROM part"))
def _(spark, d):
    path = new_folder(spark, "fai")
    p = v.table(spark, d, "part")
    K.write_lines(p.select("p_partkey", cat(F.concat(F.lit("chr"), "p_partkey"), F.col("p_size") * 1000, F.lit("5"), F.lit("60"), F.lit("61")).alias("line")), path, ["p_partkey"])
    return R.parse_fai(read_lines(spark, [path]))


@query("report_file", sql("", "SELECT p_partkey, p_brand, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part"))
def _(spark, d):
    path = new_folder(spark, "report")
    K.write_report(v.table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), path)
    return spark.read.csv(path, sep="\t", header=True, schema="p_partkey long, p_brand string, p_size long, p_retailprice double")
