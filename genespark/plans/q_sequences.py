"""Sequence composition, k-mers, lengths, duplicates and sampling on the documents as reads."""

from pyspark.sql import functions as F

from genespark.functions import sequence as S
from genespark.operators import sequences as Q
from genespark.plans import views as v
from genespark.plans.registry import ORACLES, query
from genespark.plans.views import r6, rnd, sql
from genespark.sources import formats as R

RC = "reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))"


def with_qual(spark, d):
    """Reads with a quality string that depends on the base and on the document."""
    t = v.reads(spark, d)
    q = F.when(F.col("doc_id") % 3 == 0, F.translate("seq", "ACGT", "5?I!")).when(F.col("doc_id") % 3 == 1, F.translate("seq", "ACGT", "?5!I")).otherwise(F.translate("seq", "ACGT", "IIII"))
    return t.withColumn("qual", q).withColumn("comment", F.concat(F.lit("DIST="), F.length("seq") % 40)).withColumn("line_no", F.col("doc_id"))


QUAL = """, q AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN translate(seq, 'ACGT', '5?I!') WHEN 1 THEN translate(seq, 'ACGT', '?5!I') ELSE translate(seq, 'ACGT', 'IIII') END AS qual FROM reads)"""


def alignments(spark, d):
    """Line items as alignment rows: flag, mapping quality, template length, a read of varying length."""
    t = v.table(spark, d, "lineitem")
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    flag = F.element_at(F.array(*[F.lit(x) for x in (0, 4, 16, 99, 147, 83, 163, 73, 1024, 256, 512, 2048)]), (k % 12 + 1).cast("int"))
    return t.select(
        F.concat_ws(":", F.lit("m:1:f:1"), F.col("l_suppkey"), F.col("l_partkey"), F.lit("0"), F.col("l_linenumber"), (F.col("l_quantity").cast("int") % 4 * 10 + 20)).alias("qname"),
        flag.alias("flag"), F.concat(F.lit("chr"), k % 5 + 1).alias("rname"), (F.col("l_extendedprice").cast("long")).alias("pos"),
        (F.col("l_tax") * 500).cast("int").alias("mapq"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") * 10).otherwise(F.col("l_quantity") * -10).cast("int").alias("isize"),
        F.expr("repeat('A', int(l_quantity))").alias("seq"),
    )


ALN = """aln AS (SELECT 'm:1:f:1:' || l_suppkey || ':' || l_partkey || ':0' AS rid, CAST(l_quantity AS INTEGER) % 4 * 10 + 20 AS sublen,
 ([0, 4, 16, 99, 147, 83, 163, 73, 1024, 256, 512, 2048])[CAST((l_orderkey * 7 + l_linenumber) % 12 + 1 AS INTEGER)] AS flag, 'chr' || ((l_orderkey * 7 + l_linenumber) % 5 + 1) AS rname,
 CAST(trunc(l_tax * 500) AS INTEGER) AS mapq, CAST(l_quantity AS INTEGER) * CASE WHEN l_linenumber % 2 = 0 THEN 10 ELSE -10 END AS isize, CAST(l_quantity AS INTEGER) AS len FROM lineitem)"""


@query("reverse_complement", sql("reads", f"SELECT name, {RC} AS rc FROM reads"))
def _(spark, d):
    return v.reads(spark, d).select("name", S.reverse_complement(F.col("seq")).alias("rc"))


_bs = "regexp_replace(regexp_replace(regexp_replace({}, 'CG', 'cG', 'g'), 'GC', 'Gc', 'g'), 'C', 'T', 'g')"


@query("bisulfite_convert", sql("reads", f"""SELECT name || '|BS|F' AS name, upper({_bs.format('seq')}) AS seq FROM reads
UNION ALL SELECT name || '|BS|R', upper({_bs.format(RC)}) FROM reads"""))
def _(spark, d):
    return Q.bisulfite_records(v.reads(spark, d))


@query("unique_kmers", sql("reads", "SELECT name, count(DISTINCT substr(seq, i, 5)) AS n FROM (SELECT name, seq, unnest(range(1, length(seq) - 3)) AS i FROM reads WHERE length(seq) >= 5) GROUP BY name UNION ALL SELECT name, 0 FROM reads WHERE length(seq) < 5"))
def _(spark, d):
    return v.reads(spark, d).select("name", S.unique_kmers(F.col("seq"), 5).cast("long").alias("n"))


@query("kmer_counts", sql("reads", "SELECT substr(seq, i, 4) AS kmer, count(*) AS n FROM (SELECT seq, unnest(range(1, length(seq) - 2)) AS i FROM reads) GROUP BY 1"))
def _(spark, d):
    return Q.kmer_counts(v.reads(spark, d), 4)


@query("kmer_entropy", sql("reads", f"""SELECT name, round(-sum(p * ln(p)), 6) + 0.0 AS entropy FROM (SELECT name, n / sum(n) OVER (PARTITION BY name) AS p FROM (
SELECT name, substr(seq, i, 3) AS k, count(*) AS n FROM (SELECT name, seq, unnest(range(1, length(seq) - 1)) AS i FROM reads) GROUP BY 1, 2)) GROUP BY name"""))
def _(spark, d):
    return Q.kmer_entropy(v.reads(spark, d)).select("name", r6(F.col("entropy")).alias("entropy"))


@query("conditional_entropy", sql("reads", f""", di AS (SELECT name, substr(seq, i, 2) AS k, any_value(length(seq)) AS l, any_value(length(seq) - length(replace(seq, substr(seq, i, 1), ''))) AS ny, count(*) AS n
 FROM (SELECT name, seq, unnest(range(1, length(seq))) AS i FROM reads) GROUP BY 1, 2)
SELECT r.name, round(coalesce(c, 0), 6) + 0.0 AS centropy FROM reads r LEFT JOIN (SELECT name, -sum(ny / l * (n / (l - 1)) * ln(n / (l - 1))) AS c FROM di GROUP BY name) USING (name)"""))
def _(spark, d):
    return Q.conditional_entropy(v.reads(spark, d)).select("name", r6(F.col("centropy")).alias("centropy"))


@query("sequence_content", sql("", f"""SELECT doc_id, length(regexp_replace(text, '[^CG]', '', 'g')) AS gc, length(text) - length(replace(text, 'CG', '')) AS cpg2,
 length(text) - length(regexp_replace(text, '[^ACGT]', '', 'g')) AS masked FROM documents"""))
def _(spark, d):
    t = v.table(spark, d, "documents")
    c = F.col("text")
    return t.select("doc_id", S.base_count(c, "CG").cast("long").alias("gc"), (2 * S.cpg_count(c)).cast("long").alias("cpg2"), S.masked_count(c).cast("long").alias("masked"))


@query("nucleotide_composition", sql("reads", f"""SELECT {', '.join(f"CAST(sum(length(seq) - length(replace(seq, '{b}', ''))) AS BIGINT) AS {b}" for b in 'ACGTN')}, CAST(sum(length(seq)) AS BIGINT) AS total,
 {rnd("sum(length(regexp_replace(seq, '[^CG]', '', 'g'))) / sum(length(seq))")} AS gc FROM reads"""))
def _(spark, d):
    return Q.nucleotide_composition(v.reads(spark, d)).withColumn("gc", r6(F.col("gc")))


@query("quality_histogram", sql("reads", f"{QUAL} SELECT ch AS q, count(*) AS n, ascii(ch) AS code FROM (SELECT unnest(string_split(qual, '')) AS ch FROM q) WHERE ch <> '' GROUP BY ch"))
def _(spark, d):
    return Q.quality_histogram(with_qual(spark, d))


@query("read_length_histogram", sql("reads", "SELECT r.range AS length, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, (SELECT max(length(seq)) FROM reads) + 1)) AS range) r LEFT JOIN (SELECT length(seq) AS l, count(*) AS n FROM reads GROUP BY 1) ON l = r.range"))
def _(spark, d):
    return Q.length_histogram(v.reads(spark, d), dense=True)


@query("alignment_length_histogram", f"""WITH {ALN} SELECT CAST(CASE WHEN flag & 1 <> 0 THEN abs(isize) ELSE len END AS BIGINT) AS length, count(*) AS n FROM aln
WHERE flag & (256 + 512 + 2048 + 1024 + 4) = 0 AND (flag & 1 = 0 OR (flag & 128 = 0 AND flag & 10 = 2 AND isize <> 0)) GROUP BY 1""")
def _(spark, d):
    return Q.alignment_length_histogram(alignments(spark, d), ignore_duplicates=True)


@query("flag_mask_filter", f"WITH {ALN} SELECT flag, count(*) AS n FROM aln WHERE flag & 3844 = 0 AND mapq >= 15 GROUP BY flag")
def _(spark, d):
    return Q.flag_mask_filter(alignments(spark, d), 3844, 15).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("strict_pairs", f"WITH {ALN} SELECT rname, flag, count(*) AS n FROM aln WHERE flag IN (99, 147, 83, 163) GROUP BY 1, 2")
def _(spark, d):
    return Q.strict_pairs(alignments(spark, d)).groupBy("rname", "flag").agg(F.count(F.lit(1)).alias("n"))


@query("subread_collate", f"WITH {ALN} SELECT rid AS read_id, sublen AS length, count(*) AS n FROM aln WHERE flag & 2820 = 0 AND mapq >= 25 GROUP BY 1, 2")
def _(spark, d):
    return Q.subread_collate(alignments(spark, d))


@query("subread_table", f"WITH {ALN} SELECT rid AS read_id, {', '.join(f'count(*) FILTER (sublen = {x}) AS n{x}' for x in (50, 40, 30, 20))} FROM aln WHERE flag & 2820 = 0 AND mapq >= 25 GROUP BY 1")
def _(spark, d):
    t = Q.subread_table(Q.subread_collate(alignments(spark, d)), [20, 30, 40, 50])
    return t.toDF("read_id", *[f"n{c}" for c in t.columns[1:]])


@query("subread_proportion", f"WITH {ALN}, c AS (SELECT rid, sublen, count(*) AS n FROM aln WHERE flag & 2820 = 0 AND mapq >= 25 GROUP BY 1, 2) SELECT sublen AS length, {rnd('avg(n) / 10')} AS proportion, count(*) AS reads FROM c GROUP BY 1")
def _(spark, d):
    return Q.subread_proportion(Q.subread_collate(alignments(spark, d)), 10).withColumn("proportion", r6(F.col("proportion")))


@query("rmdup_exact", sql("reads", f"""{QUAL}, b AS (SELECT seq, i, max(substr(qual, i, 1)) AS ch FROM (SELECT seq, qual, unnest(range(1, length(seq) + 1)) AS i FROM q) GROUP BY 1, 2),
m AS (SELECT seq, string_agg(ch, '' ORDER BY i) AS qual FROM b GROUP BY seq)
SELECT min_by(name, doc_id) AS name, min_by('DIST=' || (length(seq) % 40), doc_id) AS comment, seq, m.qual, count(*) AS copies FROM q JOIN m USING (seq) GROUP BY seq, m.qual"""))
def _(spark, d):
    return Q.rmdup_exact(with_qual(spark, d))


@query("rmdup_totals", sql("reads", 'SELECT count(*) AS total, count(DISTINCT seq) AS "unique", count(*) - count(DISTINCT seq) AS duplicates FROM reads'))
def _(spark, d):
    return Q.rmdup_totals(Q.rmdup_exact(with_qual(spark, d)))


def mates(spark, d):
    """Documents as mates: document k gives mate 1, its reverse complement mate 2; some carry the hairpin."""
    t = v.reads(spark, d)
    k = F.col("doc_id") % 31
    cut = lambda s: F.when(k < 29, F.concat(F.substring(F.lit(s), F.lit(1), k.cast("int")), F.substring(F.lit(s), k.cast("int") + 2, F.lit(40)))).otherwise("")
    a = t.select(F.concat("name", F.lit("/1 x")).alias("name"), F.concat(F.substring("seq", F.lit(1), F.lit(1 << 30)), cut(Q.HAIRPIN)).alias("seq"))
    b = t.select(F.concat("name", F.lit("/2")).alias("name"), S.reverse_complement(F.col("seq")).alias("seq"))
    return Q.mate_join(a, b)


MATES = f""", mates AS (SELECT name, doc_id, seq || CASE WHEN doc_id % 31 < 29 THEN substr('{Q.HAIRPIN}', 1, CAST(doc_id % 31 AS INTEGER)) || substr('{Q.HAIRPIN}', CAST(doc_id % 31 AS INTEGER) + 2, 40) ELSE '' END AS seq1, {RC} AS seq2 FROM reads)"""


@query("mate_join", sql("reads", f"{MATES} SELECT name, length(seq1) AS l1, length(seq2) AS l2 FROM mates"))
def _(spark, d):
    return mates(spark, d).select("name", F.length("seq1").cast("long").alias("l1"), F.length("seq2").cast("long").alias("l2"))


_near = lambda s: "(" + ", ".join(f"'{x}'" for x in Q.near_kmers(s, 12)) + ")"


@query("hairpin_kmer_hits", sql("reads", f"""{MATES}, h AS (SELECT name, count(*) FILTER (substr(seq1, i, 12) IN {_near(Q.HAIRPIN)} AND i <= length(seq1) - 11) AS a, count(*) FILTER (substr(seq2, i, 12) IN {_near(Q.RHAIRPIN)} AND i <= length(seq2) - 11) AS b
 FROM (SELECT *, unnest(range(1, greatest(length(seq1), length(seq2)) + 1)) AS i FROM mates) GROUP BY name) SELECT name, greatest(a, b) AS hits FROM h"""))
def _(spark, d):
    m = Q.hairpin_kmer_hits(mates(spark, d), 12)
    return m.withColumn("hits", F.col("hits").cast("long"))


_del = {Q.HAIRPIN[:i] + Q.HAIRPIN[i + 1:]: i for i in range(29)}


@query("hairpin_deletions", sql("reads", f"""{MATES}, del(k, p) AS (VALUES {', '.join(f"('{s}', {i})" for s, i in _del.items())})
SELECT name, arg_min(p, i) AS at FROM (SELECT name, unnest(range(1, length(seq1) - 26)) AS i, seq1 FROM mates) m JOIN del ON substr(seq1, i, 28) = k GROUP BY name HAVING arg_min(p, i) NOT IN (0, 28)"""))
def _(spark, d):
    return Q.hairpin_deletions(mates(spark, d))


TILES = ", tiles AS (SELECT name, i, substr(seq, i * 121 + 1, 121) AS seq FROM (SELECT name, seq, unnest(range(0, (length(seq) + 120) // 121)) AS i FROM reads))"


def tiles(spark, d):
    t = v.reads(spark, d).select("name", "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / 121).cast("int"))).alias("i"))
    return t.select("name", "i", F.substring("seq", F.col("i") * 121 + 1, F.lit(121)).alias("seq"))


_pr = ["substr(seq, 1, 60)", "substr(seq, 31, 61)", "substr(seq, 31, 30) || 'A' || substr(seq, 62, 30)", "substr(seq, 62, 60)"]


@query("probe_metrics", sql("reads", f"""{TILES}, p AS ({' UNION ALL '.join(f"SELECT name, i, {j} AS j, {e} AS p FROM tiles" for j, e in enumerate(_pr))}),
k AS (SELECT name, i, j, substr(p, x, 3) AS kk, count(*) AS n FROM (SELECT *, unnest(range(1, length(p) - 1)) AS x FROM p) GROUP BY 1, 2, 3, 4),
e AS (SELECT name, i, j, -sum(n / t * ln(n / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY name, i, j) AS t FROM k) GROUP BY 1, 2, 3),
g AS (SELECT name, i, CASE WHEN min(length(p)) > 0 THEN avg(length(regexp_replace(p, '[^CG]', '', 'g')) / nullif(length(p), 0)) END AS gc, avg((length(p) - length(replace(p, 'CG', ''))) / 2) AS cpg FROM p GROUP BY 1, 2)
SELECT name, CAST(i AS INTEGER) AS i, {rnd('min(h)', 5)} AS entropy, {rnd('any_value(gc)')} AS gc, {rnd('any_value(cpg)')} AS cpg FROM g LEFT JOIN e USING (name, i) GROUP BY 1, 2"""))
def _(spark, d):
    t = Q.probe_metrics(tiles(spark, d).withColumn("alt", F.lit("A")), 60)
    return t.select("name", "i", r6(F.col("entropy"), 5).alias("entropy"), r6(F.col("gc")).alias("gc"), r6(F.col("cpg")).alias("cpg"))


@query("unmasked_windows", sql("", """, t AS (SELECT doc_id, i, substr(text, i * 121 + 1, 121) AS seq FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 120) // 121)) AS i FROM documents))
SELECT doc_id, i FROM t WHERE length(regexp_replace(seq, '[^ACGT]', '', 'g')) = 2"""))
def _(spark, d):
    t = v.table(spark, d, "documents").filter("length(text) > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 121).cast("int"))).alias("i"))
    t = t.select("doc_id", F.col("i").cast("long").alias("i"), F.substring("text", F.col("i") * 121 + 1, F.lit(121)).alias("seq"))
    return Q.unmasked_windows(t, 2).select("doc_id", "i")


@query("palindrome_clip", sql("reads", f""", m AS (SELECT name, seq, {RC} AS rc, unnest(range(1, length(seq) // 2 + 1)) AS i FROM reads),
n AS (SELECT r.name, coalesce(min(i) FILTER (substr(m.seq, i, 1) <> substr(m.rc, i, 1)) - 1, any_value(length(r.seq) // 2)) AS n FROM reads r LEFT JOIN m USING (name) GROUP BY r.name)
SELECT r.name, CASE WHEN n >= 2 AND n < length(seq) // 2 THEN substr(seq, 1, length(seq) - n) ELSE seq END AS seq FROM reads r JOIN n USING (name)"""))
def _(spark, d):
    return v.reads(spark, d).select("name", S.palindrome_clip(F.col("seq"), 2).alias("seq"))


@query("cpg_islands", sql("reads", """, b AS (SELECT name, i, substr(seq, i + 1, 1) AS b, substr(seq, i + 2, 1) AS nx FROM (SELECT name, seq, unnest(range(0, length(seq))) AS i FROM reads)),
w AS (SELECT name, i, sum((b = 'C')::INT) OVER f AS c, sum((b = 'G')::INT) OVER f AS g, sum((b = 'C' AND nx = 'G')::INT) OVER e AS cg, count(*) OVER f AS n FROM b
 WINDOW f AS (PARTITION BY name ORDER BY i ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING), e AS (PARTITION BY name ORDER BY i ROWS BETWEEN CURRENT ROW AND 98 FOLLOWING)),
x AS (SELECT name, i, i - row_number() OVER (PARTITION BY name ORDER BY i) AS r FROM w WHERE n = 100 AND c + g > 50 AND cg > 0 AND cg / (c * g) > 0.006)
SELECT name, min(i) AS "start", max(i) + 100 AS "end" FROM x GROUP BY name, r HAVING max(i) + 100 - min(i) >= 120"""))
def _(spark, d):
    return Q.cpg_islands(v.reads(spark, d), least=120, size=2000)


def contig_lines(spark, d):
    """The texts as FASTA lines of two files, 50 letters a line."""
    r = v.reads(spark, d)
    body = F.split(F.regexp_replace("seq", "(.{50})", "$1\n"), "\n")
    t = r.select("doc_id", F.posexplode(F.concat(F.array(F.concat(F.lit(">"), "name", F.lit(" a contig"))), body)).alias("i", "value"))
    return t.select("value", F.concat(F.lit("f"), F.col("doc_id") % 2).alias("file"), (F.col("doc_id") * 1_000_000 + F.col("i")).alias("line_no"))


@query("fasta_pieces", sql("reads", """, k AS (SELECT name, seq, unnest(range(0, (length(seq) - 1) // 1000 + 1)) * 1000 AS "offset" FROM reads)
SELECT name, "offset", substr(seq, greatest("offset" - 2, 0) + 1, CASE WHEN "offset" = 0 THEN 1002 ELSE 1004 END) AS piece FROM k"""))
def _(spark, d):
    return R.fasta_pieces(contig_lines(spark, d), size=1000, before=2, after=2)


@query("cpg_islands_of_pieces", ORACLES["cpg_islands"])
def _(spark, d):
    return Q.cpg_islands(R.fasta_pieces(contig_lines(spark, d), size=2000, after=99), least=120, size=2000)


ENZ = [("e1", "GAAT", 1), ("e2", "TTA", 0), ("e3", "CAG", 2)]


@query("restriction_fragments", sql("reads", """, e(j, nm, m, cut) AS (VALUES (0, 'e1', 'GAAT', 1), (1, 'e2', 'TTA', 0), (2, 'e3', 'CAG', 2)),
p AS (SELECT name, seq, unnest(range(0, length(seq))) AS i FROM reads),
h AS (SELECT p.name, i, j, nm, cut FROM p JOIN e ON substr(seq, i + 1, length(m)) = m),
l AS (SELECT *, lag(j) OVER w AS pj, lag(i) OVER w AS pi, lag(nm) OVER w AS pn, lag(cut) OVER w AS pc FROM h WINDOW w AS (PARTITION BY name ORDER BY i, j))
SELECT name, pi + pc AS "start", i + cut + 1 AS "end", pn AS "left", nm AS "right", i + cut - pi - pc AS length FROM l WHERE pj <> j AND i + cut - pi - pc > 20 AND i + cut - pi - pc < 200"""))
def _(spark, d):
    return Q.restriction_fragments(v.reads(spark, d), ENZ, 20, 200, size=1500)


@query("masked_runs", sql("", f""", s AS (SELECT doc_id, regexp_replace(translate(text, '{v.LETTERS}', '{v.MASKED}'), '[^acgtACGT]', '', 'g') AS seq FROM documents),
b AS (SELECT doc_id, i, substr(seq, i + 1, 1) AS b FROM (SELECT doc_id, seq, unnest(range(0, length(seq))) AS i FROM s)),
x AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM b WHERE b = lower(b))
SELECT 'r' || doc_id AS name, min(i) AS "start", max(i) + 1 AS "end" FROM x GROUP BY doc_id, r"""))
def _(spark, d):
    t = v.table(spark, d, "documents").select(F.concat(F.lit("r"), "doc_id").alias("name"), F.regexp_replace(F.translate("text", v.LETTERS, v.MASKED), "[^acgtACGT]", "").alias("seq"))
    return Q.masked_runs(t, size=700)


@query("fasta_region", sql("reads", "SELECT name, substr(seq, 11, 40) AS part FROM reads"))
def _(spark, d):
    return v.reads(spark, d).select("name", S.region(F.col("seq"), 11, 50).alias("part"))


@query("remove_region", sql("reads", "SELECT name, substr(seq, 1, 10) || substr(seq, 31) AS seq FROM reads"))
def _(spark, d):
    return v.reads(spark, d).select("name", S.without_region(F.col("seq"), 10, 30).alias("seq"))


@query("sample_exact_fraction")
def _(spark, d):
    return Q.sample_exact_fraction(v.sites(spark, d), 0.3)


@query("sample_exact_fraction_size", sql("sites", "SELECT CAST(floor(count(*) * 0.3) AS BIGINT) AS n, CAST(floor(count(*) * 0.3) AS BIGINT) AS ids FROM sites"))
def _(spark, d):
    return Q.sample_exact_fraction(v.sites(spark, d), 0.3).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("site_id").alias("ids"))


@query("shuffle_and_rename")
def _(spark, d):
    return Q.shuffle_and_rename(v.reads(spark, d)).select("name", "number")


@query("shuffle_numbers", sql("reads", "SELECT row_number() OVER (ORDER BY doc_id) AS number FROM reads"))
def _(spark, d):
    return Q.shuffle_and_rename(v.reads(spark, d)).select("number")


@query("nested_subreads")
def _(spark, d):
    return Q.nested_subreads(with_qual(spark, d), 3, [60, 40, 20], short="whole").select("name", "seq", "offset")


@query("nested_subread_lengths", sql("reads", """SELECT length(seq) AS length, count(*) AS n FROM (SELECT seq FROM reads UNION ALL
SELECT substr(seq, 1, s) FROM reads, (VALUES (60), (40), (20)) t(s), range(3)) GROUP BY 1"""))
def _(spark, d):
    t = Q.nested_subreads(with_qual(spark, d), 3, [60, 40, 20], short="whole")
    return t.groupBy(F.length("seq").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


@query("distance_tags", sql("reads", "SELECT length(seq) % 40 AS dist, count(*) AS n FROM reads GROUP BY 1"))
def _(spark, d):
    return Q.distance_tags(with_qual(spark, d))
