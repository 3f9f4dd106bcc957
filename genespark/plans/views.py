"""Genomics-shaped views over the driver tables, in Spark and as DuckDB CTEs.

Only the shapes matter: an order is a site, a line item is a call of one individual at that site, a part
is an interval, a document is a read.
"""

from pyspark.sql import functions as F

from genespark.operators import tiling


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread_scan(df, key):
    """One file with one row group is one task, whatever the cores; deal its rows out. Inputs of many splits are left as they are.

    Only the plan differs, and only for the small test tables: without it the k-mer queries take twice as long there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def width(rows):
    """Shuffle partitions for the rows of a table as it is read; Parquet footers tell their number."""
    return tiling.width(rows.sparkSession, rows.count())


def r6(col, digits=6):
    """Round for comparison; adding zero turns a negative zero into zero."""
    return F.round(col, digits) + F.lit(0.0)


def sites(spark, d):
    k = F.col("o_orderkey")
    ref = (k % 4).cast("int")
    alt = ((ref + 1 + F.floor(k / 4) % 3) % 4).cast("int")
    base = lambda i: F.substring(F.lit("ACGT"), i + 1, F.lit(1))
    return table(spark, d, "orders").select(
        k.alias("site_id"),
        (F.col("o_custkey") % 5 + 1).cast("int").alias("chrom"),
        (k * 100 + 1).alias("pos"),
        base(ref).alias("ref"),
        base(alt).alias("alt"),
    )


def calls(spark, d):
    """One row per (site, individual): genotype, depth, quality."""
    rows = table(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    # the flags as numbers in their order: a least number is aggregated without a sort
    code = F.when(flag < "A", 0).when(flag == "A", 1).when(flag < "N", 2).when(flag == "N", 3).when(flag > "N", 4)
    t = rows.select(F.col("l_orderkey").alias("site_id"), F.col("l_linenumber").alias("idx"), code.alias("rf"), "l_discount", "l_quantity", "l_tax")
    # nearly every row is a group of its own, so rows are dealt out by site before they are grouped; a join by site then moves none again
    a = t.repartition(width(rows), "site_id").groupBy("site_id", "idx").agg(
        F.min("rf").alias("rf"),
        F.min("l_discount").alias("md"),
        F.sum("l_quantity").cast("int").alias("dp"),
        F.round(F.sum("l_tax") * 1000).alias("qual"),
    )
    gt = F.when(F.col("rf") == 1, 0).when(F.col("rf") == 3, 1).otherwise(2)
    return a.select(
        "site_id",
        "idx",
        F.concat(F.lit("S"), F.col("idx")).alias("sample"),
        F.concat(F.lit("P"), F.col("idx") % 4 + 1).alias("grp"),
        F.when(F.col("md") != 0, gt).alias("gt"),
        "dp",
        "qual",
    )


def genotypes(spark, d):
    return calls(spark, d).join(sites(spark, d), "site_id")


def individuals(spark, d):
    return (
        table(spark, d, "lineitem").select(F.col("l_linenumber").alias("idx")).distinct()
        .select("idx", F.concat(F.lit("S"), "idx").alias("sample"), F.concat(F.lit("P"), F.col("idx") % 4 + 1).alias("grp"))
    )


def intervals(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        (k % 5 + 1).cast("int").alias("chrom"),
        (k * 700).alias("start"),
        (k * 700 + F.col("p_size") * 50).alias("end"),
        F.concat(F.lit("G"), k).alias("name"),
    )


def blocks(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.concat(F.lit("S"), k % 7 + 1).alias("sample"),
        (k % 5 + 1).cast("int").alias("chrom"),
        (k * 10000 + 1).alias("start"),
        (k * 10000 + 40001).alias("end"),
    )


#: Every letter of the texts stands for a base: a, c, g, t for themselves, the others in turn.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêçñóíABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÓÍ"
BASES = "".join(c.upper() if c in "acgtACGT" else "ACGT"[i % 4] for i, c in enumerate(LETTERS))

#: The same with the case of the letter.
MASKED = "".join(b if c.isupper() else b.lower() for c, b in zip(LETTERS, BASES))


def reads(spark, d):
    seq = F.regexp_replace(F.translate("text", LETTERS, BASES), "[^ACGT]+", "")
    return (
        spread_scan(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
        .filter(F.col("text").rlike(f"[{LETTERS}]"))  # a base comes of each of these and of nothing else; the sequence is not made to ask
        .select(F.col("doc_id"), F.concat(F.lit("r"), F.col("doc_id")).alias("name"), seq.alias("seq"))
    )


def meth(spark, d):
    rows = table(spark, d, "lineitem")
    p = F.col("l_partkey")
    methylated = F.count_if("_r")
    # strand and context as one number, a shorter key than their names
    kind = F.when(p % 2 == 0, 0).otherwise(3) + F.when(p % 3 == 0, 0).when(p % 3 == 1, 1).otherwise(2)
    t = rows.select(
        (F.col("l_suppkey") % 5 + 1).cast("int").alias("chrom"), (p * 40 + F.col("l_suppkey") % 37).alias("start"), kind.alias("_kind"),
        (F.col("l_returnflag") == "R").alias("_r"),
    )
    # nearly every row is a place of its own, so rows are dealt out by place before they are grouped
    g = t.repartition(width(rows), "chrom", "start").groupBy("chrom", "start", "_kind").agg(
        methylated.alias("mc"), (F.count(F.lit(1)) - methylated).alias("c")
    )
    rest = F.col("_kind") % 3
    return g.select(
        "chrom",
        "start",
        F.when(F.col("_kind") < 3, "+").otherwise("-").alias("strand"),
        F.when(rest == 0, "CpG").when(rest == 1, "CHG").otherwise("CHH").alias("context"),
        "c",
        "mc",
        (F.col("start") + 1).alias("end"),
    )


def idxstats(spark, d):
    """Reads per sample (user) and contig (event type by value band), with contig lengths."""
    e = table(spark, d, "events")
    contig = F.concat(F.lit("chr"), F.when(F.col("event_id") % 11 == 0, "X").otherwise((F.col("event_id") % 5 + 1).cast("string")))
    g = e.groupBy(F.concat(F.lit("U"), F.col("user_id") % 50).alias("sample"), contig.alias("contig")).agg(
        F.count(F.lit(1)).alias("nreads")
    )
    return g.withColumn(
        "len",
        F.when(F.col("contig") == "chrX", 155).otherwise(250 - 10 * F.substring("contig", 4, 9).cast("int")).cast("long") * 1000000,
    )


CTES = {
    "sites": """sites AS (
      SELECT o_orderkey AS site_id, CAST(o_custkey % 5 + 1 AS INTEGER) AS chrom, o_orderkey * 100 + 1 AS pos,
             substr('ACGT', CAST(o_orderkey % 4 AS INTEGER) + 1, 1) AS ref,
             substr('ACGT', CAST((o_orderkey % 4 + 1 + (o_orderkey // 4) % 3) % 4 AS INTEGER) + 1, 1) AS alt
      FROM orders)""",
    "calls": """calls AS (
      SELECT l_orderkey AS site_id, l_linenumber AS idx, 'S' || l_linenumber AS sample,
             'P' || (l_linenumber % 4 + 1) AS grp,
             CASE WHEN min(l_discount) <> 0 THEN CASE min(l_returnflag) WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END END AS gt,
             CAST(sum(l_quantity) AS INTEGER) AS dp, round(sum(l_tax) * 1000) AS qual
      FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "genotypes": "genotypes AS (SELECT * FROM calls JOIN sites USING (site_id))",
    "individuals": """individuals AS (
      SELECT DISTINCT l_linenumber AS idx, 'S' || l_linenumber AS sample, 'P' || (l_linenumber % 4 + 1) AS grp FROM lineitem)""",
    "intervals": """intervals AS (
      SELECT CAST(p_partkey % 5 + 1 AS INTEGER) AS chrom, p_partkey * 700 AS "start",
             p_partkey * 700 + p_size * 50 AS "end", 'G' || p_partkey AS name FROM part)""",
    "blocks": """blocks AS (
      SELECT 'S' || (s_suppkey % 7 + 1) AS sample, CAST(s_suppkey % 5 + 1 AS INTEGER) AS chrom,
             s_suppkey * 10000 + 1 AS "start", s_suppkey * 10000 + 40001 AS "end" FROM supplier)""",
    "reads": f"""reads AS (
      SELECT * FROM (SELECT doc_id, 'r' || doc_id AS name, regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g') AS seq
      FROM documents) WHERE length(seq) > 0)""",
    "meth": """meth AS (
      SELECT chrom, "start", "start" + 1 AS "end", strand, context, CAST(sum(c) AS BIGINT) AS c, CAST(sum(mc) AS BIGINT) AS mc
      FROM (SELECT CAST(l_suppkey % 5 + 1 AS INTEGER) AS chrom, l_partkey * 40 + l_suppkey % 37 AS "start",
                   CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
                   CASE l_partkey % 3 WHEN 0 THEN 'CpG' WHEN 1 THEN 'CHG' ELSE 'CHH' END AS context,
                   count(*) FILTER (l_returnflag = 'R') AS mc, count(*) FILTER (l_returnflag <> 'R') AS c
            FROM lineitem GROUP BY l_suppkey, l_partkey) GROUP BY ALL)""",
    "idxstats": """idxstats AS (
      SELECT *, CAST(CASE WHEN contig = 'chrX' THEN 155 ELSE 250 - 10 * CAST(substr(contig, 4) AS INTEGER) END AS BIGINT) * 1000000 AS len
      FROM (SELECT 'U' || (user_id % 50) AS sample,
                   'chr' || CASE WHEN event_id % 11 = 0 THEN 'X' ELSE CAST(event_id % 5 + 1 AS VARCHAR) END AS contig,
                   count(*) AS nreads FROM events GROUP BY 1, 2))""",
}


def sql(ctes, body):
    """DuckDB text: the named views, then the body (which may go on with more CTEs after a comma)."""
    body = body.strip()
    if not ctes:
        return ("WITH " + body[1:].strip()) if body.startswith(",") else body
    head = "WITH " + ",\n".join(CTES[c] for c in ctes.split())
    return f"{head}\n{body}"


GENO = "calls sites genotypes"


def rnd(expr, digits=6):
    return f"(round({expr}, {digits}) + 0.0)"
