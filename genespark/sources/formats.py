"""Parsers of the exchange formats: a table of lines in, a typed table out."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genespark.functions.coords import natural_key, strip_chr
from genespark.operators import tiling
from genespark.sources.lines import checked, fields, read_lines, read_numbered

SPACE = r"[ \t]+"


def _at(f, i, cast=None):
    c = F.get(f, F.lit(i))
    return c.try_cast(cast) if cast else c


def _space(col="value"):
    return F.split(F.trim(col), SPACE)


# --- variants -------------------------------------------------------------------------------------


def per_file(table, value, many_files):
    """A lookup of one value per file, as a column: one map that every task gets, so the lines stay where they are.

    ``many_files`` joins the lines with the table instead, for so many files that searching a map for each line costs
    more than a shuffle.
    """
    if many_files:
        return lambda lines: lines.join(table.select("file", value.alias("_of_file")), "file")
    known = table.agg(F.map_from_entries(F.collect_list(F.struct("file", value.alias("v")))).alias("m"))
    return lambda lines: lines.withColumn("_of_file", F.try_element_at(known.scalar(), F.col("file"))).filter("_of_file is not null")


def parse_vcf(lines, many_files=False):
    """One row per record: fixed columns, ``format``, ``calls`` (sample, text), ``samples`` array of (sample, FORMAT map).

    FORMAT is read per row. Records of a file without a header line are left out.
    """
    head = lines.filter(F.col("value").startswith("#CHROM")).withColumn("_f", fields()).dropDuplicates(["file"])
    names = F.slice("_f", 10, F.greatest(F.size("_f") - 9, F.lit(0)))
    body = lines.filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    body = per_file(head, names, many_files)(body).withColumn("_f", fields())
    f = F.col("_f")
    fmt = F.split(_at(f, 8), ":")
    texts = F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0)))
    as_map = lambda g: F.map_from_entries(F.filter(
        F.zip_with(fmt, F.split(g, ":"), lambda k, x: F.struct(k.alias("k"), x.alias("v"))), lambda e: e["k"].isNotNull()))
    samples = F.zip_with(F.col("_of_file"), texts, lambda n, g: F.struct(n.alias("sample"), as_map(g).alias("fmt")))
    calls = F.zip_with(F.col("_of_file"), texts, lambda n, g: F.struct(n.alias("sample"), g.alias("text")))
    return body.select(
        "file", strip_chr(_at(f, 0)).alias("chrom"), _at(f, 1).cast("long").alias("pos"), _at(f, 2).alias("id"),
        _at(f, 3).alias("ref"), F.split(_at(f, 4), ",").alias("alts"), _at(f, 5, "double").alias("qual"),
        _at(f, 6).alias("filter"), _at(f, 7).alias("info"), fmt.alias("format"), calls.alias("calls"), samples.alias("samples"),
    )


def vcf_samples(lines):
    """Sample names per file, in column order."""
    head = lines.filter(F.col("value").startswith("#CHROM")).withColumn("_f", fields())
    return head.select("file", F.posexplode(F.slice("_f", 10, F.greatest(F.size("_f") - 9, F.lit(0)))).alias("idx", "sample"))


def vcf_headers(lines):
    return lines.filter(F.col("value").startswith("#")).select("file", "value")


def vcf_genotypes(variants):
    """Long calls: gt = copies of the reference allele (NULL if missing), depth, allele depths.

    The places of GT, DP and AD are looked up once per record.
    """
    places = [F.array_position("format", k).cast("int").alias(f"_{k}") for k in ("GT", "DP", "AD")]
    t = variants.select("chrom", "pos", "id", "ref", "alts", "qual", "filter", *places, F.explode("calls").alias("c"))
    t = t.withColumn("_v", F.split("c.text", ":"))
    t = t.select("*", *[F.when(F.col(f"_{k}") > 0, F.get("_v", F.col(f"_{k}") - 1)).alias(k.lower()) for k in ("GT", "DP", "AD")])
    alleles = F.split("gt", r"[/|]")
    missing = F.col("gt").isNull() | F.array_contains(alleles, ".")
    return t.select(
        "chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alt"), "qual", "filter", F.col("c.sample").alias("sample"),
        F.when(~missing, F.size(F.filter(alleles, lambda a: a == "0"))).alias("gt"), F.col("dp").try_cast("int").alias("dp"),
        F.transform(F.split("ad", ","), lambda x: x.try_cast("int")).alias("ad"), F.col("gt").alias("gt_text"),
    )


def read_vcf(spark, paths):
    return parse_vcf(read_lines(spark, paths))


# --- EIGENSTRAT -----------------------------------------------------------------------------------


def parse_snp(lines):
    f = F.col("_f")
    return lines.withColumn("_f", _space()).select(
        F.col("line_no").alias("site_id"), _at(f, 0).alias("snpid"), _at(f, 1).alias("chrom"), _at(f, 2, "double").alias("gpos"),
        _at(f, 3).cast("long").alias("pos"), _at(f, 4).alias("ref"), _at(f, 5).alias("alt"),
    )


def parse_ind(lines):
    f = F.col("_f")
    return lines.withColumn("_f", _space()).select(
        F.col("line_no").cast("int").alias("idx"), _at(f, 0).alias("sample"), _at(f, 1).alias("sex"), _at(f, 2).alias("grp")
    )


def parse_geno(lines):
    """One row per (line, column); 9 becomes NULL."""
    return lines.select(F.col("line_no").alias("site_id"), F.posexplode(F.split(F.trim("value"), "")).alias("idx", "code")).filter(
        F.col("code") != ""
    ).select("site_id", "idx", F.when(F.col("code") != "9", F.col("code").cast("int")).alias("gt"))


def join_eigenstrat(geno, snp, ind):
    return geno.join(snp, "site_id").join(ind, "idx")


def positional_join(left, right, on="line_no"):
    """Join two line-numbered tables; a line without a partner fails the job."""
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), on, "full")
    ok = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.withColumn(on, checked(ok, F.col(on), "tables differ in length")).drop("_l", "_r")


def read_eigenstrat(spark, geno, snp, ind):
    n = lambda p: read_numbered(spark, p)
    return join_eigenstrat(parse_geno(n(geno)), parse_snp(n(snp)), parse_ind(n(ind)))


# --- sequences ------------------------------------------------------------------------------------


def parse_fasta(records):
    """Records split at newline + '>' (the first one keeps its own '>')."""
    text = F.regexp_replace("value", "^>", "")
    label = F.regexp_extract(text, r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace(text, r"^[^\r\n]*", ""), r"[\r\n]", "")
    words = F.split(label, r"\s", 2)
    return records.filter(F.trim("value") != "").select(
        words[0].alias("name"), F.get(words, F.lit(1)).alias("comment"), body.alias("seq"), F.lit(None).cast("string").alias("qual")
    )


def read_fasta(spark, paths):
    return parse_fasta(read_lines(spark, paths, sep="\n>"))


def fasta_pieces(lines, size=1 << 20, before=0, after=0, tile=1 << 20):
    """(name, offset, piece): a contig's bases from offset on, ``size`` of them with ``before`` and ``after`` more around.

    lines: value, file, line_no (ascending, not necessarily dense).  A contig is never a row: line lengths are summed along
    the file, tile by tile, the last header before a line is carried on, and each piece is put together from the lines that
    reach into it.  Offsets are multiples of ``size``; at the ends of a contig there is nothing beyond.
    """
    head = F.col("value").startswith(">")
    text = F.regexp_replace("value", r"[\r\n]", "")
    t = lines.select("file", "line_no", text.alias("_text"), head.alias("_head"))
    t = tiling.running_sum(t, ["file"], "line_no", {"_through": F.when(F.col("_head"), 0).otherwise(F.length("_text")).cast("long")}, tile)
    name = F.split(F.expr("substring(_text, 2)"), r"\s", 2)[0]
    t = t.withColumn("_own", F.when(F.col("_head"), F.struct(name.alias("name"), F.col("_through").alias("at"))))
    t = tiling.nearest(t, ["file"], "line_no", [], "_own", "_of", tile).filter("not _head and _of is not null and _text <> ''")
    start = F.col("_through") - F.length("_text") - F.col("_of.at")
    t = t.select(F.col("_of.name").alias("name"), start.alias("_start"), "_text")
    end = F.col("_start") + F.length("_text")
    first = F.greatest(F.lit(0), F.floor((F.col("_start") - after) / size)).cast("long")
    # the last pieces begin with what stands before them
    last = F.floor((end - 1 + before) / size).cast("long")
    t = t.withColumn("_k", F.explode(F.sequence(first, last)))
    low, high = F.col("_k") * size - before, (F.col("_k") + 1) * size + after
    skip = F.greatest(F.lit(0), low - F.col("_start"))
    take = F.least(end, high) - F.col("_start") - skip
    part = F.call_function("substring", F.col("_text"), (skip + 1).cast("int"), take.cast("int"))
    t = t.filter(take > 0).select("name", "_k", F.struct((F.col("_start") + skip).alias("at"), part.alias("part")).alias("_p"))
    t = t.groupBy("name", "_k").agg(F.array_sort(F.collect_list("_p")).alias("_p"), F.max(F.col("_p.at") + F.length("_p.part")).alias("_end"))
    t = t.filter(F.col("_end") > F.col("_k") * size)
    return t.select("name", (F.col("_k") * size).alias("offset"), F.array_join(F.col("_p.part"), "").alias("piece"))


def read_fasta_pieces(spark, paths, size=1 << 20, before=0, after=0):
    """Contigs of any length from FASTA files of any number of splits, as pieces."""
    return fasta_pieces(read_numbered(spark, paths), size, before, after)


def parse_fastq(lines):
    """Four numbered lines make a read."""
    k = F.col("line_no") % 4
    part = lambda i: F.max(F.when(k == i, F.col("value")))
    t = lines.groupBy("file", F.floor(F.col("line_no") / 4).alias("line_no")).agg(
        part(0).alias("label"), part(1).alias("seq"), part(3).alias("qual")
    )
    words = F.split(F.regexp_replace("label", "^@", ""), r"\s", 2)
    return t.select("file", "line_no", words[0].alias("name"), F.get(words, F.lit(1)).alias("comment"), "seq", "qual")


def read_fastx(spark, path):
    """FASTA or FASTQ, told apart by the first character."""
    first = read_lines(spark, path).filter("value <> ''").select("value").first()
    if first is None or first[0][0] not in ">@":
        raise ValueError(f"{path}: neither FASTA nor FASTQ")
    if first[0][0] == ">":
        return read_fasta(spark, path)
    return parse_fastq(read_numbered(spark, path)).select("name", "comment", "seq", "qual")


def parse_sam(lines):
    f = F.col("_f")
    t = lines.filter(~F.col("value").startswith("@") & (F.col("value") != "")).withColumn("_f", fields())
    t = t.withColumn("_f", checked(F.size("_f") >= 11, F.col("_f"), "alignment line with fewer than 11 columns"))
    return t.select(
        _at(f, 0).alias("qname"), _at(f, 1).cast("int").alias("flag"), _at(f, 2).alias("rname"), _at(f, 3, "long").alias("pos"),
        _at(f, 4, "int").alias("mapq"), _at(f, 5).alias("cigar"), _at(f, 6).alias("mrnm"), _at(f, 7, "long").alias("mpos"),
        _at(f, 8, "int").alias("isize"), _at(f, 9).alias("seq"), _at(f, 10).alias("qual"),
        F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))).alias("opt"),
    )


# --- intervals and small tables -------------------------------------------------------------------


def parse_bed(lines):
    """Loci: the position is the interval's end; of repeated positions the first line stays."""
    f = F.col("_f")
    t = lines.filter("value <> ''").withColumn("_f", fields()).select(
        "line_no", strip_chr(_at(f, 0)).alias("chrom"), _at(f, 1, "long").alias("start"), _at(f, 2).cast("long").alias("pos"), _at(f, 3).alias("snpid")
    )
    first = F.min_by(F.struct("start", "snpid", "line_no"), "line_no")
    return t.groupBy("chrom", "pos").agg(first.alias("x")).select("chrom", "pos", "x.start", "x.snpid", "x.line_no")


def sort_by_coordinate(df, pos="pos"):
    return df.orderBy(*natural_key(F.col("chrom")), pos)


def parse_snp_chip(lines):
    """Header of sample names, then row id and codes; long rows, and a width check."""
    head = lines.filter("line_no = 0").select(F.slice(fields(), 2, 1 << 30).alias("h"))
    t = lines.filter("line_no > 0 and value <> ''").withColumn("_f", fields()).withColumn("_h", head.scalar())
    t = t.withColumn("_f", checked(F.size("_f") == F.size("_h") + 1, F.col("_f"), "row width differs from the header"))
    pairs = F.arrays_zip(F.col("_h").alias("sample"), F.slice("_f", 2, 1 << 30).alias("code"))
    return t.select(_at(F.col("_f"), 0).cast("long").alias("snp_num"), F.posexplode(pairs).alias("idx", "p")).select("snp_num", "idx", "p.sample", "p.code")


def parse_gff3(lines):
    f = F.col("_f")
    return lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).withColumn("_f", fields()).select(
        _at(f, 0).alias("seqid"), _at(f, 1).alias("source"), _at(f, 2).alias("type"), _at(f, 3).cast("long").alias("start"),
        _at(f, 4).cast("long").alias("end"), _at(f, 5).alias("score"), _at(f, 6).alias("strand"), _at(f, 7).alias("phase"), _at(f, 8).alias("attributes"),
    )


def parse_assembly_report(lines):
    """Assigned molecule, GenBank and RefSeq accession of each sequence (columns 3, 5 and 7)."""
    f = F.col("_f")
    return lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).withColumn("_f", fields()).select(
        _at(f, 2).alias("molecule"), _at(f, 4).alias("genbank"), F.trim(_at(f, 6)).alias("refseq")
    )


def parse_dbsnp_flat(entries, assembly):
    """Blank-line separated entries -> rs, ss ids, chrom, pos, ref, alt for one assembly; SNPs with a place only."""
    rows = F.transform(F.split("value", r"\r?\n"), lambda x: F.split(F.trim(x), r" \| "))
    kind = lambda p: F.filter("rows", lambda r: r[0].startswith(p))
    value = lambda r, key: F.regexp_extract(F.get(F.filter(r, lambda x: F.trim(x).startswith(f"{key}=")), F.lit(0)), "=(.*)$", 1)
    t = entries.select(rows.alias("rows"))
    t = t.select(
        F.get(F.filter(kind("rs"), lambda r: F.array_contains(F.transform(r, F.trim), "snp")), F.lit(0)).alias("rs"),
        F.transform(kind("ss"), lambda r: r[0]).alias("ss"),
        F.get(F.filter("rows", lambda r: (r[0] == "SNP")), F.lit(-1) + F.size(F.filter("rows", lambda r: r[0] == "SNP"))).alias("snp"),
        F.get(F.filter("rows", lambda r: (r[0] == "CTG") & (value(r, "assembly") == assembly)), F.lit(0)).alias("ctg"),
    ).filter("rs is not null and size(ss) > 0 and ctg is not null")
    alleles = value(F.col("snp"), "alleles")
    two = F.length(alleles) == 5
    base = lambda i: F.when(two, F.substring(alleles, i, 1))
    return t.select(
        F.get("rs", F.lit(0)).alias("rs"), "ss", value(F.col("ctg"), "chr").alias("chrom"),
        F.coalesce(value(F.col("ctg"), "chr-pos").try_cast("long"), F.lit(-1)).alias("pos"), base(2).alias("ref"), base(4).alias("alt"),
    )


def dbsnp_id_index(entries):
    """One row per rs or ss id."""
    return entries.select(F.explode(F.array_union(F.array("rs"), "ss")).alias("id"), "*")


def parse_idxstats(lines, min_length=0, include=None, exclude=None):
    f = F.col("_f")
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    t = lines.filter("value <> ''").withColumn("_f", fields()).select(
        name.alias("sample"), _at(f, 0).alias("contig"), _at(f, 1).cast("long").alias("len"), _at(f, 2).cast("long").alias("nreads")
    ).filter((F.col("contig") != "*") & (F.col("len") >= min_length))
    if include:
        t = t.filter(F.col("contig").isin(list(include)))
    return t.filter(~F.col("contig").isin(list(exclude))) if exclude else t


def parse_fai(lines):
    f = F.col("_f")
    return lines.filter("value <> ''").withColumn("_f", fields()).select(strip_chr(_at(f, 0)).alias("chrom"), _at(f, 1).cast("long").alias("length"))


def parse_flagstat(lines):
    """passed + failed description (percentages) lines."""
    pat = r"^(\d+) \+ (\d+) ([^(]*[^( ]) ?(?:\(([^:)]*?)%? ?:?.*)?$"
    x = lambda i: F.regexp_extract("value", pat, i)
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.flagstats?$", "")
    desc = F.when(x(3).startswith("in total"), "total").otherwise(x(3))
    return lines.filter(F.col("value").rlike(pat)).select(
        name.alias("sample"), x(1).cast("long").alias("passed"), x(2).cast("long").alias("failed"), desc.alias("description"), x(4).try_cast("double").alias("percent")
    )


def flagstat_table(stats, descriptions):
    """One row per sample, one column per description."""
    return stats.groupBy("sample").pivot("description", list(descriptions)).agg(F.first("passed"))


def parse_dstats(lines, many_files=False):
    """Result tables of three programs in one shape; the BABA - ABBA convention is turned into ABBA - BABA."""
    head = lines.filter("line_no = 0")
    kind = F.struct(_at(fields(), 0).alias("first"), F.array_contains(fields(), "D_Z").alias("jack"))
    f = F.col("_f")
    t = per_file(head, kind, many_files)(lines.filter("line_no > 0 and value <> ''")).withColumn("_f", fields())
    first, jack = F.col("_of_file.first"), F.col("_of_file.jack")
    d = F.when(first == "H1", _at(f, 5, "double")).otherwise(-_at(f, 4, "double"))
    z = F.when(first == "H1", _at(f, 8, "double")).when(jack, -_at(f, 6, "double")).otherwise(-_at(f, 5, "double"))
    known = checked(first.isin("H1", "P1"), _at(f, 0), "unknown D statistics format")
    return t.select("line_no", known.alias("p1"), _at(f, 1).alias("p2"), _at(f, 2).alias("p3"), d.alias("d"), z.alias("z"))


# --- methylation ----------------------------------------------------------------------------------


def parse_methlist(lines):
    f = F.col("_f")
    return lines.withColumn("_f", fields()).filter(_at(f, 1, "long").isNotNull()).select(
        _at(f, 0).alias("chrom"), _at(f, 1).cast("long").alias("start"), _at(f, 2).cast("long").alias("end"), _at(f, 3).alias("strand"),
        _at(f, 4).cast("long").alias("depth"), _at(f, 5).cast("long").alias("c"), _at(f, 6).cast("long").alias("mc"), _at(f, 7).alias("context"),
    )


def parse_methylkit(lines):
    """Counts are recovered from coverage and percent."""
    f = F.col("_f")
    cov = _at(f, 4, "long")
    mc = F.round(0.01 * cov * _at(f, 5, "double")).cast("long")
    return lines.withColumn("_f", fields()).filter(_at(f, 2, "long").isNotNull()).select(
        _at(f, 1).alias("chrom"), (_at(f, 2).cast("long") - 1).alias("start"), _at(f, 2).cast("long").alias("end"),
        F.when(_at(f, 3) == "F", "+").otherwise("-").alias("strand"), cov.alias("depth"), (cov - mc).alias("c"), mc.alias("mc"),
    )


def parse_pileometh(lines):
    f = F.col("_f")
    return lines.filter(~F.col("value").startswith("track")).withColumn("_f", _space()).filter(F.size("_f") >= 6).select(
        _at(f, 0).alias("chrom"), _at(f, 1).cast("long").alias("start"), _at(f, 2).cast("long").alias("end"),
        _at(f, 4).cast("long").alias("mc"), _at(f, 5).cast("long").alias("c"),
    )


def parse_dss(lines):
    """Numbered chromosomes only."""
    f = F.col("_f")
    return lines.withColumn("_f", fields()).filter(_at(f, 0).rlike("^chr[0-9]+$")).select(
        strip_chr(_at(f, 0)).cast("int").alias("chrom"), _at(f, 1).cast("long").alias("pos"), _at(f, 2).cast("long").alias("n"), _at(f, 3).cast("long").alias("x"),
    ).withColumn("level", F.try_divide("x", "n"))


# --- further tables -------------------------------------------------------------------------------


def parse_typed_columns(lines, columns, skip=0):
    """``columns``: name -> (0-based index, type)."""
    t = lines.filter(F.col("line_no") >= skip) if skip else lines
    t = t.filter("trim(value) <> ''").withColumn("_f", _space())
    return t.select(*[_at(F.col("_f"), i).cast(kind).alias(n) for n, (i, kind) in columns.items()])


def parse_posterior_log(lines, keep):
    """Chosen columns of a tab-separated table with a header; a row of another width fails the job."""
    rows = lines.filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    head = rows.agg(F.struct(F.min("line_no").alias("at"), F.split(F.min_by("value", "line_no"), "\t").alias("names")))
    t = rows.withColumn("_h", head.scalar()).filter(F.col("line_no") > F.col("_h.at")).withColumn("_f", fields())
    t = t.withColumn("_f", checked(F.size("_f") == F.size("_h.names"), F.col("_f"), "row width differs from the header"))
    place = lambda c: (F.array_position("_h.names", c) - 1).cast("int")
    return t.select("line_no", *[F.get("_f", place(c)).cast("double").alias(c) for c in keep])


def read_posterior_log(spark, path, keep):
    return parse_posterior_log(read_numbered(spark, path), keep)


def split_fold_tag(aln, hairpin_length=29):
    """Both strands and their qualities from the XF:Z:s1|s2|q1|q2 tag of a folded read; a read without it fails.

    A read reached the hairpin when the folded pair is longer than the read plus the hairpin.
    """
    tag = F.get(F.filter("opt", lambda x: x.startswith("XF:Z:")), F.lit(0))
    text = F.substring(checked(tag.isNotNull() & tag.contains("|"), tag, "alignment without a fold tag"), 6, 1 << 30)
    part = lambda k: F.substring(F.col("_xf"), F.col("_n") * k + k + 1, F.col("_n"))
    # inline() finds the tag once per read; the four parts below refer to it
    t = aln.select("*", F.inline(F.array(F.struct(text.alias("_xf")))))
    t = t.select("*", F.inline(F.array(F.struct((F.instr("_xf", "|") - 1).alias("_n")))))
    for k, name in enumerate(("s1", "s2", "q1", "q2")):
        t = t.withColumn(name, part(k))
    return t.withColumn("rev", F.col("flag").bitwiseAND(16) != 0).withColumn("chrom", F.col("rname")).withColumn(
        "pos0", F.col("pos") - 1).withColumn("hairpin", F.length("seq") + hairpin_length < F.col("_n")).drop("_xf", "_n")


def parse_evec(lines):
    """Eigenvector rows: sample, coordinates, group; the line of eigenvalues starts with '#'."""
    f = F.col("_f")
    return lines.filter(~F.trim("value").startswith("#") & (F.trim("value") != "")).withColumn("_f", _space()).select(
        _at(f, 0).alias("sample"), F.transform(F.slice(f, 2, F.size(f) - 2), lambda x: x.cast("double")).alias("coords"), F.element_at(f, -1).alias("grp")
    )


def parse_eigenvalues(lines):
    return lines.filter("trim(value) <> ''").select("line_no", F.trim("value").cast("double").alias("eigenvalue"))


def parse_segments(lines):
    """``cactus`` segment lines: tree number, chromosome, start, end, score."""
    f = F.col("_f")
    t = lines.filter(F.col("value").startswith("cactus")).withColumn("_f", _space())
    return t.select(
        F.regexp_extract(_at(f, 0), r"^cactus(\d+)", 1).cast("int").alias("tree"), strip_chr(F.regexp_replace(_at(f, 1), ".$", "")).alias("chrom"),
        _at(f, 2).cast("long").alias("start"), _at(f, 4).cast("long").alias("end"), F.regexp_extract("value", r"score=([-+0-9.eE]+)", 1).cast("double").alias("score"),
    )


def parse_hist(lines):
    """One count per line; the value is the index among the count lines."""
    t = lines.filter("value <> '' and not startswith(value, '#')")
    # fit lines precede or follow the counts, so the offset is the number of '#' or empty lines before the first count
    first = t.agg(F.min("line_no").alias("f"))
    return t.select((F.col("line_no") - first.scalar()).alias("value"), F.trim("value").cast("long").alias("n"))


def parse_hist_fits(lines):
    """``#model;k=v;...`` lines."""
    t = lines.filter(F.col("value").startswith("#")).withColumn("_f", F.split(F.substring("value", 2, 1 << 20), ";"))
    kv = F.explode(F.slice("_f", 2, 1 << 20)).alias("kv")
    return t.select(_at(F.col("_f"), 0).alias("model"), kv).select("model", F.split("kv", "=")[0].alias("name"), F.split("kv", "=")[1].cast("double").alias("value"))


def parse_hybrid_blocks(lines):
    """Introgressed intervals per sample (last six characters of the id); chromosomes above 22 move up by 10."""
    f = F.col("_f")
    c = _at(f, 2).cast("int")
    return lines.filter("line_no > 0 and value <> ''").withColumn("_f", fields()).select(
        F.substring(_at(f, 1), -6, 6).alias("sample"), F.when(c > 22, c + 10).otherwise(c).alias("chrom"),
        _at(f, 4).cast("long").alias("start"), _at(f, 5).cast("long").alias("end"),
    )


def parse_nt_pairs(lines):
    """CTX5p and CTX3p rows as (end, position, pair, count, share within the row)."""
    head = lines.filter(F.col("value").rlike("^#CTX[53]p")).select(
        F.substring("value", 2, 5).alias("end"), F.expr("slice(split(value, '\t'), 3, size(split(value, '\t')))").alias("_pairs")
    )
    t = lines.filter(F.col("value").rlike("^CTX[53]p")).withColumn("_f", fields())
    t = t.select(_at(F.col("_f"), 0).alias("end"), _at(F.col("_f"), 1, "int").alias("pos"), F.slice("_f", F.lit(3), F.size("_f")).alias("_n")).join(head, "end")
    t = t.withColumn("_n", F.transform("_n", lambda x: x.try_cast("double"))).withColumn("_t", F.aggregate("_n", F.lit(0.0), lambda a, x: a + x))
    e = t.select("end", "pos", "_t", F.explode(F.arrays_zip(F.col("_pairs").alias("pair"), F.col("_n").alias("n"))).alias("e"))
    return e.select("end", "pos", "e.pair", F.col("e.n").cast("long").alias("n"), F.coalesce(F.try_divide("e.n", "_t"), F.lit(0.0)).alias("share"))


def parse_admixture_q(lines, ind):
    """Ancestry shares per individual with their running sum over the components; rows are of equal width."""
    width = lines.filter("trim(value) <> ''").agg(F.max(F.size(_space())).alias("w"))
    t = lines.filter("trim(value) <> ''").withColumn("_f", _space()).withColumn("_w", width.scalar())
    t = t.withColumn("_f", checked(F.size("_f") == F.col("_w"), F.col("_f"), "rows of different width"))
    q = t.select(F.col("line_no").cast("int").alias("idx"), F.posexplode("_f").alias("k", "q")).withColumn("q", F.col("q").cast("double"))
    run = W.partitionBy("idx").orderBy("k").rowsBetween(W.unboundedPreceding, 0)  # one row per component
    return q.withColumn("cumulative", F.sum("q").over(run)).join(ind, "idx")
