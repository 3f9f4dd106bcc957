"""Exchange formats as tables of lines.

One line is built per output row and the rows are ordered by their keys.  Formats that hold one long row
per sample are emitted in fragments of a fixed number of sites (wrapped lines), so no task ever holds the
sequence of a whole genome.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genespark.functions.coords import chrom_code, natural_key
from genespark.functions.draws import draw
from genespark.operators import tiling

# IUPAC codes of heterozygotes.
IUPAC = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}
# Two-digit allele codes per genotype (copies of the reference; NULL is missing).
GENEPOP = {0: "0202", 1: "0102", 2: "0101"}


def write_lines(df, path, order, column="line"):
    """Order by the keys and write the line column as text, one file per range."""
    df.orderBy(*order).select(column).write.text(path)


def write_report(df, path):
    df.write.csv(path, sep="\t", header=True)


# --- EIGENSTRAT -----------------------------------------------------------------------------------


def individual_order(individuals):
    return individuals.agg(F.transform(F.array_sort(F.collect_list("idx")), lambda i: i.cast("int")).alias("i"))


def geno_lines(sites, gts, individuals, exclude_missing=False):
    """One digit per individual in matrix order, 9 for missing or absent calls."""
    g = gts.filter("gt is not null").groupBy("site_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("int"), F.col("gt").cast("string")))).alias("_m")
    )
    t = sites.join(g, "site_id", "left").withColumn("_i", individual_order(individuals).scalar())
    code = lambda i: F.coalesce(F.try_element_at("_m", i), F.lit("9"))
    t = t.withColumn("line", F.array_join(F.transform("_i", code), ""))
    if exclude_missing:
        t = t.filter(~F.col("line").contains("9"))
    return t.drop("_m", "_i")


def snp_lines(sites, six=False, autosomes=29):
    code = F.coalesce(chrom_code(F.col("chrom").cast("string"), autosomes).cast("string"), F.col("chrom").cast("string"))
    base = [F.col("snpid"), code, F.lit("0.0"), F.col("pos").cast("string")]
    return sites.withColumn("line", F.concat_ws("\t", *base, *([F.coalesce("ref", F.lit("X")), F.coalesce("alt", F.lit("X"))] if six else [])))


def ind_lines(individuals, label=None):
    """Name, sex and group; the format holds 39 characters of a name, and a longer one is an error rather than cut."""
    name = F.when(F.length("sample") <= 39, F.col("sample")).otherwise(F.raise_error(F.concat(F.lit("sample name over 39 characters: "), "sample")))
    group = F.lit(label) if label else F.coalesce(F.col("grp"), F.col("sample"))
    return individuals.select("idx", F.concat_ws("\t", name, F.lit("U"), group).alias("line"))


def flip_genotypes(gts):
    return gts.withColumn("gt", 2 - F.col("gt"))


def missingness(gts):
    return gts.withColumn("missing", F.col("gt").isNull().cast("int"))


def recode_snp_chip(chip):
    """Array codes 0, 1, 2, ? count the other allele; turn them around and make ? NULL."""
    return chip.withColumn("gt", 2 - F.col("code").try_cast("int"))


def group_from_name(name):
    """Group label from an array sample name: drop the last part, or the first two of X?_[AB].. names, and known prefixes."""
    parts = F.split(name, "_")
    head = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "_")
    tail = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "_")
    coded = F.get(parts, F.lit(1)).rlike("^[AB]")
    label = F.when(F.size(parts) == 1, name).when(~name.startswith("X"), head).when(coded, tail).otherwise(name)
    # Preparation prefixes.
    return F.regexp_replace(label, "^(rep|replig|pool|lig_col|lig_eth|3ul|6ul|10ul)_", "")


# --- one row per sample ---------------------------------------------------------------------------


def ranked_sites(sites):
    """Consecutive 0-based site numbers in (chromosome, position) order."""
    chroms = sites.select("chrom").distinct()
    order = chroms.withColumn("_c", F.row_number().over(W.orderBy(*natural_key(F.col("chrom").cast("string")))).cast("long"))  # one row per contig
    t = sites.join(order, "chrom").withColumn("_at", F.shiftleft("_c", 40) + F.col("pos"))
    return tiling.row_numbers(t, [], "_at", "rank").withColumn("rank", F.col("rank") - 1).drop("_at", "_c")


def sample_fragments(gts, ranked, char, missing, width=60):
    """(idx, sample, grp, fragment, text): ``width`` sites of one sample per row, dense over all sites."""
    total = ranked.agg(F.count(F.lit(1)).alias("n"))
    t = gts.join(ranked.select("site_id", "rank"), "site_id").withColumn("_ch", char).filter("_ch is not null")
    cells = t.groupBy("idx", "sample", "grp", F.floor(F.col("rank") / width).alias("fragment")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("rank") % width).cast("int"), "_ch"))).alias("_m")
    )
    people = gts.select("idx", "sample", "grp").distinct()
    grid = people.withColumn("_n", total.scalar()).withColumn("fragment", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / width))))
    full = grid.join(cells, ["idx", "sample", "grp", "fragment"], "left")
    last = F.least(F.lit(width), F.col("_n") - F.col("fragment") * width).cast("int") - 1
    text = F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(missing))), "")
    return full.select("idx", "sample", "grp", "fragment", text.alias("text"))


def _with_header(fragments, header):
    """Put a header row (fragment -1) before the fragments of each sample."""
    people = fragments.select("idx", "sample", "grp").distinct().select("idx", F.lit(-1).cast("long").alias("fragment"), header.alias("line"))
    return people.unionByName(fragments.select("idx", "fragment", F.col("text").alias("line")))


def iupac_char():
    pair = F.concat(F.least("ref", "alt"), F.greatest("ref", "alt"))
    table = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    return F.when(F.col("gt") == 2, F.col("ref")).when(F.col("gt") == 0, F.col("alt")).when(F.col("gt") == 1, F.try_element_at(table, pair))


def polymorphic(gts):
    """Site ids whose called genotypes hold both alleles."""
    s = gts.filter("gt is not null").groupBy("site_id").agg(F.sum("gt").alias("s"), (2 * F.count("gt")).alias("n"))
    return s.filter("s > 0 and s < n").select("site_id")


def invariant_counts(gts):
    """Monomorphic sites per fixed base (what an ascertainment correction needs)."""
    s = gts.filter("gt is not null").groupBy("site_id", "ref", "alt").agg(F.sum("gt").alias("s"), (2 * F.count("gt")).alias("n"))
    base = F.when(F.col("s") == F.col("n"), F.col("ref")).when(F.col("s") == 0, F.col("alt"))
    return s.withColumn("base", base).filter("base is not null").groupBy("base").agg(F.count(F.lit(1)).alias("n"))


def to_phylip(gts, sites, numeric=True, width=60, drop_monomorphic=False):
    """Sequential PHYLIP: a count line, then per sample its name followed by fragments of its row.

    ``drop_monomorphic`` leaves out the sites whose calls hold one allele; `invariant_counts` says how many there are.
    """
    if drop_monomorphic:
        keep = polymorphic(gts)
        people = gts.select("idx", "sample", "grp").distinct()
        sites = sites.join(keep, "site_id", "left_semi")
        # a sample that has calls at dropped sites only keeps its (empty) row
        gts = people.join(gts.drop("sample", "grp").join(keep, "site_id", "left_semi"), "idx", "left")
    ranked = ranked_sites(sites)
    char = F.col("gt").cast("string") if numeric else iupac_char()
    frags = sample_fragments(gts, ranked, char, "?" if numeric else "N", width)
    people = gts.select("idx").distinct().agg(F.count(F.lit(1)).alias("k"))
    counts = ranked.agg(F.count(F.lit(1)).alias("n")).withColumn("k", people.scalar())
    head = counts.select(F.lit(-1).alias("idx"), F.lit(-1).cast("long").alias("fragment"), F.concat_ws(" ", F.lit(""), "k", "n").alias("line"))
    name = F.when(F.col("fragment") == 0, F.concat("sample", F.lit(" "), "text")).otherwise(F.col("text"))
    return head.unionByName(frags.select(F.col("idx").cast("int").alias("idx"), "fragment", name.alias("line")))


def to_multifasta(gts, sites, width=60):
    """IUPAC sequences of the polymorphic sites, wrapped."""
    keep = polymorphic(gts)
    frags = sample_fragments(gts.join(keep, "site_id", "left_semi"), ranked_sites(sites.join(keep, "site_id", "left_semi")), iupac_char(), "N", width)
    return _with_header(frags, F.concat(F.lit(">"), "sample"))


def to_genotype_fasta(gts, sites, width=60):
    frags = sample_fragments(gts, ranked_sites(sites), F.col("gt").cast("string"), "9", width)
    return _with_header(frags, F.concat(F.lit(">"), F.concat_ws("_", "sample", "grp")))


def to_genepop(gts, sites, width=60):
    """Population blocks; each individual's genotypes continue over several lines."""
    table = F.create_map(*[F.lit(x) for kv in GENEPOP.items() for x in kv])
    char = F.concat(F.lit(" "), F.try_element_at(table, F.col("gt")))
    frags = sample_fragments(gts, ranked_sites(sites), char, " 0000", width)
    pops = frags.select("grp").distinct().select("grp", F.lit(-1).alias("idx"), F.lit(-1).cast("long").alias("fragment"), F.lit("Pop").alias("line"))
    line = F.when(F.col("fragment") == 0, F.concat("grp", F.lit(","), "text")).otherwise(F.col("text"))
    return pops.unionByName(frags.select("grp", F.col("idx").cast("int").alias("idx"), "fragment", line.alias("line")))


def to_nexus(gts, sites, nucleotide=False, reference=None, seed=1, width=60):
    """Matrix rows of the sites whose alleles all have length one; alternative counts, or one allele drawn."""
    snps = sites.filter((F.length("ref") == 1) & (F.length("alt") == 1))
    if nucleotide:
        char = F.when(draw(F.lit(2), seed, "site_id", "sample") < F.col("gt"), F.col("ref")).when(F.col("gt").isNotNull(), F.col("alt"))
    else:
        char = (2 - F.col("gt")).cast("string")
    g = gts.join(snps.select("site_id"), "site_id", "left_semi")
    ranked = ranked_sites(snps)
    frags = sample_fragments(g, ranked, char, "?", width)
    if reference:
        ref = snps.select("site_id", "ref", "alt", F.lit(2).alias("gt"), F.lit(0).alias("idx"), F.lit(reference).alias("sample"), F.lit("").alias("grp"))
        frags = frags.unionByName(sample_fragments(ref, ranked, F.col("ref") if nucleotide else F.lit("0"), "?", width))
    line = F.when(F.col("fragment") == 0, F.concat("sample", F.lit(" "), "text")).otherwise(F.col("text"))
    return frags.select("idx", "fragment", line.alias("line"))


def nexus_header(n_samples, n_sites, nucleotide=False):
    kind = 'DNA symbols="ACGT"' if nucleotide else 'integer symbols="012"'
    return ["#NEXUS", "BEGIN DATA;", f"DIMENSIONS NTAX={n_samples} NCHAR={n_sites};", f"FORMAT DATATYPE={kind} missing=? gap=- transpose=no;", "matrix"]


def to_treemix(gts, groups, sites):
    """``reference,alternative`` allele counts per group and site, in the listed group order."""
    aggs = []
    for i, g in enumerate(groups):
        mine = F.col("grp") == g
        aggs += [F.coalesce(F.sum(F.when(mine, F.col("gt"))), F.lit(0)).alias(f"r{i}"), (2 * F.count(F.when(mine, F.col("gt")))).alias(f"n{i}")]
    c = gts.groupBy("site_id").agg(*aggs)
    t = sites.select("site_id", "chrom", "pos").join(c, "site_id", "left").fillna(0)
    cell = [F.concat_ws(",", f"r{i}", F.expr(f"n{i} - r{i}")) for i in range(len(groups))]
    return t.select("chrom", "pos", "site_id", F.concat_ws(" ", *cell).alias("line"))


def smcpp_lines(runs):
    """Run, observed state, alternative alleles and alleles of each run, in order along the chromosome."""
    return runs.select("chrom", "run", F.concat_ws("\t", "span", "state", "n_alt", "n_total").alias("line"))


# --- methylation and intervals --------------------------------------------------------------------


def context_class(context):
    """CpG, CHG or CHH of a trinucleotide; contexts that hold N are NULL."""
    return F.when(context.rlike("^CG"), "CpG").when(context.rlike("^C[ACT]G"), "CHG").when(context.rlike("^C[ACT][ACT]"), "CHH")


def methylkit_lines(meth):
    n = F.col("c") + F.col("mc")
    pct = lambda x: F.format_string("%.2f", 100.0 * F.col(x) / n)
    pos = F.col("start") + 1
    strand = F.when(F.col("strand") == "-", "R").otherwise("F")
    line = F.concat_ws("\t", F.concat_ws(".", "chrom", pos), "chrom", pos, strand, n, pct("mc"), pct("c"))
    return meth.filter(n > 0).withColumn("line", line)


def pileometh_lines(meth):
    n = F.col("c") + F.col("mc")
    line = F.concat_ws("\t", "chrom", "start", "end", F.floor(100 * F.col("mc") / n), "mc", "c")
    return meth.filter(n > 0).withColumn("line", line)


def both_strands(pairs):
    """Rows with +C, +mC, -C, -mC of one context become one row per strand.

    The reverse cytosine of CpG lies one base on, of CHG two; CHH keeps one strand, the reverse one only if
    the forward one has no reads.
    """
    shift = F.when(F.col("context") == "CpG", 1).when(F.col("context") == "CHG", 2).otherwise(0)
    fwd = F.struct(F.lit("+").alias("strand"), F.col("start"), F.col("pc").alias("c"), F.col("pmc").alias("mc"))
    rev = F.struct(F.lit("-").alias("strand"), (F.col("start") + shift).alias("start"), F.col("nc").alias("c"), F.col("nmc").alias("mc"))
    single = F.array(F.when(F.expr("pc + pmc > 0"), fwd).otherwise(rev))
    both = F.when(F.col("context") == "CHH", single).otherwise(F.array(fwd, rev))
    t = pairs.select("chrom", "context", F.explode(both).alias("s")).select("chrom", "context", "s.*")
    return t.withColumn("end", F.col("start") + 1).filter("c + mc > 0")


def merged_strands(pairs):
    """One row per context: both strands added, or for CHH the one strand that has reads."""
    one = (F.col("context") == "CHH") & F.expr("pc + pmc > 0")
    other = (F.col("context") == "CHH") & F.expr("pc + pmc = 0")
    pick = lambda p, n: F.when(one, F.col(p)).when(other, F.col(n)).otherwise(F.col(p) + F.col(n))
    t = pairs.select("chrom", "start", "end", "context", pick("pc", "nc").alias("c"), pick("pmc", "nmc").alias("mc"))
    return t.filter("c + mc > 0")


def write_by_context(lines, path):
    lines.select("context", "line").write.partitionBy("context").text(path)


def gff_to_bed(gff, report, types):
    """Features of the wanted types on assembly names: the molecule, else the GenBank accession."""
    wanted = gff.filter(F.col("type").isin(list(types)))
    t = wanted.join(report, wanted["seqid"] == report["refseq"], "left")
    name = F.coalesce(F.when(F.col("molecule") != "na", F.col("molecule")), F.col("genbank"), F.col("seqid"))
    return t.select(name.alias("chrom"), (F.col("start") - 1).alias("start"), "end", "type")
