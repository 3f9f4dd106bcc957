import gzip
import random

import pytest
from pyspark.sql import functions as F

from genespark.operators import methylation, sequences, variants
from genespark.sinks import formats as K
from genespark.sources import formats as R
from genespark.sources.lines import read_lines, read_numbered
from genespark.sources.plink import locus_genotypes, read_plink


def write(path, text):
    if str(path).endswith(".gz"):
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)
    return str(path)


VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb
chr1\t5\trs1\tA\tC\t50\tPASS\t.\tGT:DP:AD\t0/1:9:4,5\t./.
chrX\t7\t.\tG\t.\t.\tq10\t.\tGT:DP\t0|0:3\t1/1:2
chr2\t9\t.\tG\tT,TA\t1\tPASS\t.\tDP:GT\t4:1/2\t5:0/2
"""


@pytest.mark.parametrize("name", ["x.vcf", "x.vcf.gz"])
def test_vcf_format_is_read_per_row(spark, tmp_path, name):
    v = R.read_vcf(spark, write(tmp_path / name, VCF))
    g = {(r.chrom, r["sample"]): r for r in R.vcf_genotypes(v).collect()}
    assert (g["1", "a"].gt, g["1", "a"].dp, g["1", "a"].ad) == (1, 9, [4, 5])
    assert (g["1", "b"].gt, g["1", "b"].dp, g["1", "b"].ad) == (None, None, None)
    assert (g["X", "a"].gt, g["X", "b"].gt, g["X", "a"].qual) == (2, 0, None)
    assert (g["2", "a"].gt, g["2", "a"].dp, g["2", "b"].gt) == (0, 4, 1)
    lines = read_lines(spark, str(tmp_path / name))
    assert [r.sample for r in R.vcf_samples(lines).orderBy("idx").collect()] == ["a", "b"]
    assert R.vcf_headers(lines).count() == 2
    assert variants.biallelic_snps_only(v).count() == 1


def test_line_numbers_across_splits_and_files(spark, tmp_path):
    paths = [write(tmp_path / f"f{k}.txt", "".join(f"{k}-{i}\n" for i in range(n))) for k, n in ((0, 700), (1, 3), (2, 0), (3, 1500))]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = read_numbered(spark, paths).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 2203
    for r in rows:
        assert r.value.split("-")[1] == str(r.line_no)


def test_lines_stay_where_they_are_when_they_are_numbered(spark, tmp_path):
    path = write(tmp_path / "a.txt.gz", "".join(f"{k}\n" for k in range(500)))
    t = read_numbered(spark, path)
    assert sorted((r.line_no, r.value) for r in t.collect()) == [(k, str(k)) for k in range(500)]
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_contigs_over_many_splits(spark, tmp_path):
    rng = random.Random(6)
    contigs = {f"chr{k}": "".join(rng.choice("ACGTacgtN") for _ in range(n)) for k, n in enumerate((40_000, 1, 59, 60, 61, 3000, 4000, 0))}
    contigs["chr9"] = "ACG" + "CG" * 3000 + "AT" * 300 + "cgGCgc" * 200 + "A"
    text = "".join(f">{n} some words\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for n, s in contigs.items())
    path = write(tmp_path / "a.fa", text)
    other = write(tmp_path / "b.fa", ">last\nACGT\r\nAC\r\n")
    contigs["last"] = "ACGTAC"
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        for size, before, after in ((1000, 0, 99), (700, 2, 2), (1 << 20, 0, 0)):
            got = {(r.name, r.offset): r.piece for r in R.read_fasta_pieces(spark, [path, other], size, before, after).collect()}
            want = {(n, k): s[max(0, k - before) : k + size + after] for n, s in contigs.items() for k in range(0, len(s), size)}
            assert got == want
        pieces = R.read_fasta_pieces(spark, [path, other], 1000, 0, 99)
        whole = spark.createDataFrame(list(contigs.items()), "name string, seq string")
        rows = lambda df: sorted(map(tuple, df.collect()))
        assert rows(sequences.cpg_islands(pieces, size=1000)) == rows(sequences.cpg_islands(whole)) != []
        assert rows(sequences.masked_runs(R.read_fasta_pieces(spark, [path, other], 1000), size=1000)) == rows(sequences.masked_runs(whole))
        cuts = [("e1", "GAT", 1), ("e2", "CGG", 0)]
        assert rows(sequences.restriction_fragments(pieces, cuts, 3, 400, size=1000)) == rows(sequences.restriction_fragments(whole, cuts, 3, 400))
        two = R.read_fasta_pieces(spark, [path, other], 700, 2, 2)
        assert rows(methylation.reference_cytosines(two, size=700)) == rows(methylation.reference_cytosines(whole))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_eigenstrat_files(spark, tmp_path):
    geno = write(tmp_path / "a.geno", "029\n911\n")
    snp = write(tmp_path / "a.snp", " rs1 1 0.0 100 A C\nrs2   30\t0.0 200 G T\n")
    ind = write(tmp_path / "a.ind", "s1 M p\ns2 F p\ns3 U q\n")
    rows = R.read_eigenstrat(spark, geno, snp, ind).collect()
    assert {(r.snpid, r["sample"]): r.gt for r in rows} == {
        ("rs1", "s1"): 0, ("rs1", "s2"): 2, ("rs1", "s3"): None, ("rs2", "s1"): None, ("rs2", "s2"): 1, ("rs2", "s3"): 1}


def test_positional_join_rejects_different_lengths(spark):
    a = spark.createDataFrame([(0, 1), (1, 2)], "line_no long, a int")
    with pytest.raises(Exception, match="differ in length"):
        R.positional_join(a, a.filter("line_no = 0").withColumnRenamed("a", "b")).collect()


def test_fasta_and_fastq(spark, tmp_path):
    fa = write(tmp_path / "a.fa", ">x one two\nACG\nT\n>y\nGG\n")
    assert sorted(map(tuple, R.read_fastx(spark, fa).select("name", "comment", "seq").collect())) == [("x", "one two", "ACGT"), ("y", None, "GG")]
    fq = write(tmp_path / "a.fq.gz", "@x c\nACGT\n+\nIII!\n@y\nGG\n+\n##\n")
    assert sorted(map(tuple, R.read_fastx(spark, fq).collect())) == [("x", "c", "ACGT", "III!"), ("y", None, "GG", "##")]
    with pytest.raises(ValueError):
        R.read_fastx(spark, write(tmp_path / "a.txt", "hello\n"))


def test_bed_keeps_the_first_of_repeated_loci(spark, tmp_path):
    bed = write(tmp_path / "a.bed", "chr1\t4\t5\tb\nchr1\t0\t5\ta\n2\t9\t10\tc\n")
    rows = R.parse_bed(read_numbered(spark, bed))
    assert sorted((r.chrom, r.pos, r.snpid) for r in rows.collect()) == [("1", 5, "b"), ("2", 10, "c")]
    order = spark.createDataFrame([("X", 1), ("10", 5), ("2", 9), ("2", 3)], "chrom string, pos long")
    assert [(r.chrom, r.pos) for r in R.sort_by_coordinate(order).collect()] == [("2", 3), ("2", 9), ("10", 5), ("X", 1)]


def test_sam_rejects_short_lines(spark):
    bad = spark.createDataFrame([("@HD",), ("a\t0\tx",)], "value string")
    with pytest.raises(Exception, match="fewer than 11"):
        R.parse_sam(bad).collect()


def test_plink_two_bit_codes(spark, tmp_path):
    people, sites = 5, 7
    codes = [[(s + 2 * i) % 4 for i in range(people)] for s in range(sites)]
    data = bytearray(b"\x6c\x1b\x01")
    for row in codes:
        for k in range(0, people, 4):
            data.append(sum(c << (2 * j) for j, c in enumerate(row[k : k + 4])))
    (tmp_path / "p.bed").write_bytes(bytes(data))
    write(tmp_path / "p.fam", "".join(f"f{i % 2} i{i} 0 0 0 0\n" for i in range(people)))
    write(tmp_path / "p.bim", "".join(f"1 rs{s} 0 {s * 10} A C\n" for s in range(sites)))
    calls = read_plink(spark, str(tmp_path / "p"), sites_per_partition=2)
    assert calls.rdd.getNumPartitions() >= 1
    table = {0: 0, 1: None, 2: 1, 3: 2}
    got = {(r.pos, r.iid): r.gt for r in calls.collect()}
    assert got == {(s * 10, f"i{i}"): table[codes[s][i]] for s in range(sites) for i in range(people)}
    assert locus_genotypes(calls, "1", 30).count() == people
    (tmp_path / "p.bed").write_bytes(b"abc")
    with pytest.raises(Exception, match="not a site-major"):
        read_plink(spark, str(tmp_path / "p")).collect()


def test_posterior_log_and_eigenvalues(spark, tmp_path):
    log = write(tmp_path / "x.log", "a\tb\tc\n1\t2\t3\n4\t5\t6\n")
    assert sorted(map(tuple, R.read_posterior_log(spark, log, ["c", "a"]).drop("line_no").collect())) == [(3.0, 1.0), (6.0, 4.0)]
    with pytest.raises(Exception):
        R.read_posterior_log(spark, write(tmp_path / "y.log", "a\tb\n1\t2\t3\n"), ["a"]).collect()
    ev = R.parse_eigenvalues(read_numbered(spark, write(tmp_path / "e.txt", " 2.5\n1.5\n")))
    assert sorted(r.eigenvalue for r in ev.collect()) == [1.5, 2.5]


def test_fai(spark):
    lines = spark.createDataFrame([("chr1\t100\t5\t60\t61",)], "value string")
    assert tuple(R.parse_fai(lines).first()) == ("1", 100)


def test_written_lines_keep_their_order(spark, tmp_path):
    df = spark.range(50).select((50 - F.col("id")).alias("k"), F.concat(F.lit("l"), 50 - F.col("id")).alias("line"))
    K.write_lines(df.repartition(4), str(tmp_path / "out"), ["k"])
    parts = sorted((tmp_path / "out").glob("part-*"))
    text = "".join(p.read_text() for p in parts).split()
    assert text == [f"l{i}" for i in range(1, 51)]


def test_context_folders_and_report(spark, tmp_path):
    m = spark.createDataFrame([("1", 4, 5, "+", 1, 3, "CGA"), ("1", 9, 10, "-", 0, 2, "CNN")], "chrom string, start long, end long, strand string, c long, mc long, context string")
    m = m.withColumn("context", K.context_class(F.col("context"))).filter("context is not null")
    K.write_by_context(K.pileometh_lines(m), str(tmp_path / "pm"))
    (part,) = (tmp_path / "pm" / "context=CpG").glob("part-*")
    assert part.read_text() == "1\t4\t5\t75\t3\t1\n"
    K.write_report(m, str(tmp_path / "rep"))
    assert any(p.read_text().startswith("chrom\tstart") for p in (tmp_path / "rep").glob("part-*.csv"))


def test_group_names(spark):
    names = ["rep_Cow_1", "single", "XX_A3_Bison_x", "XX_Q_1", "10ul_Yak_2"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.g for r in df.select(K.group_from_name(F.col("n")).alias("g")).collect()] == ["Cow", "single", "Bison_x", "XX_Q_1", "Yak"]
