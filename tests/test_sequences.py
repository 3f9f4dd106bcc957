import math
import random
from collections import Counter

from pyspark.sql import functions as F

from genespark.functions import sequence as S
from genespark.operators import sequences as Q

RNG = random.Random(2)


def seqs(spark, rows):
    return spark.createDataFrame(rows, "name string, seq string")


def one(spark, seq, col):
    return seqs(spark, [("x", seq)]).select(col.alias("v")).first().v


def test_bisulfite_at_the_ends(spark):
    c = S.bisulfite_convert(F.col("seq"))
    assert one(spark, "CAC", c) == "TAT"
    assert one(spark, "CGC", c) == "CGC"
    assert one(spark, "CCGGCC", c) == "TCGGCT"


def test_kmers_of_short_sequences(spark):
    assert one(spark, "ACG", S.kmers(F.col("seq"), 3)) == ["ACG"]
    assert one(spark, "AC", S.kmers(F.col("seq"), 3)) == []
    assert one(spark, "AAAA", S.kmers(F.col("seq"), 2)) == ["AA"] * 3


def test_entropies_agree(spark):
    s = "".join(RNG.choice("ACGT") for _ in range(90))
    n = Counter(s[i : i + 3] for i in range(88))
    want = -sum(c / 88 * math.log(c / 88) for c in n.values())
    assert math.isclose(one(spark, s, S.kmer_entropy_short(F.col("seq"))), want, rel_tol=1e-9)
    assert math.isclose(Q.kmer_entropy(seqs(spark, [("x", s)])).first().entropy, want, rel_tol=1e-9)


def test_palindromes(spark):
    clip = S.palindrome_clip(F.col("seq"), 3)
    assert one(spark, "ACGTTTTTTACGT", clip) == "ACGTTTTTT"
    assert one(spark, "ACGAAAATTT", clip) == "ACGAAAATTT"
    assert one(spark, "ACGT", clip) == "ACGT"


def test_contig_chunks_do_not_change_results(spark):
    s = "".join(RNG.choice("ACGTacgt") for _ in range(3000)) + "CG" * 150 + "".join(RNG.choice("AT") for _ in range(400))
    df = seqs(spark, [("x", s), ("y", s[:700])])
    for f in (
        lambda size: Q.masked_runs(df, size=size),
        lambda size: Q.restriction_fragments(df, [("a", "AC", 1), ("b", "GAT", 0)], 5, 60, size=size),
        lambda size: Q.cpg_islands(df, size=size),
    ):
        whole = sorted(map(tuple, f(1 << 20).collect()))
        assert whole and whole == sorted(map(tuple, f(137).collect()))


def test_cpg_island_position(spark):
    df = seqs(spark, [("x", "A" * 300 + "CG" * 150 + "A" * 300)])
    (r,) = Q.cpg_islands(df).collect()
    # windows with more than 50 C or G of 100
    assert (r.start, r.end) == (251, 649)


def test_rmdup_keeps_first_name_and_best_quality(spark):
    rows = [("b", "c2", "ACGT", "!I!I", 2), ("a", "c1", "ACGT", "I!!!", 1), ("z", None, "TT", "##", 3)]
    df = spark.createDataFrame(rows, "name string, comment string, seq string, qual string, line_no long")
    got = {r.seq: (r.name, r.comment, r.qual, r.copies) for r in Q.rmdup_exact(df).collect()}
    assert got == {"ACGT": ("a", "c1", "II!I", 2), "TT": ("z", None, "##", 1)}
    assert Q.rmdup_totals(Q.rmdup_exact(df)).first().duplicates == 1


def test_nested_subreads_are_nested(spark, partitions):
    s = "".join(RNG.choice("ACGT") for _ in range(80))
    df = spark.createDataFrame([("r", s, "I" * 80)], "name string, seq string, qual string")
    rows = {r.name: r for r in Q.nested_subreads(df, 2, [50, 30, 10]).collect()}
    assert len(rows) == 7
    for rep in (1, 2):
        outer = s
        for size in (50, 30, 10):
            r = rows[f"r:{rep}:{size}"]
            assert len(r.seq) == size and r.seq in outer and s[r.offset : r.offset + size] == r.seq
            outer = r.seq


def test_sample_fraction_and_shuffle(spark, partitions):
    df = spark.range(100).select(F.col("id").alias("site_id"))
    a = sorted(r.site_id for r in Q.sample_exact_fraction(df, 0.25).collect())
    assert len(a) == 25 and a == sorted(r.site_id for r in Q.sample_exact_fraction(df.repartition(7), 0.25).collect())


def test_hairpins(spark):
    cut = Q.HAIRPIN[:7] + Q.HAIRPIN[8:]
    m = spark.createDataFrame([("a", "AA" + cut + "TT", "ACGT" * 10), ("b", "ACGT" * 10, "ACGT" * 10)], "name string, seq1 string, seq2 string")
    assert [(r.name, r.at) for r in Q.hairpin_deletions(m).collect()] == [("a", 7)]
    hits = {r.name: r.hits for r in Q.hairpin_kmer_hits(m, 12).collect()}
    assert hits["a"] >= 17 and hits["b"] == 0
