"""Column expressions on nucleotide strings; they stay in the JVM."""

from pyspark.sql import functions as F


def reverse_complement(seq):
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def bisulfite_convert(seq):
    """C becomes T unless a neighbour is G."""
    return F.regexp_replace(seq, "(?<!G)C(?!G)", "T")


def kmers(seq, k):
    """All k-mers in order (empty for shorter sequences): a lookahead matches at every base, in one linear scan."""
    return F.regexp_extract_all(seq, F.lit("(?=(.{%d}))" % k), F.lit(1))


def unique_kmers(seq, k):
    return F.size(F.array_distinct(kmers(seq, k)))


def kmer_entropy_short(seq, k=3):
    """Shannon entropy (nats) of the k-mers of a short sequence inside one row: one pass over sorted k-mers."""
    nln = lambda n: F.when(n > 0, n * F.ln(n)).otherwise(0.0)
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    step = lambda acc, x: F.struct(
        x.alias("last"),
        F.when(acc["last"] == x, acc["n"] + 1.0).otherwise(1.0).alias("n"),
        F.when(acc["last"] == x, acc["s"]).otherwise(acc["s"] + nln(acc["n"])).alias("s"),
    )
    total = (F.length(seq) - (k - 1)).cast("double")
    done = lambda acc: F.ln(total) - F.try_divide(acc["s"] + nln(acc["n"]), total)
    return F.when(total > 0, F.aggregate(F.array_sort(kmers(seq, k)), start, step, done))


def base_count(seq, bases):
    return F.length(F.regexp_replace(seq, f"[^{bases}]", ""))


def gc_fraction(seq):
    return F.try_divide(base_count(seq, "CG"), F.length(seq))


def cpg_count(seq):
    return F.regexp_count(seq, F.lit("CG"))


def masked_count(seq):
    """Bases that are lower case or not A, C, G, T."""
    return F.length(seq) - base_count(seq, "ACGT")


def palindrome_length(seq):
    """How many 3' bases mirror the 5' end (compared up to half the sequence).

    Equality of prefixes is monotone, so the length is built bit by bit from prefix comparisons.
    """
    rc = reverse_complement(seq)
    half = F.floor(F.length(seq) / 2).cast("int")
    bits = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    longer = lambda n, b: (n + b <= half) & (F.left(seq, F.least(n + b, half)) == F.left(rc, F.least(n + b, half)))
    return F.aggregate(bits, F.lit(0), lambda n, b: F.when(longer(n, b), n + b).otherwise(n))


def palindrome_clip(seq, least):
    """Clip a 3' end that mirrors the 5' end by at least ``least`` bases; full palindromes are left whole."""
    half = F.floor(F.length(seq) / 2)
    kept = lambda n: F.when((n >= least) & (n < half), F.left(seq, F.length(seq) - n)).otherwise(seq)
    return F.get(F.transform(F.array(palindrome_length(seq)), kept), F.lit(0))


def probes(seq, alt, plen):
    """Four probes tiled over a window of 2 plen + 1 bases; the third carries the alternative allele."""
    half = plen // 2
    s = F.upper(seq)
    sub = lambda a, b: F.substring(s, a + 1, b - a)
    return F.array(
        sub(0, plen), sub(half, plen + half + 1), F.concat(sub(half, plen), alt, sub(plen + 1, plen + half + 1)), sub(plen + 1, 2 * plen + 1)
    )


def region(seq, start, end):
    """Bases start..end, 1-based and inclusive."""
    return F.substring(seq, F.lit(start), F.lit(end - start + 1))


def without_region(seq, start, end):
    """The sequence with the 0-based half-open interval removed."""
    return F.concat(F.substring(seq, F.lit(1), F.lit(start)), F.substring(seq, F.lit(end + 1), F.length(seq)))
