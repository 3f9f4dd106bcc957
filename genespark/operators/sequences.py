"""Reads and contigs.  Long contigs are handled as overlapping chunks, never base by base in one task."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genespark.functions import sequence as S
from genespark.functions.draws import draw
from genespark.operators import tiling

CHUNK = 1 << 20
RUN = pa.schema([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

# The hairpin adapter and its counterpart on the second mate.
HAIRPIN = "ACGCCGGCGGCAAGTGAAGCCGCCGGCGT"
RHAIRPIN = "ACGCCGGCGGCTTCACTTGCCGCCGGCGT"

# Alignment flag bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED = 0x1, 0x2, 0x4, 0x8
READ2, SECONDARY, QCFAIL, DUPLICATE, SUPPLEMENTARY = 0x80, 0x100, 0x200, 0x400, 0x800
STRICT_PAIR_FLAGS = (0x63, 0x93, 0x53, 0xA3)


def chunks(seqs, overlap, size=CHUNK):
    """(name, offset, piece): pieces of ``size`` bases plus ``overlap`` bases of the next piece.

    seqs: whole sequences (name, seq), or pieces of contigs as ``fasta_pieces`` gives them with the same ``size`` and at
    least ``overlap`` bases after; contigs that are no single row take the second form.
    """
    if "piece" in seqs.columns:
        return seqs.select("name", "offset", F.substring("piece", 1, size + overlap).alias("piece"))
    n = F.length("seq")
    at = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
    return seqs.filter(n > 0).select("name", "seq", at.alias("_i")).select(
        "name", (F.col("_i").cast("long") * size).alias("offset"), F.substring("seq", F.col("_i") * size + 1, F.lit(size + overlap)).alias("piece")
    )


def bisulfite_records(seqs):
    """Forward and reverse converted records of each sequence."""
    name = F.regexp_replace("name", r"\|$", "")
    fwd = F.struct(F.concat(name, F.lit("|BS|F")).alias("name"), S.bisulfite_convert(F.col("seq")).alias("seq"))
    rev = F.struct(F.concat(name, F.lit("|BS|R")).alias("name"), S.bisulfite_convert(S.reverse_complement(F.col("seq"))).alias("seq"))
    return seqs.select(F.explode(F.array(fwd, rev)).alias("r")).select("r.*")


def kmer_counts(seqs, k):
    return seqs.select(F.explode(S.kmers(F.col("seq"), k)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def kmer_entropy(seqs, k=3, skip_n=False):
    """Shannon entropy (nats) of each sequence's k-mers."""
    t = seqs.select("name", F.explode(S.kmers(F.col("seq"), k)).alias("kmer"))
    if skip_n:
        t = t.filter(~F.col("kmer").contains("N"))
    n = t.groupBy("name", "kmer").agg(F.count(F.lit(1)).alias("n"))
    a = n.groupBy("name").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("nl"))
    return a.select("name", (F.ln("t") - F.col("nl") / F.col("t")).alias("entropy"))


def conditional_entropy(seqs, mode="joint"):
    """Entropy of a base given the one before it.

    ``joint`` weighs p(y) by the dinucleotide frequency as the published numbers do; ``conditional`` uses
    p(x|y) proper.
    """
    pairs = [y + x for y in "ACGT" for x in "ACGT"]
    # overlapping pairs: mark each position once by looking one base ahead
    di = {p: F.regexp_count("seq", F.lit(f"{p[0]}(?={p[1]})")).cast("double") for p in pairs}
    t = seqs.select("name", F.length("seq").alias("_l"), *[di[p].alias(p) for p in pairs], *[S.base_count(F.col("seq"), b).cast("double").alias(f"_{b}") for b in "ACGT"])
    dil = F.col("_l") - 1
    h = F.lit(0.0)
    for p in pairs:
        row = sum([F.col(p[0] + x) for x in "CGT"], F.col(p[0] + "A"))
        q = F.try_divide(F.col(p), dil if mode == "joint" else row)
        py = F.col(f"_{p[0]}") / F.col("_l")
        h = h - F.when(F.col(p) > 0, py * q * F.ln(q)).otherwise(0.0)
    return t.select("name", h.alias("centropy"))


def nucleotide_composition(seqs, letters="ACGTN"):
    """Counts per letter over all sequences and the GC ratio, from string lengths (no explode)."""
    up = F.upper("seq")
    sums = [F.sum(F.length("seq") - F.length(F.replace(up, F.lit(b), F.lit("")))).alias(b) for b in letters]
    a = seqs.agg(*sums, F.sum(F.length("seq")).alias("total"))
    return a.withColumn("gc", F.try_divide(F.col("G") + F.col("C"), F.expr("A + C + G + T")))


def quality_histogram(reads):
    """Bases per quality character."""
    t = reads.select(F.explode(F.split("qual", "")).alias("q")).filter("q <> ''")
    return t.groupBy("q").agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.ascii("q"))


def length_histogram(reads, length=None, dense=False):
    """Reads per length; ``dense`` adds the lengths without reads, from 0 to the longest."""
    n = length if length is not None else F.length("seq")
    h = reads.select(n.cast("long").alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    return tiling.dense_from_zero(h, "length").join(h, "length", "left").fillna(0, ["n"]) if dense else h


def alignment_length_histogram(aln, mapped=True, ignore_duplicates=False, ignore_pairs=False, contig=None, min_mapq=0):
    """Lengths from alignments: template length for proper pairs (first mate), read length otherwise."""
    mask = SECONDARY | QCFAIL | SUPPLEMENTARY
    mask |= DUPLICATE if ignore_duplicates else 0
    mask |= PAIRED if ignore_pairs else 0
    mask |= UNMAPPED if mapped else 0
    bit = lambda m: F.col("flag").bitwiseAND(m)
    t = aln.filter((bit(mask) == 0) & (F.coalesce("mapq", F.lit(0)) >= min_mapq))
    if contig is not None:
        t = t.filter(F.col("rname") == contig)
    if mapped is False:
        t = t.filter(bit(UNMAPPED) != 0)
    pair = bit(PAIRED) != 0 if mapped else F.lit(False)
    usable = ~pair | ((bit(READ2) == 0) & (bit(PROPER | MATE_UNMAPPED) == PROPER) & (F.col("isize") != 0))
    length = F.when(pair, F.abs("isize")).otherwise(F.length("seq"))
    return length_histogram(t.filter(usable), length)


def flag_mask_filter(aln, mask, min_mapq=0):
    return aln.filter((F.col("flag").bitwiseAND(mask) == 0) & (F.col("mapq") >= min_mapq))


def strict_pairs(aln):
    return aln.filter(F.col("flag").isin(*STRICT_PAIR_FLAGS))


def rmdup_exact(reads):
    """Collapse identical sequences: first name and comment, the highest quality at each base, copy number.

    Only duplicated sequences are taken apart base by base, under a digest of the sequence; partial
    aggregation shrinks a sequence with very many copies to one row per base before the shuffle.
    """
    first = F.min_by(F.struct("name", "comment", "qual"), "line_no")
    u = reads.withColumn("_id", F.sha2("seq", 256)).groupBy("_id", "seq").agg(first.alias("f"), F.count(F.lit(1)).alias("copies"))
    many = u.filter("copies > 1").select("_id")
    bases = (
        reads.filter("qual is not null").select(F.sha2("seq", 256).alias("_id"), "qual").distinct().join(many, "_id", "left_semi")
        .select("_id", F.posexplode(F.split("qual", "")).alias("p", "q")).groupBy("_id", "p").agg(F.max("q").alias("q"))
    )
    merged = bases.groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "q"))), lambda s: s["q"]), "").alias("_best"))
    out = u.join(merged, "_id", "left")
    return out.select("f.name", "f.comment", "seq", F.coalesce("_best", "f.qual").alias("qual"), "copies")


def rmdup_totals(unique):
    t = unique.agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("unique"))
    return t.withColumn("duplicates", F.col("total") - F.col("unique"))


def subread_collate(aln, min_mapq=25):
    """Mapped replicates per (master read, length); names end in :replicate:length."""
    t = flag_mask_filter(aln, UNMAPPED | SECONDARY | QCFAIL | SUPPLEMENTARY, min_mapq).withColumn("_f", F.split("qname", ":"))
    t = t.filter(F.size("_f") > 7)
    return t.groupBy(
        F.array_join(F.slice("_f", 1, 7), ":").alias("read_id"), F.element_at("_f", -1).cast("int").alias("length")
    ).agg(F.count(F.lit(1)).alias("n"))


def subread_table(collated, lengths):
    """One row per read, one column per length (longest first)."""
    order = sorted(lengths, reverse=True)
    return collated.groupBy("read_id").pivot("length", order).agg(F.sum("n")).fillna(0)


def subread_proportion(collated, nreps):
    return collated.groupBy("length").agg((F.avg("n") / nreps).alias("proportion"), F.count(F.lit(1)).alias("reads"))


def mate_join(r1, r2):
    """Mates by read name (the first word, without /1 and /2)."""
    key = F.regexp_replace(F.split("name", r"\s")[0], "/[12]$", "")
    a = r1.select(key.alias("name"), F.col("seq").alias("seq1"))
    return a.join(r2.select(key.alias("name"), F.col("seq").alias("seq2")), "name")


def near_kmers(seq, k):
    """K-mers of every variant of ``seq`` with one deletion or one substitution."""
    variants = [seq[:i] + seq[i + 1 :] for i in range(len(seq))]
    variants += [seq[:i] + b + seq[i + 1 :] for i in range(len(seq)) for b in "ACGT"]
    return sorted({s[i : i + k] for s in variants for i in range(len(s) - k + 1)})


def hairpin_kmer_hits(mates, k, hairpin=HAIRPIN, rhairpin=RHAIRPIN):
    """Larger count over the two mates of k-mers that belong to the near-hairpin set."""
    hits = lambda col, ref: F.size(F.filter(S.kmers(F.col(col), k), lambda x: x.isin(near_kmers(ref, k))))
    return mates.select("name", F.greatest(hits("seq1", hairpin), hits("seq2", rhairpin)).alias("hits"))


def hairpin_deletions(mates, hairpin=HAIRPIN, rhairpin=RHAIRPIN):
    """Position of a one-base deletion in the hairpin, where the mates agree or only one shows it."""
    n = len(hairpin)
    drop = lambda s: {s[:i] + s[i + 1 :]: i for i in range(n)}

    def first(col, table):
        seen = F.array(*[F.struct(F.instr(F.col(col), s).alias("at"), F.lit(i).alias("i")) for s, i in table.items()])
        return F.array_min(F.filter(seen, lambda h: h["at"] > 0))["i"]

    back = {s: n - 1 - i for s, i in drop(rhairpin).items()}
    # inline() evaluates both searches once per row, however often the filters below use them
    t = mates.select("name", F.inline(F.array(F.struct(first("seq1", drop(hairpin)).alias("i1"), first("seq2", back).alias("i2")))))
    ends = lambda c: F.coalesce(F.col(c).isin(0, n - 1), F.lit(False))
    t = t.filter(~ends("i1") & ~ends("i2"))
    return t.filter("coalesce(i1, i2) is not null and (i1 is null or i2 is null or i1 = i2)").select("name", F.coalesce("i1", "i2").alias("at"))


def probe_metrics(windows, plen, k=3):
    """Smallest k-mer entropy, mean GC and mean CpG count over the four probes of each window."""
    t = windows.withColumn("_p", S.probes(F.col("seq"), F.col("alt"), plen))
    mean = lambda f: F.aggregate(F.transform("_p", f), F.lit(0.0), lambda a, x: a + x) / 4
    return t.withColumn("entropy", F.array_min(F.transform("_p", lambda p: S.kmer_entropy_short(p, k)))).withColumn(
        "gc", mean(S.gc_fraction)
    ).withColumn("cpg", mean(lambda p: S.cpg_count(p).cast("double"))).drop("_p")


def unmasked_windows(windows, count):
    """Windows with exactly ``count`` unmasked bases."""
    return windows.filter(S.base_count(F.col("seq"), "ACGT") == count)


def cpg_islands(seqs, window=100, least=200, ratio=0.006, size=CHUNK):
    """Runs of sliding windows rich in C, G and CpG; 0-based half-open, at least ``least`` long.

    seqs as for ``chunks``.  A piece gives the runs of its windows, not a row for each; runs that meet at a border are joined.
    """
    half = window // 2

    def rich_runs(batches):
        for batch in batches:
            out = []
            for name, offset, piece in zip(*(batch.column(c).to_pylist() for c in ("name", "offset", "piece"))):
                base = np.frombuffer(piece.upper().encode("ascii", "replace"), dtype=np.uint8)
                n = min(len(base) - window + 1, size)
                if n < 1:
                    continue
                is_c, is_g = base == ord("C"), base == ord("G")
                total = lambda x, wide: np.diff(np.cumsum(np.concatenate(([0], x)))[[np.arange(n), np.arange(n) + wide]], axis=0)[0]
                c, g, cg = total(is_c, window), total(is_g, window), total(is_c[:-1] & is_g[1:], window - 1)
                rich = (c + g > half) & (cg > 0)
                rich[rich] = cg[rich] / (c[rich] * g[rich]) > ratio
                edges = np.flatnonzero(np.diff(np.concatenate(([0], rich.astype(np.int8), [0]))))
                out += [(name, offset + a, offset + b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
            yield pa.RecordBatch.from_pylist([dict(zip(RUN.names, r)) for r in out], schema=RUN)

    runs = chunks(seqs, window - 1, size).select("name", F.col("offset").cast("long"), "piece").mapInArrow(rich_runs, "name string, start long, end long")
    t = tiling.with_neighbour(runs, ["name"], "start", "end", "_prev")
    t = tiling.islands(t, ["name"], "start", F.col("_prev") == F.col("start"), "run")
    r = t.groupBy("name", "run").agg(F.min("start").alias("start"), (F.max("end") + window - 1).alias("end"))
    return r.filter(F.col("end") - F.col("start") >= least).drop("run")


def restriction_fragments(seqs, enzymes, low, high, size=CHUNK):
    """Fragments between neighbouring cuts of different enzymes, strictly between low and high long.

    ``enzymes``: list of (name, motif, cut offset).
    """
    reach = max(len(m) for _, m, _ in enzymes) - 1
    t = chunks(seqs, reach, size).withColumn("piece", F.upper("piece"))
    k = len(enzymes)
    # splitting before every motif gives tokens that start at the matches; their running length is the position
    cuts = [F.struct(F.lit(j).alias("j"), F.lit(m.upper()).alias("motif"), F.split("piece", f"(?={m.upper()})").alias("tokens")) for j, (_, m, _) in enumerate(enzymes)]
    t = t.select("name", "offset", F.inline(F.array(*cuts)))
    tok = t.select("name", "offset", "j", "motif", F.posexplode("tokens").alias("i", "token"))
    before = W.partitionBy("name", "offset", "j").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    tok = tok.withColumn("_at", F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)))
    hit = (F.col("i") > 0) | F.col("token").startswith(F.col("motif"))
    hits = tok.filter(hit & (F.col("_at") < size)).select("name", ((F.col("offset") + F.col("_at")) * k + F.col("j")).alias("at"))
    hits = tiling.with_neighbour(hits, ["name"], "at", "at", "_prev", tiling.TILE * k)
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("cut")) for n, _, c in enzymes])
    enz = lambda c: F.get(table, (F.col(c) % k).cast("int"))
    place = lambda c: F.floor(F.col(c) / k) + enz(c)["cut"]
    frag = hits.filter("_prev is not null").filter(F.col("at") % k != F.col("_prev") % k).select(
        "name", place("_prev").alias("start"), (place("at") + 1).alias("end"),
        enz("_prev")["name"].alias("left"), enz("at")["name"].alias("right"), (place("at") - place("_prev")).alias("length"),
    )
    return frag.filter((F.col("length") > low) & (F.col("length") < high))


def masked_runs(seqs, size=CHUNK):
    """Lower-case runs as 0-based half-open intervals; runs that cross a chunk border are joined again."""
    t = chunks(seqs, 0, size)
    tok = t.select("name", "offset", F.posexplode(F.regexp_extract_all("piece", F.lit("[a-z]+|[^a-z]+"), F.lit(0))).alias("i", "token"))
    before = W.partitionBy("name", "offset").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    tok = tok.withColumn("start", F.col("offset") + F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)))
    r = tok.filter(F.col("token").rlike("^[a-z]")).select("name", "start", (F.col("start") + F.length("token")).alias("end"))
    r = tiling.with_neighbour(r, ["name"], "start", "end", "_prev")
    r = tiling.islands(r, ["name"], "start", F.col("_prev") == F.col("start"), "run")
    return r.groupBy("name", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


# --- sampling -------------------------------------------------------------------------------------


def sample_exact_fraction(sites, fraction, ids=("site_id",), seed=1):
    """Exactly floor(n * fraction) rows, chosen by hash order."""
    n = sites.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction)).alias("n"))
    ranked = tiling.hash_rank(sites, [], list(ids), seed, "_rank")
    return ranked.filter(F.col("_rank") <= n.scalar()).drop("_rank")


def shuffle_and_rename(seqs, seed=1):
    """Sequences in hash order, renamed 1..n."""
    return tiling.hash_rank(seqs, [], ["name"], seed, "number")


def nested_subreads(reads, nrep, sizes, seed=1, short="error"):
    """The reads themselves and, per replicate, nested random substrings of the given falling sizes.

    A read shorter than a size fails the job; with ``short="whole"`` all that is left of it is taken instead.
    """
    t = reads.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(nrep))))
    off, length, rows = F.lit(0), F.length("seq"), []
    if short == "error":
        length = F.when(length >= max(sizes), length).otherwise(F.raise_error(F.lit("a read is shorter than the sizes asked for")))
    for size in sizes:
        off = off + draw(F.greatest(length - size, F.lit(1)), seed, "name", "rep", F.lit(size)).cast("int")
        length = F.least(length, F.lit(size))
        rows.append(F.struct(
            F.concat_ws(":", "name", "rep", F.lit(str(size))).alias("name"), F.call_function("substring", F.col("seq"), off + 1, length).alias("seq"),
            F.call_function("substring", F.col("qual"), off + 1, length).alias("qual"), off.alias("offset"),
        ))
    subs = t.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return reads.select("name", "seq", "qual", F.lit(0).alias("offset")).unionByName(subs)


def distance_tags(reads):
    """DIST= values in record comments."""
    d = F.regexp_extract("comment", "DIST=([0-9]+)", 1)
    return reads.select(F.when(d != "", d.cast("long")).alias("dist")).filter("dist is not null").groupBy("dist").agg(F.count(F.lit(1)).alias("n"))
