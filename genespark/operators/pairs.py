"""All pairs of individuals, counted on bit planes.

Emitting every pair at every site would multiply the data by the number of samples.  Here the calls of a site become
two bits each, packed by 32 into longs; a task turns the sites it holds into two planes of bits per individual and counts a
pair's comparable and differing sites by AND and population count.  Only these sums are shuffled.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genespark.operators import tiling

#: Sites whose planes are held at once, and longs of calls at which a block ends earlier.
SITE_BLOCK, HELD = 1 << 13, 1 << 22
#: Longs that one pass over pairs of individuals may make.
PAIR_WORDS = 1 << 21

# Effect classes from weakest to strongest.
IMPACTS = ["MODIFIER", "LOW", "MODERATE", "HIGH"]


def _planes(site, word, bits, sites):
    """Individuals with a call, and for each a row of longs over the sites: has a call, has one copy or two, has two."""
    words, at = np.unique(word, return_inverse=True)
    codes = np.zeros((len(words), sites), dtype=np.int64)
    codes[at, site] = bits
    shift = 2 * np.arange(32, dtype=np.int64)[None, :, None]
    width = -(-sites // 64) * 8

    def packed(plane):
        raw = np.zeros((plane.shape[0] * 32, width), dtype=np.uint8)
        raw[:, : -(-sites // 8)] = np.packbits(plane.reshape(-1, sites).astype(bool), axis=1)
        return raw.view(np.uint64)

    low, high = (packed((codes[:, None, :] >> (shift + k)) & 1) for k in (0, 1))
    called = low | high
    some = np.flatnonzero(called.any(axis=1))
    return (words[some // 32].astype(np.int64) * 32 + some % 32), called[some], high[some], (low & high)[some]


def _counts(called, one, two):
    """For all pairs i < j of rows: (i, j, differing sites, comparable sites, sum of differences)."""
    n, words = called.shape
    step = max(1, PAIR_WORDS // max(1, n * words))

    def many(x):
        return np.bitwise_count(x).sum(axis=2, dtype=np.int64)

    for lo in range(0, n, step):
        rows = slice(lo, min(n, lo + step))
        both = called[rows, None] & called[None, lo:]
        x, y = (both & (p[rows, None] ^ p[None, lo:]) for p in (one, two))
        i, j = np.meshgrid(np.arange(lo, rows.stop), np.arange(lo, n), indexing="ij")
        comparable = many(both)
        keep = (i < j) & (comparable > 0)
        yield i[keep], j[keep], many(x | y)[keep], comparable[keep], (many(x) + many(y))[keep]


def pair_counts(gts, keys=(), individuals=None, site_block=SITE_BLOCK):
    """(keys, idx_i < idx_j) -> differ, comparable, weight; ``keys`` are columns of the site (class, block).

    An individual has one call at a site (chrom, pos and, where there is one, site_id).  The individual table (idx,
    sample) saves a pass over the genotypes.
    """
    keys = list(keys)
    samples = (gts if individuals is None else individuals).select("idx", "sample").distinct()
    site = [c for c in ("site_id", "chrom", "pos") if c in gts.columns and c not in keys]
    # none 00, no copy 01, one 10, two 11
    code = F.call_function("shiftleft", (F.col("gt") + 1).cast("long"), (2 * F.pmod(F.col("idx"), F.lit(32))).cast("int"))
    g = gts.filter("gt is not null").withColumn("_w", F.floor(F.col("idx") / 32).cast("long"))
    words = g.groupBy(*site, *keys, "_w").agg(F.bit_or(code).alias("_bits"))
    sites = words.groupBy(*site, *keys).agg(F.collect_list(F.struct("_w", "_bits")).alias("_calls")).select(*keys, "_calls")
    sites = sites.sortWithinPartitions(*keys) if keys else sites
    types = {f.name: f.dataType.simpleString() for f in sites.schema.fields}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, held, longs = None, [], 0, 0

        def block():
            site, word, bits = (np.concatenate(x) for x in zip(*parts))
            names, *planes = _planes(site, word, bits, held)
            for i, j, *sums in _counts(*planes):
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array([x.as_py()] * len(i), x.type) for x in key], pa.array(names[i].astype(np.int32)), pa.array(names[j].astype(np.int32)), *map(pa.array, sums)],
                        names=[*keys, "idx_i", "idx_j", "differ", "comparable", "weight"],
                    )

        for batch in batches:
            calls = batch.column("_calls")
            of = [batch.column(c) for c in keys]
            starts = [0]
            if keys:
                same = np.ones(batch.num_rows - 1, dtype=bool)
                for c in of:
                    at = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
                    same &= at[1:] == at[:-1]
                starts += (np.flatnonzero(~same) + 1).tolist()
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
                here = [c[lo] for c in of]
                if parts and here != key:
                    yield from block()
                    parts, held, longs = [], 0, 0
                key = here
                while lo < hi:
                    take = min(hi - lo, site_block - held)
                    some = calls.slice(lo, take)
                    at = np.repeat(np.arange(take), some.value_lengths().to_numpy())
                    flat = some.flatten()
                    parts.append((held + at, flat.field("_w").to_numpy(), flat.field("_bits").to_numpy()))
                    lo, held, longs = lo + take, held + take, longs + len(at)
                    if held == site_block or longs > HELD:
                        yield from block()
                        parts, held, longs = [], 0, 0
        if parts:
            yield from block()

    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "idx_i int, idx_j int, differ long, comparable long, weight long"])
    total = sites.mapInArrow(count, schema).groupBy(*keys, "idx_i", "idx_j").agg(*[F.sum(c).alias(c) for c in ("differ", "comparable", "weight")])
    name = lambda s: samples.select(F.col("idx").cast("int").alias(f"idx_{s}"), F.col("sample").alias(s))
    return total.join(name("i"), "idx_i").join(name("j"), "idx_j").drop("idx_i", "idx_j")


def pairwise_distance(gts, block=None, **kw):
    """Share of differing sites among sites where both individuals are homozygous, whole or per grid block."""
    homo = gts.filter("gt in (0, 2)")
    keys = []
    if block:
        homo = homo.withColumn("block", (F.floor(F.col("pos") / block) * block).cast("long"))
        keys = ["chrom", "block"]
    p = pair_counts(homo, keys, **kw)
    return p.select(*keys, "i", "j", "differ", "comparable", (F.col("differ") / F.col("comparable")).alias("distance"))


def pairwise_distance_by_class(gts, cls, **kw):
    """Allele differences per pair and per class of the site (impact class or integer score)."""
    return pair_counts(gts, [cls], **kw).select("i", "j", cls, "weight", "comparable")


def rank_pairs(by_class):
    """Pairs in order of distance per comparable site; one row per pair, so the order is over few rows."""
    t = by_class.groupBy("i", "j").agg(F.sum("weight").alias("weight"), F.sum("comparable").alias("comparable"))
    t = t.withColumn("distance", F.col("weight") / F.col("comparable"))
    ordered = tiling.cumulative_counts(t, [], "distance")
    start = ordered.select("distance", (F.col("cum") - F.col("n")).alias("_start"))
    w = W.partitionBy("distance").orderBy("i", "j")
    return t.join(start, "distance").withColumn("place", (F.col("_start") + F.row_number().over(w)).cast("long")).drop("_start")


def impact_shares(by_class, most=0.5, cls="class"):
    """Share of each class in a pair's distance; pairs beyond ``most`` differences per site are dropped."""
    t = by_class.groupBy("i", "j").agg(F.sum("weight").alias("_w"), F.sum("comparable").alias("_n"))
    t = t.filter(F.col("_w") / F.col("_n") <= most)
    return by_class.join(t, ["i", "j"]).withColumn("share", F.col("weight") / F.col("_w")).drop("_w", "_n")


def percentile_bin_means(df, x, y, probs):
    """Mean of y inside the open intervals between consecutive percentiles of x."""
    q = tiling.exact_quantiles(df, [], x, probs).select(F.array(*[f"q{i}" for i in range(len(probs))]).alias("q"))
    t = df.withColumn("_q", q.scalar())
    bin_ = F.size(F.filter("_q", lambda c: c < F.col(x)))
    t = t.withColumn("bin", bin_).filter((F.col("bin") > 0) & (F.col(x) < F.try_element_at("_q", F.col("bin") + 1)))
    return t.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"))


def max_impact(info):
    """Strongest effect class in an ANN entry (third bar-separated field of each annotation)."""
    ann = F.split(F.regexp_extract(info, "(?:^|;)ANN=([^;]*)", 1), ",")
    rank = F.transform(ann, lambda a: F.array_position(F.array(*[F.lit(i) for i in IMPACTS]), F.get(F.split(a, r"\|"), F.lit(2))))
    return F.try_element_at(F.array(*[F.lit(i) for i in IMPACTS]), F.array_max(rank).cast("int"))


def score_lookup(sites, scores):
    """Left join the first score listed for a position."""
    first = scores.groupBy("chrom", "pos").agg(F.min_by("score", "line_no").alias("score"))
    return sites.join(first, ["chrom", "pos"], "left")
