"""Interval operators.  Intervals are 0-based and half open; positions are 1-based unless named otherwise.

Range joins become: cut the intervals into disjoint pieces with one owner each, copy the pieces into the
fixed bins they touch, and look up the last piece that starts at or before each point inside its bin.  A
point meets at most one piece, so neither nested intervals nor hot regions multiply rows.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genespark.operators import tiling

BIN = 1 << 14


def disjoint_pieces(intervals, keys, owner=None, start="start", end="end", size=tiling.TILE):
    """Non-overlapping pieces, each owned by the first covering interval in (start, end, owner) order.

    Whatever starts earlier covers a prefix of a later interval, so the part an interval owns begins at the
    largest end seen before it.
    """
    name = F.min(owner) if owner else F.lit(True)
    base = (
        intervals.filter(F.col(start) < F.col(end))
        .groupBy(*keys, F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"))
        .agg(name.alias("owner"))
    )
    seen = tiling.running_max_before(base, keys, "start", ["end"], "end", "_seen", size)
    piece_start = F.greatest(F.col("start"), F.coalesce(F.col("_seen"), F.col("start")))
    return (
        seen.withColumn("piece_start", piece_start)
        .filter(F.col("piece_start") < F.col("end"))
        .select(*keys, "piece_start", F.col("end").alias("piece_end"), F.col("start").alias("owner_start"), "owner")
    )


def locate(points, pieces, keys, zero_based, unique=False, width=BIN):
    """Add ``hit`` (owner, owner_start, piece_start, piece_end) for the piece that holds each point, else NULL."""
    keys = list(keys)
    p = points.withColumn("_p", zero_based.cast("long"))
    probe = p.select(*keys, "_p") if unique else p.select(*keys, "_p").distinct()
    info = F.struct("piece_start", "piece_end", "owner_start", "owner")
    cells = pieces.select(
        *keys,
        F.explode(F.sequence(tiling.tile_of("piece_start", width), tiling.tile_of(F.col("piece_end") - 1, width))).alias("_bin"),
        F.col("piece_start").alias("_at"),
        F.lit(0).alias("_kind"),
        info.alias("_info"),
    )
    empty = F.lit(None).cast(cells.schema["_info"].dataType)
    rows = probe.select(
        *keys, tiling.tile_of("_p", width).alias("_bin"), F.col("_p").alias("_at"), F.lit(1).alias("_kind"), empty.alias("_info")
    ).unionByName(cells)
    w = W.partitionBy(*keys, "_bin").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    found = (
        rows.withColumn("_last", F.last("_info", ignorenulls=True).over(w))
        .filter(F.col("_kind") == 1)
        .select(*keys, F.col("_at").alias("_p"), F.when(F.col("_at") < F.col("_last.piece_end"), F.col("_last")).alias("hit"))
    )
    return p.join(found, [*keys, "_p"], "left").drop("_p")


def region_filter(sites, intervals, keys=("chrom",), keep=True, pos="pos", unique=False):
    """Keep (or drop) sites with start < pos <= end of any interval."""
    hits = locate(sites, disjoint_pieces(intervals, keys), keys, F.col(pos) - 1, unique)
    cond = F.col("hit").isNotNull() if keep else F.col("hit").isNull()
    return hits.filter(cond).drop("hit")


def interval_annotation(points, genes, keys=("chrom",), pos="pos", name="name", unique=False):
    """First gene with start <= pos < end in (start, end, name) order; empty string when there is none."""
    hits = locate(points, disjoint_pieces(genes, keys, owner=name), keys, F.col(pos), unique)
    return hits.withColumn("gene", F.coalesce(F.col("hit.owner"), F.lit(""))).drop("hit")


def interval_mask(genotypes, blocks, keys=("sample", "chrom"), pos="pos", gt="gt"):
    """Set calls inside the sample's blocks (closed ends) to NULL and drop sites that lose every call."""
    closed = blocks.withColumn("_end", F.col("end") + 1)
    hits = locate(genotypes, disjoint_pieces(closed, keys, end="_end"), keys, F.col(pos), unique=True)
    masked = hits.withColumn(gt, F.when(F.col("hit").isNull(), F.col(gt))).drop("hit")
    # a site has one row per individual, so this window stays small
    any_left = F.max(gt).over(W.partitionBy("site_id"))
    return masked.withColumn("_any", any_left).filter(F.col("_any").isNotNull()).drop("_any")


def window_anti_join(snps, indels, window, keys=("chrom",), pos="pos", length="length"):
    """Drop SNPs within length + window of an indel, either side."""
    reach = F.col(length) + F.lit(window)
    around = indels.select(*keys, (F.col(pos) - 1 - reach).alias("start"), (F.col(pos) + reach).alias("end"))
    return region_filter(snps, around, keys, keep=False, pos=pos)


def flank_windows(sites, fai, width, pos="pos"):
    """Window of +/- width around each site, clamped to the contig."""
    return sites.join(fai.select("chrom", "length"), "chrom").select(
        "chrom",
        F.greatest(F.lit(0), F.col(pos) - 1 - width).cast("long").alias("start"),
        F.least(F.col("length"), F.col(pos) + width).cast("long").alias("end"),
        pos,
    )


def bin_aggregate(points, value, width, keys=("chrom",), start="start", quantiles=True):
    """Fixed bins: count, sum, mean, min, max and (optionally) the exact median of the points in each bin."""
    binned = points.withColumn("bin_start", tiling.tile_of(start, width) * width)
    group = [*keys, "bin_start"]
    stats = binned.groupBy(*group).agg(
        F.count(value).alias("n"),
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )
    if quantiles:
        middle = tiling.exact_quantiles(binned, group, value, [0.5]).withColumnRenamed("q0", "median")
        stats = stats.join(middle, group, "left")
    return stats.withColumn("bin_end", F.col("bin_start") + width)


def over_spans(spans, points, keys, at, aggregates, size=tiling.TILE):
    """For each span (keys, _start, _end; half open) the aggregates of the points in it; spans without points are left out.

    aggregates: name -> (function that merges parts, column of points).  The ends of all spans cut the axis into numbered
    pieces.  A piece is aggregated once, and so are the nodes of a binary tree over the pieces; a span is made of at most
    two nodes of each level.  So neither the depth of the overlap nor the width of a span multiplies rows.
    """
    keys = list(keys)
    ends = spans.select(*keys, F.col("_start").alias("_at")).unionByName(spans.select(*keys, F.col("_end").alias("_at"))).distinct()
    cuts = tiling.row_numbers(ends, keys, "_at", "_cut", size)
    here = points.groupBy(*keys, F.col(at).cast("long").alias("_at")).agg(*[f(c).alias(n) for n, (f, c) in aggregates.items()])
    rows = here.withColumn("_cut", F.lit(None).cast("long")).withColumn("_kind", F.lit(1)).unionByName(cuts.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    placed = tiling.nearest(rows, keys, "_at", ["_kind"], "_cut", "_piece", size).filter("_kind = 1 and _piece is not null")
    leaf = placed.groupBy(*keys, "_piece").agg(*[f(n).alias(n) for n, (f, _) in aggregates.items()])

    first, last = (cuts.select(*keys, F.col("_at").alias(e), F.col("_cut").alias(n)) for e, n in (("_start", "_a"), ("_end", "_b")))
    numbered = spans.join(first, [*keys, "_start"]).join(last, [*keys, "_end"])
    height = F.floor(F.log2(F.col("_b") - F.col("_a"))).cast("int")
    top = numbered.agg(F.coalesce(F.max(height), F.lit(0)).alias("top")).scalar()
    nodes = leaf.withColumn("_level", F.explode(F.sequence(F.lit(0), top))).withColumn("_node", F.expr("shiftright(_piece, _level)"))
    nodes = nodes.groupBy(*keys, "_level", "_node").agg(*[f(n).alias(n) for n, (f, _) in aggregates.items()])

    def parts(level):
        # what is left of the span at a level: its first node if that is a right child, its last one if that is a left child
        low, high = F.ceil(F.col("_a") / F.pow(F.lit(2.0), level)).cast("long"), F.floor(F.col("_b") / F.pow(F.lit(2.0), level)).cast("long")
        left = F.when((low < high) & (low % 2 == 1), F.struct(level.alias("_level"), low.alias("_node")))
        right = F.when((low < high) & (high % 2 == 1), F.struct(level.alias("_level"), (high - 1).alias("_node")))
        return F.array_compact(F.array(left, right))

    made_of = numbered.select(*keys, "_start", "_end", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), height), parts))).alias("_p")).select(*keys, "_start", "_end", "_p.*")
    met = made_of.join(nodes, [*keys, "_level", "_node"])
    return met.groupBy(*keys, "_start", "_end").agg(*[f(n).alias(n) for n, (f, _) in aggregates.items()])


def interval_aggregate(bins, points, value, keys=("chrom",), start="start", end="end", at="pos0"):
    """Left join points to intervals of any width and overlap and aggregate; intervals without points keep NULLs."""
    keys = list(keys)
    spans = bins.filter(F.col(start) < F.col(end)).select(*keys, F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end")).distinct()
    known = points.withColumn("_one", F.when(F.col(value).isNotNull(), 1).otherwise(0).cast("long"))
    stats = over_spans(spans, known, keys, at, {"n": (F.sum, "_one"), "total": (F.sum, value), "low": (F.min, value), "high": (F.max, value)})
    stats = stats.withColumnsRenamed({"_start": start, "_end": end}).withColumn("mean", F.try_divide("total", "n"))
    return bins.join(stats, [*keys, start, end], "left").select(*bins.columns, "n", "total", "mean", "low", "high")


def target_window_coverage(depths, targets, width, keys=("chrom",), pos="pos", depth="dp"):
    """Per target: area, covered positions, own depth, deepest, mean and shape of depth within +/- width/2.

    Depths are whole numbers; their sums and sums of squares are exact, so windows that overlap share them as pieces.
    """
    keys = list(keys)
    half = width // 2
    d = F.col(depth)
    t = targets.select(*keys, F.col(pos).cast("long").alias("target")).distinct()
    spans = t.select(*keys, (F.col("target") - half).alias("_start"), (F.col("target") + half + 1).alias("_end"))
    points = depths.select(
        *keys, F.col(pos).alias("_pos"), d.alias("_d"), (d > 0).cast("long").alias("_covered"), F.when(d > 0, d.cast("long")).otherwise(0).alias("_sum"),
        F.when(d > 0, d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).otherwise(0).alias("_squares"),
    )
    stats = over_spans(spans, points, keys, "_pos", {
        "area": (F.sum, "_d"), "nonzero": (F.sum, "_covered"), "max_depth": (F.max, "_d"), "_sum": (F.sum, "_sum"), "_squares": (F.sum, "_squares"),
    })
    stats = stats.withColumn("target", F.col("_start") + half).drop("_start", "_end")
    own = depths.groupBy(*keys, F.col(pos).cast("long").alias("target")).agg(F.max(F.when(d > 0, d)).alias("target_depth"))
    out = t.join(stats, [*keys, "target"], "left").join(own, [*keys, "target"], "left").fillna(0, ["area", "nonzero", "target_depth", "max_depth"])
    n, total = F.col("nonzero"), F.col("_sum").cast("decimal(19,0)")
    spread = (n.cast("decimal(10,0)") * F.col("_squares").cast("decimal(28,0)") - total * total).cast("double")
    out = out.withColumn("mean_depth", F.try_divide(F.col("_sum").cast("double"), n))
    out = out.withColumn("sd_depth", F.when(n > 1, F.sqrt(spread / (n.cast("double") * (n - 1)))))
    return out.select(*keys, "target", "area", "nonzero", "target_depth", "max_depth", "mean_depth", "sd_depth")


def mappability_window(windows, segments, keys=("chrom",)):
    """Mean mappability over each window; segments (start, end, score) do not overlap.

    The per-base score sum up to any coordinate is piecewise linear, so a window needs two point look-ups
    in the prefix sums instead of a join to every segment it spans.
    """
    size = F.col("end") - F.col("start")
    prefix = tiling.running_sum(segments, keys, "start", {"_cum": size * F.col("score")})
    cells = prefix.select(
        *keys, F.col("start").alias("_at"), F.struct("start", "end", "score", "_cum").alias("_seg"), F.lit(0).alias("_kind")
    )
    ends = windows.select(*keys, F.col("start").alias("_at")).unionByName(windows.select(*keys, F.col("end").alias("_at"))).distinct()
    empty = F.lit(None).cast(cells.schema["_seg"].dataType)
    rows = cells.unionByName(ends.select(*keys, "_at", empty.alias("_seg"), F.lit(1).alias("_kind")))
    looked = last_before(rows, keys, "_at", "_kind", "_seg", "_last").filter("_kind = 1")
    seg = F.col("_last")
    total = F.when(seg.isNull(), 0.0).otherwise(
        seg["_cum"] - F.greatest(F.lit(0), seg["end"] - F.col("_at")) * seg["score"]
    )
    at = looked.select(*keys, "_at", total.alias("_sum"))
    lo = at.select(*keys, F.col("_at").alias("start"), F.col("_sum").alias("_lo"))
    hi = at.select(*keys, F.col("_at").alias("end"), F.col("_sum").alias("_hi"))
    return (
        windows.join(lo, [*keys, "start"]).join(hi, [*keys, "end"])
        .withColumn("mappability", (F.col("_hi") - F.col("_lo")) / size)
        .drop("_lo", "_hi")
    )


def last_before(rows, keys, at, tie, value, out, size=tiling.TILE):
    """Last non-NULL ``value`` at or before each row in (at, tie) order, across tile borders."""
    t = rows.withColumn("_tile", tiling.tile_of(at, size))
    w = W.partitionBy(*keys, "_tile").orderBy(at, tie).rowsBetween(W.unboundedPreceding, 0)
    tops = t.filter(F.col(value).isNotNull()).groupBy(*keys, "_tile").agg(F.max_by(value, at).alias("_top"))
    tiles = t.select(*keys, "_tile").distinct().join(tops, [*keys, "_tile"], "left")
    before = W.partitionBy(*keys).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    carry = tiles.select(*keys, "_tile", F.last("_top", ignorenulls=True).over(before).alias("_carry"))
    return (
        t.withColumn("_local", F.last(value, ignorenulls=True).over(w))
        .join(carry, [*keys, "_tile"])
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_local", "_carry", "_tile")
    )
