"""Ordered computations that never need a whole chromosome in one task.

A window ``PARTITION BY chrom ORDER BY pos`` puts every row of a chromosome in one task, and one
chromosome may hold a third of the data.  Everything here cuts the position axis into tiles, works
inside a tile, and carries the state across tile borders through a summary with one row per tile.
Rows per tile are bounded by the tile length as long as positions are unique within the keys.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genespark.scratch import stash

TILE = 1 << 20
RANK_TILES = 256
HASH_SHIFT = 48

#: Rows of a wide shuffle that one task gets, about.
TASK_ROWS = 1 << 19


def tile_of(pos, size=TILE):
    return F.floor(F.col(pos) / F.lit(size)).cast("long") if isinstance(pos, str) else F.floor(pos / F.lit(size)).cast("long")


def width(spark, rows):
    """Shuffle partitions by the number of rows, so that what one task holds does not grow with it."""
    return max(spark.sparkContext.defaultParallelism, rows // TASK_ROWS + 1)


def spread(df, *keys, rows=0):
    """Hash partitioning on the grouping keys with the session's full shuffle width, or more if there are so many ``rows``.

    Grouped Python work costs far more per byte than AQE assumes when it merges small shuffle partitions; a
    fixed number is left alone, and the following groupBy on the same keys needs no further exchange.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows and width(spark, rows)), *keys)


def _tiled(df, pos, size):
    return df.withColumn("_tile", tile_of(pos, size))


def with_neighbour(df, keys, pos, value, out, size=TILE, side="prev"):
    """Value of the row before (or after) in position order, across tile borders."""
    prev = side == "prev"
    t = _tiled(df, pos, size)
    order = F.col(pos).asc() if prev else F.col(pos).desc()
    w = W.partitionBy(*keys, "_tile").orderBy(order)
    edge = (F.max_by if prev else F.min_by)(F.struct(value), F.col(pos))
    tile_order = F.col("_tile").asc() if prev else F.col("_tile").desc()
    carry = (
        t.groupBy(*keys, "_tile").agg(edge.alias("_edge"))
        .withColumn("_carry", F.lag("_edge").over(W.partitionBy(*keys).orderBy(tile_order)))
        .drop("_edge")
    )
    return (
        t.withColumn("_local", F.lag(F.struct(value)).over(w))
        .join(carry, [*keys, "_tile"])
        .withColumn(out, F.coalesce("_local", "_carry")[value])
        .drop("_local", "_carry", "_tile")
    )


def running_sum(df, keys, pos, sums, size=TILE):
    """``sums`` maps output name to a column; each output is the inclusive running total by position."""
    t = _tiled(df, pos, size)
    for name, col in sums.items():
        t = t.withColumn(f"_v_{name}", col)
    w = W.partitionBy(*keys, "_tile").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    totals = t.groupBy(*keys, "_tile").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    totals = totals.select(
        *keys, "_tile", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums]
    )
    out = t.select("*", *[F.sum(f"_v_{n}").over(w).alias(f"_l_{n}") for n in sums]).join(totals, [*keys, "_tile"])
    for n in sums:
        out = out.withColumn(n, F.col(f"_l_{n}") + F.col(f"_b_{n}"))
    return out.drop("_tile", *[f"_{p}_{n}" for n in sums for p in "vlb"])


def running_max_before(df, keys, pos, tie, value, out, size=TILE):
    """Largest ``value`` over the rows strictly before this one in (pos, tie) order; NULL for the first."""
    t = _tiled(df, pos, size)
    w = W.partitionBy(*keys, "_tile").orderBy(pos, *tie).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    tops = t.groupBy(*keys, "_tile").agg(F.max(value).alias("_m"))
    tops = tops.select(*keys, "_tile", F.max("_m").over(before).alias("_before"))
    return (
        t.withColumn("_local", F.max(value).over(w))
        .join(tops, [*keys, "_tile"])
        .withColumn(out, F.greatest("_local", "_before"))
        .drop("_local", "_before", "_tile")
    )


def row_numbers(df, keys, pos, out="rn", size=TILE):
    return running_sum(df, keys, pos, {out: F.lit(1).cast("long")}, size)


def islands(df, keys, pos, same_as_previous, out="island", size=TILE):
    """Number runs of consecutive rows; ``same_as_previous`` is a boolean column (NULL starts a run)."""
    opens = F.when(same_as_previous, 0).otherwise(1).cast("long")
    return running_sum(df, keys, pos, {out: opens}, size)


def rolling_rows(df, keys, pos, width, aggs, size=TILE, bucket=1 << 16):
    """Trailing frame of ``width`` records.  Buckets of consecutive records carry a halo of ``width - 1``."""
    bucket = max(bucket, width)
    numbered = row_numbers(df, keys, pos, "_rn", size).withColumn("_b", tile_of(F.col("_rn") - 1, bucket))
    reaches = (F.col("_rn") - 1) % bucket >= bucket - (width - 1)
    spread = numbered.withColumn(
        "_to", F.explode(F.when(reaches, F.array(F.col("_b"), F.col("_b") + 1)).otherwise(F.array(F.col("_b"))))
    )
    w = W.partitionBy(*keys, "_to").orderBy("_rn").rowsBetween(-(width - 1), 0)
    out = spread.select("*", *[c.over(w).alias(n) for n, c in aggs.items()])
    return out.filter(F.col("_to") == F.col("_b")).drop("_rn", "_b", "_to")


def cumulative_counts(df, keys, value, weight=None, tiles=RANK_TILES):
    """Distinct values with their count ``n`` and inclusive cumulative count ``cum`` in value order.

    Equal values are merged before the shuffle, so a value held by a third of the rows is one row here.
    The value axis is cut at approximate quantiles; the cuts only steer the split, the counts are exact.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))
    probs = [i / tiles for i in range(1, tiles)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, F.lit(probs), F.lit(10 * tiles)).alias("_cuts"))
    t = counts.join(cuts, list(keys)) if keys else counts.withColumn("_cuts", cuts.scalar())
    # binary search: how many cut points lie below the value
    bits = F.array(*[F.lit(1 << i) for i in range(tiles.bit_length() - 1, -1, -1)])
    below = lambda k: (k <= F.size("_cuts")) & (F.get("_cuts", k - 1) < F.col(value))
    t = t.withColumn("_tile", F.aggregate(bits, F.lit(0), lambda k, b: F.when(below(k + b), k + b).otherwise(k)).cast("long")).drop("_cuts")
    w = W.partitionBy(*keys, "_tile").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    totals = t.groupBy(*keys, "_tile").agg(F.sum("n").alias("_t"))
    totals = totals.select(*keys, "_tile", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"))
    return (
        t.withColumn("_l", F.sum("n").over(w))
        .join(totals, [*keys, "_tile"])
        .withColumn("cum", F.col("_l") + F.col("_b"))
        .drop("_l", "_b", "_tile")
    )


def exact_quantiles(df, keys, value, probs, weight=None):
    """Linear-interpolation quantiles ``q0..``, one column per probability, without gathering a group."""
    ranked = cumulative_counts(df, keys, value, weight)
    known = F.col(value).isNotNull()
    total = df.groupBy(*keys).agg((F.count_if(known) if weight is None else F.sum(F.when(known, weight))).alias("_n"))
    ranked = ranked.join(total, list(keys)) if keys else ranked.withColumn("_n", total.scalar())
    aggs = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("_n") - 1)
        aggs += [
            F.min(F.when(F.col("cum") > F.floor(h), F.col(value))).alias(f"_lo{i}"),
            F.min(F.when(F.col("cum") > F.ceil(h), F.col(value))).alias(f"_hi{i}"),
            F.max(h - F.floor(h)).alias(f"_f{i}"),
        ]
    out = ranked.groupBy(*keys).agg(*aggs)
    cols = [
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"q{i}")
        for i in range(len(probs))
    ]
    return out.select(*keys, *cols)


def rank_table(df, keys, value, out):
    """Mid-rank of every distinct value."""
    ranked = cumulative_counts(df, keys, value)
    return ranked.select(*keys, value, (F.col("cum") - F.col("n") + (F.col("n") + 1) / 2.0).alias(out))


def average_ranks(df, keys, value, out):
    """Mid-rank of every row; the ranks live on distinct values and are joined back."""
    return df.join(rank_table(df, keys, value, out), [*keys, value])


def hash_rank(df, keys, ids, seed, out="rank"):
    """1-based order of a seeded hash; tiles are the leading hash bits, so they are even whatever the keys."""
    h = F.xxhash64(*[F.col(c) for c in ids], F.lit(seed))
    t = df.withColumn("_h", h).withColumn("_tile", F.shiftright("_h", HASH_SHIFT))
    w = W.partitionBy(*keys, "_tile").orderBy("_h", *ids)
    before = W.partitionBy(*keys).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    totals = t.groupBy(*keys, "_tile").agg(F.count(F.lit(1)).alias("_t"))
    totals = totals.select(*keys, "_tile", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"))
    return (
        t.withColumn("_l", F.row_number().over(w))
        .join(totals, [*keys, "_tile"])
        .withColumn(out, F.col("_l") + F.col("_b"))
        .drop("_l", "_b", "_tile", "_h")
    )


# --- greedy anchors -------------------------------------------------------------------------------


def _jump(p, gap):
    """Index of the first position beyond each position plus gap."""
    return np.searchsorted(p, p + gap, side="right")


def _exits(p, gap):
    """Last anchor of the tile when the chain enters at each position, by doubling the steps."""
    n = len(p)
    to = np.minimum(_jump(p, gap), n)
    to = np.where(to == n, np.arange(n), to)
    while True:
        further = to[to]
        if (further == to).all():
            return p[to]
        to = further


#: A step function holds what lies within the gap of its tile's start; up to this share of a tile a chromosome's functions are chained at once.
SHORT = 64


def greedy_anchors(sites, keys, pos, gap, size=TILE):
    """Anchor of every position: the first position is an anchor, and so is each next one past anchor + gap.

    The scan is sequential, yet a tile only matters to its successor through its last anchor.  Where the gap is short
    against the tile, each tile reports, for every possible entry, the anchor it would leave with (a step function);
    those short step functions are chained per key; then all tiles resolve their anchors at once.  For any other gap
    the functions are rows, composed pairwise up a tree of tiles (``_anchors_by_tree``).
    """
    keys = list(keys)
    if gap * SHORT <= size:
        return _anchors_by_chain(sites, keys, pos, gap, size)
    p = sites.select(*keys, F.col(pos).cast("long").alias(pos)).distinct()
    anchors = _anchors_by_tree(p, keys, pos, gap, size)
    marked = p.join(anchors.withColumn("_own", F.col(pos)), [*keys, pos], "left")
    return nearest(marked, keys, pos, [], "_own", "anchor", size).select(*keys, pos, "anchor")


def nearest(rows, keys, at, ties, value, out, size=TILE, forward=False):
    """Last non-NULL ``value`` up to each row in (at, ties) order, or the first one from it on; tile borders are crossed."""
    t = _tiled(rows, at, size)
    direction = F.desc if forward else F.asc
    w = W.partitionBy(*keys, "_tile").orderBy(direction(at), *[direction(c) for c in ties]).rowsBetween(W.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.col(at))
    edge = F.min_by(value, known) if forward else F.max_by(value, known)
    carry = t.groupBy(*keys, "_tile").agg(edge.alias("_edge"))
    before = W.partitionBy(*keys).orderBy(direction("_tile")).rowsBetween(W.unboundedPreceding, -1)
    carry = carry.select(*keys, "_tile", F.last("_edge", ignorenulls=True).over(before).alias("_carry"))
    return (
        t.withColumn("_local", F.last(value, ignorenulls=True).over(w))
        .join(carry, [*keys, "_tile"])
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_local", "_carry", "_tile")
    )


def _anchors_by_tree(p, keys, pos, gap, size):
    """The anchors among the distinct positions ``p``, for any gap.

    ``exit`` of a position is where the chain that enters a group of tiles there comes out of it: the first anchor past
    the group.  In a group no wider than the gap that is the next position past the gap; two neighbouring groups compose by
    a look-up of the left one's exits among the right one's entries.  Only positions that can be entries of a group have a
    row (those within the gap of its start, and the next one), so wider groups have fewer.  Going down again, each
    group passes its entry on.  Every step is a join by position, so no task holds a chromosome, or a tile of any width.
    """
    far = p.select(*keys, (F.col(pos) + gap).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_p"), F.col(pos).alias("_of"))
    here = p.select(*keys, F.col(pos).alias("_at"), F.lit(0).alias("_kind"), F.col(pos).alias("_p"), F.lit(None).cast("long").alias("_of"))
    after = nearest(here.unionByName(far), keys, "_at", ["_kind"], "_p", "_exit", size, forward=True)
    after = after.filter("_kind = 1").select(*keys, F.col("_of").alias(pos), "_exit")
    table = with_neighbour(after, keys, pos, pos, "_before", size)

    def group(c, width):
        return F.floor(F.col(c) / F.lit(width)).cast("long")

    def entries(t, width):
        start = group(pos, width) * width
        return t.filter(F.col("_before").isNull() | (F.col("_before") < start + gap))

    width = size
    if gap < size:
        table = _exits_of_tiles(table, keys, pos, size)
    while 2 * width <= gap + 1:
        width *= 2
    levels = [(width, stash(entries(table, width)))]
    span = p.agg(F.min(pos).alias("low"), F.max(pos).alias("high")).first()
    if span["low"] is None:
        return p
    while span["low"] // width != span["high"] // width:
        below = levels[-1][1]
        width *= 2
        inside = F.when(group("_exit", width) == group(pos, width), F.col("_exit"))
        right = below.select(*keys, F.col(pos).alias("_via"), F.col("_exit").alias("_out"))
        t = entries(below, width).withColumn("_via", inside).join(right, [*keys, "_via"], "left")
        t = t.select(*keys, pos, F.when(F.col("_via").isNull(), F.col("_exit")).otherwise(F.col("_out")).alias("_exit"), "_before")
        levels.append((width, stash(t)))
    entry = p.groupBy(*keys).agg(F.min(pos).alias(pos)) if keys else p.agg(F.min(pos).alias(pos))
    for (wide, _), (_, below) in zip(reversed(levels), reversed(levels[:-1])):
        out = entry.join(below.select(*keys, pos, "_exit"), [*keys, pos])
        right = out.filter(group("_exit", wide) == group(pos, wide)).select(*keys, F.col("_exit").alias(pos))
        entry = stash(entry.unionByName(right))
    if gap >= size:
        return entry
    return _anchors_of_tiles(p, entry, keys, pos, gap, size)


def _exits_of_tiles(table, keys, pos, size):
    """For a gap under a tile: the exits of positions from their tile, from those of one step each."""

    def follow(pdf):
        pdf = pdf.sort_values(pos)
        p, out = pdf[pos].to_numpy(dtype=np.int64), pdf["_exit"]
        n = len(p)
        to = np.searchsorted(p, out.fillna(-1).to_numpy(dtype=np.int64))
        inside = out.notna().to_numpy() & (to < n)
        to = np.where(inside, to, np.arange(n))
        while not (to[to] == to).all():
            to = to[to]
        return pdf.assign(_exit=out.to_numpy()[to])[[*keys, pos, "_exit", "_before"]]

    t = _tiled(table, pos, size)
    return spread(t, *keys, "_tile").groupBy(*keys, "_tile").applyInPandas(follow, table.select(*keys, pos, "_exit", "_before").schema)


def _anchors_of_tiles(p, entry, keys, pos, gap, size):
    """For a gap under a tile: all anchors, from the first one of each tile."""

    def walk(pdf):
        at = np.sort(pdf[pos].to_numpy(dtype=np.int64))
        i = int(np.searchsorted(at, pdf[pos][pdf["_entry"]].min()))
        nxt, kept = _jump(at, gap), []
        while i < len(at):
            kept.append(at[i])
            i = nxt[i]
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, pos: kept})

    marked = p.join(entry.withColumn("_entry", F.lit(True)), [*keys, pos], "left").fillna(False, ["_entry"])
    first = _tiled(entry, pos, size).select(*keys, "_tile").distinct()
    t = _tiled(marked, pos, size).join(first, [*keys, "_tile"], "left_semi")
    return spread(t, *keys, "_tile").groupBy(*keys, "_tile").applyInPandas(walk, p.select(*keys, pos).schema)


def _anchors_by_chain(sites, keys, pos, gap, size):
    t = _tiled(sites.select(*keys, pos).distinct(), pos, size)
    fields = {f.name: f.dataType for f in t.schema.fields}
    key_fields = [T.StructField(k, fields[k]) for k in keys]
    tile_field = T.StructField("_tile", T.LongType())
    longs = T.ArrayType(T.LongType())

    def summarise(pdf):
        p = np.sort(pdf[pos].to_numpy(dtype=np.int64))
        tile = int(pdf["_tile"].iloc[0])
        leave = _exits(p, gap)
        reach = int(np.searchsorted(p, tile * size - 1 + gap, side="right")) + 1
        p, leave = p[:reach], leave[:reach]
        last_of_run = np.append(leave[1:] != leave[:-1], True)
        row = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**row, "_tile": [tile], "_upto": [p[last_of_run]], "_leave": [leave[last_of_run]]})

    steps = spread(t, *keys, "_tile").groupBy(*keys, "_tile").applyInPandas(
        summarise,
        T.StructType([*key_fields, tile_field, T.StructField("_upto", longs), T.StructField("_leave", longs)]),
    )

    def chain(pdf):
        pdf = pdf.sort_values("_tile")
        entries, anchor = [], None
        for upto, leave in zip(pdf["_upto"], pdf["_leave"]):
            entries.append(anchor)
            if anchor is None:
                anchor = int(leave[0])
                continue
            i = int(np.searchsorted(upto, anchor + gap, side="right"))
            if i < len(upto):
                anchor = int(leave[i])
        out = pdf[[*keys, "_tile"]].copy()
        out["_entry"] = pd.array(entries, dtype="Int64")
        return out

    entry_schema = T.StructType([*key_fields, tile_field, T.StructField("_entry", T.LongType())])
    grouped = steps.groupBy(*keys) if keys else steps.groupBy(F.lit(0))
    entries = grouped.applyInPandas(chain, entry_schema)

    def resolve(pdf):
        p = np.sort(pdf[pos].to_numpy(dtype=np.int64))
        entry = pdf["_entry"].iloc[0]
        known = not pd.isna(entry)
        nxt = _jump(p, gap)
        anchors = np.empty(len(p), dtype=np.int64)
        i = int(np.searchsorted(p, int(entry) + gap, side="right")) if known else 0
        if known:
            anchors[:i] = int(entry)
        while i < len(p):
            anchors[i : nxt[i]] = p[i]
            i = nxt[i]
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, pos: p, "anchor": anchors})

    out_schema = T.StructType([*key_fields, T.StructField(pos, T.LongType()), T.StructField("anchor", T.LongType())])
    joined = t.withColumn(pos, F.col(pos).cast("long")).join(entries, [*keys, "_tile"])
    return spread(joined, *keys, "_tile").groupBy(*keys, "_tile").applyInPandas(resolve, out_schema)


def dense_from_zero(table, column, end=None):
    """All whole numbers from 0 to the greatest in the table, or below ``end``."""
    if end is not None:
        return table.sparkSession.range(end).select(F.col("id").alias(column))
    top = table.agg(F.max(F.col(column).cast("long")).alias("_top")).filter("_top is not null")
    return top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("_top"))).alias(column))
