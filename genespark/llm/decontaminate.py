"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only (operator 5).

A mask looks at some places of a window of tokens and ignores the others, so a window with substituted words still
hashes alike. Hits of documents on benchmark windows are verified by comparing the tokens around them one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1: compared, 0: ignored. All masks compare the first two tokens, which a first filter uses.
MASKS = ("1101101101", "1110011011", "1111010110")
#: Tokens around a hit that are compared, on either side.
MARGIN = 32
#: A leak: `WINDOW` tokens in a row of which `AGREE` are the same (in proportion for shorter items).
WINDOW, AGREE = 13, 11
_PAIR_BITS, _SEED_BITS, _WORD = 16, 18, 32
#: Benchmark windows up to this number are broadcast (some 30 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda t: F.xxhash64(t))


def _starts(h: Column, span: int) -> Column:
    some = F.size(h) >= span
    return F.when(some, F.sequence(F.lit(0), F.greatest(F.size(h) - span, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _pair(h, i):
    return F.get(h, i).bitwiseXOR(F.shiftright(F.get(h, i + 1), 7)).bitwiseAND(F.lit(2**_PAIR_BITS - 1)).cast("int")


def _seeds(h, i, masks) -> list[Column]:
    return [F.xxhash64(F.lit(m), *[F.get(h, i + k) for k, c in enumerate(mask) if c == "1"]) for m, mask in enumerate(masks)]


def _bitmap(values: DataFrame, bits: int) -> Column:
    """Which values (below 2^bits) occur, as an array literal of fixed size."""
    rows = values.groupBy(F.shiftright("v", 5).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("v").bitwiseAND(F.lit(_WORD - 1)))).alias("bits")
    )
    words = dict.fromkeys(range(2**bits // _WORD), 0) | {r["word"]: r["bits"] for r in rows.collect()}
    return F.expr(f"array({','.join(f'{x}L' for _, x in sorted(words.items()))})")


def _known(bitmap: Column, v: Column) -> Column:
    return F.getbit(F.get(bitmap, F.shiftright(v, 5)), v.bitwiseAND(F.lit(_WORD - 1))) == 1


def _low(seed: Column) -> Column:
    return seed.bitwiseAND(F.lit(2**_SEED_BITS - 1)).cast("int")


def leaks(docs: DataFrame, benchmark: DataFrame, masks=MASKS, window: int = WINDOW, agree: int = AGREE) -> DataFrame:
    """doc_id, item_id, agreeing, compared, n_places, hash: a row for each document and benchmark item that it leaks.

    agreeing of compared tokens are the same in the best window; hash is xxhash64 of the document's text. Items with
    equal tokens count as the one with the least item_id. Items shorter than the masks cannot be told from chance and
    leak nothing; null texts hold no tokens. Rows with one doc_id and text give one row, an empty table none.
    """
    span = max(map(len, masks))
    items = benchmark.select("item_id", token_hashes(F.col("text").cast("string")).alias("tokens")).filter(F.size("tokens") >= span)
    items = items.groupBy("tokens").agg(F.min("item_id").alias("item_id"))
    t = F.col("tokens")
    places = items.select("item_id", "tokens", F.explode(_starts(t, span)).alias("q"))
    seeds = places.select("item_id", "q", F.explode(F.array(*_seeds(t, F.col("q"), masks))).alias("seed"))
    pairs = _bitmap(places.select(_pair(t, F.col("q")).alias("v")), _PAIR_BITS)
    known = _bitmap(seeds.select(_low(F.col("seed")).alias("v")), _SEED_BITS)
    if seeds.count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)

    text = F.col("text").cast("string")
    read = docs.select("doc_id", F.xxhash64(text).alias("hash"), token_hashes(text).alias("h"))
    h = F.col("h")
    # a filter or an inner explode here would make Spark push a copy of all this below, with h computed anew for each token
    starts = F.filter(_starts(h, span), lambda i: _known(pairs, _pair(h, i)))
    found = F.flatten(
        F.transform(
            starts,
            lambda i: F.filter(
                F.transform(F.array(*_seeds(h, i, masks)), lambda s: F.struct(i.alias("p"), s.alias("seed"))),
                lambda x: _known(known, _low(x["seed"])),
            ),
        )
    )
    around = F.transform(
        found,
        lambda x: F.struct(
            x["p"].alias("p"), x["seed"].alias("seed"),
            F.slice(h, F.greatest(x["p"] - MARGIN, F.lit(0)) + 1, F.least(x["p"], F.lit(MARGIN)) + span + MARGIN).alias("around"),
        ),
    )
    hits = read.select("doc_id", "hash", F.explode_outer(around).alias("x")).select("doc_id", "hash", "x.*").join(seeds, "seed")
    # one comparison for the hits of a stretch: they lie in the margin of its first
    stretch = hits.groupBy("doc_id", "hash", "item_id", (F.col("p") - F.col("q")).alias("shift"), F.floor(F.col("p") / MARGIN).alias("part"))
    first = stretch.agg(F.min(F.struct("p", "around")).alias("x")).select("doc_id", "hash", "item_id", "shift", "x.*")
    beside = first.join(items, "item_id")

    # place k of `around` is token p - min(p, MARGIN) + k of the document, and `shift` less in the item
    start = F.greatest(F.col("p") - MARGIN, F.lit(0)) - F.col("shift")
    same = F.transform(
        F.sequence(F.lit(0), F.size("around") - 1),
        lambda k: F.when(F.get(F.col("around"), k) == F.get(F.col("tokens"), F.when(start + k >= 0, start + k)), 1).otherwise(0),
    )
    width = F.least(F.lit(window), F.size("tokens"), F.size("around"))
    compared = beside.withColumn("same", same).withColumn("width", width)
    sums = F.transform(
        F.sequence(F.lit(0), F.size("same") - F.col("width")),
        lambda k: F.aggregate(F.slice(F.col("same"), k + 1, F.col("width")), F.lit(0), lambda a, b: a + b),
    )
    scored = compared.withColumn("agreeing", F.array_max(sums))
    true = F.col("agreeing") * window >= F.col("width") * agree
    best = scored.groupBy("doc_id", "hash", "item_id").agg(
        F.max(F.when(true, F.struct("agreeing", "width"))).alias("x"), F.count_if(true).alias("n_places")
    ).filter("n_places > 0")
    return best.select("doc_id", "item_id", F.col("x.agreeing"), F.col("x.width").alias("compared"), "n_places", "hash")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that leak no benchmark item, with all their columns."""
    bad = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("id_of"), F.col("hash").alias("hash_of")).distinct()
    d = docs.alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("id_of")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("hash_of"))
    return d.join(bad, same, "left_anti")
