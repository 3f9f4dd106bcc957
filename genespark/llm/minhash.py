"""b-bit MinHash over word shingles: signatures, bands, verified links and their components.

Items (documents, paragraphs) become vertices once per distinct shingle set, so exact copies cost one vertex. Bands
only propose pairs; packed 2-bit minima estimate their similarity by counting bits, the rest is compared on full sets.
No bucket is ever written out as all its pairs: every member is first compared with one leader of its bucket, and
only members that are still in different components meet each other, inside a join condition.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genespark.llm.common import U64, distinct, hashes_at, in_slices, lower_hashes, mix, release, shingle_hashes, shingles_in_order, stash, utf8, word_places

#: Hash functions of a signature, two low bits of each minimum are kept: 256 bits, four longs.
HASHES, BITS, LONGS = 128, 2, 4
#: Of the wide signature, for members of large groups that the short one cannot tell apart: 64 longs.
WIDE_HASHES, WIDE_LONGS = 2048, 64
#: Shingles whose minima are taken in one pass: their products stay in the cache of a core.
SHARED = 256
_A = mix(np.arange(1001, 1001 + WIDE_HASHES, dtype=U64)) | U64(1)
_B = mix(np.arange(5001, 5001 + WIDE_HASHES, dtype=U64))

ITEM = T.StructType(
    [
        T.StructField("pid", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("item", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("print", T.BinaryType()),
        *[T.StructField(f"s{i}", T.LongType()) for i in range(LONGS)],
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("hash", T.LongType()),
    ]
)


def fingerprint(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def minima(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """The least value of each hash function, over blocks of shingles so that memory stays small for any text."""
    block = max(1, 65_536 // hashes)
    low = np.full(hashes, np.iinfo(U64).max, dtype=U64)
    for at in range(0, len(shingles), block):
        x = shingles[at : at + block, None] * _A[:hashes]
        x += _B[:hashes]
        np.minimum(low, x.min(axis=0), out=low)
    return low ^ (low >> U64(32))  # the high bits decided; let the low ones, which are kept, depend on them


def minima_of(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """A row of minima for each (non-empty) set. Small sets share one pass of numpy; a large one goes by itself."""
    low = np.empty((len(sets), hashes), dtype=U64)
    small = [k for k, x in enumerate(sets) if len(x) <= SHARED]
    for k, x in enumerate(sets):
        if len(x) > SHARED:
            low[k] = minima(x, hashes)
    at = 0
    while at < len(small):
        to, size = at, 0
        while to < len(small) and (to == at or size + len(sets[small[to]]) <= SHARED):
            size += len(sets[small[to]])
            to += 1
        group = [sets[k] for k in small[at:to]]
        x = np.concatenate(group)[:, None] * _A[:hashes]
        x += _B[:hashes]
        least = np.minimum.reduceat(x, np.cumsum([0, *map(len, group[:-1])]), axis=0)
        low[small[at:to]] = least ^ (least >> U64(32))
        at = to
    return low


def pack(low: np.ndarray) -> np.ndarray:
    """Two low bits of each minimum, 32 to a long; one row or many."""
    bits = (low & U64(3)).reshape(*low.shape[:-1], -1, 32) << (U64(2) * np.arange(32, dtype=U64))
    return np.bitwise_or.reduce(bits, axis=-1).view(np.int64)


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    used = low[..., : bands * rows].reshape(*low.shape[:-1], bands, rows)
    total = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), used.shape[:-1])
    for r in range(rows):
        total = mix(total + used[..., r])
    return total.view(np.int64)


def _numbered(frames: Iterator[pd.DataFrame], cut: Callable, size: int, bands: int, rows: int) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    columns = [f.name for f in ITEM]

    def signed(out, sets):
        full = [k for k, x in enumerate(sets) if len(x)]
        low = minima_of([sets[k] for k in full], HASHES)
        keys = dict(zip(full, zip(pack(low).tolist(), band_keys(low, bands, rows).tolist()))) if full else {}
        none = ([None] * LONGS, None)
        whole = [(*row[:-1], *keys.get(k, none)[0], keys.get(k, none)[1], row[-1]) for k, row in enumerate(out)]
        frame = pd.DataFrame(whole, columns=columns)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        for i in range(LONGS):
            frame[f"s{i}"] = pd.array([r[8 + i] for r in whole], dtype="Int64")
        return frame

    for frame in frames:
        out, sets, held = [], [], 0
        for doc_id, text, hashed in zip(frame["doc_id"], frame["text"], frame["hash"]):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            for item, start, length, n_words, sh in cut(text, size):
                out.append((number, doc_id, item, start, length, n_words, len(sh), fingerprint(sh), hashed))
                sets.append(sh)
                number, held = number + 1, held + len(sh)
            if held >= 200_000:
                yield signed(out, sets)
                out, sets, held = [], [], 0
        yield signed(out, sets)


def whole(text, size, wanted=None):
    """A document as one item: its number, start, length, number of words and shingles."""
    h = lower_hashes(text)
    yield 0, 0, len(text or ""), len(h), shingle_hashes(h, size)


def paragraphs(least: int):
    """The lines of a document with `least` words or more (of these the wanted ones), with their place in code points."""

    def cut(text, size, wanted=None):
        data = utf8(text).lower()
        starts, ends = word_places(data)
        h = hashes_at(data, starts, ends)
        first = np.searchsorted(starts, np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)).tolist()
        runs = shingles_in_order(h, size)
        at = 0
        for k, (line, i, j) in enumerate(zip((text or "").split("\n"), [0, *first], [*first, len(h)])):
            if j - i >= least and (wanted is None or k in wanted):
                yield k, at, len(line), j - i, distinct(runs[i : j - size + 1]) if j - i >= size else shingle_hashes(h[i:j], size)
            at += len(line) + 1

    return cut


def texts(docs):
    """The columns that are read; hash and doc_id tell rows apart later."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("hash"))


def items(docs: DataFrame, cut: Callable, size: int, bands: int, rows: int) -> DataFrame:
    """One row for each item that `cut` finds in the texts; pid numbers them. Stash it before use: pid is made here."""
    if bands * rows > HASHES:
        raise ValueError(f"{bands} bands of {rows} need more than {HASHES} hash functions")
    return texts(docs).mapInArrow(*in_slices(lambda frames: _numbered(frames, cut, size, bands, rows), ITEM))


def matches(a: str, b: str, hashes: int = HASHES):
    """How many of the two-bit minima are the same, from the packed longs s0, s1, ... of two sides."""
    total = F.lit(hashes)
    for i in range(hashes // 32):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        folded = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        total = total - F.bit_count(folded)
    return total


#: Share of different minima whose low bits are the same by chance.
CHANCE = 1 / 2**BITS


def estimated(a: str, b: str, hashes: int = HASHES):
    """Similarity estimated from the packed minima, corrected for chance matches."""
    return (matches(a, b, hashes) / F.lit(float(hashes)) - F.lit(CHANCE)) / F.lit(1 - CHANCE)


def least_estimate(percent: int, hashes: int = HASHES, deviations: float = 5.0) -> float:
    """A bound that the estimate of a pair at the wanted similarity misses with less than one chance in a million."""
    p = percent / 100 * (1 - CHANCE) + CHANCE
    return percent / 100 - deviations * (p * (1 - p) / hashes) ** 0.5 / (1 - CHANCE)


def wide_signatures(texts: DataFrame, size: int) -> DataFrame:
    """pid and a struct of 64 longs: 2048 minima of each item of texts (pid, text)."""

    def sign(frames):
        for f in frames:
            sets = [shingle_hashes(lower_hashes(t), size) for t in f["text"]]
            packed = pack(np.array([minima(x, WIDE_HASHES) for x in sets], dtype=U64).reshape(-1, WIDE_HASHES))
            yield pd.DataFrame({"pid": f["pid"], **{f"s{i}": packed[:, i] for i in range(WIDE_LONGS)}})

    longs = [f"s{i}" for i in range(WIDE_LONGS)]
    return texts.mapInArrow(*in_slices(sign, ", ".join(["pid long", *[f"{x} long" for x in longs]]))).select("pid", F.struct(*longs).alias("wide"))


def shingle_arrays(texts: DataFrame, size: int) -> DataFrame:
    """pid and the full set of shingle hashes of each item of texts (pid, text)."""

    def sets(frames):
        for f in frames:
            found = [shingle_hashes(lower_hashes(t), size).view(np.int64) for t in f["text"]]
            yield pd.DataFrame({"pid": f["pid"], "wide": found})

    return texts.mapInArrow(*in_slices(sets, "pid long, wide array<long>"))


def same_enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full shingle sets are similar enough. texts: pid, text of one item."""

    def check(frames):
        sets = OrderedDict()

        def shingles(pid, text):
            if pid in sets:
                sets.move_to_end(pid)
            else:
                sets[pid] = shingle_hashes(lower_hashes(text), size)
                if len(sets) > 64:
                    sets.popitem(last=False)
            return sets[pid]

        for f in frames:
            keep = [
                same_enough(shingles(a, s), shingles(b, t), percent)
                for a, b, s, t in zip(f["a"], f["b"], f["text_a"], f["text_b"])
            ]
            yield f.loc[np.array(keep, dtype=bool), ["a", "b"]]

    left = texts.select(F.col("pid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("pid").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").mapInArrow(*in_slices(check, "a long, b long", "text_a"))


def item_texts(wanted: DataFrame, docs: DataFrame, cut: Callable, size: int) -> DataFrame:
    """Text (pid, text) of the wanted items (pid, doc_id, hash, item, print), read from the documents again."""

    def find(frames):
        for f in frames:
            out = []
            for text, asked in zip(f["text"], f["asked"]):
                rest = {(a["item"], bytes(a["print"])): a["pid"] for a in asked}
                places = {a["item"] for a in asked}
                for item, start, length, _, sh in cut(text, size, places):
                    pid = rest.get((item, fingerprint(sh)))
                    if pid is not None:
                        out.append((pid, text[start : start + length]))
            yield pd.DataFrame(out, columns=["pid", "text"])

    # the items of one document that are wanted: bounded by that document
    asked = wanted.groupBy(F.col("hash").alias("h"), F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("pid", "item", "print")).alias("asked"))
    found = texts(docs).join(asked, (F.col("hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("of")))
    return found.select("text", "asked").mapInArrow(*in_slices(find, "pid long, text string")).dropDuplicates(["pid"])


def components(edges: DataFrame) -> DataFrame:
    """(pid, root) for every vertex of the edges (a, b); root is the least vertex that is reachable.

    Alternates large stars (neighbours above a vertex move to its least neighbour) and small stars (those below do),
    until the edges stay the same: a logarithmic number of rounds, each joined and written, none through the driver.
    """
    edges = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())

    def mark(e):
        return tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())

    was, old = mark(edges), []
    while was[0]:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stash(large.filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old += [edges, large]
        edges = stash(small.union(low).filter("a <> b").distinct())
        now = mark(edges)
        if now == was:
            break
        was = now
    release(*old)
    # at rest every vertex points at its root
    return edges.select(F.col("a").alias("pid"), F.col("b").alias("root"))


def classes(found: DataFrame, docs: DataFrame, cut: Callable, size: int, percent: int, short_items: bool = False) -> DataFrame:
    """(pid, root, copies_of) of every item with shingles: root names its component, copies_of its class of equal sets.

    found: the stashed result of `items`. Members of large groups are compared by wide signatures before their full
    sets; short items (paragraphs) have sets that are no larger than these, so their sets are compared at once.
    """
    scratch = []

    def tmp(df):
        scratch.append(stash(df))
        return scratch[-1]

    full = found.filter("n_shingles > 0")
    first = full.groupBy("print").agg(F.min("pid").alias("copies_of"))
    alike = tmp(full.select("pid", "print").join(first, "print").select("pid", "copies_of"))
    own = alike.filter("pid = copies_of").select("pid")
    one = tmp(full.join(own, "pid", "left_semi").select("pid", "doc_id", "hash", "item", "print", *[f"s{i}" for i in range(LONGS)], "bands"))
    vertices = one.select("pid", *[f"s{i}" for i in range(LONGS)])

    entries = one.select(F.explode("bands").alias("bucket"), "pid")
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    members = tmp(entries.join(shared, "bucket"))
    # the leader of a bucket is the member that meets most others in all its buckets: the source of a group of copies
    # shares nearly every bucket with each of them, so one comparison with it brings the whole group together
    met = members.groupBy("pid").agg(F.sum("many").alias("met"))
    most = members.join(met, "pid").groupBy("bucket").agg(F.max(F.struct("met", "pid")).alias("leader"))
    led = members.join(most.select("bucket", F.col("leader.pid").alias("leader")), "bucket")

    bound = least_estimate(percent)

    def near(pairs):
        x = pairs.join(vertices.alias("x").select(F.col("pid").alias("a"), F.struct(*[f"s{i}" for i in range(LONGS)]).alias("x")), "a")
        x = x.join(vertices.select(F.col("pid").alias("b"), F.struct(*[f"s{i}" for i in range(LONGS)]).alias("y")), "b")
        return x.filter(estimated("x", "y") >= bound).select("a", "b")

    star = tmp(near(led.filter("pid <> leader").select(F.col("pid").alias("a"), F.col("leader").alias("b")).distinct()))
    links = tmp(_confirmed(star, one, docs, cut, size, percent, tmp))
    roots = components(links)

    # members of one bucket that are not yet together: compare them with each other, the wide signatures included, all
    # inside the join, so that pairs far from the wanted similarity are never rows
    at = members.select("bucket", "pid").join(roots, "pid", "left").withColumn("root", F.coalesce("root", "pid"))
    apart = at.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    at = tmp(at.join(apart.select("bucket"), "bucket"))
    texts = tmp(_texts_of(at.select("pid").distinct(), one, docs, cut, size))
    short = one.select("pid", F.struct(*[f"s{i}" for i in range(LONGS)]).alias("short"), "bands")
    full_or_wide = shingle_arrays(texts, size) if short_items else wide_signatures(texts, size)
    signed = at.join(tmp(short.join(full_or_wide, "pid")), "pid")
    x, y = (signed.select("bucket", "pid", "root", *[F.col(c).alias(f"{c}_{k}") for c in ("short", "wide", "bands")]).alias(k) for k in "xy")
    close = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") < F.col("y.root"))
    close = close & (estimated("short_x", "short_y") >= bound)
    # a pair that shares several buckets is a row of the first one only
    close = close & (F.get(F.array_intersect("bands_x", "bands_y"), F.lit(0)) == F.col("x.bucket"))
    if short_items:
        both = F.size(F.array_intersect("wide_x", "wide_y"))
        close = close & (100 * both >= percent * (F.size("wide_x") + F.size("wide_y") - both))
    else:
        close = close & (estimated("wide_x", "wide_y", WIDE_HASHES) >= least_estimate(percent, WIDE_HASHES))
    rest = x.join(y, close).select(F.col("x.pid").alias("a"), F.col("y.pid").alias("b"))
    tried = star.select("a", "b").union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = tmp(rest.join(tried, ["a", "b"], "left_anti"))
    more = rest if short_items else tmp(verified(rest, texts, size, percent))
    if not more.isEmpty():
        roots = components(links.union(more))
    named = own.join(roots, "pid", "left").select(F.col("pid").alias("copies_of"), F.coalesce("root", "pid").alias("root"))
    out = stash(alike.join(named, "copies_of"))
    release(*scratch)
    return out


def _texts_of(pids, one, docs, cut, size):
    wanted = one.join(pids, "pid", "left_semi").select("pid", "doc_id", "hash", "item", "print")
    return item_texts(wanted, docs, cut, size)


def _confirmed(pairs, one, docs, cut, size, percent, tmp):
    ends = pairs.select(F.explode(F.array("a", "b")).alias("pid")).distinct()
    return verified(pairs, tmp(_texts_of(ends, one, docs, cut, size)), size, percent)
