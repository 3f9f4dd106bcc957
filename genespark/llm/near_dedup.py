"""Near-duplicate documents by b-bit MinHash (operator 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genespark.llm import minhash
from genespark.llm.common import attach, release, stash

#: 32 bands of 4: a pair at similarity 0.75 shares no band in 5 cases of a million.
SIZE, PERCENT, BANDS, ROWS = 5, 75, 32, 4


def _components(docs, size, percent, bands, rows):
    """pid, doc_id, hash, n_shingles, root of every row."""
    found = stash(minhash.items(docs, minhash.whole, size, bands, rows))
    of = minhash.classes(found, docs, minhash.whole, size, percent)
    named = found.select("pid", "doc_id", "hash", "n_shingles").join(of.select("pid", "root"), "pid", "left")
    out = stash(named.withColumn("root", F.coalesce("root", "pid")))
    release(found)
    return out


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, copies for every row of docs (doc_id, text; other columns are not read).

    Null, empty or blank texts have no shingles and stand alone. A text shorter than `size` words is one shingle.
    Repeated rows are in one component and each is returned; rows with the component's least doc_id are all kept. A
    null doc_id never names a component unless nothing else is in it; such a row is kept only then. An empty table
    gives an empty result. copies counts the rows of the component.
    """
    named = _components(docs, size, percent, bands, rows)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("group_size"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return attach(named, least, ["root"], "pid").select("doc_id", "n_shingles", "component_id", kept.alias("kept"), F.col("group_size").alias("copies"))


def drop_near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with one row of each component (the least doc_id, nulls last, then one text), all its columns unchanged.

    Rows without words all stay. Of rows that repeat that doc_id and text, the one whose other columns sort first stays.
    """
    named = _components(docs, size, percent, bands, rows)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "pid")
    best = named.groupBy("root").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    shared = attach(named, best, ["root"], "pid").filter("best is not null")
    gone = shared.filter("not (doc_id <=> best.doc_id and hash = best.hash)").select("doc_id", "hash").distinct()
    again = shared.filter("pid <> best.pid and doc_id <=> best.doc_id and hash = best.hash").select("doc_id", "hash").distinct()

    def same(t):
        return F.col("d.doc_id").eqNullSafe(t.doc_id) & (F.xxhash64("d.text") == t.hash)

    left = docs.alias("d").join(gone, same(gone), "left_anti")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = left.alias("d").join(again, same(again), "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest) if rest else F.lit(0)).alias("row"))
    once = once.select([F.col(c) if c in ("doc_id", "text") else F.col(f"row.{c}").alias(c) for c in docs.columns])
    return left.alias("d").join(again, same(again), "left_anti").unionByName(once)
