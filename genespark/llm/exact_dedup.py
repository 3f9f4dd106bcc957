"""Equal documents by composable polynomial fingerprints, confirmed byte for byte (operator 11).

A text's fingerprint is the value of its bytes as a polynomial at four fixed points modulo a prime. A part of a text adds
its own value times the point to the power of the bytes before it, so parts are hashed anywhere, in any order, and summed:
texts over `CHUNK` bytes are dealt out in chunks. Rows with one fingerprint are then compared with one of them, chunk by
chunk, in sorted streams that hold two chunks at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genespark.llm.common import attach, row_numbers_from, slices, stash

PRIME = (1 << 31) - 1
#: Points at which the polynomial of a text is evaluated.
BASES = (1_103_515_245, 1_566_083_941, 69_621 * 12_345, 1_812_433_253 % PRIME)
#: Bytes of a chunk, and of the windows that are summed at once.
CHUNK, WINDOW = 1 << 20, 1 << 18
#: Members of a group that are compared with its first row in one stream.
STREAM = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_KEY = ["f0", "f1", "n_bytes"]
_ROW = "uid long, doc_id long, n_bytes long, text_sha256 string, f0 long, f1 long, at long, part binary"
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, ddl.split(", "))])


def _powers(base: int) -> np.ndarray:
    """base ** 0, 1, ... WINDOW - 1 modulo the prime."""
    out = np.ones(WINDOW, dtype=np.uint64)
    n = 1
    while n < WINDOW:
        out[n : 2 * n] = out[:n] * np.uint64(pow(base, n, PRIME)) % np.uint64(PRIME)
        n *= 2
    return out


class Polynomial:
    """Values of byte strings at one point, lowest power first."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, _powers(base), _powers(pow(base, -1, PRIME))

    def shift(self, bytes_before: np.ndarray) -> np.ndarray:
        """What the value of a part is multiplied by when so many bytes stand before it."""
        whole, rest = np.divmod(np.asarray(bytes_before, dtype=np.int64), WINDOW)
        kinds, at = np.unique(whole, return_inverse=True)
        far = np.array([pow(self.base, int(k) * WINDOW, PRIME) for k in kinds], dtype=np.uint64)
        return self.up[rest] * far[at] % np.uint64(PRIME)

    def of_parts(self, window: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The value of each of the (non-empty) parts that a window of bytes is cut into."""
        total = np.add.reduceat(window.astype(np.uint64) * self.up[: len(window)], starts) % np.uint64(PRIME)
        return total * self.down[starts] % np.uint64(PRIME)


@lru_cache(maxsize=4)
def polynomials(bases: tuple[int, ...]) -> list[Polynomial]:
    return [Polynomial(b) for b in bases]


def values(data: bytes, ends: np.ndarray, bases: tuple[int, ...]) -> np.ndarray:
    """One row of values for each of the texts that `data` is cut into at `ends`."""
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    out = np.zeros((len(ends), len(bases)), dtype=np.uint64)
    for at in range(0, len(raw), WINDOW):
        window = raw[at : at + WINDOW]
        # the texts that have bytes in this window, and where their parts start
        first = np.searchsorted(ends, at, side="right")
        last = np.searchsorted(begins, at + len(window), side="left")
        of = np.arange(first, last)[ends[first:last] > begins[first:last]]
        starts = np.maximum(begins[of], at)
        for k, p in enumerate(polynomials(bases)):
            part = p.of_parts(window, starts - at) * p.shift(starts - begins[of]) % np.uint64(PRIME)
            out[of, k] = (out[of, k] + part) % np.uint64(PRIME)
    return out


def packed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = v.astype(np.int64)
    return v[:, 0] | v[:, 1] << 32, v[:, 2] | v[:, 3] << 32


def _prints(chunk: int, bases: tuple[int, ...], deal: bool):
    """Rows of _ROW. deal: texts over `chunk` bytes come as chunks without a fingerprint, all others without their bytes;
    otherwise every text has its fingerprint and comes in chunks."""
    schema = arrow_schema(_ROW)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = row_numbers_from()
        for batch in slices(batches, "text", 1 << 22):
            texts = [b"" if t is None else t.translate(_LOWER) for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").to_pylist()
            here = [not deal or len(t) <= chunk for t in texts]
            hashed = [t for t, h in zip(texts, here) if h]
            f0, f1 = packed(values(b"".join(hashed), np.cumsum([len(t) for t in hashed], dtype=np.int64), bases)) if hashed else ((), ())
            prints = iter(zip(map(int, f0), map(int, f1)))
            rows, held = [], 0
            for doc_id, text, h in zip(ids, texts, here):
                row = (uid, doc_id, len(text), hashlib.sha256(text).hexdigest(), *(next(prints) if h else (None, None)))
                uid += 1
                if deal and h:
                    rows.append((*row, None, None))
                    continue
                for at in range(0, max(1, len(text)), chunk):
                    rows.append((*row, at, text[at : at + chunk]))
                    held += len(rows[-1][-1])
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return read


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))


def fingerprints(docs: DataFrame, chunk: int = CHUNK, bases: tuple[int, ...] = BASES) -> DataFrame:
    """uid, doc_id, n_bytes, text_sha256, f0, f1 of every row; chunks of long texts are hashed by themselves and summed."""
    found = stash(_texts(docs).mapInArrow(_prints(chunk, bases, True), _ROW))
    columns = ["uid", "doc_id", "n_bytes", "text_sha256"]
    part_schema = "uid long, doc_id long, n_bytes long, text_sha256 string, v0 long, v1 long, v2 long, v3 long"

    def hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "part", 1 << 22):
            parts, at = batch.column("part").to_pylist(), batch.column("at").to_numpy()
            v = values(b"".join(parts), np.cumsum([len(p) for p in parts], dtype=np.int64), bases)
            shifted = [(v[:, k] * p.shift(at) % np.uint64(PRIME)).astype(np.int64) for k, p in enumerate(polynomials(bases))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *map(pa.array, shifted)], schema=arrow_schema(part_schema))

    parts = found.filter("part is not null").repartition("uid", "at").mapInArrow(hash_chunks, part_schema)
    sums = parts.groupBy(columns).agg(*[(F.sum(f"v{k}") % PRIME).alias(f"v{k}") for k in range(4)])
    joined = [F.col(f"v{k}").bitwiseOR(F.shiftleft(f"v{k + 1}", 32)).alias(f"f{k // 2}") for k in (0, 2)]
    return found.filter("part is null").select(*columns, "f0", "f1").unionByName(stash(sums.select(*columns, *joined)))


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(keys).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))


def _differing(chunks: DataFrame) -> DataFrame:
    """uid of the rows whose bytes differ from those of the first row of their group (the one with keep_id).

    chunks: uid, doc_id, f0, f1, n_bytes, at, part, group_size, keep_id. A large group is dealt over several streams, and
    the chunks of its first row go to each of them.
    """
    of = F.ceil(F.col("group_size") / F.lit(STREAM)).cast("long")
    first = chunks.filter("doc_id <=> keep_id")
    one = first.filter("at = 0").groupBy(_KEY).agg(F.max("uid").alias("uid")).select("uid")
    first = first.join(one, "uid", "left_semi").withColumn("stream", F.explode(F.sequence(F.lit(0).cast("long"), of - 1)))
    members = chunks.withColumn("stream", F.pmod(F.xxhash64("uid"), of))
    place = [*_KEY, "stream", "at"]
    both = first.select(*place, F.lit(0).alias("role"), "uid", "part").unionByName(members.select(*place, F.lit(1).alias("role"), "uid", "part"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = held = None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in [*place, "role", "uid", "part"])):
                if row[-3] == 0:
                    here, held = row[: len(place)], row[-1]
                elif row[: len(place)] != here:
                    raise ValueError("a chunk without the first row's chunk")
                elif row[-1] != held:
                    out.append(row[-2])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["uid"])

    dealt = both.repartition(*place).sortWithinPartitions(*place, "role")
    return dealt.mapInArrow(compare, "uid long").distinct()


def exact_duplicates(docs: DataFrame, chunk: int = CHUNK, bases: tuple[int, ...] = BASES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_bytes for every row of docs (doc_id, text; no other column is read).

    Texts are equal if they are so after A-Z are lower-cased and no other letter; null counts as empty, and all empty texts
    are one group. keep_id is the largest doc_id of a group; every row that repeats it is kept. Rows without doc_id are
    kept only in a group where no row has one. n_bytes is the length in UTF-8. Very long texts are hashed and compared in
    chunks. An empty table gives an empty result. Should different texts share a fingerprint, they are told apart by
    their bytes, in as many rounds as there are such texts.
    """
    prints = fingerprints(docs, chunk, bases)
    groups = _groups(prints, _KEY)
    again = stash(groups.filter("group_size > 1"))
    texts = _texts(docs).mapInArrow(_prints(chunk, bases, False), _ROW)
    chunks = stash(attach(texts, again, _KEY, "uid").filter("group_size is not null"))
    differing = stash(_differing(chunks))
    if differing.isEmpty():
        alone = F.col("group_size").isNull()
        out = attach(prints, again, _KEY, "uid")
        out = out.withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))).fillna(1, ["group_size"])
        return _judged(out)

    # different texts with one fingerprint: each round settles those that equal the first row, the rest have a first row of their own
    shared = chunks.join(differing, "uid", "left_semi").select(_KEY).distinct()
    left = chunks.join(stash(shared), _KEY, "left_semi")
    clean = prints.join(shared, _KEY, "left_anti")
    number, settled = 0, None
    while True:
        rows = left.filter("at = 0").join(differing, "uid", "left_anti").select("uid", "doc_id", "text_sha256", *_KEY, F.lit(number).alias("number"))
        settled = rows if settled is None else settled.unionByName(rows)
        if differing.isEmpty():
            break
        left = left.join(differing, "uid", "left_semi").drop("group_size", "keep_id")
        left = stash(attach(left, _groups(left.filter("at = 0"), _KEY), _KEY, "uid"))
        differing, number = stash(_differing(left)), number + 1
    rows = clean.select(settled.columns[:-1]).withColumn("number", F.lit(0)).unionByName(settled)
    rows = stash(rows)
    return _judged(attach(rows, _groups(rows, [*_KEY, "number"]), [*_KEY, "number"], "uid"))


def _judged(rows: DataFrame) -> DataFrame:
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_bytes")
