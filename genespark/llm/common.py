"""What several operators share: words, 64-bit word hashes, written intermediate tables."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genespark.scratch import release, shared_folder, stash  # noqa: F401

U64 = np.uint64


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_numbers_from() -> int:
    """The first number of this task's rows: tasks have eight billion each. Stash what is numbered before it is used twice."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 33


def slices(batches, column: str, most: int):
    """The batches in slices that hold about `most` bytes of one string or binary column, a row at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def give_back():
    """Let the system have what this worker process has freed: it stays alive between tasks, and the executor shares its memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_slices(function, schema, column: str = "text", most: int = 1 << 22):
    """function (from and to pandas frames) and schema, for mapInArrow: it gets frames that hold about `most` bytes of one column.

    An Arrow batch may hold 64 MB of text; as Python objects, with arrays over all their words, that is many times more.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # gives freed batches back
        for frame in function(b.to_pandas(integer_object_nulls=True) for b in slices(batches, column, most)):
            if len(frame):
                yield pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)
        give_back()

    return run, schema


def attach(rows, groups, keys: list[str], spread: str):
    """rows with the other columns of their group (null if it is not there). groups: one row for each key, with group_size.

    A group of over a thousandth of all rows in groups is one of a thousand at most, so these are broadcast; the others
    are joined by key. Rows of the large ones are dealt by `spread` then, which is any column that tells rows apart.
    """
    more = [c for c in groups.columns if c not in keys]
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    large = groups.filter(F.col("group_size") * 1000 > total)
    hot = large.select(*keys, F.struct(*more).alias("_hot"))
    cold = groups.filter(F.col("group_size") * 1000 <= total).select(*keys, F.lit(0).cast("long").alias("_salt"), F.struct(*more).alias("_cold"))
    out = rows.join(F.broadcast(hot), keys, "left")
    out = out.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1000))).cast("long"))
    # by a shuffle at every size
    out = out.join(cold.hint("merge"), [*keys, "_salt"], "left").withColumn("_of", F.coalesce("_hot", "_cold"))
    return out.select(*rows.columns, *[F.col(f"_of.{c}").alias(c) for c in more])


def words(text: str | None) -> list[bytes]:
    """Words between the six ASCII white-space characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
#: What XXH3 mixes into words of up to 3, 8 and 16 bytes (its default secret), and its multipliers.
_FLIPS = tuple(map(U64, (0x87275A9B, 0xC73AB174C5ECD5A2, 0x6782737BEA4239B9, 0xAF56BC3B0996523A)))
_PRIMES = tuple(map(U64, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x9FB21C651E98DF25, 0x165667919E3779F9)))


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes where words between ASCII white space start and end."""
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = _SPACE[np.frombuffer(data, dtype=np.uint8)]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[::2], edges[1::2]


def _folded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The high and the low half of the 128-bit products, xored."""
    low, half = U64(0xFFFFFFFF), U64(32)
    a, b, c, d = x & low, x >> half, y & low, y >> half
    middle = b * c + (a * c >> half)
    other = a * d + (middle & low)
    return x * y ^ (b * d + (middle >> half) + (other >> half))


def hashes_at(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """xxh3_64 of the words of `data`, as WordHashes has it: for words of up to 16 bytes in arrays, all at once."""
    size = ends - starts
    h = np.empty(len(size), dtype=U64)
    padded = data + bytes(8)
    byte = np.frombuffer(padded, dtype=np.uint8)
    four, eight = (np.ndarray(len(data) + 1, dtype=t, buffer=padded, strides=(1,)) for t in ("<u4", "<u8"))

    k = np.flatnonzero(size <= 3)
    at, n = starts[k], size[k]
    x = byte[at].astype(U64) << U64(16) | byte[at + (n >> 1)].astype(U64) << U64(24) | byte[at + n - 1].astype(U64) | n.astype(U64) << U64(8)
    x ^= _FLIPS[0]
    x ^= x >> U64(33)
    x *= _PRIMES[0]
    x ^= x >> U64(29)
    x *= _PRIMES[1]
    h[k] = x ^ (x >> U64(32))

    k = np.flatnonzero((size > 3) & (size <= 8))
    at, n = starts[k], size[k]
    x = four[at + n - 4].astype(U64) + (four[at].astype(U64) << U64(32))
    x ^= _FLIPS[1]
    x ^= (x << U64(49) | x >> U64(15)) ^ (x << U64(24) | x >> U64(40))
    x *= _PRIMES[2]
    x ^= (x >> U64(35)) + n.astype(U64)
    x *= _PRIMES[2]
    h[k] = x ^ (x >> U64(28))

    k = np.flatnonzero((size > 8) & (size <= 16))
    at, n = starts[k], size[k]
    x, y = eight[at] ^ _FLIPS[2], eight[at + n - 8] ^ _FLIPS[3]
    x = n.astype(U64) + x.byteswap() + y + _folded(x, y)
    x ^= x >> U64(37)
    x *= _PRIMES[3]
    h[k] = x ^ (x >> U64(32))

    for k in np.flatnonzero(size > 16):
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return h


def lower_hashes(text: str | None) -> np.ndarray:
    """xxh3_64 of each word of a text, with A-Z lower-cased (and no other letter)."""
    data = utf8(text).lower()
    return hashes_at(data, *word_places(data))


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it holds `most` words, so its memory is bounded."""

    def __init__(self, most=100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, ws) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=U64, count=len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


#: Odd multipliers, one for each place of a shingle.
PLACES = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def shingles_in_order(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of `size` words; a shorter text is one shingle, an empty one has none."""
    n = len(h)
    if n == 0:
        return h
    k = min(n, size)
    total = h[: n - k + 1] * PLACES[0]
    for i in range(1, k):
        total = total + h[i : n - k + 1 + i] * PLACES[i]
    return mix(total + U64(k))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted; of small arrays in a fraction of the time that np.unique takes."""
    x = np.sort(x)
    if len(x) < 2:
        return x
    new = np.empty(len(x), dtype=bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words."""
    return distinct(shingles_in_order(h, size))
