"""Token files: ids coded by a static range asymmetric numeral system (operator 6).

A file is a Parquet table, so it lives in any store that Spark writes to. Documents come in ascending doc_id order, cut
into ranges, and these into segments; a segment has one frequency table, which its blocks share. A block holds whole
documents and is coded by itself with LANES interleaved states, one 16-bit word at most for each symbol. Its checkpoints
keep the states and the place in the word stream every STEPS steps, with a CRC of the ids up to the next one: decoding
may start at any of them.

    range, segment, block    order of the blocks
    table     binary         zlib of the symbols used, then their frequencies (sum 2^16), both uint32; the same value in
                             all blocks of a segment, so Parquet's dictionary keeps it once
    inside    long           ids of the range before this block
    n_ids     long           ids in the block
    doc_ids   array<long>    documents of the block in order
    lengths   array<long>    their numbers of ids
    words     binary         uint16 stream, in the order of decoding
    marks     array<struct>  checkpoints: step int, word long, states binary (uint32), crc long
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genespark.llm import tokens

SCALE = 16
LANES = 4096
#: Steps of all lanes between two checkpoints.
STEPS = 64
BLOCK_IDS = 1 << 19
SEGMENT_IDS = 1 << 22

_MARK = T.StructType(
    [T.StructField("step", T.IntegerType()), T.StructField("word", T.LongType()), T.StructField("states", T.BinaryType()), T.StructField("crc", T.LongType())]
)
SCHEMA = T.StructType(
    [
        T.StructField("range", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("table", T.BinaryType()), T.StructField("inside", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("words", T.BinaryType()), T.StructField("marks", T.ArrayType(_MARK)),
    ]
)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Scale counts so that they sum to 2^SCALE and every symbol that occurs keeps at least 1."""
    total, used = 1 << SCALE, counts > 0
    if used.sum() > total:
        raise ValueError(f"{used.sum()} different ids do not fit into a table of {total}")
    freq = np.where(used, np.maximum(1, counts * total // max(1, int(counts.sum()))), 0)
    excess = int(freq.sum()) - total
    order = np.argsort(-freq, kind="stable")
    while excess > 0:  # take from the most frequent ones what the floors of 1 cost
        room = freq[order] - 1
        cut = np.minimum(room, -(-excess * room // max(1, int(room.sum()))))
        over = np.cumsum(cut) - excess
        cut = np.where(over > 0, np.maximum(0, cut - over), cut)
        freq[order] -= cut
        excess = int(freq.sum()) - total
    freq[order[0]] -= excess
    return freq


class Table:
    """Symbols, frequencies, and what coding looks up in them."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype(np.uint32), freq.astype(np.uint32)
        self.low = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint32)
        # for each of the 2^SCALE slots: its symbol, that symbol's frequency, and how far into it the slot lies
        self.symbol_at, self.freq_at = np.repeat(self.symbols, freq), np.repeat(self.freq, freq)
        self.rest_at = np.arange(len(self.freq_at), dtype=np.uint32) - np.repeat(self.low, freq)

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> Table:
        counts = np.zeros(0, dtype=np.int64)
        for ids in parts:
            more = np.bincount(ids)
            if len(more) > len(counts):
                counts, more = more, counts
            counts[: len(more)] += more
        symbols = np.flatnonzero(counts)
        return cls(symbols, frequencies(counts[symbols]))

    def places(self, ids: np.ndarray) -> np.ndarray:
        at = np.zeros(int(self.symbols[-1]) + 1, dtype=np.int32)
        at[self.symbols] = np.arange(len(self.symbols), dtype=np.int32)
        return at[ids]

    def dump(self) -> bytes:
        return zlib.compress(self.symbols.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes())

    @classmethod
    def load(cls, data: bytes) -> Table:
        both = np.frombuffer(zlib.decompress(data), dtype="<u4")
        return cls(both[: len(both) // 2], both[len(both) // 2 :])


def encode(ids: np.ndarray, table: Table) -> tuple[bytes, list[tuple[int, int, bytes, int]]]:
    """The word stream and the checkpoints (step, word, states, CRC up to the next) of one block."""
    at, half = table.places(ids), np.uint32(16)
    freqs, lows = table.freq[at], table.low[at]
    states = np.full(LANES, 1 << 16, dtype=np.uint32)
    out, marks, written = [], [], 0
    for step in range(-(-len(ids) // LANES) - 1, -1, -1):
        here = slice(step * LANES, (step + 1) * LANES)
        f = freqs[here]
        x = states[: len(f)]
        full = np.flatnonzero((x >> half) >= f)  # no room for another symbol: a word leaves
        leaving = x[full]
        out.append(leaving.astype("<u2"))
        written += len(full)
        x[full] = leaving >> half
        q = x // f
        x += q * (np.uint32(1 << SCALE) - f) + lows[here]
        if step % STEPS == 0:
            part = ids[step * LANES : (step + STEPS) * LANES].astype("<u4")
            marks.append((step, written, states.astype("<u4").tobytes(), zlib.crc32(part.tobytes())))
    stream = np.concatenate(out[::-1]) if out else np.zeros(0, dtype="<u2")
    return stream.tobytes(), [(step, len(stream) - back, state, crc) for step, back, state, crc in reversed(marks)]


def decode(words: bytes, marks, n_ids: int, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids between checkpoints `first` and `last` (exclusive; all by default); a wrong checksum is an error."""
    stream, half = np.frombuffer(words, dtype="<u2"), np.uint32(16)
    done = [np.zeros(0, dtype="<u4")]
    for step, word, states, crc in marks[first:last]:
        x = np.frombuffer(states, dtype="<u4").copy()
        ids = np.empty(min(STEPS * LANES, n_ids - step * LANES), dtype="<u4")
        for at in range(0, len(ids), LANES):
            y = x[: len(ids) - at]
            slot = y & np.uint32(0xFFFF)
            ids[at : at + len(y)] = table.symbol_at[slot]
            y >>= half
            y *= table.freq_at[slot]
            y += table.rest_at[slot]
            empty = np.flatnonzero(y < (1 << 16))
            y[empty] = (y[empty] << half) | stream[word : word + len(empty)]
            word += len(empty)
        if zlib.crc32(ids) != crc:
            raise ValueError("the token file is damaged: a checksum differs")
        done.append(ids)
    return np.concatenate(done)


def _segments(width: str):
    """Sorted documents (range, doc_id, ids) of whole ranges -> rows of the file; holds one segment at a time."""

    def rows(here, number, inside, held):
        table = Table.of([ids for _, ids in held])
        shared, block, docs, size = table.dump(), 0, [], 0
        for k, (doc_id, ids) in enumerate(held):
            docs.append((doc_id, ids))
            size += len(ids)
            if size >= BLOCK_IDS or k == len(held) - 1:
                words, marks = encode(np.concatenate([i for _, i in docs]), table)
                yield here, number, block, shared, inside, size, [d for d, _ in docs], [len(i) for _, i in docs], words, marks
                block, docs, inside, size = block + 1, [], inside + size, 0

    def segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, here, number, inside = [], 0, None, 0, 0
        for f in frames:
            for at, doc_id, ids in zip(f["range"], f["doc_id"], f["ids"]):
                if held and (at != here or n >= SEGMENT_IDS):
                    yield pd.DataFrame(list(rows(here, number, inside, held)), columns=SCHEMA.names)
                    number, inside = (number + 1, inside + n) if at == here else (0, 0)
                    held, n = [], 0
                here = at
                held.append((None if pd.isna(doc_id) else int(doc_id), np.frombuffer(ids, dtype=width)))
                n += len(held[-1][1])
        if held:
            yield pd.DataFrame(list(rows(here, number, inside, held)), columns=SCHEMA.names)

    return segments


#: How ids travel until they are coded: two bytes hold those of a vocabulary of up to 65,536.
WIDTH = "<u2"


def token_ids(docs: DataFrame, path: str | None = None, end: int = tokens.END, width: str = WIDTH) -> DataFrame:
    """doc_id and ids (little-endian unsigned integers, the end id last) of every row; a null text counts as empty.

    An id that `width` cannot hold is an error.
    """
    path, most = path or tokens.vocabulary_path(), np.iinfo(width).max

    def narrow(whole: np.ndarray) -> bytes:
        if whole.max() > most:
            raise ValueError(f"id {whole.max()} does not fit into {width}")
        return whole.astype(width).tobytes()

    @F.pandas_udf("binary")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = tokens.encoder(path)
        for s in texts:
            whole = (np.frombuffer(tokens.with_end(encoder, t if isinstance(t, str) else None, end), dtype="<u4") for t in s)
            yield pd.Series([narrow(w) for w in whole], dtype=object)

    return docs.select(F.col("doc_id").cast("long"), ids(F.col("text").cast("string")).alias("ids"))


def write(coded: DataFrame, path: str, bounds: list[int], width: str = WIDTH) -> None:
    """Write the ids as a token file. bounds: ascending doc_ids at which ranges end; they only deal out the work.

    Rows come in ascending doc_id order, those without one first, equal ones in the order of their ids.
    """
    ends = F.expr(f"array({','.join(f'{b}L' for b in bounds)})") if bounds else F.array().cast("array<bigint>")
    ranged = coded.withColumn("range", F.size(F.filter(ends, lambda b: b < F.coalesce(F.col("doc_id"), b))))
    rows = ranged.repartition(len(bounds) + 1, "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "ids")
    rows.select("range", "doc_id", "ids").mapInPandas(_segments(width), SCHEMA).write.parquet(path)


def doc_bounds(docs: DataFrame, ranges: int) -> list[int]:
    """About equal shares of the rows by doc_id, from an approximate quantile of that column alone."""
    if ranges < 2:
        return []
    q = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / ranges for k in range(1, ranges)], 10_000).alias("q")).first()["q"]
    return sorted(set(q or []))


def read(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document of a token file.

    The sizes of the ranges (as many as the writer was given) go through the driver; blocks are decoded where they lie.
    """
    stored = spark.read.schema(SCHEMA).parquet(path)
    before, total = {}, 0
    for r in stored.groupBy("range").agg(F.sum("n_ids").alias("n")).orderBy("range").collect():
        before[r["range"]] = total
        total += r["n"]

    def decoded(frames):
        known, table = None, None
        for f in frames:
            for r in f.itertuples(index=False):
                if r.table != known:
                    known, table = r.table, Table.load(r.table)
                marks = [(m["step"], m["word"], m["states"], m["crc"]) for m in r.marks]
                ids, at, out = decode(r.words, marks, r.n_ids, table), 0, []
                for doc_id, n in zip(r.doc_ids, r.lengths):
                    out.append((doc_id, before[r.range] + r.inside + at, n, zlib.crc32(ids[at : at + n])))
                    at += n
                yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    rows = stored.select("range", "inside", "n_ids", "table", "doc_ids", "lengths", "words", "marks")
    return rows.mapInPandas(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, vocabulary: str | None = None, ranges: int | None = None) -> DataFrame:
    """Tokenise every text, write the token file at `path` and read it back: see `read`.

    Null and empty texts are their end id alone; repeated rows follow each other; an empty table gives an empty file.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    write(token_ids(docs, vocabulary), path, doc_bounds(docs, ranges))
    return read(spark, path)
