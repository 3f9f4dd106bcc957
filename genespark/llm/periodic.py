"""Periodic runs of words: maximal pairs from the tree of common prefixes (operator 13).

A run of length L and period q is a maximal pair: places i and i + q whose texts agree on L - q words and no further, on
either side. Conversely a maximal pair at distance q that agrees on `exponent - 1` times q words or more is a run, so
nothing is extended; of several pairs with one stretch (distances q, 2q, ...) the least distance is the period.

The tree is walked bottom-up over sorted suffixes: a node is an interval of suffixes with a common prefix, and its places
are listed with the word on their left. When two children meet, pairs between them agree on exactly the node's prefix;
those with different left words are maximal. Of a node's prefix w, the occurrences within |w| / 2 words of a place are evenly
spaced, and all but the first of them have the same word on their left (it is part of w). So a window of a list has at most
two classes of left words, and its first two places name them: each place costs a search and its results.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genespark.llm.common import slices, words

_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUN), ("collapsed", pa.string())])
_BLOCK = 2048


class Places:
    """An ascending list in blocks, so that a place is put into a very long one without moving the whole."""

    __slots__ = ("blocks", "size")

    def __init__(self, place: int):
        self.blocks, self.size = [[place]], 1

    def add(self, place: int):
        k = self._block(place)
        block = self.blocks[k]
        block.insert(bisect_left(block, place), place)
        self.size += 1
        if len(block) > _BLOCK:
            self.blocks[k : k + 1] = [block[: _BLOCK // 2], block[_BLOCK // 2 :]]

    def _block(self, place: int) -> int:
        if len(self.blocks) == 1:
            return 0
        lo, hi = 0, len(self.blocks) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if self.blocks[mid][-1] < place:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def from_(self, place: int):
        """The places from `place` on."""
        k = self._block(place)
        at = bisect_left(self.blocks[k], place)
        while k < len(self.blocks):
            block = self.blocks[k]
            for i in range(at, len(block)):
                yield block[i]
            k, at = k + 1, 0


def _distinct(pairs: np.ndarray):
    """Ranks of values in ascending order, from 0, and how often each occurs."""
    kinds, at, many = np.unique(pairs, return_inverse=True, return_counts=True)
    return at.astype(np.int64), many


def _next_rank(rank: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    return (rank << np.int64(32)) | (ahead + 1)


def _near_repeats(codes: np.ndarray, doc: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Which places may belong to a pair: the words from them on occur again, so near that a run may be there.

    Grams of `least`, 2 * least, ... words: a pair that agrees on l words, at most l / (exponent - 1) apart, shares its
    gram of the greatest such size up to l, and between the two nearest places with one gram the distance is no greater.
    """
    n = len(codes)
    near = np.zeros(n, dtype=bool)
    # every word of a run occurs as often as the period fits
    word, many = _distinct(doc.astype(np.int64) << np.int64(32) | codes)
    rank = np.full(n + 1, -1, dtype=np.int64)
    rank[:n] = np.where(many[word] >= exponent, word, -1)
    size = 1

    def longer(by):
        """Ranks of grams that are `by` words longer, where they occur twice."""
        out = np.full(n + 1, -1, dtype=np.int64)
        at = np.flatnonzero(rank[:n] >= 0)
        at = at[rank[np.minimum(at + by, n)] >= 0]
        if len(at):
            kind, many = _distinct(_next_rank(rank[at], rank[at + by]))
            twice = many[kind] > 1
            out[at[twice]] = kind[twice]
        return out

    while size < least:
        by = min(size, least - size)
        rank, size = longer(by), size + by
    while (rank >= 0).any():
        at = np.flatnonzero(rank >= 0)
        order = np.argsort(rank[at], kind="stable")
        place, kind = at[order], rank[at][order]
        close = (kind[1:] == kind[:-1]) & ((exponent - 1) * (place[1:] - place[:-1]) < 2 * size)
        near[place[1:][close]] = True
        near[place[:-1][close]] = True
        rank, size = longer(size), 2 * size
    return near


def _suffixes(codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, and on how many words each agrees with the one before.

    Ranks of 1, 2, 4, ... words are kept (a doubling each), which gives the common prefix of any two places by a descent.
    Every text of `codes` has to end in a code of its own.
    """
    n = len(codes)
    rank, many = _distinct(codes)
    levels, size = [], 1
    while True:
        levels.append(np.append(rank, -1).astype(np.int32))
        if len(many) == n:
            break
        ahead = np.full(n, -1, dtype=np.int64)
        ahead[: max(0, n - size)] = rank[size:]
        rank, many = _distinct(_next_rank(rank, ahead))
        size *= 2
    order = places[np.argsort(rank[places])]
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a + common, n)] == levels[k][np.minimum(b + common, n)]
        common += same.astype(np.int64) << k
    return order, common


def _pairs(order: list[int], common: list[int], left: list[int], base: int, least: int, exponent: int) -> dict[tuple[int, int], int]:
    """(start, length) -> period of every run, from sorted places and their common prefixes."""
    found: dict[tuple[int, int], int] = {}

    def emit(a, b, depth):
        i, q = (a, b - a) if a < b else (b, a - b)
        if depth >= (exponent - 1) * q and depth + q >= least:
            key = (i, depth + q)
            if found.get(key, q) >= q:
                found[key] = q

    def meet(x: Places, y: Places, depth: int) -> Places:
        if x.size < y.size:
            x, y = y, x
        reach = depth // (exponent - 1)
        for p in y:
            own, second = left[p], None
            for k, other in enumerate(x.from_(p - reach)):
                if other > p + reach:
                    break
                if k == 1 and left[other] == own:
                    break  # so have all that follow
                if left[other] != own:
                    emit(p, other, depth)
        for p in y:
            x.add(p)
        return x

    open_: list[list] = []
    node = Places(order[0]) if order else None
    for place, depth in zip(order[1:], common):
        while open_ and open_[-1][0] > depth:
            d, other = open_.pop()
            node = meet(other, node, d)
        if depth < base:
            open_, node = [], Places(place)
            continue
        if open_ and open_[-1][0] == depth:
            open_[-1][1] = meet(open_[-1][1], node, depth)
        else:
            open_.append([depth, node])
        node = Places(place)
    while open_:
        d, other = open_.pop()
        node = meet(other, node, d)
    return found


def runs_of(texts: list[np.ndarray], least: int = 6, exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text (codes of its words), ascending by start, then period."""
    if exponent < 3:
        raise ValueError("the exponent is three at least")
    base = min(max(least - q, (exponent - 1) * q) for q in range(1, least + 1))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    size = np.array([len(t) for t in texts], dtype=np.int64)
    if not size.sum():
        return out
    # a code of its own after each text keeps grams and prefixes within it
    top = max(int(t.max()) for t in texts if len(t)) + 1
    codes = np.concatenate([np.append(t, top + k) for k, t in enumerate(texts)]).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    doc = np.repeat(np.arange(len(texts)), size + 1)
    near = _near_repeats(codes, doc, base, exponent)
    some = np.unique(doc[near])
    if not len(some):
        return out
    # only texts that may have runs are sorted; equal words in two of them are told apart by the text
    picked = np.isin(doc, some)
    at = np.flatnonzero(picked)
    codes, doc, near = codes[at], doc[at], near[at]
    kinds, codes = np.unique(doc << np.int64(40) | codes, return_inverse=True)
    order, common = _suffixes(codes.astype(np.int64), np.flatnonzero(near))
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    left = np.where(first, -1 - np.arange(len(codes)), np.concatenate(([0], codes[:-1])))
    found = _pairs(order.tolist(), common.tolist(), left.tolist(), base, least, exponent)
    for (start, length), period in found.items():
        k = int(doc[start])
        out[k].append((int(at[start] - begin[k]), length, period))
    for rows in out:
        rows.sort(key=lambda r: (r[0], r[2]))
    return out


class _Codes(dict):
    def __missing__(self, word):
        self[word] = code = len(self)
        return code


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period."""
    step = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, rewrite: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; ascending by start, then period) and collapsed for every row of docs.

    Words are what stands between ASCII white space in text. A run is a stretch whose smallest period q fits `exponent`
    times and that is `least` words long or more, and that no neighbouring word extends with that period. collapsed is the
    text without what a run holds after its first q words, its words joined by a space. `rewrite` may give, for a doc_id
    and a number of words, which original word stands at each place. Null and empty texts have no words and no runs.
    Other columns of docs are not read; repeated rows and rows without doc_id each have a row. A text of any length is
    searched whole, in memory in proportion to its words times the logarithm of their number.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 21):
            table = _Codes()
            ids = batch.column("doc_id").to_pylist()
            texts = [b"" if t is None else t for t in batch.column("text").to_pylist()]
            split = [t.split() for t in texts]
            codes = [np.fromiter(map(table.__getitem__, ws), dtype=np.int64, count=len(ws)) for ws in split]
            if rewrite is not None:
                for k, doc_id in enumerate(ids):
                    place = rewrite(doc_id, len(split[k])) if split[k] else None
                    if place is not None:
                        codes[k] = codes[k][place]
                        split[k] = [split[k][i] for i in place.tolist()]
            out = []
            for doc_id, ws, runs in zip(ids, split, runs_of(codes, least, exponent)):
                keep = ws if not runs else [ws[i] for i in np.flatnonzero(collapsed(len(ws), runs)).tolist()]
                spans = [{"start": a, "length": b, "period": c} for a, b, c in runs]
                out.append((doc_id, len(ws), spans, b" ".join(keep)))
            columns = list(zip(*out))
            text = pa.array(columns[3], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns[:3], _SCHEMA.types)), text], schema=_SCHEMA)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    spans = "array<struct<start: bigint, length: bigint, period: bigint>>"
    return texts.mapInArrow(search, f"doc_id long, n_words long, runs {spans}, collapsed string")


def longest_exponent(runs="runs"):
    """Of an array of runs the one with the greatest exact length / period; the first of equals."""
    better = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, x: F.when(better(best, x), x).otherwise(best))
