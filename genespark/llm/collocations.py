"""Phrases that are more than their parts, by direct-address tiles of ranked ids (operator 12).

Words that are frequent in their language get ids by falling frequency. Neighbouring ids fall into tiles of id ranges;
a tile is counted as one array of all its cells where it is dense, as sorted cells with counts where it is sparse. Frequent
pairs are ranked in turn, texts become sequences of their ids, and neighbours in those are phrases of one word more.

Texts travel as units: the ids of a bounded stretch of texts in one language. What a unit sends to a tile is counted in
the unit first, and the tiles of the most frequent words are dealt over several tasks before the last sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genespark.llm.common import release, row_numbers_from, slices, stash

LEAST, PERCENT, TOP, MOST_WORDS = 30, 80, 2000, 4
#: Bytes of text in a unit.
UNIT = 1 << 24
#: Ids up to HEAD are in blocks of NEAR ids (tiles of 2^20 cells, counted densely once they are full enough), others in blocks of FAR.
HEAD, NEAR, FAR = 1 << 13, 1 << 10, 1 << 13
#: Tasks for the first sums of the tile of the most frequent words; others get fewer, as their ids fall.
SALTS = 64
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_MARK = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _BREAKS, b"abcdefghijklmnopqrstuvwxyz" + b"." * len(_BREAKS))
_DICTIONARY = pa.schema([("unit", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("local", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_TILES = pa.schema([("lang", pa.string()), ("ti", pa.int64()), ("tj", pa.int64()), ("salt", pa.int64()), ("unit", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])
_SUMS = pa.schema([("lang", pa.string()), ("ti", pa.int64()), ("tj", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])
_FREQUENT = pa.schema([("lang", pa.string()), ("ti", pa.int64()), ("tj", pa.int64()), ("cell", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("f", pa.int64())])
_FOUND = pa.schema([("unit", pa.int64()), ("ti", pa.int64()), ("tj", pa.int64()), ("cells", pa.binary()), ("new", pa.binary())])
_UNITS = pa.schema([("lang", pa.string()), ("unit", pa.int64()), ("ids", pa.binary())])
_SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _packed(x: np.ndarray, width: int = 4) -> bytes:
    """Whole numbers as planes of their bytes, lowest first: the higher ones are mostly zeros, which shuffles and files compress."""
    if len(x) and int(x.max()) >> (8 * width):
        raise ValueError(f"{int(x.max())} does not fit {width} bytes")
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _unpacked(raw: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def _packed_cells(cells: np.ndarray) -> bytes:
    return _packed(np.diff(cells, prepend=0))


def _unpacked_cells(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw))


class _Codes(dict):
    def __missing__(self, word):
        self[word] = code = len(self)
        return code


def encoded(docs: DataFrame) -> DataFrame:
    """For each unit a row with its local codes (0 between pieces), and one for each of its words with code and count."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = row_numbers_from()
        for batch in slices(batches, "text", UNIT):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                table = _Codes({b".": 0})
                tokens = b".".join(texts).translate(_MARK).replace(b".", b" . ").split()
                codes = np.fromiter(map(table.__getitem__, tokens), dtype=np.int64, count=len(tokens))
                many = np.bincount(codes, minlength=len(table))
                ws = list(table)[1:]
                n = len(ws)
                if not n:
                    continue
                dictionary = [pa.array(np.full(n, unit)), pa.array([lang] * n, pa.string()), pa.array(ws, pa.binary()), pa.array(np.arange(1, n + 1)), pa.array(many[1:])]
                yield pa.RecordBatch.from_arrays([*dictionary, pa.nulls(n, pa.binary())], schema=_DICTIONARY)
                yield _batch([(unit, lang, None, None, None, _packed(codes))], _DICTIONARY)
                unit += 1

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    texts = docs.select(lang, F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(read, _ddl(_DICTIONARY))


def ranked(table: DataFrame, ties: list[str]) -> DataFrame:
    """table with id: 0, 1, ... in each lang by falling f. Equal f are in any one order.

    What is rare is many: rows with one f are dealt over tiles by hash, and only the sizes of the tiles are added up in order.
    """
    tiles = F.greatest(F.lit(1).cast("long"), F.floor(3000 / F.col("f")).cast("long"))
    t = table.withColumn("tile", F.pmod(F.xxhash64(*ties), tiles))
    many = t.groupBy("lang", "f", "tile").agg(F.count(F.lit(1)).alias("many"))
    before = W.partitionBy("lang").orderBy(F.desc("f"), "tile").rowsBetween(W.unboundedPreceding, -1)
    base = many.select("lang", "f", "tile", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(W.partitionBy("lang", "f", "tile").orderBy(*ties)) - 1
    return t.withColumn("at", within).join(base, ["lang", "f", "tile"]).withColumn("id", F.col("base") + F.col("at")).drop("tile", "at", "base")


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) and max(int(a.max()), int(b.max())) >= 1 << 31:
        raise ValueError("over two billion frequent phrases of one length in a language")
    return a << np.int64(31) | b


def _block(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < HEAD, ids // NEAR, HEAD // NEAR + (ids - HEAD) // FAR)


def _first(block: np.ndarray) -> np.ndarray:
    near = HEAD // NEAR
    return np.where(block < near, block * NEAR, HEAD + (block - near) * FAR)


def _unit_tiles(units: DataFrame) -> DataFrame:
    """What each unit sends to each tile: the cells of its pairs of neighbours, with counts. Ids of units are one more than the id, 0 a break."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, unit, packed in zip(*(batch.column(c).to_pylist() for c in ("lang", "unit", "ids"))):
                ids = _unpacked(packed) - 1
                a, b = ids[:-1], ids[1:]
                real = (a >= 0) & (b >= 0)
                keys, counts = np.unique(_keys(a[real], b[real]), return_counts=True)
                a, b = keys >> np.int64(31), keys & np.int64((1 << 31) - 1)
                ti, tj = _block(a), _block(b)
                cells = (a - _first(ti)) * FAR + (b - _first(tj))
                order = np.lexsort((cells, tj, ti))
                ti, tj, cells, counts = ti[order], tj[order], cells[order], counts[order]
                if not len(cells):
                    continue
                at = np.flatnonzero(np.concatenate(([True], (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1]))))
                salts = np.maximum(1, SALTS // ((1 + ti[at]) * (1 + tj[at])))
                salt = (unit * 2654435761 % 1000003) % salts
                ends = np.append(at[1:], len(cells)).tolist()
                rows = zip(ti[at].tolist(), tj[at].tolist(), salt.tolist(), at.tolist(), ends)
                out = [(lang, i, j, s, unit, _packed_cells(cells[x:y]), _packed(counts[x:y])) for i, j, s, x, y in rows]
                for lo in range(0, len(out), 4096):
                    yield _batch(out[lo : lo + 4096], _TILES)

    return units.mapInArrow(count, _ddl(_TILES))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]], dense: bool) -> tuple[np.ndarray, np.ndarray]:
    cells, counts = (np.concatenate(x) for x in zip(*parts))
    if dense and len(cells) * 16 >= NEAR * NEAR:
        # direct addresses; sums of whole numbers are exact up to 2^53
        total = np.bincount(cells // FAR * NEAR + cells % FAR, weights=counts, minlength=NEAR * NEAR)
        at = np.flatnonzero(total)
        return at // NEAR * FAR + at % NEAR, total[at].astype(np.int64)
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    return cells[first], np.add.reduceat(counts, first)


def _sum_tiles(tiles: DataFrame, keys: list[str], width: int, least: int | None = None) -> DataFrame:
    """One row for each tile (and salt, if it is among the keys) with the sums of its cells; with `least` one for each frequent cell.

    width: bytes of the counts that come in; sums go out in eight.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, held = None, [], 0

        def near():
            return here[1] < HEAD // NEAR and here[2] < HEAD // NEAR

        def row():
            cells, counts = _summed(parts, near())
            if least is None:
                return _batch([(*here[:3], _packed_cells(cells), _packed(counts, 8))], _SUMS)
            cells, counts = cells[counts >= least], counts[counts >= least]
            lang, ti, tj = here
            a, b = _first(np.int64(ti)) + cells // FAR, _first(np.int64(tj)) + cells % FAR
            n = len(cells)
            columns = [pa.array([lang] * n, pa.string()), pa.array(np.full(n, ti)), pa.array(np.full(n, tj)), *map(pa.array, (cells, a, b, counts))]
            return pa.RecordBatch.from_arrays(columns, schema=_FREQUENT)

        for batch in batches:
            for *key, cells, counts in zip(*(batch.column(c).to_pylist() for c in [*keys, "cells", "counts"])):
                if key != here:
                    if here is not None:
                        yield row()
                    here, parts, held = key, [], 0
                parts.append((_unpacked_cells(cells), _unpacked(counts, width)))
                held += len(parts[-1][0])
                if held > 2 * len(parts[0][0]) + (1 << 20):
                    parts = [_summed(parts, near())]
                    held = len(parts[0][0])
        if here is not None:
            yield row()

    dealt = tiles.select(*keys, "cells", "counts").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(add, _ddl(_SUMS if least is None else _FREQUENT))


def frequent_pairs(tiles: DataFrame, least: int) -> DataFrame:
    """lang, ti, tj, cell, a, b, f, id of the pairs that occur `least` times or more."""
    sums = _sum_tiles(_sum_tiles(tiles, ["lang", "ti", "tj", "salt"], 4), ["lang", "ti", "tj"], 8, least)
    return stash(ranked(stash(sums), ["a", "b"]))


def _runs(*columns: np.ndarray):
    """(from, to) of stretches of rows that agree in all columns."""
    n = len(columns[0])
    at = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))) if n else []
    return zip(at, [*at[1:], n])


def _recoded(units: DataFrame, found: DataFrame, pairs: bool) -> DataFrame:
    """Units in the ids of `found`: (unit, local, id) of single codes, or (unit, ti, tj, cells, new) of pairs of neighbours."""
    empty = {"ids": "binary", "lang": "string"} | ({"ti": "long", "tj": "long", "cells": "binary", "new": "binary"} if pairs else {"local": "long", "id": "long"})

    def padded(table, kind):
        return table.select("unit", F.lit(kind).alias("kind"), *[F.col(c) if c in table.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()])

    def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known = None, []
        for batch in batches:
            unit, kind = batch.column("unit").to_numpy(), batch.column("kind").to_numpy()
            for lo, hi in _runs(unit, kind):
                if unit[lo] != here:
                    here, known = unit[lo], []
                part = batch.slice(lo, hi - lo)
                if kind[lo] == 0 and not pairs:
                    known.append((part.column("local").to_numpy(), part.column("id").to_numpy()))
                elif kind[lo] == 0:
                    for ti, tj, cells, new in zip(*(part.column(c).to_pylist() for c in ("ti", "tj", "cells", "new"))):
                        cells = _unpacked_cells(cells)
                        known.append((_keys(_first(np.int64(ti)) + cells // FAR, _first(np.int64(tj)) + cells % FAR), _unpacked(new)))
                elif known:
                    keys, new = (np.concatenate(x) for x in zip(*known))
                    order = np.argsort(keys)
                    keys, new = keys[order], new[order]
                    asked = _unpacked(part.column("ids")[0].as_py())
                    if pairs:
                        a, b = asked[:-1] - 1, asked[1:] - 1
                        asked = np.where((a >= 0) & (b >= 0), _keys(np.maximum(a, 0), np.maximum(b, 0)), -1)
                    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    out = np.where(keys[at] == asked, new[at] + 1, 0)
                    # one break between stretches is enough
                    out = out[np.concatenate(([True], (out[1:] > 0) | (out[:-1] > 0)))] if len(out) else out
                    if out.any():
                        yield _batch([(part.column("lang")[0].as_py(), int(here), _packed(out))], _UNITS)

    both = padded(found, 0).unionByName(padded(units, 1))
    return both.repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(translate, _ddl(_UNITS))


def _found_in_units(tiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Which frequent pairs each unit holds, and their ids: the rows of a tile meet the tile's frequent cells."""
    salts = F.greatest(F.lit(1).cast("long"), F.floor(SALTS / ((1 + F.col("ti")) * (1 + F.col("tj")))).cast("long"))
    keys = ["lang", "ti", "tj", "salt"]
    none = F.lit(None).cast("long")
    known = pairs.select("lang", "ti", "tj", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), none.alias("unit"), "cell", "id", F.lit(None).cast("binary").alias("cells"))
    both = known.unionByName(tiles.select(*keys, "unit", none.alias("cell"), none.alias("id"), "cells"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, known, ids = None, [], None, None
        for batch in batches:
            out = []
            place = [batch.column(c).to_pylist() for c in keys]
            unit = batch.column("unit").to_pylist()
            cell, new = (batch.column(c).fill_null(0).to_numpy() for c in ("cell", "id"))
            cells = batch.column("cells")
            k = 0
            while k < len(unit):
                key = tuple(p[k] for p in place)
                if key != here:
                    here, parts, known = key, [], None
                if unit[k] is None:
                    # the frequent cells of a tile come first, in order
                    to = k
                    while to < len(unit) and unit[to] is None and tuple(p[to] for p in place) == here:
                        to += 1
                    parts.append((cell[k:to], new[k:to]))
                    k = to
                    continue
                if known is None and parts:
                    known, ids = (np.concatenate(x) for x in zip(*parts))
                    parts = []
                if known is not None:
                    mine = _unpacked_cells(cells[k].as_py())
                    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                    hit = known[at] == mine
                    if hit.any():
                        out.append((unit[k], key[1], key[2], _packed_cells(mine[hit]), _packed(ids[at[hit]])))
                k += 1
            yield _batch(out, _FOUND)

    return both.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_first("unit"), "cell").mapInArrow(meet, _ddl(_FOUND))


def _with_cut(table: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """l, r and score of the lowest-scoring cut of each phrase, the first of equals. cuts: columns of f of both parts."""
    part = [f"struct(2000000BD * cast(f as decimal(19,0)) div cast({x} + {y} as decimal(20,0)) as score, {k} as k, {x} as l, {y} as r)" for k, (x, y) in enumerate(cuts)]
    return table.withColumn("best", F.expr(f"array_min(array({', '.join(part)}))"))


def phrases(docs: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """lang, words, phrase, a, l, r, score, n of every candidate that no longer one covers.

    Of docs, text and lang are read (null: empty, `und`). A-Z are lower-cased; texts are cut into pieces at .,;:!? and line
    ends, and pieces into words at blanks and tabs. Everything is counted within a language: n words in all, a phrase as
    often as its words stand next to each other in a piece, overlaps included. Candidates are phrases of two to four words
    that occur `least` times (a). score is floor(2000000 * a / (l + r)) for the cut into two parts (which occur l and r
    times) that scores lowest. A candidate is left out if a longer one that holds it occurs `percent` per cent as often.
    Repeated rows count as often as they are there. Texts of any length are counted whole; an empty table has no phrases.
    """
    found = stash(encoded(docs))
    of_units = found.filter("word is not null")
    counted = of_units.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    words = stash(ranked(stash(counted.filter(F.col("f") >= least)), ["word"]))
    total = of_units.groupBy("lang").agg(F.sum("n").alias("n"))

    total = stash(total)
    ids = of_units.select("unit", "lang", "word", "local").join(words.select("lang", "word", "id"), ["lang", "word"]).select("unit", "local", "id")
    units = stash(_recoded(found.filter("ids is not null").select("lang", "unit", "ids"), ids, pairs=False))
    release(found)

    levels = []
    for size in range(2, MOST_WORDS + 1):
        tiles = stash(_unit_tiles(units))
        levels.append(frequent_pairs(tiles, least))
        was = units
        if size < MOST_WORDS:
            units = stash(_recoded(units, _found_in_units(tiles, levels[-1]), pairs=True))
        release(tiles, was)
    two, three, four = levels

    # of each phrase: how often its first and last word occur, its first and last two, its last word
    w = words.select("lang", "id", F.col("word").cast("string").alias("word"), "f")
    x = w.select("lang", F.col("id").alias("a"), F.col("word").alias("phrase"), F.col("f").alias("first"))
    y = w.select("lang", F.col("id").alias("b"), F.col("word").alias("end"), F.col("f").alias("last"))
    pairs = two.select("lang", "id", "a", "b", "f").join(x, ["lang", "a"]).join(y, ["lang", "b"])
    pairs = stash(pairs.select("lang", "id", "f", F.concat_ws(" ", "phrase", "end").alias("phrase"), "end", "first", "last"))

    def longer(level, shorter, head, tail):
        x = shorter.select("lang", F.col("id").alias("a"), "phrase", "first", F.col("f").alias("fa"), F.col(head).alias("head"))
        y = shorter.select("lang", F.col("id").alias("b"), "end", "last", F.col("f").alias("fb"), F.col(tail).alias("tail"))
        both = level.select("lang", "id", "a", "b", "f").join(x, ["lang", "a"]).join(y, ["lang", "b"])
        return both.withColumn("phrase", F.concat_ws(" ", "phrase", "end"))

    triples = stash(longer(three, pairs, "f", "f"))
    quads = longer(four, triples.select("*").drop("a", "b", "head", "tail"), "fa", "fb")

    def covered(shorter, level):
        """shorter without what a phrase of one word more covers; one of two words more occurs no more often than that one."""
        over = level.select("lang", F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("over")).groupBy("lang", "id").agg(F.max("over").alias("over"))
        return shorter.join(over, ["lang", "id"], "left").filter(F.col("over").isNull() | (100 * F.col("over").cast("decimal(20,0)") < percent * F.col("f").cast("decimal(20,0)")))

    out = [
        _with_cut(covered(pairs, three), [("first", "last")]),
        _with_cut(covered(triples, four), [("first", "fb"), ("fa", "last")]),
        _with_cut(quads, [("first", "fb"), ("head", "tail"), ("fa", "last")]),
    ]
    rows = [t.select("lang", F.lit(k + 2).alias("words"), "phrase", F.col("f").alias("a"), F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").cast("long").alias("score")) for k, t in enumerate(out)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).join(total, "lang")


def top_phrases(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each lang by score, then a (both falling), then phrase, with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = found.withColumn("tile", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "tile").orderBy(*order))).filter(F.col("rank") <= top)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order))
    return some.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
