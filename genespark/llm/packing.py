"""Best-fit packing planned on a histogram of lengths (operator 9).

Only the histogram (a row for each length up to the capacity) reaches the driver. The plan says, for runs of pieces of
one length, which sequences take them and where; pieces find their run by their rank among the pieces of their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genespark.llm import tokens
from genespark.llm.common import stash

CAPACITY = 4096


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, pieces, pieces a sequence, first sequence, offset).

    Sequences with the same room left are alike, so each step handles a run of them. The fullest sequences that still
    have room come first and are filled one after the other; new ones are opened only if none has room.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, how many)
    rooms: list[int] = []
    runs, opened = [], 0

    def give_back(left, first, many):
        if many and left:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, many = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            else:
                left, first = capacity, opened
                many = -(-rest // (capacity // length))
                opened += many
            each = left // length
            take = min(rest, each * many)
            full, over = divmod(take, each)
            runs.append((length, rank, take, each, first, capacity - left))
            give_back(left - each * length, first, full)
            give_back(left - over * length, first + full, 1 if over else 0)
            used = full + bool(over)
            give_back(left, first + used, many - used)
            rank, rest = rank + take, rest - take
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, order=("doc_id", "piece"), rows_a_chunk: int = 1_000_000) -> DataFrame:
    """pieces (with a long column length, 1 to capacity) plus sequence_id and offset; read it from a written table.

    A length that a third of all pieces have is counted in chunks, so no task ranks it alone. Rows that are equal in
    `order` may swap places. An empty table stays empty; a null or impossible length is an error.
    """
    spark = pieces.sparkSession
    found = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if any(n is None or not 1 <= n <= capacity for n in found):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    runs = spark.createDataFrame(
        plan(found, capacity), "of long, first_rank long, many long, each long, first_sequence long, first_offset long"
    )
    chunks = max(16, sum(found.values()) // rows_a_chunk)
    keyed = pieces.withColumn("chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    sizes = keyed.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    here = F.row_number().over(Window.partitionBy("length", "chunk").orderBy(*order))
    ranked = keyed.withColumn("here", here).join(sizes, ["length", "chunk"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("here") - 1)
    fits = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("many"))
    placed = ranked.join(runs, fits).withColumn("place", F.col("rank") - F.col("first_rank"))
    sequence = F.col("first_sequence") + F.floor(F.col("place") / F.col("each"))
    offset = F.col("first_offset") + F.col("place") % F.col("each") * F.col("length")
    return placed.select(*pieces.columns, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end: int = tokens.END) -> DataFrame:
    """Pieces of all texts (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    A null or empty text is its end id alone. Rows with one doc_id, or none, are packed each for itself; other columns
    are not read.
    """
    path = path or tokens.vocabulary_path()
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    cut = stash(source.mapInPandas(tokens.pieces(path, capacity, end), schema))
    return pack(cut, capacity, order=("doc_id", "piece", "ids_crc32"))
