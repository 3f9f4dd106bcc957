"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text gives perplexities (operator 3).

Every different word of the trusted text has an entry of its own, and every different pair of words. Counts of pairs live
in shards by pair, and so do the back-off weights and continuation shares of words by word; shards grow in number with
the trusted text. Texts meet them by sending each shard the pairs and words that belong to it. Only the most frequent
words (HEAD at most, so this has a fixed size) travel to every task: they are most of any text, and no shard gets them.
Texts go to the shards in ROUNDS parts, each written before the next begins: the disk holds what one part sends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genespark.llm.common import PLACES, U64, give_back, hashes_at, mix, release, slices, stash, utf8, word_places

#: Words that every task gets; texts look up all others in their shards, with the same result.
HEAD = 1 << 17
#: Trusted documents for each shard.
DOCS_A_SHARD = 50_000
#: Ids of trusted documents up to this number are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Parts in which texts are sent to the shards, one after the other.
ROUNDS = 6
#: Share of the trusted documents that calibrates the thresholds instead of training.
HELD_OUT = 20
#: The context of a first word.
START = 0
#: Bits of a word's hash that tell it from others.
WORD_BYTES = 6

_ROWS = "shard int, kind int, uid long, doc_id long, lang string, n long, logp double, a binary, b binary, c binary"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
_SENT = pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, _ROWS.split(", "))])
_COUNTS = "shard int, vocabulary binary, contexts binary, words binary, counts binary"
_SUMS = ("total", "ones", "twos", "more", "continuations")
_PAIRS, _WORDS, _META, _TEXT, _TAIL = range(5)


def word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words of all texts, one text after the other, and how many each text has."""
    data = [utf8(t) for t in texts]
    ends = np.cumsum([len(x) + 1 for x in data])
    data = b"\n".join(data)
    places = word_places(data)
    size = np.diff(np.searchsorted(places[0], ends), prepend=0)
    return np.maximum(hashes_at(data, *places) >> U64(64 - 8 * WORD_BYTES), U64(1)), size


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Fewer texts at a time than a batch holds: as Python objects, with arrays over all their words, they are far larger."""
    pa.set_memory_pool(pa.system_memory_pool())  # gives freed batches back
    for batch in slices(batches, "text", 1 << 22):
        yield batch.to_pydict()


def _packed(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of unsigned numbers, first bytes first: high ones are mostly equal and compress to little."""
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=U64(0))


def _place(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard (high half) and fingerprint within the shard (low half), from different bits of a hash.

    A shard has a bounded number of entries, so what 32 bits mistake for an entry is as rare at every size.
    """
    return (h >> U64(32)) % U64(shards) << U64(32) | h & U64(0xFFFFFFFF)


def _prints(places: np.ndarray) -> bytes:
    """Fingerprints of ascending places in one shard."""
    return _packed(_gaps(places & U64(0xFFFFFFFF)), 4)


def _pair_places(contexts: np.ndarray, ids: np.ndarray, shards: int) -> np.ndarray:
    return _place(mix(contexts * PLACES[0] + ids * PLACES[1]), shards)


def _word_places(ids: np.ndarray, shards: int) -> np.ndarray:
    return _place(mix(ids * PLACES[2]), shards)


def _contexts(ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The word before each word; sizes: of the texts."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[(np.cumsum(size) - size)[size > 0]] = START
    return out


def _groups(keys: np.ndarray):
    """For every run of equal high halves: the shard and its slice."""
    shard = keys >> U64(32)
    first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    for s, at, to in zip(shard[first], first, np.append(first[1:], len(keys))):
        yield int(s), slice(at, to)


def _merged(parts):
    """Contexts, words and counts of equal pairs in one, ascending."""
    contexts, ids, numbers = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, contexts))
    contexts, ids, numbers = contexts[order], ids[order], numbers[order]
    new = np.concatenate(([True], (contexts[1:] != contexts[:-1]) | (ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    return contexts[first], ids[first], np.add.reduceat(numbers, first) if len(first) else numbers


def _dump(contexts, ids, numbers):
    """Different words once, ascending; pairs by the places of their words among these."""
    vocabulary, places = np.unique(np.concatenate((contexts, ids)), return_inverse=True)
    c, w = places[: len(ids)].astype(U64), places[len(ids) :].astype(U64)
    return _packed(_gaps(vocabulary), WORD_BYTES), _packed(_gaps(c), 4), _packed(w, 4), _packed(numbers, 8)


def _load(vocabulary, contexts, ids, numbers):
    v = np.cumsum(_unpacked(vocabulary, WORD_BYTES), dtype=U64)
    return v[np.cumsum(_unpacked(contexts, 4), dtype=U64).astype(np.int64)], v[_unpacked(ids, 4).astype(np.int64)], _unpacked(numbers, 8)


def pair_counts(texts: DataFrame, shards: int) -> DataFrame:
    """One row for each shard that has any pair: its words, then contexts (ascending), words and counts of its pairs, packed."""
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, _COUNTS.split(", "))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in _slices(batches):
            ids, size = word_ids(f["text"])
            contexts, ids, numbers = _merged([(_contexts(ids, size), ids, np.ones(len(ids), dtype=U64))])
            places = _pair_places(contexts, ids, shards)
            order = np.argsort(places >> U64(32), kind="stable")
            out = [(s, *_dump(*(x[order[part]] for x in (contexts, ids, numbers)))) for s, part in _groups(places[order])]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in out], schema=schema)
        give_back()

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, parts, size = None, [], 0

        def row():
            return pd.DataFrame([(here, *_dump(*_merged(parts)))], columns=schema.names)

        for f in frames:
            for s, *packed in f.itertuples(index=False):
                if here is not None and s != here:
                    yield row()
                    parts, size = [], 0
                here = s
                parts.append(_load(*packed))
                size += len(parts[-1][0])
                if len(parts) > 1 and size > 2 * len(parts[0][0]) + 2_000_000:
                    parts = [_merged(parts)]
                    size = len(parts[0][0])
        if parts:
            yield row()
        give_back()

    dealt = texts.select(F.col("text").cast("string")).mapInArrow(count, _COUNTS).repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInPandas(gather, _COUNTS)


def word_sums(counts: DataFrame) -> DataFrame:
    """For every word: occurrences as a context, contexts seen once, twice and more often, different words before it.

    Words -1 to -4 carry in `total` the numbers of pairs that occur once to four times.
    """

    def sums(frames):
        for f in frames:
            for _, *packed in f.itertuples(index=False):
                contexts, ids, n = _load(*packed)
                n = n.astype(np.int64)
                first = np.flatnonzero(np.concatenate(([True], contexts[1:] != contexts[:-1])))
                left = [np.add.reduceat(x.astype(np.int64), first) for x in (n, n == 1, n == 2, n > 2)]
                followed, times = np.unique(ids, return_counts=True)
                known = np.union1d(contexts[first], followed)
                out = np.zeros((len(_SUMS), len(known)), dtype=np.int64)
                out[:4, np.searchsorted(known, contexts[first])] = left
                out[4, np.searchsorted(known, followed)] = times
                yield pd.DataFrame({"word": known.astype(np.int64), **dict(zip(_SUMS, out))})
                rare = [(n == k).sum() for k in range(1, 5)]
                yield pd.DataFrame({"word": -np.arange(1, 5), "total": rare, **dict.fromkeys(_SUMS[1:], 0)})

    rows = counts.mapInPandas(sums, "word long, " + ", ".join(f"{x} long" for x in _SUMS))
    return rows.groupBy("word").agg(*[F.sum(x).alias(x) for x in _SUMS])


@dataclass
class Model:
    """Discounts of pairs, the log share of a word never seen, the frequent words (ascending) and the table of the others."""

    discounts: np.ndarray
    unseen: float
    head: np.ndarray
    total: np.ndarray
    off: np.ndarray
    share: np.ndarray
    others: DataFrame | None

    def look_up(self, ids: np.ndarray):
        """Where words stand in the head, and whether they do."""
        if not len(self.head):
            return np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=bool)
        at = np.minimum(np.searchsorted(self.head, ids), len(self.head) - 1)
        return at, self.head[at] == ids


def fit(counts: DataFrame, head: int = HEAD) -> Model:
    """The model from stashed pair counts; at most head + 1 words and some sums reach the driver."""
    table = stash(word_sums(counts))
    real = F.col("word") >= 0
    r = table.agg(
        *[F.coalesce(F.sum(F.when(F.col("word") == -k, F.col("total"))), F.lit(0)).alias(f"n{k}") for k in range(1, 5)],
        F.count(F.when(real & (F.col("continuations") == 1), 1)).alias("c1"),
        F.count(F.when(real & (F.col("continuations") == 2), 1)).alias("c2"),
        F.count(F.when(real & (F.col("continuations") > 0), 1)).alias("seen"),
        F.coalesce(F.sum("continuations"), F.lit(0)).alias("every"),
    ).first()
    n1, n2, n3, n4 = (max(1, r[f"n{k}"]) for k in range(1, 5))
    y = n1 / (n1 + 2 * n2)
    discounts = [0.0, *(min(k, max(0.05, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]
    # the lowest order: continuations with one absolute discount, interpolated with an equal share for every word and the unknown one
    c1, every, seen = max(1, r["c1"]), max(1, r["every"]), r["seen"]
    low = c1 / (c1 + 2 * r["c2"])
    rest = (low * seen / every if seen else 1.0) / (seen + 1)
    kept = sum(F.col(x) * float(d) for x, d in zip(_SUMS[1:4], discounts[1:]))
    off = F.when(F.col("total") > 0, F.log(kept / F.col("total"))).otherwise(0.0)
    share = F.log(F.greatest(F.col("continuations") - low, F.lit(0.0)) / every + rest)
    rows = table.filter(real).select("word", "total", off.alias("off"), share.alias("share"))
    # the fewest eighths of a doubling of occurrences over which there are no more than `head` words; a few hundred rows at most
    eighth, least, n = F.floor(F.log2(F.greatest("total", F.lit(1))) * 8), -1, 0
    for step in rows.groupBy(eighth.alias("at")).agg(F.count("*").alias("n")).orderBy(F.desc("at")).collect():
        n += step["n"]
        if n > head:
            least = step["at"]
            break
    above = (eighth > least) | (F.col("word") == START)
    top = rows.filter(above).toPandas().sort_values("word")
    columns = [top["word"].to_numpy(dtype=U64), *(top[c].to_numpy(dtype=float) for c in ("total", "off", "share"))]
    return Model(np.array(discounts), float(np.log(rest)), *columns, rows.filter(~above))


def _gains(counts: DataFrame, model: Model, shards: int) -> DataFrame:
    """shard, a (fingerprints, packed), b (float64): what log P(word | context) of each pair that was seen is above that of an unseen one."""
    bare = replace(model, others=None)  # what tasks get
    discounts, total, off, share = bare.discounts, bare.total, bare.off, bare.share

    def gain(n, of, lower):
        return np.log1p(np.maximum(n - discounts[np.minimum(n, 3).astype(int)], 0) / of / np.exp(lower))

    def here(frames):
        for f in frames:
            for s, *counted in f.itertuples(index=False):
                contexts, ids, n = _load(*counted)
                (c, knows), (w, known) = bare.look_up(contexts), bare.look_up(ids)
                both = knows & known
                g = gain(n[both].astype(float), total[c[both]], off[c[both]] + share[w[both]])
                places = _pair_places(contexts[both], ids[both], shards)
                order = np.argsort(places, kind="stable")
                yield pd.DataFrame([(s, _prints(places[order]), g[order].astype("<f8").tobytes())], columns=["shard", "a", "b"])
        give_back()

    def others(frames):
        for f in frames:
            for _, *packed in f.itertuples(index=False):
                contexts, ids, n = _load(*packed)
                lacks = 2 * ~bare.look_up(contexts)[1] + ~bare.look_up(ids)[1]
                for at in range(0, len(ids), 100_000):
                    some = at + np.flatnonzero(lacks[at : at + 100_000])
                    yield pd.DataFrame({"lacks": lacks[some], "context": contexts[some].astype(np.int64), "next": ids[some].astype(np.int64), "n": n[some].astype(np.int64)})
        give_back()

    def packed(frames):
        for f in frames:
            contexts, ids, n = (f[x].to_numpy(dtype=U64) for x in ("context", "next", "n"))
            (c, knows), (w, known) = bare.look_up(contexts), bare.look_up(ids)
            of, back, lower = (f[x].to_numpy(dtype=float, na_value=0.0) for x in ("t1", "o1", "s2"))
            of[knows], back[knows], lower[known] = total[c[knows]], off[c[knows]], share[w[known]]
            g, places = gain(n.astype(float), of, back + lower), _pair_places(contexts, ids, shards)
            order = np.argsort(places, kind="stable")
            for s, part in _groups(places[order]):
                yield pd.DataFrame([(s, _prints(places[order][part]), g[order][part].astype("<f8").tobytes())], columns=["shard", "a", "b"])

    schema = "shard int, a binary, b binary"
    rows = counts.mapInPandas(others, "lacks int, context long, next long, n long")
    as_context = model.others.select(F.col("word").alias("context"), F.col("total").alias("t1"), F.col("off").alias("o1"))
    as_next = model.others.select(F.col("word").alias("next"), F.col("share").alias("s2"))
    # a word that is joined is not among the frequent ones, so no key is hot
    first = rows.filter("lacks = 2").join(as_context, "context").withColumn("s2", F.lit(None).cast("double"))
    second = rows.filter("lacks = 1").join(as_next, "next").withColumns({"t1": F.lit(None).cast("long"), "o1": F.lit(None).cast("double")})
    both = rows.filter("lacks = 3").join(as_context, "context").join(as_next, "next")
    rest = first.unionByName(second).unionByName(both).select("context", "next", "n", "t1", "o1", "s2").mapInPandas(packed, schema)
    return counts.mapInPandas(here, schema).unionByName(rest)


def _other_words(model: Model, shards: int) -> DataFrame:
    """shard, a (fingerprints, packed), b and c (float64): log share above that of an unseen word, log back-off weight."""
    unseen = model.unseen

    def packed(frames):
        for f in frames:
            places = _word_places(f["word"].to_numpy(dtype=U64), shards)
            order = np.argsort(places, kind="stable")
            share, off = f["share"].to_numpy()[order] - unseen, f["off"].to_numpy()[order]
            for s, part in _groups(places[order]):
                yield pd.DataFrame([(s, _prints(places[order][part]), share[part].astype("<f8").tobytes(), off[part].astype("<f8").tobytes())], columns=["shard", "a", "b", "c"])

    return model.others.select("word", "off", "share").mapInPandas(packed, "shard int, a binary, b binary, c binary")


def _entries(counts: DataFrame, model: Model, shards: int) -> DataFrame:
    """What shards know: shard, kind, a, b, c of pairs and of words."""
    pairs = _gains(counts, model, shards).select("shard", F.lit(_PAIRS).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("c"))
    return pairs.unionByName(_other_words(model, shards).select("shard", F.lit(_WORDS).alias("kind"), "a", "b", "c"))


def scores(docs: DataFrame, counts: DataFrame, model: Model, shards: int) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity of every row; null and empty texts have no tokens and a null perplexity."""
    return _scored(docs, stash(_entries(counts, model, shards)), model, shards)


def _scored(docs: DataFrame, entries: DataFrame, model: Model, shards: int) -> DataFrame:
    """The same from the stashed entries, which are released."""
    bare = replace(model, others=None)
    off, share, unseen = bare.off, bare.share, bare.unseen
    start = float(off[0]) if len(model.head) and model.head[0] == START else 0.0

    def messages(keys, doc, n, kind, uid):
        """What each shard gets: how many fingerprints each document has, and these, ascending in every document, as gaps."""
        prints, to = (keys & U64(0xFFFFFFFF)).astype(np.uint32), keys & ~U64(0xFFFFFFFF) | doc.astype(U64)
        order = np.argsort(prints, kind="stable")
        order = order[np.argsort(to[order], kind="stable")]
        prints, to = prints[order], to[order]
        for s, part in _groups(to):
            sizes = np.bincount((to[part] & U64(0xFFFFFFFF)).astype(np.int64), minlength=n)
            gaps = np.diff(prints[part], prepend=np.uint32(0))  # below zero where a document starts: modulo 2^32
            yield s, kind, uid, None, None, len(gaps), None, _packed(gaps, 4), _packed(sizes, 4), None

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        for f in _slices(batches):
            ids, size = word_ids(f["text"])
            doc = np.repeat(np.arange(len(size)), size)
            last = np.zeros(len(ids), dtype=bool)
            last[np.cumsum(size)[size > 0] - 1] = True
            at, known = bare.look_up(ids)
            own = np.full(len(ids), unseen)
            own[known] = share[at[known]] + np.where(last[known], 0.0, off[at[known]])
            base = np.bincount(doc, weights=own, minlength=len(size)) + np.where(size > 0, start, 0.0)
            out = [
                ((uid + k) % shards, _META, uid + k, d, lang, int(n), float(b), None, None, None)
                for k, (d, lang, n, b) in enumerate(zip(f["doc_id"], f["lang"], size, base))
            ]
            out += messages(_pair_places(_contexts(ids, size), ids, shards), doc, len(size), _TEXT, uid)
            out += messages(_word_places(ids[~known], shards), (2 * doc + last)[~known], 2 * len(size), _TAIL, uid)
            uid += len(size)
            yield pa.RecordBatch.from_pylist([dict(zip(_SENT.names, row)) for row in out], schema=_SENT)
        give_back()

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a shard in the order of kind: entries of pairs, entries of words, then texts."""
        here, parts, tables = None, {}, {}

        def table(kind):
            """The entries of a shard, ascending, as they were sent in parts."""
            if kind not in tables:
                columns = [np.concatenate(x) for x in zip(*parts.pop(kind, []))]
                if columns:
                    order = np.argsort(columns[0], kind="stable")
                    columns = [c[order] for c in columns]
                tables[kind] = columns
            return tables[kind]

        def found(r, kind):
            prints, sizes = np.cumsum(_unpacked(r.a, 4), dtype=U64).astype(np.uint32), _unpacked(r.b, 4).astype(np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            known = table(kind)
            if not known:
                return np.zeros(0, dtype=np.int64), doc[:0], known
            at = np.minimum(np.searchsorted(known[0], prints), len(known[0]) - 1)
            hit = known[0][at] == prints
            return at[hit], doc[hit], known

        for f in frames:
            for r in f[f["kind"] != _META].itertuples(index=False):
                if r.shard != here:
                    here, parts, tables = r.shard, {}, {}
                if r.kind in (_PAIRS, _WORDS):
                    arrays = [np.cumsum(_unpacked(r.a, 4), dtype=U64).astype(np.uint32), np.frombuffer(r.b, dtype="<f8")]
                    parts.setdefault(r.kind, []).append(arrays + ([np.frombuffer(r.c, dtype="<f8")] if r.kind == _WORDS else []))
                    continue
                if r.kind == _TEXT:
                    at, doc, known = found(r, _PAIRS)
                    gain = known[1][at] if known else np.zeros(0)
                else:
                    at, doc, known = found(r, _WORDS)
                    gain = known[1][at] + np.where(doc & 1, 0.0, known[2][at]) if known else np.zeros(0)
                    doc = doc >> 1
                total = np.bincount(doc, weights=gain)
                some = np.flatnonzero(total)
                yield pd.DataFrame({"uid": r.uid + some, "doc_id": pd.array([None] * len(some), dtype="Int64"), "lang": None, "n": 0, "logp": total[some]})
            meta = f[f["kind"] == _META]
            yield meta[["uid", "doc_id", "lang", "n", "logp"]].astype({"doc_id": "Int64"})
        give_back()

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    rows = docs.select(F.col("doc_id").cast("long"), lang, F.col("text").cast("string"))
    none = {x.split()[0]: F.lit(None).cast(x.split()[1]) for x in _ROWS.split(", ")}
    given = entries.select(*[c.alias(k) for k, c in (none | {c: F.col(c) for c in entries.columns}).items()])
    perplexity = F.when(F.col("n_tokens") > 0, F.exp(-F.col("logp") / F.col("n_tokens")))

    def part(k):
        some = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == k)
        both = some.mapInArrow(send, _ROWS).unionByName(given)
        met = both.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
        parts = met.mapInPandas(meet, "uid long, doc_id long, lang string, n long, logp double")
        whole = parts.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("lang").alias("lang"), F.sum("n").alias("n_tokens"), F.sum("logp").alias("logp"))
        return stash(whole.select("doc_id", "lang", "n_tokens", perplexity.alias("perplexity")))

    out = reduce(DataFrame.unionByName, [part(k) for k in range(ROUNDS)])
    release(entries)
    return out


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, slack: float = 1.1, weight: int = 20) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, evened, threshold, kept of every row of docs (doc_id, text, lang).

    Trusted are the documents whose labels all say quality 1. Four fifths of them (by a hash of doc_id) train the model;
    the others calibrate it. A few words say little, so every perplexity is evened as if `weight` words at the median of
    its language came with the text. Each language takes the `quantile` of evened perplexities, times `slack`, as its
    threshold. A language without such documents takes median and threshold of all, and without any trusted document
    everything with words is kept. Rows without words have no perplexity and are not kept. Repeated rows are scored each
    for itself. A text is read whole, by one task.
    """
    judged = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    trusted = judged.filter("q = 1").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(100)) < HELD_OUT).alias("held"))
    many = trusted.count()
    shards = max(16, many // DOCS_A_SHARD)
    train = trusted.filter("not held").select("doc_id")
    if many <= BROADCAST_ROWS:
        train = F.broadcast(train)
    counts = stash(pair_counts(docs.select("doc_id", "text").join(train, "doc_id"), shards))
    model = fit(counts)
    entries = stash(_entries(counts, model, shards))
    release(counts)
    found = _scored(docs, entries, model, shards)
    calibration = trusted.filter("held").select("doc_id")

    def with_quantile(rows: DataFrame, column: str, share: float, name: str) -> DataFrame:
        """rows with that quantile of the calibrating documents of their language, or else of all of them."""
        held = rows.join(calibration, "doc_id").filter(F.col(column).isNotNull())
        of = held.groupBy(F.coalesce("lang", F.lit("")).alias("of")).agg(F.percentile_approx(column, share, 10_000).alias("own"))
        every = held.agg(F.percentile_approx(column, share, 10_000).alias("all")).first()["all"]
        out = rows.join(of, F.coalesce("lang", F.lit("")) == F.col("of"), "left")
        return out.select(*rows.columns, F.coalesce("own", F.lit(every).cast("double")).alias(name))

    found = with_quantile(found, "perplexity", 0.5, "median")
    median = F.coalesce("median", "perplexity")
    evened = F.exp((F.log("perplexity") * F.col("n_tokens") + F.log(median) * weight) / (F.col("n_tokens") + weight))
    out = with_quantile(found.withColumn("evened", evened), "evened", quantile, "threshold")
    threshold = F.coalesce(F.col("threshold") * slack, F.lit(float("inf")))
    kept = F.coalesce(F.col("evened") <= threshold, F.lit(False))
    return out.select("doc_id", "lang", "n_tokens", "perplexity", "evened", threshold.alias("threshold"), kept.alias("kept"))
