"""Quality rules: a decision list learnt from labelled statistics, applied as Spark conditional expressions (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genespark.llm.common import PLACES, WordHashes, give_back, mix, words

_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letters long, n_upper long, n_exclaims long, n_distinct long"


def statistics(text: str | None, table: WordHashes) -> tuple[int, ...]:
    """The counts of _STATS for one whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")

    def many(chars):
        return len(raw) - len(raw.translate(None, chars))

    seen, repeated, n_lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            n_lines += 1
            repeated += line in seen
            seen.add(line)
    h = table.array(words(text))
    n = len(h)
    return (
        n, len(text) - many(_SPACES), many(_SYMBOLS), repeated, repeat_words(h), n_lines, many(_LETTERS), many(_UPPER),
        raw.count(b"!"), len(np.unique(h)),
    )


def repeat_words(h: np.ndarray) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(h)
    if n < 4:
        return 0
    windows = mix(h[:-2] * PLACES[0] + h[1:-1] * PLACES[1] + h[2:] * PLACES[2])
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.isin(windows, twice)
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= at
    return int(covered.sum())


def _stats_udf():
    names = [x.split()[0] for x in _STATS.split(", ")]

    @F.pandas_udf(_STATS)
    def stats(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = WordHashes()
        for s in texts:
            yield pd.DataFrame([statistics(t if isinstance(t, str) else None, table) for t in s], columns=names, dtype="int64")
        table.clear()
        give_back()

    return stats


def _share(a: str, b: str):
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: What the rules may test: a name and its expression over the statistics.
FEATURES = {
    "symbols_a_char": lambda: _share("n_symbols", "word_chars"),
    "chars_a_word": lambda: _share("word_chars", "n_words"),
    "repeat_share": lambda: _share("n_repeat_words", "n_words"),
    "dup_line_share": lambda: _share("n_dup_lines", "n_lines"),
    "words_a_line": lambda: _share("n_words", "n_lines"),
    "upper_share": lambda: _share("n_upper", "n_letters"),
    "exclaims_a_word": lambda: _share("n_exclaims", "n_words"),
    "distinct_share": lambda: _share("n_distinct", "n_words"),
}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        v = x[self.feature].to_numpy()
        return v > self.bound if self.above else v <= self.bound

    def column(self) -> Column:
        v = FEATURES[self.feature]()
        return v > F.lit(self.bound) if self.above else v <= F.lit(self.bound)

    def __str__(self):
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:.6g}"


def _covers(rule, x):
    out = np.ones(len(x), dtype=bool)
    for test in rule:
        out &= test.holds(x)
    return out


def _bounds(v: np.ndarray, most: int = 64) -> np.ndarray:
    """Half-way points between the values at even ranks."""
    q = np.unique(np.quantile(v, np.linspace(0, 1, most), method="nearest"))
    return (q[1:] + q[:-1]) / 2


def _grow(x, bad, longest):
    """Add the test with the largest gain in information about bad rows until only bad rows are covered."""
    rule, inside = [], np.ones(len(x), dtype=bool)
    while len(rule) < longest and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best = (1e-9, None, None)
        for f in x.columns:
            v = x[f].to_numpy()
            for bound in _bounds(v[inside]):
                above = v > bound
                for side in (True, False):
                    now = inside & (above if side else ~above)
                    p, n = (now & bad).sum(), (now & ~bad).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, Test(f, side, float(bound)), now)
        if best[1] is None:
            break
        rule.append(best[1])
        inside = best[2]
    return rule


def _worth(rule, x, bad):
    inside = _covers(rule, x)
    p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p, n


def learn(x: pd.DataFrame, bad: np.ndarray, least_precision: float = 0.95, longest: int = 4, most: int = 16, seed: int = 7) -> list[tuple[Test, ...]]:
    """Sequential covering: grow a conjunction on two thirds of the rows, cut its tail on the rest, drop what it covers.

    A rule enters the list only if, on rows it was not grown on, `least_precision` of those it covers are bad. Without
    rows of both kinds the list is empty.
    """
    part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    left, rules = np.ones(len(x), dtype=bool), []
    while len(rules) < most:
        g, p = left & part, left & ~part
        if not (bad[g].any() and bad[p].any() and (~bad[g]).any()):
            break
        rule = _grow(x[g], bad[g], longest)
        if not rule:
            break
        xp, bp = x[p], bad[p]
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, xp, bp)[0])
        _, hit, miss = _worth(rule, xp, bp)
        if not hit or hit < least_precision * (hit + miss):
            break
        rules.append(tuple(rule))
        left &= ~_covers(rule, x)
    return rules


def with_statistics(docs: DataFrame, name: str = "statistics") -> DataFrame:
    """docs with a struct of the counts of each text; other columns stay as they are."""
    return docs.withColumn(name, _stats_udf()(F.col("text").cast("string")))


def _base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, **options) -> list[tuple[Test, ...]]:
    """Learn the list from at most `sample` labelled documents, those with the least hashes of doc_id.

    A document with several labels counts as bad if one says so; labels without doc_id or quality are left out, as are
    documents that fail the fixed rules anyway.
    """
    chosen = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    counts = with_statistics(texts).select("quality", "statistics.*").filter(~_base_failed())
    rows = counts.select((F.col("quality") == 0).alias("bad"), *[f().alias(n) for n, f in FEATURES.items()]).toPandas()
    rows = rows.sort_values(list(rows.columns)).reset_index(drop=True)
    return learn(rows[list(FEATURES)], rows["bad"].to_numpy(dtype=bool), **options)


def verdict(rules: list[tuple[Test, ...]]) -> Column:
    """Number of the first rule that holds, as one ordered conditional expression; null if none does."""
    out = None
    for k, rule in enumerate(rules):
        test = rule[0].column()
        for more in rule[1:]:
            test = test & more.column()
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def judged(docs: DataFrame, rules: list[tuple[Test, ...]]) -> DataFrame:
    """The counts of every row with base_failed, rule (the rule of the list that rejects it) and kept.

    Null, empty and blank texts have no words and fail. Every row is judged for itself, repeated ones alike.
    """
    counts = with_statistics(docs.select("doc_id", "text")).select("doc_id", "statistics.*")
    out = counts.withColumn("base_failed", _base_failed()).withColumn("rule", verdict(rules))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule",
    )


def keep_good(docs: DataFrame, rules: list[tuple[Test, ...]]) -> DataFrame:
    """The rows of docs that pass, with their columns as they were, whatever these are called."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    counts = with_statistics(whole).select("row", "statistics.*")
    good = counts.filter(~_base_failed()).filter(verdict(rules).isNull())
    return good.select([F.col("row").getField(c).alias(c) for c in docs.columns])
