"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio (operator 2)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "markov")

#: Letters, digits and signs of a run, one class each; class 0 is everything else.
ALPHABET = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CLASSES = len(ALPHABET) + 1
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[np.frombuffer(ALPHABET, dtype=np.uint8)] = np.arange(1, CLASSES)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points, in the order of start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _secret_values(text: str) -> list[str]:
    """The secret parts of the fixed patterns: values, without the words that announce them."""
    out = []
    if any(k in text.lower() for k in _KEYWORDS):
        out += [m[2] for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [m[0] for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [m[0] for m in _HEX.finditer(text)]


def _pairs(text: str) -> np.ndarray:
    c = _CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    return np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES) if len(c) > 1 else np.zeros(CLASSES * CLASSES, dtype=np.int64)


def labelled_samples(text: str) -> tuple[list[str], list[str]]:
    """Random strings (values of the fixed patterns) and ordinary text (what lies between them) of one document."""
    spans = base_spans(text)
    if not spans:
        return [], [text]
    ordinary, at = [], 0
    for start, _, end in spans:
        if start > at:
            ordinary.append(text[at:start])
        at = max(at, end)
    ordinary.append(text[at:])
    return _secret_values(text), ordinary


@dataclass
class Model:
    """ratio: log of P(random) / P(ordinary) for each pair of classes."""

    ratio: np.ndarray
    least: float = 12.0
    mean: float = 0.9
    letters: float = 1.5

    def spans(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Runs of 16 characters or more with a letter that score as random and touch no fixed span.

        A run scores `least` or more in all and `mean` or more a pair; `letters` a pair if it has no digit.
        """
        out = []
        for m in _RUN.finditer(text):
            run = m[0]
            if not any(c.isalpha() for c in run):
                continue
            if any(s < m.end() and m.start() < e for s, _, e in taken):
                continue
            c = _CLASS[np.frombuffer(run.encode(), dtype=np.uint8)]
            score = float(self.ratio[c[:-1] * CLASSES + c[1:]].sum())
            if score >= self.least and score >= (self.mean if any(x.isdigit() for x in run) else self.letters) * (len(c) - 1):
                out.append((m.start(), 3, m.end()))
        return out


def count_samples(samples: DataFrame) -> DataFrame:
    """samples (text, random boolean) -> counts of character pairs for each label; nulls count as empty."""

    def count(frames):
        total = np.zeros((2, CLASSES * CLASSES), dtype=np.int64)
        for f in frames:
            for text, random in zip(f["text"], f["random"]):
                if isinstance(text, str) and random is not None:
                    total[int(bool(random))] += _pairs(text)
        yield _nonzero(total)

    return _summed(samples.select(F.col("text").cast("string"), "random").mapInPandas(count, "random boolean, pair int, n long"))


def count_documents(docs: DataFrame) -> DataFrame:
    """The same from whole documents, which label their own samples: see labelled_samples."""

    def count(frames):
        total = np.zeros((2, CLASSES * CLASSES), dtype=np.int64)
        for f in frames:
            for text in f["text"]:
                if isinstance(text, str):
                    random, ordinary = labelled_samples(text)
                    for r in random:
                        total[1] += _pairs(r)
                    for o in ordinary:
                        total[0] += _pairs(o)
        yield _nonzero(total)

    return _summed(docs.select(F.col("text").cast("string")).mapInPandas(count, "random boolean, pair int, n long"))


def _nonzero(total):
    label, pair = np.nonzero(total)
    return pd.DataFrame({"random": label.astype(bool), "pair": pair.astype("int32"), "n": total[label, pair]})


def _summed(counts):
    return counts.groupBy("random", "pair").agg(F.sum("n").alias("n"))


_LOWER, _UPPER, _DIGIT = (np.array([ALPHABET.index(c) for c in part]) for part in (ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]))
#: What joins the words of a name: signs that paths, constants and slugs are put together with.
_JOINTS = [ALPHABET.index(c) for c in b"/_-"]


def _names(counts: np.ndarray) -> np.ndarray:
    """Pair counts of identifiers made from ordinary text: its words with a joint, a capital or a number between them, and in capitals.

    counts: of classes, 0 among them, which stands before and after a word. An identifier is as likely as a word, and each way
    to make one as any other.
    """
    inside, ends, starts = counts[1:, 1:].astype(float), counts[1:, 0].astype(float), counts[0, 1:].astype(float)
    first, out = starts / max(1.0, starts.sum()), inside.copy()
    ways = len(_JOINTS) + 2
    for sign in _JOINTS:
        out[:, sign] += ends / ways
        out[sign] += starts / ways
    capital = np.zeros(len(first))
    capital[_UPPER] = first[_LOWER] + first[_UPPER]
    out += np.outer(ends / ways, capital)
    out[:, _DIGIT] += ends[:, None] / ways / len(_DIGIT)
    # a number has one to four digits, then a joint or the next word
    number = ends.sum() / ways / len(_DIGIT)
    out[np.ix_(_DIGIT, _DIGIT)] += 1.5 * number / len(_DIGIT)
    out[_DIGIT] += number / 2 * (first + capital)
    out[np.ix_(_DIGIT, _JOINTS)] += number / len(_JOINTS)
    # the same in capitals, as constants are
    for old, new in ((np.ix_(_LOWER, _LOWER), np.ix_(_UPPER, _UPPER)), (np.ix_(_LOWER, _JOINTS), np.ix_(_UPPER, _JOINTS)), (np.ix_(_JOINTS, _LOWER), np.ix_(_JOINTS, _UPPER))):
        out[new] += out[old] / ways
    return out


def fit(counts: DataFrame, prior: float = 20.0) -> Model:
    """Both models from pair counts (at most 2 * 68 * 68 rows).

    The prior of a random string is uniform over the alphabet, that of ordinary text nearly nothing, so an alphabet that
    no sample shows still counts as random. Ordinary are words and the identifiers that are made of them.
    """
    total = np.zeros((2, CLASSES, CLASSES))
    for r in counts.collect():
        total[int(r["random"]), r["pair"] // CLASSES, r["pair"] % CLASSES] = r["n"]
    seen = (_names(total[0]), total[1, 1:, 1:])
    logs = [np.log((t + p) / (t.sum(axis=1, keepdims=True) + p * t.shape[1])) for t, p in zip(seen, (0.5, prior))]
    ratio = np.zeros((CLASSES, CLASSES))
    ratio[1:, 1:] = np.clip(logs[1] - logs[0], -6, 6)
    return Model(ratio.ravel())


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of every row; a null text counts as empty."""
    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"

    @F.pandas_udf(schema)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            out = []
            for text in s:
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                more = model.spans(text, base)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                out.append((*n, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + more), len(more)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", find(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")


def redact(docs: DataFrame, model: Model, mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by `mark`, and n_chars (if there is one) counted anew for the texts that changed.

    Rows and other columns stay; null and clean texts stay as they are.
    """

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out = []
            for text in s:
                if isinstance(text, str):
                    base = base_spans(text)
                    if spans := sorted(base + model.spans(text, base)):
                        parts, at = [], 0
                        for start, _, end in spans:
                            if start >= at:
                                parts += [text[at:start], mark]
                            at = max(at, end)
                        text = "".join([*parts, text[at:]])
                    out.append(text)
                else:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    new = docs.select(F.struct(*docs.columns).alias("row"), clean(F.col("text").cast("string")).alias("clean"))
    out = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == "text":
            out.append(F.col("clean").alias(c))
        elif c == "n_chars":
            changed = ~F.col("clean").eqNullSafe(F.col("row").getField("text"))
            out.append(F.when(changed, F.length("clean").cast("long")).otherwise(old).alias(c))
        else:
            out.append(old.alias(c))
    return new.select(out)
