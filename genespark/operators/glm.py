"""Logistic models, many at a time: rows fold to distinct patterns, and one job a round serves every model."""

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Fit:
    names: list
    beta: np.ndarray
    cov: np.ndarray
    loglik: float
    rows: int
    rank: int

    @property
    def deviance(self):
        return -2.0 * self.loglik

    @property
    def aic(self):
        return 2.0 * self.rank - 2.0 * self.loglik


def _columns_of(df, term):
    """(name, expression) of every design column of a term: a number, the levels of a text but the most rare, or products."""
    if ":" in term:
        sides = [_columns_of(df, t) for t in term.split(":")]
        out = []
        for combo in itertools.product(*sides):
            value = combo[0][1]
            for _, e in combo[1:]:
                value = value * e
            out.append((":".join(n for n, _ in combo), value))
        return out
    if not isinstance(df.schema[term].dataType, (T.StringType, T.BooleanType)):
        return [(term, F.col(term).cast("double"))]
    levels = df.groupBy(term).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), term)
    return [(f"{term}_{r[0]}", (F.col(term) == F.lit(r[0])).cast("double")) for r in levels.collect()[:-1]]


def _sums(patterns, wanted, centre, scale):
    """One pass: log-likelihood, score and information of every wanted (subset, columns, coefficients)."""

    def fold(batches):
        totals = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x = (np.stack(pdf["_x"].to_numpy()) - centre) / scale
            inside = np.stack(pdf["_in"].to_numpy()).astype(bool)
            k, n = pdf["_k"].to_numpy(dtype=float), pdf["_n"].to_numpy(dtype=float)
            for f, (subset, cols, beta) in wanted.items():
                m = inside[:, subset]
                if not m.any():
                    continue
                xs = x[m][:, cols]
                eta = xs @ beta
                p = np.where(eta >= 0, 1.0, np.exp(-np.abs(eta))) / (1.0 + np.exp(-np.abs(eta)))
                loglik = np.sum(k[m] * eta - n[m] * (np.maximum(eta, 0.0) + np.log1p(np.exp(-np.abs(eta)))))
                info = (xs * (n[m] * p * (1.0 - p))[:, None]).T @ xs
                part = np.concatenate([[loglik, n[m].sum()], xs.T @ (k[m] - n[m] * p), info.ravel()])
                totals[f] = totals.get(f, 0.0) + part
        for f, v in totals.items():
            yield pd.DataFrame({"fit": np.int32(f), "at": np.arange(len(v), dtype=np.int32), "v": v})

    rows = patterns.mapInPandas(fold, "fit int, at int, v double").groupBy("fit", "at").agg(F.sum("v").alias("v")).collect()
    out = {f: np.zeros(2 + len(c) + len(c) ** 2) for f, (_, c, _) in wanted.items()}
    for r in rows:
        out[r["fit"]][r["at"]] = r["v"]
    return out


def fit_all(df, y, models, subsets=("true",), most=60):
    """Maximum-likelihood logistic fits of all ``models`` (tuples of terms) on all ``subsets`` (conditions): {(subset, model): Fit}.

    ``y`` is 0 or 1.  Rows that lack y or a predictor of any model are left out, so all fits of a subset share their rows.  The
    rows are folded once to distinct (predictors, subsets) with counts; a round is one pass over those that returns, for each
    fit that still moves, sums whose number depends on its coefficients only.  Newton steps are halved when the likelihood
    falls.  Columns that others determine share their estimate (smallest norm) and do not count as parameters.  An empty
    subset has rank 0; fits that do not come to rest are an error.
    """
    terms = sorted({t for m in models for t in m})
    used = sorted({c for t in terms for c in t.split(":")})
    rows = df.dropna(subset=[y, *used])
    inside = F.array(*[F.coalesce(F.expr(c), F.lit(False)) for c in subsets])
    folded = rows.select(inside.alias("_in"), *used, F.col(y).cast("double").alias("_y")).groupBy("_in", *used).agg(
        F.sum("_y").alias("_k"), F.count(F.lit(1)).alias("_n"))
    design, at = [], {}
    for t in terms:
        found = _columns_of(rows, t)
        at[t] = range(len(design), len(design) + len(found))
        design += found
    ones = len(design)
    patterns = folded.select("_in", "_k", "_n", F.array(*[e for _, e in design], F.lit(1.0)).alias("_x")).persist()
    try:
        return _rounds(patterns, models, subsets, [n for n, _ in design], at, ones, most)
    finally:
        patterns.unpersist()


def _rounds(patterns, models, subsets, design, at, ones, most):
    w = F.col("_n").cast("double")
    moments = patterns.agg(F.sum(w), *[F.sum(w * F.col("_x")[i]) for i in range(ones)], *[F.sum(w * F.col("_x")[i] * F.col("_x")[i]) for i in range(ones)]).first()
    total = moments[0] or 1.0
    mean = np.array([(moments[1 + i] or 0.0) / total for i in range(ones)])
    var = np.array([(moments[1 + ones + i] or 0.0) / total for i in range(ones)]) - mean * mean
    centre = np.append(mean, 0.0)
    scale = np.append(np.where(var > 1e-24 * (1.0 + mean * mean), np.sqrt(np.maximum(var, 1e-300)), 1.0), 1.0)

    keys = [(s, m) for s in range(len(subsets)) for m in models]
    cols = {f: [*itertools.chain.from_iterable(at[t] for t in m), ones] for f, (_, m) in enumerate(keys)}
    beta = {f: np.zeros(len(c)) for f, c in cols.items()}
    last, step, best, done = {}, {}, {}, {}
    for _ in range(most):
        moving = {f: (keys[f][0], cols[f], beta[f]) for f in cols if f not in done}
        if not moving:
            break
        for f, v in _sums(patterns, moving, centre, scale).items():
            q = len(cols[f])
            loglik, n, score, info = v[0], v[1], v[2 : 2 + q], v[2 + q :].reshape(q, q)
            if f in last and loglik < last[f] - 1e-9 * (abs(last[f]) + 1.0):
                step[f] = step[f] / 2.0
                beta[f] = best[f] + step[f]
                continue
            inverse = np.linalg.pinv(info, rcond=1e-12, hermitian=True)
            last[f], best[f], step[f] = loglik, beta[f], inverse @ score
            if float(score @ step[f]) <= 1e-11 * (abs(loglik) + 0.1):
                done[f] = (best[f] + step[f], inverse, loglik, int(n), int(np.linalg.matrix_rank(info, tol=1e-12 * max(1e-300, np.abs(info).max()), hermitian=True)))
            else:
                beta[f] = best[f] + step[f]
    if len(done) < len(cols):
        raise ArithmeticError("a logistic model did not come to rest")
    out = {}
    for f, (b, cov, loglik, n, rank) in done.items():
        # back from centred and scaled columns
        back = np.diag(1.0 / scale[cols[f]])
        back[-1, :] -= centre[cols[f]] / scale[cols[f]]
        s, m = keys[f]
        out[subsets[s], m] = Fit([*[design[i] for i in cols[f][:-1]], "intercept"], back @ b, back @ cov @ back.T, float(loglik), n, rank)
    return out


def two_sided(z):
    """Two-sided normal p."""
    return math.erfc(abs(z) / math.sqrt(2.0))
