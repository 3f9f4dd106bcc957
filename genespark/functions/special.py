"""Special functions in numpy, vectorised for Arrow batches.  Used only where Spark has no built-in."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def lgamma(x):
    return _LGAMMA(np.asarray(x, dtype=float))


def _rounds(*sizes):
    """Rounds within which the expansions below converge: they need some square roots of their largest argument."""
    return 1000 + int(20 * math.sqrt(max(float(np.max(v, initial=0.0)) for v in sizes)))


def _still(step, before):
    """Fractions that stand still: two rounds at the last digit, or so near it that only rounding moves them.

    Rounding moves a round by more than the last digit when the arguments are large, and then never stops.
    """
    return (np.maximum(step, before) < 1e-15) | ((step < 1e-10) & (step >= before))


def _fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz), iterated until it stands still."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    done, before = np.zeros(h.shape, dtype=bool), np.full_like(h, np.inf)
    for m in range(1, _rounds(a, b)):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        step = np.abs(d * c - 1.0)
        done |= _still(step, before)
        before = step
        if np.all(done):
            return h
    raise ArithmeticError("the incomplete beta function did not converge")


def _stirling_rest(n):
    """lgamma(n) less Stirling's main terms (n - 1/2) log n - n + log(2 pi) / 2."""
    big = np.maximum(n, 16.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * big * big)) / (big * big)) / (big * big)) / big
    small = np.minimum(n, 16.0)
    exact = lgamma(small) - ((small - 0.5) * np.log(small) - small + 0.5 * math.log(2 * math.pi))
    return np.where(n < 16.0, exact, series)


def _log1p_less(u):
    """log(1 + u) - u without cancellation near zero."""
    near = np.where(np.abs(u) < 0.03, u, 0.0)
    series = np.zeros_like(near)
    for k in range(12, 1, -1):
        series = near * series + (-1.0) ** (k + 1) / k
    return np.where(np.abs(u) < 0.03, near * near * series, np.log1p(u) - u)


def _beta_front(a, b, x):
    """x^a (1 - x)^b / B(a, b): the saddle point keeps its digits at any size of a and b."""
    n = a + b
    away = n * x - a
    deviance = a * _log1p_less(away / a) + b * _log1p_less(-away / b)
    return np.sqrt(a * b / (2 * math.pi * n)) * np.exp(_stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b) + deviance)


def betainc(a, b, x):
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    inner = np.clip(x, 1e-300, 1.0 - 1e-16)
    front = _beta_front(a, b, inner)
    flip = inner > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - inner, inner)
    part = front * _fraction(p, q, z) / p
    out = np.where(flip, 1.0 - part, part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def beta_quantile(a, b, p):
    """Inverse of betainc by bisection."""
    a, b, p = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, p)))
    lo, hi = np.zeros_like(p), np.ones_like(p)
    for _ in range(60):
        mid = (lo + hi) / 2.0
        low = betainc(a, b, mid) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2.0


def gamma_upper(s, x):
    """Regularised upper incomplete gamma function: a series below s + 1, a continued fraction above."""
    s, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(s, x))
    safe = np.maximum(x, 1e-300)
    front = np.exp(-safe + s * np.log(safe) - lgamma(s))
    below = np.minimum(safe, s + 1.0)
    term = 1.0 / s
    series = term.copy()
    for k in range(1, _rounds(s)):
        term = term * below / (s + k)
        series = series + term
        if np.all(term <= 1e-17 * series):
            break
    else:
        raise ArithmeticError("the incomplete gamma series did not converge")
    b = np.maximum(safe, s + 1.0) + 1.0 - s
    c = np.full_like(safe, 1e300)
    d = 1.0 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    done, before = np.zeros(h.shape, dtype=bool), np.full_like(h, np.inf)
    for i in range(1, _rounds(s)):
        an = -i * (i - s)
        b = b + 2.0
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
        step = np.abs(d * c - 1.0)
        done |= _still(step, before)
        before = step
        if np.all(done):
            break
    else:
        raise ArithmeticError("the incomplete gamma fraction did not converge")
    out = np.where(safe < s + 1.0, 1.0 - front * series, front * h)
    return np.where(x <= 0, 1.0, np.clip(out, 0.0, 1.0))


def hypergeom_tail(x, total, marked, drawn, block=1 << 14):
    """P(X >= x) for one hypergeometric count, summed away from the mode in blocks until the terms stop mattering."""
    lo, hi = max(0, marked + drawn - total), min(marked, drawn)
    if x <= lo:
        return 1.0
    if x > hi:
        return 0.0
    c = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    up = x > (drawn + 1) * (marked + 1) // (total + 2)
    first = x if up else x - 1
    last, done = c(marked, first) + c(total - marked, drawn - first) - c(total, drawn), 0.0
    while True:
        if up:
            k = np.arange(first, min(first + block, hi), dtype=float)
            ratio = np.log((marked - k) * (drawn - k)) - np.log((k + 1.0) * (total - marked - drawn + k + 1.0))
        else:
            k = np.arange(first, max(first - block, lo), -1, dtype=float)
            ratio = np.log(k * (total - marked - drawn + k)) - np.log((marked - k + 1.0) * (drawn - k + 1.0))
        logs = last + np.concatenate([[0.0], np.cumsum(ratio)])
        terms = np.exp(logs)
        done += float(terms[:-1].sum()) if len(k) == block else float(terms.sum())
        if len(k) < block or terms[-1] <= 1e-18 * done:
            return float(min(1.0, done if up else max(0.0, 1.0 - done)))
        first, last = (first + block if up else first - block), float(logs[-1])


@F.pandas_udf(T.DoubleType())
def lnfact(n: pd.Series) -> pd.Series:
    return pd.Series(lgamma(n.to_numpy() + 1.0))


@F.pandas_udf(T.DoubleType())
def beta_cdf(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(betainc(a, b, x))


@F.pandas_udf(T.DoubleType())
def beta_ppf(a: pd.Series, b: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(beta_quantile(a, b, p))


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(gamma_upper(df / 2.0, x / 2.0))


@F.pandas_udf(T.DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p value of a t statistic."""
    return pd.Series(betainc(df / 2.0, 0.5, df / (df + t * t)))


@F.pandas_udf(T.DoubleType())
def hypergeom_sf(x: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    rows = zip(x.astype(int), total.astype(int), marked.astype(int), drawn.astype(int))
    return pd.Series([hypergeom_tail(*r) for r in rows], dtype=float)


@F.pandas_udf(T.DoubleType())
def binom_sf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= k) for a binomial count, through the incomplete beta function."""
    k, n, p = (s.to_numpy(dtype=float) for s in (k, n, p))
    return pd.Series(np.where(k <= 0, 1.0, betainc(np.maximum(k, 1.0), np.maximum(n - k + 1.0, 1e-9), p)))


def jeffreys(k, n, level=0.95):
    """Lower and upper Jeffreys bounds of k successes in n trials."""
    tail = (1.0 - level) / 2.0
    a, b = k + F.lit(0.5), n - k + F.lit(0.5)
    return beta_ppf(a, b, F.lit(tail)), beta_ppf(a, b, F.lit(1.0 - tail))
