"""Periodic runs against plain search."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from genespark.llm.periodic import collapsed, periodic_runs, runs_of
from genespark.llm.queries import QUERIES


def brute(ws, least=6, exponent=4):
    n, out = len(ws), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                out.setdefault((i, length), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted(((i, length, q) for (i, length), q in out.items()), key=lambda r: (r[0], r[2]))


def codes(ws):
    table = {}
    return np.array([table.setdefault(w, len(table)) for w in ws], dtype=np.int64)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4), st.sampled_from([(6, 4), (3, 3), (9, 4), (12, 5)]))
def test_small_alphabets(texts, how):
    assert runs_of([codes(t) for t in texts], *how) == [brute(t, *how) for t in texts]


def test_repeats_within_repeats():
    rng = random.Random(2)
    texts = []
    for _ in range(60):
        t = []
        while len(t) < 300:
            part = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
            if rng.random() < 0.5:
                part = part * rng.randrange(2, 7)
            if rng.random() < 0.4:
                part = (part + [rng.randrange(3)]) * rng.randrange(2, 6) + part[: rng.randrange(len(part))]
            t += part
        texts.append(t)
    want = [brute(t) for t in texts]
    assert sum(map(len, want)) > 300 and any(len({q for _, _, q in w}) > 3 for w in want)
    assert runs_of([codes(t) for t in texts]) == want


def test_long_texts_end():
    n = 200_000
    assert runs_of([np.zeros(n, dtype=np.int64)]) == [[(0, n, 1)]]
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 20_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    t = np.array(fibonacci[-1])
    assert runs_of([t], 6, 4) == [[]]  # its exponents stay under 3.62
    assert len(runs_of([t], 6, 3)[0]) > 1000
    short = fibonacci[12]
    assert runs_of([np.array(short)], 6, 3) == [brute(short, 6, 3)]
    rng = np.random.default_rng(4)
    period = rng.integers(0, 50, 3000)
    assert runs_of([np.tile(period, 30)]) == [[(0, 90_000, 3000)]]
    # a thousand runs of one word, each after another word
    many = np.concatenate([[k + 1, *[0] * 8] for k in range(20_000)])
    assert runs_of([many]) == [[(9 * k + 1, 8, 1) for k in range(20_000)]]


def test_exponents_under_three_are_refused():
    with pytest.raises(ValueError, match="three"):
        runs_of([np.zeros(9, dtype=np.int64)], 6, 2)


def test_operator_on_odd_rows(spark):
    long = "x " + "ab cd " * 50_000
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (4, "ha ha ha ha ha ha", 0), (4, "ha ha ha ha ha ha", 0), (None, "é É é É é É é É é", 0), (5, "a b a b a b a", 0), (6, long, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(3)
    out = {(r.doc_id, r.n_words): ([tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()}
    assert periodic_runs(docs).count() == len(rows)
    assert out[1, 0] == out[2, 0] == out[3, 0] == ([], "")
    assert out[4, 6] == ([(0, 6, 1)], "ha")
    assert out[None, 9] == ([(0, 9, 2)], "é É")
    assert out[5, 7] == ([], "a b a b a b a")
    assert out[6, 100_001] == ([(1, 100_000, 2)], "x ab cd")
    assert periodic_runs(docs.limit(0)).collect() == []


def test_query_against_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    some = 0
    for doc_id, text in docs:
        ws = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(ws)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            ws = [ws[a + (i - a) % p] if i >= a else ws[i] for i in range(n)]
        runs = brute(ws)
        some += bool(runs)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        keep = b" ".join(w for w, k in zip(ws, collapsed(n, runs)) if k)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        sha = [hashlib.sha256(x).hexdigest() for x in (listed.encode(), keep)]
        assert got[doc_id] == (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], *sha)
    assert some > 5
