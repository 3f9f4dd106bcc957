"""Phrases against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from genespark.llm import collocations
from genespark.llm.collocations import FAR, NEAR, phrases, top_phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, percent=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in found.items():
            held = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= percent * a for b in held):
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, len(p), " ".join(p), a, counts[p[:k]], counts[p[k:]], score, n[lang]))
    return sorted(out)


def texts(seed, docs=150, words=40):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "É", "state", "a", "city-hall"] + [f"w{k}" for k in range(60)]
    out = []
    for k in range(docs):
        ws = []
        while len(ws) < words:
            ws += rng.choice([["New", "York"], ["New", "York", "state", "of"], ["a"] * rng.randrange(1, 5), [rng.choice(vocabulary)], [rng.choice(vocabulary)]])
        out.append((rng.choice(["en", "en", "en", "de", None]), "".join(w + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", " ;; ", "\r"]) for w in ws)))
    return out


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(k, t, lang, 1) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n int").repartition(parts)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "words", "phrase", "a", "l", "r", "score", "n").collect())


def test_against_plain_counts(spark):
    rows = texts(1) + [("en", None), ("en", ""), (None, " .. ,\t"), ("fr", "seul"), ("xx", "b\x85c d e " * 40)]
    want = brute(rows, 6)
    assert {r[1] for r in want} == {2, 3, 4}
    assert rows_of(phrases(frame(spark, rows), least=6)) == want


def test_a_very_long_text_and_units_of_one_text(spark):
    rows = texts(2, docs=3, words=30_000) + texts(3, docs=20)
    assert rows_of(phrases(frame(spark, rows), least=50)) == brute(rows, 50)


def test_copies_of_one_text_count_each_time(spark):
    rows = [("en", "one two three four five one two")] * 700 + texts(4, docs=30)
    assert rows_of(phrases(frame(spark, rows, 9), least=30)) == brute(rows, 30)


def test_rank(spark):
    rows = texts(5)
    out = top_phrases(phrases(frame(spark, rows), least=6), top=7).collect()
    by = defaultdict(list)
    for lang, _, phrase, a, l, r, score, n in brute(rows, 6):
        by[lang].append((-score, -a, phrase.encode(), l, r, n))
    want = [(lang, k + 1, p.decode(), -a, l, r, n, -s) for lang, x in by.items() for k, (s, a, p, l, r, n) in enumerate(sorted(x)[:7])]
    assert sorted(map(tuple, out)) == sorted(want)


def test_empty_table(spark):
    assert top_phrases(phrases(frame(spark, [], 1))).collect() == []


def test_dense_and_sparse_tiles_give_the_same_sums():
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, NEAR, (2, 300_000))
    cells, counts = a * FAR + b, rng.integers(1, 50, 300_000)
    dense = collocations._summed([(cells[:1000], counts[:1000]), (cells[1000:], counts[1000:])], True)
    sparse = collocations._summed([(cells, counts)], False)
    assert all((x == y).all() for x, y in zip(dense, sparse))
    want = Counter()
    for c, n in zip(cells.tolist(), counts.tolist()):
        want[c] += n
    assert dict(zip(dense[0].tolist(), dense[1].tolist())) == want


def test_blocks_of_ids():
    ids = np.array([0, 1023, 1024, 8191, 8192, 16383, 16384, 10**9])
    block = collocations._block(ids)
    first = collocations._first(block)
    assert (first <= ids).all() and (ids - first < np.where(ids < collocations.HEAD, NEAR, FAR)).all()
    assert block.tolist()[:7] == [0, 0, 1, 7, 8, 8, 9]


def test_ids_follow_frequency(spark):
    rows = [("en" if k % 3 else "de", f"w{k}", 30 + (k * k) % 17) for k in range(500)]
    out = collocations.ranked(spark.createDataFrame(rows, "lang string, word string, f long"), ["word"]).collect()
    for lang in ("en", "de"):
        mine = sorted((r.id, r.f) for r in out if r.lang == lang)
        assert [i for i, _ in mine] == list(range(len(mine))) and [f for _, f in mine] == sorted((f for _, f in mine), reverse=True)
