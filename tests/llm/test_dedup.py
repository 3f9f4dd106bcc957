"""Near-duplicates and repeated passages against brute force, and their edge cases."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from genespark.llm import minhash, near_dedup, substring_dedup
from genespark.llm.common import WordHashes, lower_hashes, shingle_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", None) if len(r) == 2 else r for r in rows], SCHEMA)


def sentence(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def shingle_set(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def brute_components(sets):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows, at = [], 0
    for _ in range(40):
        base = sentence(rng, rng.choice([3, 6, 40, 200]))
        for _ in range(rng.choice([1, 1, 2, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((at, " ".join(copy)))
            at += 1
    # a chain: neighbours are alike, ends are not; and a group around one source
    chain = sentence(rng, 120)
    for k in range(12):
        rows.append((at, " ".join(chain[5 * k :] + chain[: 5 * k])))
        at += 1
    source = sentence(rng, 150)
    for k in range(60):
        copy = list(source)
        for _ in range(rng.choice([2, 3, 4, 5])):
            copy[rng.randrange(150)] = f"new{k}"
        rows.append((at, " ".join(copy)))
        at += 1
    rng.shuffle(rows)
    return rows


def test_near_duplicates_match_brute_force(spark, corpus):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs_of(spark, corpus)).collect()}
    sets = {i: shingle_set(t) for i, t in corpus}
    want = brute_components(sets)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = near_dedup.drop_near_duplicates(docs_of(spark, corpus)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"v{k}" for k in range(30_000))
    rows = [
        (7, "One two three four five six"), (7, "One two three four five six"), (3, "one TWO three  four\tfive six"),
        (None, "one two three four five six"), (4, None), (5, ""), (6, " \n "), (8, "two words"), (9, "Two words"),
        (10, long), (11, long + " end"), (None, "alone and without any number at all"),
    ]
    docs = docs_of(spark, rows).selectExpr("*", "1 as pid", "'x' as hash", "2 as root", "array(1) as bands")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == sorted(
        [("7", 2, "3", False)] * 2 + [("3", 2, "3", True), ("None", 2, "3", False), ("4", 0, "4", True), ("5", 0, "5", True), ("6", 0, "6", True)]
        + [("8", 1, "8", True), ("9", 1, "8", False), ("10", 29_996, "10", True), ("11", 29_997, "10", False), ("None", 3, "None", True)]
    )
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "4", "5", "6", "8", "10", "None"])
    again = docs_of(spark, [(1, "a b c d e f g")] * 3)
    assert near_dedup.drop_near_duplicates(again).count() == 1
    empty = docs_of(spark, [])
    assert near_dedup.near_duplicates(empty).count() == 0 == near_dedup.drop_near_duplicates(empty).count()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    y = np.unique(np.concatenate([x[:600], rng.integers(0, 2**63, 300).astype(np.uint64)]))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    a, b = (minhash.pack(minhash.minima(s, minhash.WIDE_HASHES)).view(np.uint64) for s in (x, y))
    same = sum((int(p ^ q) >> k) & 3 == 0 for p, q in zip(a, b) for k in range(0, 64, 2))
    estimate = (same / minhash.WIDE_HASHES - 0.25) / 0.75
    assert abs(estimate - true) < 0.06


def test_shingles_of_words():
    t = WordHashes()
    assert len(shingle_hashes(t.array([]), 5)) == 0
    assert len(shingle_hashes(t.array([b"a", b"b"]), 5)) == 1
    assert len(shingle_hashes(t.array([b"a"] * 9), 5)) == 1
    assert shingle_hashes(t.array([b"a", b"b"]), 5) != shingle_hashes(t.array([b"b", b"a"]), 5)


def test_words_hashed_in_arrays_have_the_hashes_of_single_words():
    rng = np.random.default_rng(5)
    letters = list("abcXYZ019-éß漢😀\x00\x85\u00a0\u2028\ud800")
    ws = ["".join(rng.choice(letters, n)) for n in [*range(1, 45), 1000, 5000] for _ in range(20)]
    text = "\n \t" + "".join(w + "".join(rng.choice(list(" \t\n\r\x0b\x0c"), rng.integers(1, 3))) for w in ws)
    for t in (text, text.strip(" \t\n\r\x0b\x0c"), "a", " a", "a ", "", None, " \n"):
        expected = WordHashes().array((t or "").encode("utf-8", "surrogatepass").lower().split())
        assert np.array_equal(lower_hashes(t), expected)
    assert len(lower_hashes(text)) == len(ws)


def test_lines_in_one_pass_have_the_shingles_of_each_line_alone():
    line = "Ä b c d e f g h i j a b c d e"
    text = f"\n{line}\n\na b\r\n {line} x\n{'y ' * 30}\n{line}"
    for size in (5, 40):
        found = list(minhash.paragraphs(10)(text, size))
        assert [(k, at, n, m) for k, at, n, m, _ in found] == [(1, 1, len(line), 15), (4, 37, len(line) + 3, 16), (5, 70, 60, 30), (6, 131, len(line), 15)]
        for _, at, n, _, sh in found:
            assert np.array_equal(sh, shingle_hashes(lower_hashes(text[at : at + n]), size)) and len(sh) == len(set(sh.tolist()))
        assert [x[0] for x in minhash.paragraphs(10)(text, size, {4})] == [4]


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 150)] + [(200, 200)]
    got = {r.pid: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(2, 41)} | {k: 100 for k in range(101, 150)}
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_passages_match_brute_force(spark):
    rng = random.Random(9)
    shared = [" ".join(sentence(rng, 60)) for _ in range(5)]
    texts = {}
    for d in range(60):
        lines = [" ".join(sentence(rng, rng.choice([5, 25, 70]))) for _ in range(4)]
        if d % 3 == 0:
            w = rng.choice(shared).split()
            if d % 2:
                w[7] = "other"
            lines.insert(rng.randrange(4), " ".join(w))
        texts[d] = "\n".join(lines)
    texts[60] = texts[0]
    got = substring_dedup.repeated_passages(docs_of(spark, list(texts.items()))).collect()
    sets = {(d, k): shingle_set(x) for d, t in texts.items() for k, x in enumerate(t.split("\n")) if len(x.split()) >= 20}
    of = brute_components(sets)
    size = defaultdict(int)
    for r in of.values():
        size[r] += 1
    assert {(r.doc_id, r.paragraph): (r.keeper_doc_id, r.keeper_paragraph) for r in got} == {i: r for i, r in of.items() if size[r] > 1}
    for r in got:
        assert texts[r.doc_id][r.start : r.start + r.length] == texts[r.doc_id].split("\n")[r.paragraph]
        assert r.removed == ((r.doc_id, r.paragraph) != (r.keeper_doc_id, r.keeper_paragraph))
    gone = {(r.doc_id, r.paragraph) for r in got if r.removed}
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs_of(spark, list(texts.items()))).collect()}
    assert left == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in texts.items()}


def test_repeated_passages_of_odd_rows(spark):
    line = " ".join(f"é{k}" for k in range(30))
    rows = [(None, line), (2, "x\n" + line), (2, "x\n" + line), (3, None), (4, ""), (5, line + "\n" + line)]
    docs = docs_of(spark, rows).selectExpr("*", "0 as item", "0 as removed")
    got = sorted((str(r.doc_id), r.paragraph, r.start, r.keeper_doc_id, r.removed) for r in substring_dedup.repeated_passages(docs).collect())
    assert got == [("2", 1, 2, 2, False), ("2", 1, 2, 2, True), ("5", 0, 0, 2, True), ("5", 1, len(line) + 1, 2, True), ("None", 0, 0, 2, True)]
    left = substring_dedup.remove_repeats(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted(
        [("None", ""), ("2", "x\n" + line), ("2", "x\n" + line), ("3", "None"), ("4", ""), ("5", "")]
    )
    assert substring_dedup.repeated_passages(docs_of(spark, [])).count() == 0


def test_passages_within_long_lines_and_over_wrapped_lines(spark):
    rng = random.Random(21)
    shared = sentence(rng, 60)

    def wrapped(ws, n):
        return "\n".join(" ".join(ws[k : k + n]) for k in range(0, len(ws), n))

    head, tail = sentence(rng, 70), sentence(rng, 70)
    loose = sentence(rng, 30)
    rows = [
        (1, " ".join(head + shared + tail)),
        (2, "a title\n" + wrapped(shared, 10) + "\nthe end"),
        (3, " ".join(sentence(rng, 300) + shared)),
        (4, " ".join(sentence(rng, 200))),
        (5, " ".join(sentence(rng, 90) + loose)),
        (6, " ".join(loose + sentence(rng, 90))),
        (2, "a title\n" + wrapped(shared, 10) + "\nthe end"),
    ]
    got = substring_dedup.repeated_passages(docs_of(spark, rows)).collect()
    texts = dict(rows)
    assert sorted((r.doc_id, r.n_words, r.keeper_doc_id, r.copies, r.removed) for r in got) == [
        (1, 60, 1, 4, False), *[(2, 2, 2, 2, False)] * 2, *[(2, 2, 2, 2, True)] * 2, *[(2, 60, 1, 4, True)] * 2, (3, 60, 1, 4, True),
    ]
    for r in got:
        if r.n_words == 60:
            assert texts[r.doc_id][r.start : r.start + r.length].split() == shared
        assert texts[r.doc_id][: r.start].count("\n") == r.paragraph
    left = {r.doc_id: r.text.split() for r in substring_dedup.remove_repeats(docs_of(spark, rows)).collect()}
    assert left[1] == texts[1].split() and left[2] == ["a", "title", "the", "end"]
    assert left[3] == texts[3].split()[:300] and left[4] == texts[4].split() and left[6] == texts[6].split()


def test_every_repeated_run_is_covered_and_one_copy_stays(spark):
    rng = random.Random(22)
    pool = [sentence(rng, n) for n in (52, 64, 90, 130)]
    texts = {}
    for d in range(40):
        ws = []
        for _ in range(3):
            p = rng.choice(pool)
            at = rng.randrange(len(p) - 50)
            ws += sentence(rng, rng.randrange(3, 90)) + p[at : at + rng.randrange(30, 120)]
        texts[d] = " ".join(w + rng.choice(["\n", " ", " ", " ", " "]) for w in ws)
    texts[40] = "la " * 130  # one word again and again
    got = defaultdict(list)
    docs = docs_of(spark, list(texts.items()))
    for r in substring_dedup.repeated_passages(docs).collect():
        got[r.doc_id].append((r.start, r.start + r.length, r.paragraph))
    runs = defaultdict(list)
    for d, t in texts.items():
        w = t.split()
        for k in range(len(w) - 49):
            runs[tuple(w[k : k + 50])].append((d, k))
    for where in runs.values():
        for d, k in where if len(where) > 1 else []:
            places = [m.span() for m in re.finditer(r"\S+", texts[d])][k : k + 50]
            out = [p for p in places if not any(a <= p[0] and p[1] <= b for a, b, _ in got[d])]
            # short remainders beside reported lines may be left, but never most of a run
            assert len(out) < 20, (d, k, len(out))
    left = "\n".join(r.text for r in substring_dedup.remove_repeats(docs).collect())
    have = set(minhash_pieces(left))
    assert all(p in have for run, where in runs.items() for p in minhash_pieces(" ".join(run)) if len(where) > 1)
    assert len(next(t for t in left.split("\n") if t.startswith("la ")).split()) == 50


def minhash_pieces(text, size=1):
    w = text.split()
    return [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
