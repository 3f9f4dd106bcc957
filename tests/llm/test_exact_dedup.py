"""Exact duplicates against plain grouping, with fingerprints that collide and texts in chunks."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from genespark.llm import exact_dedup
from genespark.llm.exact_dedup import PRIME, exact_duplicates, packed, polynomials, values

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        raw = text.encode("utf-8", "surrogatepass")
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(raw).hexdigest(), len(raw)) for i in ids]
    return sorted(out, key=repr)


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "keep", 1) for i, t in rows], "doc_id long, text string, keep_id string, group_size int").repartition(parts)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_values_of_parts_add_up():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 700_001, dtype=np.uint8).tobytes()
    whole = values(data, np.array([len(data)]), exact_dedup.BASES)
    horner = 0
    for byte in reversed(data[:3000]):
        horner = (horner * exact_dedup.BASES[2] + byte) % PRIME
    assert values(data[:3000], np.array([3000]), exact_dedup.BASES)[0, 2] == horner
    at = [0, 1, 2, 262_144, 262_145, 600_000, len(data)]
    parts = values(data, np.array(at[1:]), exact_dedup.BASES)
    for k, p in enumerate(polynomials(exact_dedup.BASES)):
        total = sum(int(v) * int(s) for v, s in zip(parts[:, k], p.shift(np.array(at[:-1])))) % PRIME
        assert total == whole[0, k]
    # empty texts between others
    v = values(b"abab", np.array([0, 2, 2, 4, 4]), exact_dedup.BASES)
    assert not v[[0, 2, 4]].any() and (v[1] == v[3]).all() and v[1].all()
    assert len(np.unique(packed(parts)[0])) == len(parts)


def test_groups_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(k, f"Text number {rng.randrange(60)} É") for k in range(200)]
    rows += [(200, None), (201, ""), (202, " "), (203, "É"), (204, "é"), (None, "Only Here"), (None, "text number 3 É"), (None, "only here")]
    rows += [(205, "again"), (205, "again"), (205, "other"), (206, "AGAIN"), (-5, "\u0000x"), (7, "\u0000X"), (300, "a" * 300_000), (301, "A" * 300_000), (302, "a" * 299_999 + "b")]
    assert got(exact_duplicates(frame(spark, rows))) == brute(rows)
    assert got(exact_duplicates(frame(spark, rows), chunk=7 * 1024)) == brute(rows)


def test_a_large_group_in_many_streams(spark):
    rows = [(k, "the same again" if k % 3 else f"own {k}") for k in range(3000)]
    assert got(exact_duplicates(frame(spark, rows, 11), chunk=5)) == brute(rows)


@pytest.mark.parametrize("chunk", [2, 1 << 20])
def test_texts_that_share_a_fingerprint_are_told_apart(spark, chunk):
    # at the point 1 a text's value is the sum of its bytes, so all orders of its letters collide
    rng = random.Random(5)
    words = ["abcd", "abdc", "dcba", "ABCD", "bbbb", "cab", "bca", "xyz"]
    rows = [(k, rng.choice(words)) for k in range(900)] + [(None, "cab"), (None, "bac")]
    assert got(exact_duplicates(frame(spark, rows), chunk=chunk, bases=(1, 1, 1, 1))) == brute(rows)


def test_an_empty_table(spark):
    assert exact_duplicates(frame(spark, [], 1)).collect() == []


def test_query_has_the_columns_asked_for(spark):
    from genespark.llm.queries import QUERIES

    out = QUERIES["op11_exact_dedup"](spark, "/root/testdata/sf0.001")
    assert out.columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(out) == brute(rows)
