"""Tokens, token files, packing and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from genespark.llm import common, near_dedup, packing, quality_rules, secrets, token_file, tokens
from genespark.llm.common import stash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    "Hello, world!! it's ÀÉÑ, straße, x<|endoftext|>y don't 12ab3 \x1c  é é. İI ſ K ¿qué? a​b 日本語, ----'s 's l'eau, $$$&&& ",
    "", None, " \n", "They'LL 've", '"quoted" (x)', "a　b c", "word " * 9000, "THE The the", "a\x85b́ ́c",
]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def whole(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def test_cached_words_give_the_ids_of_the_library(library):
    for most in (3, 10_000):
        encoder = tokens.Encoder(tokens.vocabulary_path(), most)
        for text in TEXTS:
            assert np.frombuffer(tokens.with_end(encoder, text), "<u4").tolist() == whole(library, text).tolist()


@pytest.mark.parametrize("n", [1, 4095, 4096, 4097, 600_001])
def test_blocks_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 49_000).astype("<u4")
    table = token_file.Table.of([ids])
    assert int(table.freq.sum()) == 1 << token_file.SCALE and table.freq.min() >= 1
    words, marks = token_file.encode(ids, table)
    again = token_file.Table.load(table.dump())
    assert (token_file.decode(words, marks, n, again) == ids).all()
    step = token_file.LANES * token_file.STEPS
    for k in range(len(marks)):  # each checkpoint by itself
        assert (token_file.decode(words, marks, n, again, k, k + 1) == ids[k * step : (k + 1) * step]).all()
    broken = [(*marks[0][:3], marks[0][3] ^ 1), *marks[1:]]
    with pytest.raises(ValueError, match="checksum"):
        token_file.decode(words, broken, n, again)


def test_flat_and_steep_tables():
    assert token_file.frequencies(np.ones(60_000, dtype=np.int64)).sum() == 65_536
    f = token_file.frequencies(np.array([10**9] + [1] * 50_000))
    assert f.sum() == 65_536 and f.min() == 1
    with pytest.raises(ValueError):
        token_file.frequencies(np.ones(70_000, dtype=np.int64))


@pytest.mark.parametrize("ranges", [1, 3])
def test_token_file_of_odd_rows(spark, library, tmp_path, ranges):
    rows = [(10 - i, t) for i, t in enumerate(TEXTS)] + [(4, "again"), (4, "again"), (None, "no number")]
    docs = docs_of(spark, rows).selectExpr("*", "1 as ids", "2 as range")
    got = token_file.round_trip(docs, f"file://{tmp_path}/t", ranges=ranges).collect()
    assert len(got) == len(rows)
    want = Counter((i, len(ids := whole(library, t)), zlib.crc32(ids.tobytes())) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    empty = token_file.round_trip(docs_of(spark, []), f"file://{tmp_path}/e", ranges=ranges)
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_segments_and_blocks_split(spark, monkeypatch, library):
    monkeypatch.setattr(token_file, "BLOCK_IDS", 50)
    monkeypatch.setattr(token_file, "SEGMENT_IDS", 120)
    import pandas as pd

    data = [np.arange(k + 1, dtype="<u2") for k in range(40)]
    frame = pd.DataFrame({"range": [0] * 30 + [2] * 10, "doc_id": range(40), "ids": [d.tobytes() for d in data]})
    out = pd.concat(list(token_file._segments("<u2")(iter([frame[:7], frame[7:]]))))
    assert out["segment"].max() > 1 and out["block"].max() > 0 and set(out["range"]) == {0, 2}
    at = {0: 0, 2: 0}
    docs = []
    for r in out.itertuples():
        assert r.inside == at[r.range]
        at[r.range] += r.n_ids
        ids = token_file.decode(r.words, r.marks, r.n_ids, token_file.Table.load(r.table))
        docs += np.split(ids, np.cumsum(r.lengths)[:-1])
    assert [d.tolist() for d in docs] == [d.tolist() for d in data]


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room[room.index(min(fits))] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_plans_match_plain_best_fit():
    rng = random.Random(0)
    for _ in range(200):
        counts = {rng.randint(1, 50): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        placed, slots = Counter(), defaultdict(list)
        for length, rank, many, each, first, offset in packing.plan(counts, 50):
            assert rank == placed[length]
            placed[length] += many
            for j in range(many):
                slots[first + j // each].append((offset + j % each * length, length))
        assert placed == counts
        for s in slots.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 50
        assert len(slots) == best_fit(Counter(counts).elements(), 50)
    assert packing.plan({}, 50) == []
    # the plan depends on the kinds of lengths, not on how many pieces there are
    assert len(packing.plan({n: 10**9 for n in range(1, 51)}, 50)) < 1000


def check_packing(rows, want, capacity):
    """rows: the result; want: counts of (doc_id, piece, start, length, crc)."""
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.sequence_id].append((r.offset, r.length))
    for s in slots.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(slots)


def pieces_of(library, rows, capacity):
    want = Counter()
    for i, text in rows:
        ids = whole(library, text)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    return want


def test_packing_of_odd_rows(spark, library):
    rows = list(enumerate(TEXTS)) + [(5, "x")] * 30 + [(None, "none"), (77, "word " * 4095)]
    docs = docs_of(spark, rows).selectExpr("*", "1 as length", "2 as piece", "3 as rank", "4 as chunk")
    want = pieces_of(library, rows, packing.CAPACITY)
    got = packing.packed_documents(docs).collect()
    assert check_packing(got, want, packing.CAPACITY) == best_fit([k[3] for k in want.elements()], packing.CAPACITY)
    assert packing.packed_documents(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length long"), 5)


def test_stages_and_pipeline_against_plain_python(spark, library, tmp_path):
    rng = random.Random(1)

    def prose(n):
        return " ".join(f"w{rng.randrange(9000)}" for _ in range(n))

    rows = [(i, prose(rng.randrange(60, 160))) for i in range(160)]
    rows = [(i, " ".join(w + "%%%" for w in t.split()) if i % 5 == 0 else t) for i, t in rows]
    items = [(k, prose(30)) for k in range(4)]
    rows += [(200, rows[1][1]), (201, rows[2][1] + " more"), (202, prose(80) + " " + items[0][1]), (203, None), (204, "few words"), (205, prose(60) + " token = \"" + "0123456789abcdef" * 3 + "\" é")]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secrets", "packing"]
    docs = common.documents(spark, str(tmp_path))
    left, steps = dict(rows), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, str(tmp_path)))
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        steps.append({r.doc_id: r.text for r in docs.collect()})
    left = {i: t for i, t in left.items() if i % 5 and i not in (203, 204) or i in (200, 205)}
    assert steps[0] == left
    left = {i: t for i, t in left.items() if i not in (200, 201)}
    assert steps[1] == left
    left.pop(202)
    assert steps[2] == left
    left[205] = left[205][: left[205].index("token =")] + "[secret]\" é"
    assert steps[3] == left
    assert {r.doc_id: r.n_chars for r in docs.collect()} == {i: len(t) for i, t in left.items()}
    want = pieces_of(library, left.items(), packing.CAPACITY)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert check_packing(got, want, packing.CAPACITY) == best_fit([k[3] for k in want.elements()], packing.CAPACITY)


def test_stages_take_empty_tables(spark, tmp_path):
    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Cluster)


def test_ids_that_do_not_fit_are_an_error(spark):
    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit"):
        token_file.token_ids(docs, end=70_000).collect()
    wide = token_file.token_ids(docs, end=70_000, width="<u4").first()
    assert np.frombuffer(wide.ids, dtype="<u4")[-1] == 70_000
