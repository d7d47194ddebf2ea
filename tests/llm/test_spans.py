"""Shared spans against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from seqbucket.llm.spans import _mix, _windows, compact_windows, gram_hashes, shared_share, shared_spans


def brute(records, span):
    at: dict = {}
    for i, t in records:
        for p in range(len(t or "") - span + 1):
            at.setdefault(t[p : p + span], set()).add(i)
    out = set()
    for i, t in records:
        hit = [False] * (len(t or "") + 1)
        for p in range(len(t or "") - span + 1):
            if len(at[t[p : p + span]]) > 1:
                hit[p : p + span] = [True] * span
        start = None
        for p, h in enumerate(hit):
            if h and start is None:
                start = p
            if not h and start is not None:
                out.add((i, start, p))
                start = None
    return sorted(out, key=repr)


@pytest.mark.parametrize("hashes", [1, 3])
@pytest.mark.parametrize("span,gram", [(16, 8), (16, 16), (10, 3), (64, 32)])
def test_windows_of_a_cartesian_tree(span, gram, hashes):
    """Each stretch lies in one window, that of its root: the leftmost smallest token, whatever finds it."""
    rnd = random.Random(span)
    texts = ["".join(rnd.choice("AC") for _ in range(n)) for n in (200, span, 0, span - 1, 90)] + ["A" * 150]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    first, last, signature = compact_windows(codes, starts, span, gram, hashes)
    covered = [p for a, b in zip(first, last) for p in range(a, b + 1)]
    assert covered == [a + i for a, t in zip(starts, texts) for i in range(len(t) - span + 1)]
    if hashes == 1:
        tokens, roots = gram_hashes(codes, gram), {}
        for a, b, s in zip(first, last, signature):
            for p in range(a, b + 1):
                h = [int(x) for x in (_mix(tokens[p : p + span - gram + 1]) | np.uint64(1))]
                assert min(h) == s
                roots.setdefault((a, b), set()).add(p + h.index(min(h)))
        assert all(len(r) == 1 for r in roots.values())


@pytest.mark.parametrize("span,gram,more", [(16, 8, {}), (16, 16, {}), (10, 3, {}), (64, 32, {}), (16, 8, {"hashes": 3}), (16, 8, {"texts": 1}), (16, 8, {"group": 2}), (10, 3, {"texts": 2, "group": 4, "hashes": 2})])
def test_against_brute_force(spark, rows, span, gram, more):
    rnd = random.Random(span + gram)
    parts = ["".join(rnd.choice("ACGT") for _ in range(rnd.randrange(span, 3 * span))) for _ in range(6)] + ["N" * (2 * span), "é€😀" * span]
    records = [(i, "".join(rnd.choice(parts) if rnd.random() < 0.6 else "".join(rnd.choice("ACGTn ") for _ in range(40)) for _ in range(rnd.randrange(5)))) for i in range(40)]
    records += [(100, None), (101, ""), (102, parts[0]), (102, parts[0]), (103, parts[0][:span]), (104, "Q" * (4 * span)), (105, "Z" * 3)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in records], "rec_id long, seq string, start_pos int, text string").repartition(3)
    assert rows(shared_spans(df, "rec_id", "seq", span, gram, **more)) == brute(records, span)


def test_share(spark, rows):
    df = spark.createDataFrame([(1, "A" * 10 + "C" * 64), (2, "C" * 64), (3, None), (4, "")], "rec_id long, seq string")
    assert rows(shared_share(df, "rec_id", "seq")) == [(1, 74, 64, 64 / 74), (2, 64, 64, 1.0), (4, 0, 0, 0.0)]


def test_one_very_long_text(spark, rows):
    rnd = random.Random(4)
    t = "".join(rnd.choice("ACGT") for _ in range(3_000_000))
    df = spark.createDataFrame([(1, t), (2, t[1_000_000:1_000_200])], "rec_id long, seq string")
    assert rows(shared_spans(df, "rec_id", "seq")) == [(1, 1_000_000, 1_000_200), (2, 0, 200)]


def test_texts_in_pieces(spark, rows, monkeypatch):
    from seqbucket.llm import spans

    rnd = random.Random(6)
    records = [(i, "".join(rnd.choice("ACGT") for _ in range(300))) for i in range(4)]
    records.append((9, records[0][1][50:250] + records[1][1] + "AC"))
    monkeypatch.setattr(spans, "CHARS", 37)
    texts = [t for _, t in records]
    got = {(int(r), int(f)) for row, first, codes, starts in spans._runs(texts, 15) for r, f in zip(row, first)}
    assert all((i, a) in got for i, t in enumerate(texts) for a in range(0, len(t) - 15, 37))
    for row, first, codes, starts in spans._runs(texts, 15):
        for r, f, a, b in zip(row, first, starts, starts[1:]):
            assert "".join(map(chr, codes[a:b])) == texts[r][f : f + b - a]


def test_one_letter_and_a_hot_passage(spark, rows):
    """A run of one letter, or of a few that repeat, makes a row, not one a character; a passage that most records hold is sent once a batch."""
    rnd = random.Random(8)
    passage = "".join(rnd.choice("ACGT") for _ in range(150))
    texts = ["A" * 3000, "C" + "A" * 2000, "GT" * 900, "TTGAC" * 300, "CC" + "TTGAC" * 90] + ["".join(rnd.choice("ACGT") for _ in range(80)) + passage for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["rec_id", "text"])
    out = pa.Table.from_batches(list(_windows(iter([batch]), 64, 32, 1, 256))).to_pandas()
    asked = out[(out["kind"] == 1) & out["text"].fillna("").map(lambda t: t in passage or set(t) in ({"A"}, {"G", "T"}) or "TTGACTTGAC" in t)]
    assert asked.groupby("text").size().max() == 1 and len(asked) < 40
    df = spark.createDataFrame(list(enumerate(texts)), "rec_id long, seq string").repartition(3)
    assert rows(shared_spans(df, "rec_id", "seq")) == brute(list(enumerate(texts)), 64)


def test_empty(spark):
    assert shared_spans(spark.createDataFrame([], "rec_id long, seq string"), "rec_id", "seq").collect() == []


def test_rows_without_an_id(spark):
    df = spark.createDataFrame([(1, "A" * 70), (None, "A" * 70)], "rec_id long, seq string")
    assert shared_spans(df, "rec_id", "seq").collect() == []
