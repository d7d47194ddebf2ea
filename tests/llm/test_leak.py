"""FM-index against brute force."""

import random
import re

import numpy as np
import pytest

from seqbucket.llm.leak import FMIndex, leaked, leaked_spans, suffix_order, words


def test_words_are_ascii_runs():
    text = "Ab9 é-K x_y İI 漢字 end".encode()
    h, a, b = words(text)
    assert [text[i:j] for i, j in zip(a, b)] == re.findall(rb"[0-9A-Za-z]+", text)
    assert words(b"AB ab")[0][0] == words(b"AB ab")[0][1] and words(b"ab ba")[0][0] != words(b"ab ba")[0][1]
    assert all(len(x) == 0 for x in words(b"")) and len(words(b" .")[0]) == 0


@pytest.mark.parametrize("seed", range(5))
def test_suffix_order(seed):
    rng = np.random.default_rng(seed)
    s = np.concatenate([rng.integers(1, 3, 400), [0]]).astype(np.int64)
    assert suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("seed", range(4))
def test_index(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, 4, rng.integers(0, 80)).astype(np.uint64) for _ in range(30)] + [np.ones(200, np.uint64)] * 2
    index = FMIndex(texts)
    phrases = rng.integers(0, 5, (60, 3)).astype(np.uint64)
    low, high = index.count(phrases)
    for p, a, b in zip(phrases.tolist(), low, high):
        t, w = index.locate(np.arange(a, b))
        want = {(i, j) for i, x in enumerate(texts) for j in range(len(x) - 2) if x[j : j + 3].tolist() == p}
        assert set(zip(t.tolist(), w.tolist())) == want and b - a == len(want)


def brute(docs, items, size):
    grams = lambda t: {tuple(w[i : i + size]) for w in [[x.lower() for x in re.findall("[0-9A-Za-z]+", t or "")]] for i in range(len(w) - size + 1)}
    return sorted({(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}, key=repr)


def test_documents(spark, rows):
    rnd = random.Random(2)
    vocabulary = ["a", "B", "c3", "dd", "É"]
    phrase = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, phrase(rnd.randrange(3, 30))) for i in range(20)] + [(50, None), (51, ""), (52, "a a a a a a a a a a a a a a")]
    docs = [(i, phrase(rnd.randrange(40)) + rnd.choice(["", "\n" + items[rnd.randrange(20)][1].upper().replace(" ", ", ")])) for i in range(60)] + [(100, None), (101, ""), (102, "a-" * 3000)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id long").repartition(3)
    t = spark.createDataFrame(items, "item_id long, text string")
    for size in (12, 4):
        assert rows(leaked(d, "doc_id", "text", t, "item_id", "text", size)) == brute(docs, items, size)
    spans = [r for r in leaked_spans(d, "doc_id", "text", t, "item_id", "text").collect() if r["doc_id"] == 102]
    assert [(r["item_id"], r["start_char"], r["end_char"]) for r in spans] == [(52, 0, 5999)]


def test_empty(spark):
    d, t = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a " * 20)], "item_id long, text string")
    assert leaked(d, "doc_id", "text", t, "item_id", "text").collect() == []
    assert leaked(t, "item_id", "text", d, "doc_id", "text").collect() == []


def test_a_text_longer_than_a_shard(spark, rows, monkeypatch):
    rnd = random.Random(9)
    item = " ".join(rnd.choice("abcdefgh") for _ in range(20))
    text = "x " * 1_500_000 + item + " y" * 3_000_000 + " " + item + " " + "z" * 8_000_000
    d = spark.createDataFrame([(1, text), (2, item), (3, "x " * 30)], "doc_id long, text string")
    t = spark.createDataFrame([(7, item)], "item_id long, text string")
    first = 3_000_000
    second = first + len(item) + 6_000_001
    want = [(1, 7, first, first + len(item)), (1, 7, second, second + len(item)), (2, 7, 0, len(item))]
    assert rows(leaked_spans(d, "doc_id", "text", t, "item_id", "text")) == sorted(want, key=repr)


def test_pieces_overlap(monkeypatch):
    from seqbucket.llm import leak

    monkeypatch.setattr(leak, "SHARD_WORDS", 7)
    rng = np.random.default_rng(5)
    h = rng.integers(0, 3, 200).astype(np.uint64)
    asked = leak.Asked([], 3)
    asked.kept = [leak.Phrases([(4, h[50:70])], 3)]
    data = b"a " * 200
    monkeypatch.setattr(leak, "all_words", lambda _: (h, np.arange(0, 400, 2), np.arange(1, 400, 2)))
    phrases = {tuple(x) for x in np.lib.stride_tricks.sliding_window_view(h[50:70], 3).tolist()}
    hit = [i for i in range(198) if tuple(h[i : i + 3].tolist()) in phrases]
    covered = set()
    for _, _, a, b in leak._search([(1, data)], asked):
        covered |= {w for w in range(200) if a <= 2 * w < b}
    assert {w for i in hit for w in range(i, i + 3)} <= covered


def test_items_in_blocks(spark, tmp_path, monkeypatch):
    """Every block is asked for on one index; items that fit in a block are read once."""
    from seqbucket.llm import leak

    rnd = random.Random(3)
    items = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(30))) for i in range(40)]
    t = spark.createDataFrame([*items, (99, "a b"), (None, items[0][1]), (98, None)], "item_id long, text string").repartition(3)
    files = leak.item_words(t, "item_id", "text", 12)
    files.write.parquet(str(tmp_path / "items"))
    names = spark.read.parquet(str(tmp_path / "items")).inputFiles()
    made = []
    monkeypatch.setattr(leak, "FMIndex", lambda texts, f=leak.FMIndex: made.append(1) or f(texts))
    docs = [(1, items[3][1].encode()), (2, (items[7][1] + " x " + items[39][1]).encode())]
    for words, blocks in ((100, 10), (1 << 20, 1)):
        monkeypatch.setattr(leak, "ITEM_WORDS", words)
        asked = leak.Asked(names, 12)
        assert len(list(asked.blocks())) >= blocks and (asked.kept is not None) == (blocks == 1)
        made.clear()
        assert {(d, i) for d, i, _, _ in leak._search(docs, asked)} == {(1, 3), (2, 7), (2, 39)} and len(made) == 1


def test_nulls_and_repeated_rows(spark, rows):
    text = "a b c d e f g h i j k l"
    d = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    t = spark.createDataFrame([(5, text), (5, text), (None, text)], "item_id long, text string")
    assert rows(leaked(d, "doc_id", "text", t, "item_id", "text")) == [(1, 5), (None, 5)]
