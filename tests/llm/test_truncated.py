"""Cut texts: endings, limits, and texts that only look cut."""

import random

import pytest

from seqbucket.llm.truncated import BROKEN, DOTS, OPEN, WHOLE, ending, judged, layouts, limits, rates, routes, shapes

HUNK = "fix it\n\ndiff --git a/x.c b/x.c\nindex 1..2 100644\n--- a/x.c\n+++ b/x.c\n@@ -1,2 +1,2 @@ f()\n a\n-b\n+c"


@pytest.mark.parametrize(
    "text,state",
    [
        ("Fix.\n\nIt works now.", WHOLE),
        ("Fix.\n\nIt works no", BROKEN),
        ("Fix.\n\nIt works no\n", OPEN),
        ("Fix the thing", OPEN),
        ("Merge it\n\n# Conflicts:\n#\tsrc/a.c", WHOLE),
        ("Merge it\n\n# Conflicts:\n#\tsrc/ab", BROKEN),
        ("Fix.\n\n> quoted from the middle of", OPEN),
        ("Fix.\n\nit was quoted from the middle of", OPEN),
        ("Fix.\n\nQUOTED IN CAPITALS, FROM THE", OPEN),
        (HUNK + " …", OPEN),
        ("Fix.\n\nIt wor…", BROKEN),
        ("Fix.\n\nIt works...", DOTS),
        ("Fix.\n\nSigned-off-by: A B <a@b.c>", WHOLE),
        ("Fix.\n\nSigned-off-by: A B <a@b", BROKEN),
        ("Fix.\n\nTicket: AB-12", WHOLE),
        ("Fix.\n\nTicket: AB", BROKEN),
        ("Fix.\n\nTicket:", BROKEN),
        ("Fix.\n\nNote: it works now.", WHOLE),
        ("Author: A B <a@b.c>\nDate: today\n\nFix it", OPEN),
        ("Author: A B <a@b.c>\nDate: today", BROKEN),
        (HUNK, OPEN),
        (HUNK[:-3], BROKEN),
        (HUNK + "\nTicket: 123456", WHOLE),
        (HUNK[: HUNK.index("@@")], BROKEN),
        (HUNK + "(", BROKEN),
        (HUNK + "\n-- \n2.40.1", OPEN),
        ("x\n\ndiff --git a/y b/y\nindex 1..2 100644\nBinary files a/y and b/y differ", WHOLE),
        ("x\n\ndiff --git a/y b/y\nindex 1..2 100644\nBinary files a/y and", BROKEN),
        ("x\n\ndiff --git a/y b/", BROKEN),
    ],
)
def test_endings(text, state):
    assert ending(text) == state
    assert ending(text.replace("\n", "\r\n")) == state


def corpus():
    rnd = random.Random(1)
    word = lambda: rnd.choice(["alpha", "beta", "gamma", "delta", "naïve"])
    docs, cut = [], set()
    for i in range(1500):
        text = "Subject\n\n" + " ".join(word() for _ in range(rnd.randrange(10, 90))) + "."
        source = "limited" if i % 3 else None
        if source and len(text) > 300:
            text = text[:300]
            if text[-1] != ".":
                cut.add(i)
        docs.append((i, source, text))
    return docs, cut


def test_limits_are_found(spark, rows):
    docs, cut = corpus()
    docs += [(3000 + i, None, "One subject that is often the same") for i in range(40)]
    docs += [(2000, "limited", None), (2001, "limited", ""), (2002, None, " \n"), (2003, "one", "x" * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    assert [(r["source"], r["unit"], r["length"]) for r in limits(shapes(df, "doc_id", "source", "text")).collect()] == [("limited", "chars", 300)]
    got = {r["doc_id"] for r in judged(df, "doc_id", "source", "text").where("cut = 1").collect()}
    assert got == cut
    share = {r["source"]: (r["n_texts"], r["n_cut"]) for r in rates(df, "doc_id", "source", "text").collect()}
    assert share["limited"] == (1000, len(cut)) and share[None] == (540, 0) and share["one"] == (1, 0)


def test_layouts_are_learned(spark, rows):
    """What nearly all texts of a source close with is learned; a text without it is cut, one with it is whole."""
    texts = [f"Subject {i}\n\nwords of no end {'very ' * (i % 7)}\n-- \n2.{i}.1" for i in range(80)]
    docs = [(i, "closed", t) for i, t in enumerate(texts)] + [(100, "closed", texts[3][:-3]), (101, "closed", texts[5][:-8]), (102, "closed", "Subject")]
    ids = [f"Subject {i}\n\nwords of no end {'very ' * (i % 7)}\nmark {i:04d}ab{i:034x}" for i in range(80)]
    docs += [(200 + i, None, t) for i, t in enumerate(ids)] + [(300, None, ids[3][:-9])]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    shape = shapes(df, "doc_id", "source", "text")
    found = {r["source"]: (set(r["heads"]), r["shapes"]) for r in layouts(shape).collect()}
    assert found["closed"] == ({"Subject 9", "--"}, ["9.9.9"]) and found[None] == ({"Subject 9", "mark x40"}, [])
    got = judged(df, "doc_id", "source", "text").where("cut = 1")
    assert rows(got.select("doc_id", "by")) == [(100, "transfer"), (101, "transfer"), (102, "transfer"), (300, "transfer")]


def test_the_two_ways(spark, rows):
    """Texts cut at a limit come by it, those that broke off elsewhere by what they lack, and a table of the ways counts both."""
    docs, cut = corpus()
    docs += [(5000 + i, "limited", f"Subject\n\nThis one broke o{'f' * i}") for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    assert rows(routes(df, "doc_id", "source", "text")) == [("limited", "limit", len(cut)), ("limited", "transfer", 3)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert judged(df, "doc_id", "source", "text").collect() == []


def test_nulls_ties_and_repeated_rows(spark, rows):
    df = spark.createDataFrame([(None, None, "A.\n\nIt wor…", 1)] * 2 + [(2, "s", "B.", 2)], "doc_id long, source string, text string, chars int")
    got = rows(judged(df, "doc_id", "source", "text").select("doc_id", "cut"))
    assert got == sorted([(None, 1), (None, 1), (2, 0)], key=repr)


def test_a_last_word_that_begins_a_frequent_one(spark):
    docs = [(i, "s", "very " * i + "long change in the journal") for i in range(20)] + [(100 + i, "s", "so " * 2 * i + "moved into main") for i in range(9)]
    docs += [(200, "s", "change it in the journa"), (201, "s", "change it in the journa\n"), (202, "s", "move it to mai"), (203, "t", "rare wor"), (204, "s", "x" * 50_000)]
    docs += [(400 + i, "s", "so " * 3 * i + "y" * 20_000 + "z") for i in range(11)] + [(420, "s", "y" * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = {r["doc_id"] for r in judged(df, "doc_id", "source", "text").where("cut = 1").collect()}
    assert got == {200, 420}  # `main` stands in 9 last lines, fewer than 10 times as many as `mai`


def test_limits_at_every_size(spark):
    """A rare limit in a large source, and chance in a small one whose lengths are uneven."""
    large = [("large", n, i) for n in range(7950, 8050) for i in range(200 if n == 8000 else 1)] + [("large", n, i) for n in range(100, 700) for i in range(100)]
    small = [("small", n, i) for n in range(20, 300) for i in range(4 if n == 100 else n % 3 == 0)]
    uneven = [("uneven", n, i) for n in range(20, 60) for i in range({33: 60, 30: 40, 36: 42}.get(n, 2))]
    shape = spark.createDataFrame([(s, i * 100_000 + n, n, n) for s, n, i in large + small + uneven], "source string, digest long, chars long, bytes long")
    assert {(r["source"], r["length"], r["n"]) for r in limits(shape).collect()} == {("large", 8000, 200)}


@pytest.mark.parametrize(
    "text,state",
    [
        ("修正\n\n設定画面の上限値を確認した。\n索引の", BROKEN),
        ("修正\n\n設定画面の上限値を確認した。", WHOLE),
        ("修正\n\n索引の「上限」", OPEN),
        ("修正\n\n索引の\n", OPEN),
        ("索引の", OPEN),
        ("Fix.\n\nयह काम करत", BROKEN),
        ("Fix.\n\nयह काम करता है।", OPEN),
        ("Fix.\n\nไม่มีจุด", OPEN),
        ("Fix.\n\n> 引用の途中", OPEN),
        ("Fix.\n\nW", BROKEN),
        ("Fix.\n\nw", OPEN),
    ],
)
def test_endings_without_case(text, state):
    assert ending(text) == state


def test_planted_cuts_without_case(spark):
    whole = "修正\n\n設定画面の上限値を確認した。索引の並びも直した。"
    docs = [(n, "s", whole[:n]) for n in range(1, len(whole) + 1)]
    got = {r["doc_id"] for r in judged(spark.createDataFrame(docs, "doc_id long, source string, text string"), "doc_id", "source", "text").where("cut = 1").collect()}
    body = whole.index("設")
    assert got == {n for n in range(body + 1, len(whole)) if whole[n - 1] != "。"}
