"""Copies hidden by formatting: canonical form, tries, radix splits."""

import random

from hypothesis import given
from hypothesis import strategies as st

from seqbucket.llm.collapse import Trie, canonical_records, collapse, copies


@given(st.lists(st.binary(max_size=6), max_size=60))
def test_trie_counts(keys):
    trie = Trie()
    for i, k in enumerate(keys):
        trie.add(k, 1, i)
    want = {k: (keys.count(k), keys.index(k)) for k in keys}
    assert {k: (n, f) for k, n, f in trie.records()} == want


def test_canonical_form(spark, rows):
    data = [
        (1, ">a=1 b=2", "ACGT"),
        (2, "> B=2|a=1;", "ac-g\nT*"),
        (3, ">b=2,,a=1,a=1\t", "AC GT"),
        (4, ">a=1", "ACGT"),
        (5, None, "ACGT"),
        (6, "", "a.c.g.t"),
        (7, ">a=1 b=2", None),
        (8, ">a=1", ""),
        (9, ">A=1", "--"),
        (1, ">a=1 b=2", "ACGT"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in data], "rec_id long, header string, seq string, canon string")
    records = canonical_records(df, "rec_id", "header", "seq")
    assert rows(copies(records)) == [(1, 2), (1, 3), (5, 6), (8, 9)]
    assert sorted((r["first"], r["n"]) for r in collapse(records).collect()) == [(1, 3), (4, 1), (5, 2), (8, 2)]


def test_splits_and_hot_groups(spark, rows):
    rnd = random.Random(7)
    pool = ["a" * 50 + "".join(rnd.choice("ac") for _ in range(9)) for _ in range(300)] + ["", "a" * 40_000]
    data = [(i, "hot" if rnd.random() < 0.35 else rnd.choice(pool)) for i in range(3000)]
    groups: dict = {}
    for i, c in data:
        groups.setdefault(c, []).append(i)
    df = spark.createDataFrame(data, "id long, canon string").repartition(6)
    got = rows(collapse(df, limit=20, step=2).select("first", "n"))
    assert got == sorted(((min(v), len(v)) for v in groups.values()), key=repr)
    assert rows(copies(df, limit=20, step=2)) == sorted(((min(v), x) for v in groups.values() for x in v if x != min(v)), key=repr)


def test_oversized_prefixes_beyond_a_broadcast(spark, rows, monkeypatch):
    from seqbucket.llm import collapse as module

    rnd = random.Random(9)
    data = [(i, "".join(rnd.choice("acé") for _ in range(5))) for i in range(2000)]
    groups: dict = {}
    for i, c in data:
        groups.setdefault(c, []).append(i)
    monkeypatch.setattr(module, "HOT", 1)
    df = spark.createDataFrame(data, "id long, canon string").repartition(4)
    parts = module.radix_buckets(df, limit=5, step=1)
    assert parts.count() == 2000 and all(r["canon"].encode().startswith(r["bucket"]) for r in parts.collect())
    assert rows(collapse(df, limit=5, step=1).select("first", "n")) == sorted(((min(v), len(v)) for v in groups.values()), key=repr)


def test_empty(spark):
    df = spark.createDataFrame([], "id long, canon string")
    assert collapse(df).collect() == [] and copies(df).collect() == []


def test_rows_without_an_id(spark, rows):
    df = spark.createDataFrame([(None, ">a=1", "AC"), (None, ">a=1", "AC"), (3, ">a=1", "AC"), (4, ">A=1;", "ac")], "rec_id long, header string, seq string")
    assert rows(copies(canonical_records(df, "rec_id", "header", "seq"))) == [(3, 4)]
