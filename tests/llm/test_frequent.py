"""Misra-Gries summaries: bounds, merges, ties, edge cases."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqbucket.llm.frequent import FAN_IN, above, cut, heavy, summarize, top


def zipf(n, seed):
    rnd = random.Random(seed)
    return [str(int(rnd.paretovariate(0.7))) for _ in range(n)]


@pytest.mark.parametrize("k", [8, 64])
def test_bounds(spark, k):
    items = zipf(5000, k)
    exact = Counter(items)
    df = spark.createDataFrame([(x,) for x in items], "item string").repartition(20)
    got = {r["item"]: r for r in heavy(df, "item", k=k).collect()}
    assert len(got) <= k and {r["total"] for r in got.values()} == {len(items)}
    assert all(r["n_low"] <= exact[x] <= r["n_high"] for x, r in got.items())
    assert all((r["n_high"] - r["n_low"]) * (k + 1) <= len(items) for r in got.values())
    assert all(x in got for x, n in exact.items() if n * (k + 1) > len(items))


def weighed(data, weighted):
    exact = Counter()
    for _, x, w in {r for r in data if r[1] is not None}:
        exact[x] += (w or 0) if weighted else 1
    return {x: n for x, n in exact.items() if n}


@pytest.mark.parametrize("weight", [None, "w"])
def test_top_and_above(spark, weight):
    items = zipf(4000, 5)
    data = [(i, x, 1 + i % 3) for i, x in enumerate(items)]
    data += data[:300] + [(9000, None, 5), (9001, "x", None), (9002, "", 3)]
    df = spark.createDataFrame(data, "id long, item string, w long")
    exact = weighed(data, weight)
    want = sorted(exact.items(), key=lambda t: (-t[1], t[0]))[:10]
    got = top(df, "id", "item", weight, n=10, k=400).collect()
    assert sorted(((r["item"], r["n"]) for r in got), key=lambda t: (-t[1], t[0])) == want and {r["sure"] for r in got} == {1}
    assert all(r["n_low"] <= r["n_high"] for r in got)
    total = sum((w or 0) if weight else 1 for _, x, w in data if x is not None)
    assert {(r["item"], r["n"]) for r in above(df, "id", "item", weight, share=50).collect()} == {(x, n) for x, n in exact.items() if n * 50 > total}


def test_a_flat_column_stays_in_bounds(spark):
    """A million items of equal weight: k doesn't grow, no task sees more than FAN_IN sketches, and the answer says that it isn't sure."""
    df = spark.range(1_000_000).select("id", F.concat(F.lit("item"), "id").alias("item")).repartition(40)
    sketch = summarize(df, "item", k=64)
    rows = sketch.collect()
    assert len(rows) == 1 and len(rows[0]["items"]) <= 64 and rows[0]["total"] == 1_000_000 and rows[0]["error"] * 65 <= 1_000_000
    plan = sketch._jdf.queryExecution().toString()
    assert "Pandas" not in plan and plan.count("collect_list") >= 2
    largest = FAN_IN * 64
    seen = summarize(df, "item", k=largest).select(F.size("items").alias("n")).collect()
    assert seen[0]["n"] <= largest
    assert {r["sure"] for r in top(df, "id", "item", n=5, k=64).collect()} <= {0}
    assert above(df, "id", "item", share=64).collect() == []


def test_cut_subtracts_the_next_largest():
    counts, less = cut(pa.table({"item": ["a", "b", "c", "d"], "n": [9, 5, 5, 2]}), 2)
    assert less == 5 and counts.to_pylist() == [{"item": "a", "n": 4}]


def test_empty_and_fewer_items(spark, rows):
    df = spark.createDataFrame([], "id long, item string")
    assert top(df, "id", "item").collect() == []
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, item string")
    assert [(r["item"], r["n"]) for r in top(df, "id", "item").collect()] == [("a", 1), ("b", 1)]


def test_ties_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "b", 1), (2, "a", 1), (3, "c", 1), (None, "a", 1), (None, "a", 1), (4, None, 1)], "id long, item string, n int")
    got = [(r["item"], r["n"]) for r in top(df, "id", "item", n=2).collect()]
    assert got == [("a", 2), ("b", 1)]
