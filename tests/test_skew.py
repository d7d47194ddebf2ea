"""Per-key counts and lookups against brute force."""

import random

from pyspark.sql import functions as F

from seqbucket.operators.skew import dense_codes, distinct_per_key, heavy_keys, salted_lookup


def test_distinct_per_key_with_a_hot_key(spark, rows):
    rnd = random.Random(1)
    data = [(i, "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", "", None, "c" * 500]), rnd.choice([None, [], [None], [rnd.randrange(50) for _ in range(rnd.randrange(6))]])) for i in range(2000)]
    want: dict = {}
    for _, k, ids in data:
        for x in ids or []:
            if k is not None and x is not None:
                want.setdefault(k, set()).add(x)
    df = spark.createDataFrame(data, "post_id long, mer string, ids array<long>").withColumn("code", F.lit(1)).withColumn("_n", F.lit(2))
    for limit in (100_000, 50):
        got = rows(distinct_per_key(df, "mer", "ids", "post_id", limit))
        assert got == sorted(((k, len(v)) for k, v in want.items()), key=repr)


def test_many_keys_span_blocks(spark, rows):
    df = spark.range(10_000).select("id", F.concat(F.lit("k"), F.col("id") % 9000).alias("mer"), F.array("id", "id").alias("ids"))
    got = rows(distinct_per_key(df, "mer", "ids", "id"))
    assert len(got) == 9000 and sum(n for _, n in got) == 10_000


def test_empty(spark):
    df = spark.createDataFrame([], "post_id long, mer string, ids array<long>")
    counts = distinct_per_key(df, "mer", "ids", "post_id")
    assert counts.collect() == [] and heavy_keys(counts, "mer", "n_items").collect() == []


def test_heavy_keys_take_ties(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 98)], "mer string, n long")
    assert rows(heavy_keys(df, "mer", "n")) == [("a",), ("b",), ("c",)]


def test_lookup_splits_hot_keys(spark, rows):
    left = spark.range(1000).select("id", F.when(F.col("id") < 600, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.upper("k"))
    got = salted_lookup(left, right, "k", "n", "id", limit=100).select("id", "v")
    assert rows(got) == rows(left.select("id", F.upper("k").alias("v")))


def test_lookup_of_several_rows_a_key(spark, rows, monkeypatch):
    """Two keys are hot, only the larger may be split; the key's rows of keyed stand once per salt."""
    from seqbucket.operators import skew

    monkeypatch.setattr(skew, "HOT", 1)
    left = spark.range(1000).select("id", F.when(F.col("id") < 600, "hot").when(F.col("id") < 900, "warm").otherwise("cold").alias("k"), (F.col("id") % 3).alias("g"))
    n = left.groupBy("k").agg(F.count("*").alias("n"))
    right = left.select("k", "g").distinct().where("g < 2").join(n, "k").withColumn("v", F.concat("k", F.col("g")))
    for counted in (None, n):
        got = salted_lookup(left, right, "k", "n", "id", limit=100, also=("g",), counted=counted)
        assert rows(got.select("id", "v")) == rows(left.where("g < 2").select("id", F.concat("k", F.col("g"))))


def test_a_written_table_is_broadcast_only_if_it_is_small(spark, rows, monkeypatch):
    from seqbucket.operators import skew

    left = spark.range(500).select("id", F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"))
    right = skew.materialize(left.groupBy("k").agg(F.count("*").alias("n")).where("k <> 'k3'"), "keyed")
    want = rows(left.join(right, "k").select("id", "k", "n"))
    for small in (skew.SMALL, 3):
        monkeypatch.setattr(skew, "SMALL", small)
        got = skew.written_lookup(left, right, "k", "n", "id", limit=50)
        assert rows(got.select("id", "k", "n")) == want
        assert ("ResolvedHint" in got._jdf.queryExecution().analyzed().toString() and "_salt" not in got._jdf.queryExecution().analyzed().toString()) == (small > 3)


def test_dense_codes(spark):
    got = sorted(r["code"] for r in dense_codes(spark.range(1000).repartition(7)).collect())
    assert got == list(range(1000))


def test_rows_without_an_id(spark, rows):
    df = spark.createDataFrame([(None, "a", [1, 2]), (None, "a", [2, 3]), (None, None, [1])], "post_id long, mer string, ids array<long>")
    assert rows(distinct_per_key(df, "mer", "ids", "post_id")) == [("a", 3)]


def test_items_in_parts(spark, rows):
    from seqbucket.operators.skew import items_per_key

    df = spark.range(900).select("id", F.when(F.col("id") < 600, "hot").otherwise("k").alias("mer"), F.array(F.col("id"), F.col("id") - 1, F.lit(None)).alias("ids"))
    got = items_per_key(df, "mer", "ids", "id", size=50).collect()
    assert max(len(r["items"]) for r in got) < 120 and all(r["items"] == sorted(r["items"]) for r in got)
    for k, want in (("hot", range(-1, 600)), ("k", range(599, 900))):
        assert sorted(x for r in got if r["mer"] == k for x in r["items"]) == list(want)
