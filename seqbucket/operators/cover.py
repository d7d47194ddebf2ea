"""Buckets by greedy set cover: the key with most uncovered reads takes them, until none is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbucket.operators.kmers import grams
from seqbucket.operators.skew import written_lookup
from seqbucket.session import materialize, release, scratch


def postings(reads: DataFrame, k: int) -> DataFrame:
    """(key, read_id): the different forward mers of each read; places with another letter than A, C, G, T
    have none."""
    return grams(reads, "read_id", "seq", k, n_as_a=False).distinct().select(F.col("gram").alias("key"), "read_id")


def best_key(posts: DataFrame) -> DataFrame:
    """(key, n): the key with most reads, the smallest of several."""
    return posts.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(1)


def round_winners(posts: DataFrame) -> DataFrame:
    """(key, n): keys that win in every one of their reads, by (n, smallest key): no two of them share a
    read, so all can be taken in one round."""
    sizes = materialize(posts.groupBy("key").agg(F.count("*").alias("n")), "sizes")
    sized = written_lookup(posts, sizes, "key", "n", "read_id")
    top = sized.groupBy("read_id").agg(F.max(F.struct(F.col("n"), (-F.col("key")).alias("neg"))).alias("t")).select("read_id", (-F.col("t.neg")).alias("top"))
    wins = posts.join(top, "read_id").groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("top") == F.col("key")).alias("w"))
    return wins.where("w = n").select("key", "n")


def set_cover(posts: DataFrame) -> DataFrame:
    """(read_id, key, round): every read that has a key goes to one. Each round takes all keys that are the
    largest among the keys of each of their reads, as the one-by-one rule would, since taking one doesn't
    change another's reads; their reads leave all postings. At least the largest key of all wins, so the
    rounds end; they are as many as the longest chain of keys of which each shares reads with the next larger one. Of
    the postings only those of the current round are kept, so disk is two rounds' postings and the rows given out."""
    spark = posts.sparkSession
    left, out, n = materialize(posts, "postings"), scratch(spark, "cover"), 0
    taken = left.select("read_id", "key", F.lit(0).alias("round")).where("false")
    while not left.isEmpty():
        n += 1
        wins = materialize(round_winners(left), "winners")
        found = written_lookup(left, wins, "key", "n", "read_id").select("read_id", "key", F.lit(n).alias("round"))
        # all rounds stand in one table, so its plan doesn't grow with them
        found.write.mode("append").parquet(out)
        taken = spark.read.schema(found.schema).parquet(out)
        before, left = left, materialize(left.join(taken.where(F.col("round") == n).select("read_id"), "read_id", "left_anti"), "postings")
        release(before, wins)
    return taken
