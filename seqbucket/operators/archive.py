"""The bucketed archive: rotation, order within buckets, chunks, deltas, and the way back.

A row holds key, body (the rotated rest of the read), off, rc, the places of N, and its place: sub_id and
pos in the bucket. Buckets are ranges of the key; a bucket is sorted by (off, body, read_id)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from seqbucket.functions import dna
from seqbucket.functions.kmer import code_mer
from seqbucket.operators.assign import K, stored
from seqbucket.operators.skew import salted_lookup
from seqbucket.session import materialize

CHUNK = 256


def rotated(reads: DataFrame, assigned: DataFrame, k: int = K) -> DataFrame:
    """(read_id, key, off, rc, body, nlocs): key as string; N in the stored direction by their places."""
    rows = stored(reads, assigned)
    body = dna.permute(F.col("f"), F.col("off").cast("int"), F.lit(k))
    return rows.select("read_id", code_mer(F.col("key"), k).alias("key"), "off", "rc", body.alias("body"), dna.n_positions(F.col("seq")).alias("nlocs"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, with pos: the place in the key's rows of this partition, from 0."""
    now, n = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        keys, i = b.column("key"), np.arange(b.num_rows)
        new = np.concatenate([[keys[0].as_py() != now], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)])
        start = np.maximum.accumulate(np.where(new, i, -1))
        pos = np.where(start >= 0, i - start, i + n)
        now, n = keys[-1].as_py(), int(pos[-1]) + 1
        yield b.append_column("pos", pa.array(pos, pa.int64()))


def placed(rows: DataFrame) -> DataFrame:
    """Adds pos, the place in the bucket from 0, and sub_id, its chunk of 256. Rows are sorted by ranges of
    (key, off, body, read_id), so that even one read repeated without end is split, and counted in their partition. Only
    the first bucket of a partition may have begun before: what is added to its places comes from a table of one row a partition. rows are written first, as the
    ranges are made from a sample, and each row is shuffled once."""
    order = ["key", "off", "body", "read_id"]
    ranges = materialize(rows, "rotated").repartitionByRange(*order).sortWithinPartitions(*order)
    counted = ranges.mapInArrow(_running, T.StructType([*rows.schema.fields, T.StructField("pos", T.LongType())]))
    counted = materialize(counted.withColumn("_part", F.spark_partition_id()), "places")
    ends = counted.groupBy("_part").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("pos", F.struct("key", "pos")).alias("n"))
    gives = ends.select("_part", F.col("last").alias("key"), (F.col("n") + 1).alias("n"), F.lit(1).alias("kind"))
    asks = ends.select("_part", F.col("first").alias("key"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("kind"))
    before = W.partitionBy("key").orderBy("_part", "kind").rowsBetween(W.unboundedPreceding, -1)
    more = gives.unionByName(asks).withColumn("_more", F.sum("n").over(before)).where("kind = 0 and _more > 0").select("_part", "key", "_more")
    found = counted.join(F.broadcast(more), ["_part", "key"], "left")
    return found.withColumn("pos", F.col("pos") + F.coalesce("_more", F.lit(0))).withColumn("sub_id", F.floor(F.col("pos") / CHUNK)).select(*rows.columns, "pos", "sub_id")


def deltas(places: DataFrame) -> DataFrame:
    """Adds delta: off less the off before in the chunk; the first of a chunk stays."""
    w = W.partitionBy("key", "sub_id").orderBy("pos")
    return places.withColumn("delta", F.col("off") - F.coalesce(F.lag("off").over(w), F.lit(0)))


def restored(rows: DataFrame) -> DataFrame:
    """Adds off again: the running sum of delta in the chunk."""
    w = W.partitionBy("key", "sub_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("off", F.sum("delta").over(w))


def elided(chunks: DataFrame) -> DataFrame:
    """Chunks (key, sub_id) with key_stored null where the chunk before has the same key, and key_read, the
    key carried forward from the bucket's first chunk."""
    w = W.partitionBy("key").orderBy("sub_id").rowsBetween(W.unboundedPreceding, 0)
    kept = chunks.withColumn("key_stored", F.when(F.col("sub_id") == 0, F.col("key")))
    return kept.withColumn("key_read", F.last("key_stored", ignorenulls=True).over(w))


def ordinals(places: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds ordinal, the place in the whole output: reads alone in their bucket first, then the buckets in
    order of key. Only the table of buckets is summed up, by ranges of keys; never the reads."""
    first = F.when(F.col("n") == 1, F.lit(0)).otherwise(1)
    prefix = F.substring("key", 1, 5)
    tops = sizes.groupBy(first.alias("_g"), prefix.alias("_p")).agg(F.sum("n").alias("_t"))
    tops = tops.select("_g", "_p", (F.sum("_t").over(W.orderBy("_g", "_p")) - F.col("_t")).alias("_base"))
    inner = F.sum("n").over(W.partitionBy("_g", "_p").orderBy("key")) - F.col("n")
    starts = sizes.withColumn("_g", first).withColumn("_p", prefix).withColumn("_in", inner).join(F.broadcast(tops), ["_g", "_p"])
    starts = starts.select("key", "n", (F.col("_base") + F.col("_in")).alias("_start"))
    return salted_lookup(places, starts, "key", "n", "read_id").withColumn("ordinal", F.col("_start") + F.col("pos")).drop("_start", "n")


def sequence() -> Column:
    """The read of an archive row: rotated back, N put in place, turned back."""
    whole = dna.unpermute(F.col("body"), F.col("key"), F.col("off").cast("int"))
    patched = dna.patch_n(whole, F.col("nlocs"))
    return F.when(F.col("rc") == 1, F.reverse(F.translate(patched, "ACGT", "TGCA"))).otherwise(patched)


def write(rows: DataFrame, path: str) -> None:
    """Parquet in ranges of the key, sorted so that equal keys, offsets and prefixes lie together. rows are written first: the ranges are made from a sample of them."""
    (
        materialize(rows, "rotated").repartitionByRange("key", "off", "body").sortWithinPartitions("key", "off", "body", "read_id")
        .write.option("compression", "zstd").mode("overwrite").parquet(path)
    )


def faults(rows: DataFrame) -> DataFrame:
    """Rows that break a rule of the archive, with the rule: no key, or a key that isn't of the letters A, C, G, T (key), an offset beyond
    the body (offset), a body with other letters than A, C, G, T (letters), a place of N outside the read (nlocs).
    Null columns break their rule; a null nlocs is no place at all."""
    size = F.length("body")
    rule = (
        F.when(~F.coalesce(F.col("key").rlike(r"\A[ACGT]+\z"), F.lit(False)), "key")
        .when(F.coalesce((F.col("off") < 0) | (F.col("off") > size), F.lit(True)), "offset")
        .when(F.col("body").rlike("[^ACGT]"), "letters")
        .when(F.exists("nlocs", lambda p: (p < 0) | (p >= size + F.length("key"))), "nlocs")
    )
    return rows.withColumn("fault", rule).where("fault is not null")


def chunk_faults(places: DataFrame) -> DataFrame:
    """(key, sub_id, fault): chunks that break a rule. `range`: places don't run from 256 * sub_id on without a gap, or a chunk
    but the last of its bucket isn't full; `order`: offsets fall where places rise. A chunk has CHUNK rows at most, so it is looked at whole."""
    rows = places.groupBy("key", "sub_id").agg(F.count("*").alias("_n"), F.min("pos").alias("_a"), F.max("pos").alias("_b"), F.countDistinct("pos").alias("_d"), F.sort_array(F.collect_list(F.struct("pos", "off"))).alias("_o"))
    last = rows.groupBy("key").agg(F.max("sub_id").alias("_last"))
    rows = rows.join(last, "key")
    begin = F.col("sub_id") * CHUNK
    gap = (F.col("_a") != begin) | (F.col("_d") != F.col("_n")) | (F.col("_b") != begin + F.col("_n") - 1) | ((F.col("_n") < CHUNK) & (F.col("sub_id") < F.col("_last")))
    falls = F.exists(F.sequence(F.lit(1), F.size("_o")), lambda i: (i > 1) & (F.try_element_at("_o", i)["off"] < F.try_element_at("_o", F.greatest(i - 1, F.lit(1)))["off"]))
    return rows.withColumn("fault", F.when(gap, "range").when(falls, "order")).where("fault is not null").select("key", "sub_id", "fault")


