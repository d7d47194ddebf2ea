"""A few keys holding most records: lookups and per-key counts whose tasks stay even."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from seqbucket.session import materialize

#: Codes of one accumulator block; keys that a lookup splits at most; rows that a written table may have to be broadcast.
BLOCK, HOT, SMALL = 4096, 4096, 1 << 19


def salted_lookup(rows: DataFrame, keyed: DataFrame, key: str, n: str, spread: str, limit: int = 100_000, also: tuple[str, ...] = (), counted: DataFrame | None = None) -> DataFrame:
    """rows joined to keyed on key, where column n of keyed is the number of rows with that key. keyed has one row
    per key, or one per key and `also`, further columns of the join, with the same n in all rows of a key. counted has key and n once per key, where that
    is at hand and spares working keyed out twice.

    Of the keys with more than limit rows the HOT largest are split over ceil(n / limit) salts chosen by the hash of column
    spread, and their rows of keyed stand once per salt. Only these keys, HOT at most however large the
    tables are, are broadcast; any other key has at most max(limit, rows / HOT) rows. Rows without a partner are dropped."""
    large = (keyed if counted is None else counted).where(F.col(n) > limit).select(key, n)
    large = large.groupBy(key).agg(F.max(n).alias(n)) if also and counted is None else large
    hot = large.orderBy(F.desc(n), key).limit(HOT).select(F.col(key).alias("_hot"), F.ceil(F.col(n) / F.lit(limit)).cast("int").alias("_salts"))
    split = lambda df: df.join(F.broadcast(hot), df[key].eqNullSafe(F.col("_hot")), "left")
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_salts"))).cast("int")
    left = split(rows).withColumn("_salt", salt).drop("_hot", "_salts")
    right = split(keyed).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_hot", "_salts")
    return left.join(right, [key, *also, "_salt"]).drop("_salt")


def written_lookup(rows: DataFrame, keyed: DataFrame, key: str, n: str, spread: str, limit: int = 100_000, also: tuple[str, ...] = ()) -> DataFrame:
    """salted_lookup in a table that is written, whose rows are therefore counted for nothing: up to SMALL of them are broadcast, so that rows aren't
    shuffled; more are looked up over salts."""
    if keyed.count() > SMALL:
        return salted_lookup(rows, keyed, key, n, spread, limit, also)
    return rows.join(F.broadcast(keyed), [key, *also])


def dense_codes(rows: DataFrame) -> DataFrame:
    """rows with a column code: 0, 1, 2 ... without gaps, in order of partitions and of rows in them. Every
    partition counts its own rows; only the counts, one per partition, are added up and broadcast."""
    rows = materialize(rows.withColumn("_mid", F.monotonically_increasing_id()), "codes")
    part = F.shiftright("_mid", 33)
    before = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = before.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(before), "_part")
        .withColumn("code", F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid", "_part", "_before")
    )


_PARTIAL = T.StructType(
    [T.StructField("block", T.LongType()), T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))]
)


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes in ascending order -> the accumulator of each block, its zeros left out. One block is held."""
    schema = pa.schema([("block", pa.int64()), ("slots", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
    at, held = None, np.zeros(BLOCK, np.int64)

    def emit(done: list) -> pa.RecordBatch:
        slots = [np.flatnonzero(a).astype(np.int32) for _, a in done]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([b for b, _ in done], pa.int64()),
                pa.array(slots, schema.field(1).type),
                pa.array([a[s] for (_, a), s in zip(done, slots)], schema.field(2).type),
            ],
            schema=schema,
        )

    for batch in batches:
        codes = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(codes):
            continue
        cuts = np.flatnonzero(np.diff(codes // BLOCK)) + 1
        done = []
        for run in np.split(codes, cuts):
            b = int(run[0] // BLOCK)
            if at is not None and b != at:
                done.append((at, held))
                held = np.zeros(BLOCK, np.int64)
            at = b
            held += np.bincount(run - b * BLOCK, minlength=BLOCK)
        if done:
            yield emit(done)
    if at is not None:
        yield emit([(at, held)])


def distinct_per_key(rows: DataFrame, key: str, items: str, row_id: str, limit: int = 100_000) -> DataFrame:
    """(key, n_items): for each non-null key the number of different non-null values in the arrays `items`
    of all its rows. A key without any item is left out; a null array counts as empty.

    Keys get dense codes; (code, item) pairs are hashed on both, so every task gets an equal split of the
    distinct pairs however hot a key is; a split adds its codes up with bincount into one dense block of
    4096 counters at a time; the blocks are summed by slot. Repeats fall away map-side, and the pairs are shuffled
    once. The table is read twice: for the dictionary only its keys and whether there is an item, then whole."""
    base = rows.where(F.col(key).isNotNull() & F.exists(items, lambda x: x.isNotNull()))
    keys = base.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows"))
    coded = materialize(dense_codes(keys), "dictionary")
    base = base.select(F.col(key).alias("_key"), F.col(row_id).alias("_row"), F.col(items).alias("_ids"))
    encoded = salted_lookup(base, coded, "_key", "_rows", "_row", limit)
    splits = encoded.select("code", F.explode("_ids").alias("_id")).where("_id is not null").distinct()
    blocks = splits.select("code").sortWithinPartitions("code").mapInArrow(_accumulate, _PARTIAL)
    sums = (
        blocks.select("block", F.explode(F.arrays_zip("slots", "counts")).alias("_c"))
        .groupBy((F.col("block") * BLOCK + F.col("_c.slots")).alias("code"))
        .agg(F.sum("_c.counts").alias("n_items"))
    )
    return coded.select("code", F.col("_key").alias(key)).join(sums, "code").select(key, "n_items")


def items_per_key(rows: DataFrame, key: str, items: str, row_id: str, size: int = 4096, limit: int = 100_000) -> DataFrame:
    """(key, part, parts, items): the different items of each key in ascending order, a key with many in
    several parts of about size items, by the items' hash; so no task gathers a key whole."""
    counts = materialize(distinct_per_key(rows, key, items, row_id, limit), "counts")
    pairs = rows.where(F.col(key).isNotNull()).select(key, F.explode(items).alias("_item")).where("_item is not null").distinct()
    found = salted_lookup(pairs, counts, key, "n_items", "_item", limit).withColumn("parts", F.ceil(F.col("n_items") / size))
    spread = F.conv(F.substring(F.md5(F.col("_item").cast("string")), 1, 8), 16, 10).cast("bigint")
    grouped = found.withColumn("part", F.pmod(spread, F.col("parts"))).groupBy(key, "part", "parts")
    return grouped.agg(F.sort_array(F.collect_list("_item")).alias("items"))


def heavy_keys(counts: DataFrame, key: str, n: str, percent: int = 1) -> DataFrame:
    """The keys that hold at least percent % of the sum of n; none if counts is empty."""
    kept = materialize(counts, "counts")
    total = kept.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return kept.where(F.col(n) * 100 >= F.lit(percent * total)).select(key)
