"""Most frequent items of a column with very many different values, in bounded memory: Misra-Gries.

A summary holds at most k items. Adding weight to a full summary subtracts the (k+1)-th largest counter
from all and drops what falls to zero; what was subtracted so far is the summary's error. A counter never
exceeds the item's true weight and is short of it by the error at most, and the error never exceeds
total / (k + 1). So each item above total / (k + 1) has a counter, whatever the order of rows or merges. k is what the threshold
asked for needs and never grows with the data; whether that was enough for a place in a ranking is part of the answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from seqbucket.session import materialize

#: Counters of a summary, and summaries merged by one task.
K, FAN_IN = 4096, 16

#: A summary is one row: its counters, error and total.
_SKETCH = pa.schema([("part", pa.int64()), ("items", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("error", pa.int64()), ("total", pa.int64())])
_SUMMARY = T.StructType(
    [T.StructField("part", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("error", T.LongType()), T.StructField("total", T.LongType())]
)


def added(items: pa.Array | pa.ChunkedArray, counts: pa.Array | pa.ChunkedArray) -> pa.Table:
    """(item, n): equal items added up."""
    sums = pa.table({"item": items, "n": counts}).group_by("item").aggregate([("n", "sum")])
    return pa.table({"item": sums["item"], "n": sums["n_sum"]})


def cut(counters: pa.Table, k: int) -> tuple[pa.Table, int]:
    """At most k counters, and what was subtracted from each: the next-largest."""
    if counters.num_rows <= k:
        return counters, 0
    values = counters["n"].to_numpy()
    less = int(np.partition(values, len(values) - k - 1)[len(values) - k - 1])
    keep = values > less
    return pa.table({"item": counters["item"].filter(pa.array(keep)), "n": pa.array(values[keep] - less, pa.int64())}), less


def _sketch(part: int, counters: pa.Table, error: int, total: int) -> pa.RecordBatch:
    values = [[part], [counters["item"].to_pylist()], [counters["n"].to_pylist()], [error], [total]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _SKETCH)], schema=_SKETCH)


def summarize(df: DataFrame, item: str, weight: str | None = None, k: int = K) -> DataFrame:
    """One summary of at most k counters over all rows, as one row (items, counts, error, total); no row where there is no item. Null
    items, and null or non-positive weights, add nothing.

    Each partition makes its own; these are merged FAN_IN at a time, so no task ever sees more than
    FAN_IN * k counters, until one is left."""
    source = df.select(F.col(item).cast("string").alias("item"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("n"))
    source = source.where("item is not null and n > 0").withColumn("part", F.spark_partition_id().cast("bigint"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, error, total, part = None, 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(2)[0].as_py()
            total += int(b.column(1).to_numpy(zero_copy_only=False).sum())
            new = added(b.column(0), b.column(1))
            if held is not None:
                both = pa.concat_tables([held, new])
                new = added(both["item"], both["n"])
            # 4 k counters at most, so that the table is cut once in a while and not for each batch
            held, less = cut(new, k) if new.num_rows > 4 * k else (new, 0)
            error += less
        if held is not None:
            held, less = cut(held, k)
            yield _sketch(part, held, error + less, total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                counters, less = cut(added(b.column(1)[i].values, b.column(2)[i].values), k)
                yield _sketch(b.column(0)[i].as_py(), counters, b.column(3)[i].as_py() + less, b.column(4)[i].as_py())

    out = source.select("item", "n", "part").mapInArrow(local, _SUMMARY)
    parts = df.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        # at most FAN_IN sketches of k counters meet
        met = out.groupBy(F.floor(F.col("part") / FAN_IN).alias("part")).agg(F.collect_list(F.struct("items", "counts")).alias("_s"), F.sum("error").alias("error"), F.sum("total").alias("total"))
        out = met.select("part", F.flatten("_s.items").alias("items"), F.flatten("_s.counts").alias("counts"), "error", "total").mapInArrow(merge, _SUMMARY)
    return out.drop("part")


def heavy(df: DataFrame, item: str, weight: str | None = None, k: int = K) -> DataFrame:
    """(item, n_low, n_high, total): every item that weighs more than total / (k + 1), and perhaps others: at most k items, whose true
    weight is from n_low to n_high. total is the weight of all rows."""
    kept = materialize(summarize(df, item, weight, k), "summary")
    return kept.select(F.explode(F.arrays_zip("items", "counts")).alias("_c"), "error", "total").select(F.col("_c.items").alias("item"), F.col("_c.counts").alias("n_low"), (F.col("_c.counts") + F.col("error")).alias("n_high"), "total")


def counted(df: DataFrame, row_id: str, item: str, weight: str | None = None, k: int = K) -> DataFrame:
    """heavy with n, the exact weight: the summary's items, at most k, are counted again, and rows that were delivered twice (equal
    row_id) count once, while the bounds are of all deliveries. Rows without a row_id count as deliveries of one row. Items whose rows all weigh nothing are left out."""
    counters = heavy(df, item, weight, k).withColumnRenamed("item", "_item")
    rows = df.select(
        F.col(row_id).alias("_row"), F.col(item).cast("string").alias("_value"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w")
    ).where("_value is not null and _w > 0")
    # k rows at most, a parameter and not a property of the data
    mine = F.broadcast(counters) if k <= 1 << 17 else counters
    bounds = ("n_low", "n_high", "total")
    once = rows.join(mine, F.col("_value") == F.col("_item")).groupBy("_value", *bounds, "_row").agg(F.max("_w").alias("_w"))
    return once.groupBy(F.col("_value").alias("item"), *bounds).agg(F.sum("_w").alias("n"))


def above(df: DataFrame, row_id: str, item: str, weight: str | None = None, share: int = 1000) -> DataFrame:
    """(item, n): all items whose exact weight is more than 1 / share of the weight of all deliveries; none is missed, since the
    summary has `share` counters."""
    return counted(df, row_id, item, weight, share).where(F.col("n") * share > F.col("total")).select("item", "n")


def top(df: DataFrame, row_id: str, item: str, weight: str | None = None, n: int = 20, k: int = K) -> DataFrame:
    """(item, n, n_low, n_high, sure): of the items of a summary of k counters the n with the largest exact weight, as counted. An
    item without a counter weighs total / (k + 1) at most; sure is 1 where all n items weigh more, so that these are the n heaviest of
    all items, and 0 where the column is too flat for k counters to say so, or has fewer than n items. Ties at the n-th place go to the smaller item in byte order."""
    best = counted(df, row_id, item, weight, k).orderBy(F.desc("n"), "item").limit(n)
    least, found = F.min("n").over(W.partitionBy("total")), F.count("*").over(W.partitionBy("total"))  # of n rows
    return best.select("item", "n", "n_low", "n_high", ((found == n) & (least * (k + 1) > F.col("total"))).cast("bigint").alias("sure"))
