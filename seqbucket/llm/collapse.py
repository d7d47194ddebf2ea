"""Duplicates hidden by formatting: one record for all that differ only in how they are written.

Records get canonical bytes. They are spread by radix: a bucket is a prefix of the canonical bytes, and a
bucket with too many different records is split by further bytes until it fits. In a bucket a trie with
terminal counters collects the records. Equal records are added up map-side first, so however many copies a
record has, a bucket sees few rows of it; copies are then told their group in even portions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqbucket.operators.skew import HOT, salted_lookup
from seqbucket.session import materialize, tasks

#: Length of the first prefixes, rows that a bucket may have, and full buckets of a task.
STEP, LIMIT, BUCKETS = 4, 20_000, 50


def canonical(header: Column, seq: Column) -> Column:
    """The letters of seq in lower case, a line feed, and the header's attributes without their `>`: in
    lower case, without repeats, in order. Null where seq is null; a null header has no attributes."""
    attributes = F.split(F.regexp_replace(F.lower(F.coalesce(header, F.lit(""))), r"\A\s*>", ""), r"[\s;|,]+")
    words = F.array_sort(F.array_distinct(F.filter(attributes, lambda x: x != "")))
    return F.concat(F.lower(F.regexp_replace(seq, r"[^\p{L}]", "")), F.lit("\n"), F.array_join(words, " "))


class Trie:
    """Path-compressed: a node is [label, children by first byte, count, smallest id]; count is 0 in a node
    at which no record ends."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, 0, 0]

    def add(self, key: bytes, count: int, first: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, count, first]
                return
            label = child[0]
            if not key.startswith(label, at):
                same = 0
                while same < len(label) and at + same < len(key) and label[same] == key[at + same]:
                    same += 1
                upper = [label[:same], {label[same]: child}, 0, 0]
                child[0] = label[same:]
                node[1][key[at]] = child = upper
            at += len(child[0])
            node = child
        node[3] = min(node[3], first) if node[2] else first
        node[2] += count

    def records(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            here = before + node[0]
            if node[2]:
                yield here, node[2], node[3]
            stack.extend((c, here) for c in node[1].values())


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal records of a batch become one row: smallest id and number of copies."""
    schema = pa.schema([("canon", pa.string()), ("first", pa.int64()), ("n", pa.int64())])
    for b in batches:
        t = pa.Table.from_batches([b]).group_by("canon").aggregate([("id", "min"), ("id", "count")])
        arrays = [t.column(c).combine_chunks() for c in ("canon", "id_min", "id_count")]
        yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


_PART = T.StructType([T.StructField("canon", T.StringType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType())])


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> the records of each bucket. One trie is held at a time."""
    trie, at = None, None

    def emit() -> pa.RecordBatch:
        rows = list(trie.records())
        return pa.RecordBatch.from_arrays(
            [pa.array([k.decode() for k, _, _ in rows], pa.string()), pa.array([f for _, _, f in rows], pa.int64()), pa.array([n for _, n, _ in rows], pa.int64())],
            names=["canon", "first", "n"],
        )

    for b in batches:
        for bucket, canon, first, n in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != at:
                if trie:
                    yield emit()
                trie, at = Trie(), bucket
            trie.add(canon.encode(), n, first)
    if trie:
        yield emit()


def radix_buckets(parts: DataFrame, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """parts with a column bucket, a prefix of the bytes of canon. A prefix whose rows are more than limit, and are not
    all the same record, gives way to prefixes twice as long; the first are step bytes. A level reads only the rows that the one before left
    open, and levels end when none is left. The oversized prefixes of a level, rows / limit of them at most, are
    broadcast only if they are no more than HOT; else rows meet them in a shuffle."""
    cut = lambda depth: F.substring(F.col("canon").cast("binary"), 1, depth)
    depth, out, open_ = step, None, parts
    while True:
        rows = open_.withColumn("bucket", cut(depth))
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("_n"), F.min("canon").alias("_low"), F.max("canon").alias("_high"))
        over = materialize(sizes.where((F.col("_n") > limit) & (F.col("_low") != F.col("_high"))).select("bucket", "_n"), "oversized")
        n = over.count()
        side = F.broadcast(over.select("bucket")) if n <= HOT else over.select("bucket")
        fits = rows.join(side, "bucket", "left_anti") if n else rows
        out = fits if out is None else out.unionByName(fits)
        if not n:
            return out
        open_ = materialize(rows.join(side, "bucket", "left_semi").drop("bucket"), "open")
        depth *= 2


def collapse(records: DataFrame, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """records(id, canon), one row per id -> (canon, first, n): one row per different record, with the smallest id and
    the number of copies. Rows without id or canon are left out."""
    source = records.where("id is not null and canon is not null")
    # a batch adds up what is equal in it; the tries add up over the batches, at most a row for each
    parts = materialize(source.select("id", "canon").mapInArrow(_combine, _PART), "parts")
    rows = parts.count()
    buckets = radix_buckets(parts, limit, step)
    return (
        buckets.select("bucket", "canon", "first", "n")
        .repartition(tasks(records.sparkSession, rows, BUCKETS * limit), "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_tries, _PART)
    )


def canonical_records(df: DataFrame, row_id: str, header: str, seq: str) -> DataFrame:
    """(id, canon); a row delivered twice (equal id) stands once. Rows without an id or a seq are left out."""
    return df.select(F.col(row_id).alias("id"), canonical(F.col(header), F.col(seq)).alias("canon")).where("id is not null and canon is not null").distinct()


def copies(records: DataFrame, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """records(id, canon) -> (keep_id, copy_id): each id that isn't the smallest of its group. Groups with
    more than limit copies are looked up over several salts. Rows meet their group by a digest, and count as its copies
    where the whole of canon is equal. records are written once and read twice."""
    digest = F.struct(F.xxhash64("canon").alias("a"), F.xxhash64(F.lit(1), "canon").alias("b"))
    kept = materialize(records.where("id is not null and canon is not null").select("id", "canon"), "records")
    groups = collapse(kept, limit, step).where("n > 1").select(digest.alias("_d"), F.col("canon").alias("_canon"), F.col("first").alias("keep_id"), F.col("n").alias("_n"))
    # two groups of one digest, which chance won't bring, are two rows of one key
    found = salted_lookup(kept.select("id", "canon", digest.alias("_d")), materialize(groups, "groups"), "_d", "_n", "id", limit)
    return found.where("canon = _canon and id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
