"""Partition of a sorted bucket into ranges with a common prefix, by dynamic programming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqbucket.functions import dna

WINDOW = 256


def common_prefix(a: str, b: str, most: int) -> int:
    most = min(most, len(a), len(b))
    for i in range(most):
        if a[i] != b[i]:
            return i
    return most


class _Ranges:
    """The recurrence over rows that are added one by one. The prefix of a range that ends in a row is the running minimum of its neighbours'
    prefixes, so of a row only its prefix with the one before is kept, and its score, for a window; the starts
    of ranges for rows whose ranges aren't settled yet."""

    def __init__(self, core: int, window: int, compat: bool = False) -> None:
        self.core, self.window, self.compat = core, window, compat
        self.n = self.base = self.size = 0
        self.seq = ""
        # of the last rows: the prefix with the row before, and the score of all rows before
        self.near = np.zeros(3 * window + 3, np.int64)
        self.score = np.zeros(3 * window + 3, np.int64)
        self.steps = np.arange(1, window + 1)
        self.start: list[tuple[int, int]] = []
        self.last = 0

    def add(self, seq: str) -> None:
        i, w = self.n, min(self.n, self.window)
        if self.size == len(self.near):
            for held in (self.near, self.score):
                held[: self.window] = held[self.size - self.window : self.size]
            self.size = self.window
        top = self.size
        self.near[top], self.score[top] = common_prefix(seq, self.seq, len(seq)) if i else 0, self.last
        best, at = -2 + (0 if self.compat else self.last), (i, 0)
        if w:
            prefix = np.minimum.accumulate(self.near[top - w + 1 : top + 1][::-1])
            value = self.steps[:w] * -(-(self.core + prefix) // 4) - 2 + self.score[top - w : top][::-1]
            k = int(value.argmax())
            if value[k] > best:
                best, at = int(value[k]), (i - 1 - k, int(prefix[k]))
        self.last, self.seq = best, seq
        self.start.append(at)
        self.n, self.size = i + 1, top + 1

    def settled(self) -> Iterator[tuple[int, int, int]]:
        """The ranges that no further row can change: those before the place where the ways back from all ends
        that a later range may follow have met."""
        ends = set(range(max(self.base - 1, self.n - self.window - 1), self.n))
        while len(ends) > 1:
            ends.remove(last := max(ends))
            ends.add(self.start[last - self.base][0] - 1)
        return self._upto(ends.pop() if ends else -1)

    def rest(self) -> Iterator[tuple[int, int, int]]:
        return self._upto(self.n - 1)

    def _upto(self, end: int) -> Iterator[tuple[int, int, int]]:
        ranges, i = [], end
        while i >= self.base:
            first, prefix = self.start[i - self.base]
            ranges.append((first, i, prefix))
            i = first - 1
        del self.start[: end + 1 - self.base]
        self.base = max(self.base, end + 1)
        return reversed(ranges)


def best_ranges(rows: list[tuple[str, int]], core: int, window: int = WINDOW, compat: bool = False) -> Iterator[tuple[int, int, int]]:
    """(first, last, prefix) of the ranges with the largest saving. rows: (sequence from the core on, offset).

    A range of m + 1 rows with prefix p saves m * ceil((core + p) / 4) - 2 bytes. compat: a range of one row
    forgets what the rows before it saved, as the original recurrence has it."""
    ranges = _Ranges(core, window, compat)
    for seq, _ in rows:
        ranges.add(seq)
    return ranges.rest()


def partition(places: DataFrame, core: int, block: int = 4096, window: int = WINDOW) -> DataFrame:
    """(key, block, first, last, pref_len): places(key, pos, off, body) in ranges, the best ones of the whole
    bucket; block is that of the range's first row. A bucket streams through one task, and every block rows the
    ranges that are settled are given out: a window and the unsettled ends are held, not the bucket. Each row's score rests on
    the one before, so a bucket can't be split; its rows take some microseconds each."""
    names = ["block", "first", "last", "pref_len"]
    schema = T.StructType([T.StructField("key", T.StringType()), *(T.StructField(n, T.LongType()) for n in names)])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, held = None, 0, _Ranges(core, window)

        def out_of(ranges: Iterator[tuple[int, int, int]]) -> list[tuple]:
            return [(at, (first + a) // block, first + a, first + b, p) for a, b, p in ranges]

        def batch(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=schema.names)

        for b in batches:
            out = []
            for key, pos, rest in zip(*(c.to_pylist() for c in b.columns)):
                if key != at:
                    out += out_of(held.rest())
                    at, first, held = key, pos, _Ranges(core, window)
                held.add(rest)
                if held.n % block == 0:
                    out += out_of(held.settled())
            if out:
                yield batch(out)
        if out := out_of(held.rest()):
            yield batch(out)

    rest = F.expr("substring(body, 1, length(body) - off)")
    rows = places.select("key", "pos", rest.alias("rest"))
    return rows.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(best, schema)


def running_prefix(places: DataFrame, most: int) -> DataFrame:
    """(key, pos, back, low): for each row of places(key, pos, off, body) and each of the 1 to `most` rows before it in its bucket, the
    smallest common prefix of the rows from that one on with the row, which is the least of the neighbours' common prefixes.
    Rows meet by their place, so a bucket of any size is spread over tasks."""
    rest = F.expr("substring(body, 1, length(body) - off)")
    rows = places.select("key", "pos", rest.alias("rest"))
    prev = rows.select("key", (F.col("pos") + 1).alias("pos"), F.col("rest").alias("prev"))
    near = rows.join(prev, ["key", "pos"]).select("key", "pos", dna.lcp(F.col("rest"), F.col("prev"), F.length("rest")).cast("bigint").alias("lcp"))
    # the prefix of neighbours counts for the rows up to most - 1 places on
    seen = near.select("key", F.col("pos").alias("_at"), "lcp", F.explode(F.sequence(F.col("pos"), F.col("pos") + most - 1)).alias("pos"))
    steps = seen.groupBy("key", "pos").agg(F.sort_array(F.collect_list(F.struct((F.col("pos") - F.col("_at") + 1).alias("back"), "lcp"))).alias("_s"), F.max("_at").alias("_top")).where("_top = pos")
    low = F.transform("_s", lambda x: F.struct(x["back"].alias("back"), F.array_min(F.transform(F.filter("_s", lambda y: y["back"] <= x["back"]), lambda y: y["lcp"])).alias("low")))
    return steps.select("key", "pos", F.explode(low).alias("_x")).select("key", "pos", "_x.back", "_x.low")
