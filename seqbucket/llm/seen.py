"""Has this key been seen before? Golomb-coded sets over hash shards, stored, and read in order of arrival.

A set holds the sorted hashes of its keys, reduced to a target range, as gaps: a Golomb-Rice code in blocks
of 128 with the first hash of each block beside it, so that a probe decodes only the block it falls into. A
shard of the hash space is planned for CAPACITY keys in a range of CAPACITY * 2 ** bits; a new key is
therefore taken for a seen one with a probability of at most 2 ** -bits, and a seen one never for new.

The keys of earlier times stand in sets that build makes once, a row per set, and that seen_before only reads: no
earlier key goes through a probe. Every answer is that of the sets; error_rates says how often they are wrong."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqbucket.session import materialize, tasks

#: Keys of a shard as planned, and bits of a hash beyond those that tell its keys apart; shards of a task. At 30 bits, 2 ** 30 new
#: keys give one wrong answer, and a key takes 35 bits instead of the 64 of a hash; at 16 bits it takes 21.
CAPACITY, BITS, BLOCK, SHARDS = 1 << 15, 30, 128, 64


class GolombSet:
    """Sorted different uint64 values, immutable."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.first = values[::BLOCK].copy()
        gaps = np.diff(values, prepend=values[:1])
        gaps[::BLOCK] = 0
        mean = float(values[-1] - values[0]) / max(1, self.n) if self.n else 0.0
        self.shift = max(0, int(np.log2(max(1.0, mean * 0.69))))
        quotients = (gaps >> np.uint64(self.shift)).astype(np.int64)
        rests = gaps & np.uint64((1 << self.shift) - 1)
        # a quotient q is q zeros and a one; every block's codes begin at a byte
        block = np.arange(self.n) // BLOCK
        ends = np.cumsum(quotients + 1)
        sizes = np.add.reduceat(quotients + 1, np.arange(0, self.n, BLOCK)) if self.n else np.zeros(0, np.int64)
        widths = (sizes + 7) // 8
        self.unary_at = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
        bits = np.zeros(int(self.unary_at[-1]) * 8, np.uint8)
        before = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        bits[ends - 1 - before[block] + self.unary_at[:-1][block] * 8] = 1
        self.unary = np.packbits(bits)
        # the rests have shift bits each, and a block's begin at a byte
        self.rest_width = (BLOCK * self.shift + 7) // 8
        padded = np.zeros(len(self.first) * BLOCK, np.uint64)
        padded[: self.n] = rests
        planes = ((padded[:, None] >> np.arange(self.shift, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        self.rests = np.packbits(planes.reshape(len(self.first), -1), axis=1) if len(self.first) else np.zeros((0, self.rest_width), np.uint8)

    @property
    def nbytes(self) -> int:
        return self.unary.nbytes + self.rests.nbytes + self.first.nbytes + self.unary_at.nbytes

    def decode(self, blocks: np.ndarray) -> np.ndarray:
        """The values of these blocks, given in ascending order."""
        counts = np.minimum(BLOCK, self.n - blocks * BLOCK)
        widths = self.unary_at[blocks + 1] - self.unary_at[blocks]
        starts = np.cumsum(widths) - widths
        at = np.repeat(self.unary_at[blocks] - starts, widths) + np.arange(int(widths.sum()))
        ones = np.flatnonzero(np.unpackbits(self.unary[at]))
        owner = np.repeat(np.arange(len(blocks)), counts)
        lead = np.cumsum(counts) - counts
        quotients = np.diff(ones, prepend=-1) - 1
        quotients[lead] = ones[lead] - starts * 8
        planes = np.unpackbits(self.rests[blocks], axis=1)[:, : BLOCK * self.shift].reshape(len(blocks), BLOCK, self.shift)
        weights = np.uint64(1) << np.arange(self.shift, dtype=np.uint64)
        rests = (planes.astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64)
        gaps = (quotients.astype(np.uint64) << np.uint64(self.shift)) + rests[owner, np.arange(len(owner)) - lead[owner]]
        sums = np.cumsum(gaps, dtype=np.uint64)
        return sums - (sums[lead] - gaps[lead])[owner] + self.first[blocks][owner]

    def values(self) -> np.ndarray:
        return self.decode(np.arange(len(self.first)))

    def packed(self) -> bytes:
        """The set in bytes: number of values, bits of a rest, the blocks' first values and code lengths, the codes."""
        head = np.array([self.n, self.shift], np.uint64)
        return b"".join(x.tobytes() for x in (head, self.first, self.unary_at, self.unary, self.rests))

    @classmethod
    def unpacked(cls, data: bytes) -> GolombSet:
        out = cls.__new__(cls)
        out.n, out.shift = (int(x) for x in np.frombuffer(data, np.uint64, 2))
        blocks = -(-out.n // BLOCK)
        out.first = np.frombuffer(data, np.uint64, blocks, 16)
        out.unary_at = np.frombuffer(data, np.int64, blocks + 1, 16 + 8 * blocks)
        at, width = 24 + 16 * blocks, int(out.unary_at[-1])
        out.unary = np.frombuffer(data, np.uint8, width, at)
        out.rest_width = (BLOCK * out.shift + 7) // 8
        out.rests = np.frombuffer(data, np.uint8, blocks * out.rest_width, at + width).reshape(blocks, out.rest_width)
        return out

    def contains(self, probes: np.ndarray) -> np.ndarray:
        """For sorted probes; only the blocks they fall into are decoded."""
        if not self.n or not len(probes):
            return np.zeros(len(probes), bool)
        block = np.searchsorted(self.first, probes, side="right") - 1
        held = self.decode(np.unique(block[block >= 0]))
        if not len(held):
            return np.zeros(len(probes), bool)
        at = np.minimum(np.searchsorted(held, probes), len(held) - 1)
        return held[at] == probes


class GrowingSet:
    """Golomb sets of growing size; a set is merged with its neighbour once that is no more than twice as
    large, so a shard has a logarithmic number of them."""

    def __init__(self) -> None:
        self.sets: list[GolombSet] = []

    def contains(self, probes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(probes), bool)
        for s in self.sets:
            left = np.flatnonzero(~found)
            found[left] = s.contains(probes[left])
        return found

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        while self.sets and self.sets[-1].n <= 2 * len(values):
            values = np.union1d(values, self.sets.pop().values())
        self.sets.append(GolombSet(values))

    @property
    def n(self) -> int:
        return sum(s.n for s in self.sets)


def _width(capacity: int, bits: int) -> int:
    """Bits of a reduced hash; the hash's other bits choose the shard."""
    return (capacity - 1).bit_length() + bits


def _shards(rows: int, capacity: int) -> int:
    return max(1, -(-rows // capacity))


_IN = pa.schema([("shard", pa.int64()), ("order_id", pa.int64()), ("hash", pa.int64()), ("again", pa.bool_()), ("golomb", pa.binary())])
_OUT = pa.schema([("order_id", pa.int64()), ("seen", pa.bool_()), ("shard", pa.int64()), ("n", pa.int64()), ("golomb", pa.binary())])


def _spark(schema: pa.Schema) -> T.StructType:
    kinds = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.binary(): T.BinaryType()}
    return T.StructType([T.StructField(f.name, kinds[f.type]) for f in schema])


def _within_batches(batches: Iterator[pa.RecordBatch], shards: int, width: int) -> Iterator[pa.RecordBatch]:
    """(order_id, hash) -> rows for the shards. Of the rows of a batch with one reduced hash only those of the smallest order are
    asked in the hash's shard; the others come after them, so they are seen (`again`), and are spread evenly. A hot key
    thus sends its shard a row per batch."""
    for b in batches:
        order, hashed = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(order):
            continue
        full = hashed.astype(np.uint64)
        home, reduced = (full >> np.uint64(width)) % np.uint64(shards), full & np.uint64((1 << width) - 1)
        by = np.lexsort((order, reduced, home))
        new = np.concatenate([[True], (np.diff(reduced[by]) != 0) | (np.diff(home[by]) != 0)])
        least = order[by][np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        again = np.zeros(len(order), bool)
        again[by] = order[by] > least
        shard = np.where(again, (order.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(shards), home)
        yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array(order), pa.array(reduced.view(np.int64)), pa.array(again), pa.nulls(len(order), pa.binary())], schema=_IN)


def _answers(batches: Iterator[pa.RecordBatch], give_sets: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, sets first, then records by order -> seen or not, or with give_sets only the shard's
    sets after all records. A shard's keys are held in Golomb sets only, one shard at a time."""
    at, held, last = None, GrowingSet(), None

    def rows(order: np.ndarray, seen: np.ndarray, shard: np.ndarray, sizes: list[int], sets: list[bytes | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((order, seen, shard, sizes, sets), _OUT)], schema=_OUT)

    def close() -> Iterator[pa.RecordBatch]:
        if give_sets and held.sets:
            n = len(held.sets)
            yield rows(np.full(n, -1), np.zeros(n, bool), np.full(n, at), [x.n for x in held.sets], [x.packed() for x in held.sets])

    for b in batches:
        shards, order, hashed = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        again, sets = b.column(3).to_numpy(zero_copy_only=False), b.column(4)
        given = sets.is_valid().to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]]) if len(shards) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if shards[lo] != at:
                yield from close()
                at, held, last = shards[lo], GrowingSet(), None
            for i in np.flatnonzero(given[lo:hi]) + lo:
                held.sets.append(GolombSet.unpacked(sets[i].as_py()))
            asked = np.arange(lo, hi)[~again[lo:hi] & ~given[lo:hi]]
            # a row delivered twice stands beside itself; keys of earlier times have order -1, sets -2
            before = np.concatenate([[last if last is not None else np.iinfo(np.int64).min], order[asked][:-1]]) if len(asked) else order[asked]
            asked = asked[(order[asked] != before) | (order[asked] < 0)]
            if len(asked):
                last = order[asked[-1]]
            values, first, inverse = np.unique(hashed[asked].view(np.uint64), return_index=True, return_inverse=True)
            known = held.contains(values)
            seen = known[inverse] | (first[inverse] != np.arange(len(asked)))
            held.add(values[~known])
            if not give_sets:
                rest = np.arange(lo, hi)[again[lo:hi]]
                both = np.concatenate([asked, rest])
                yield rows(order[both], np.concatenate([seen, np.ones(len(rest), bool)]), shards[both], np.zeros(len(both), np.int64), [None] * len(both))
    yield from close()


def _sharded(records: DataFrame, sets: DataFrame | None, shards: int, width: int, give_sets: bool) -> DataFrame:
    """The answers to records(order_id, key), or the sets after them, with these sets before."""
    rows = records.where("order_id is not null and key is not null").select(F.col("order_id").cast("bigint"), F.xxhash64(F.col("key").cast("bigint")).alias("hash"))
    rows = rows.mapInArrow(lambda it: _within_batches(it, shards, width), _spark(_IN))
    if sets is not None:
        long = lambda n: F.lit(n).cast("bigint")
        rows = rows.unionByName(sets.select("shard", long(-2).alias("order_id"), long(0).alias("hash"), F.lit(False).alias("again"), "golomb"))
    spread = rows.repartition(tasks(records.sparkSession, shards, SHARDS), "shard").sortWithinPartitions("shard", "order_id")
    return spread.mapInArrow(lambda it: _answers(it, give_sets), _spark(_OUT))


def build(keys: DataFrame, rows: int, capacity: int = CAPACITY, bits: int = BITS) -> DataFrame:
    """keys(key), BIGINT -> the Golomb sets of all of them, (shard, n, golomb) with a row per set and its number of values, written to the shared folder. They are all that
    later probes need. rows is about the number of keys that the sets are to hold in the end; it sets the
    number of shards, not what they can hold. Null keys are left out; other columns aren't read."""
    old = keys.select(F.lit(-1).cast("bigint").alias("order_id"), "key")
    return materialize(_sharded(old, None, _shards(rows, capacity), _width(capacity, bits), True).select("shard", "n", "golomb"), "golomb")


def extended(sets: DataFrame, records: DataFrame, rows: int, capacity: int = CAPACITY, bits: int = BITS) -> DataFrame:
    """The sets that also hold the keys of records: what the next records are asked against. rows, capacity and bits as in build."""
    return materialize(_sharded(records, sets, _shards(rows, capacity), _width(capacity, bits), True).select("shard", "n", "golomb"), "golomb")


def seen_before(records: DataFrame, sets: DataFrame, rows: int, capacity: int = CAPACITY, bits: int = BITS) -> DataFrame:
    """records(order_id >= 0, key), keys as BIGINT -> (order_id): records whose key is in the sets of build or is the key of a record with a
    smaller order_id, by the answers of the sets alone. Records of one order_id are one record, delivered again. Rows without a key or an
    order_id are left out; other columns aren't read. rows, capacity and bits as in build."""
    found = _sharded(records, sets, _shards(rows, capacity), _width(capacity, bits), False)
    return found.where("seen").select("order_id").distinct()


def error_rates(records: DataFrame, known: DataFrame, rows: int, capacity: int = CAPACITY, bits: int = BITS) -> DataFrame:
    """One row: bits, keys held, bits a key, first occurrences asked for, how many of them were answered `seen`,
    and the rate of wrong answers: in theory (keys of the fullest shard over its range) and as audited.

    The audit is apart from the probe and exact over all keys: the smallest order_id of each key that isn't known, added up map-side, is
    looked up among the answers. Only it reads the keys of earlier times again."""
    sets = build(known, rows, capacity, bits)
    answers = seen_before(records, sets, rows, capacity, bits)
    sizes = extended(sets, records, rows, capacity, bits).groupBy("shard").agg(F.sum("n").alias("n"), F.sum(F.length("golomb")).alias("n_bytes"))
    asked = records.where("order_id is not null and key is not null").select("order_id", F.col("key").cast("bigint"))
    both = asked.unionByName(known.where("key is not null").select(F.lit(-1).cast("bigint").alias("order_id"), F.col("key").cast("bigint")))
    firsts = both.groupBy("key").agg(F.min("order_id").alias("order_id")).where("order_id >= 0")
    judged = firsts.join(answers.withColumn("wrong", F.lit(1)), "order_id", "left").agg(F.count("*").alias("asked"), F.count("wrong").alias("wrong"))
    held = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("keys"), (F.sum("n_bytes") * 8 / F.sum("n")).alias("bits_a_key"), (F.max("n") / F.lit(float(1 << _width(capacity, bits)))).alias("rate_in_theory"))
    one = F.lit(bits).alias("bits")
    rates = held.select(one, "*").join(judged.select(one, "*"), "bits")
    return rates.select("bits", "keys", "bits_a_key", "asked", "wrong", "rate_in_theory", F.try_divide("wrong", "asked").alias("rate_audited"))
