"""Mers of reads held in blocks: what each block asks about its mers crosses a shuffle as sorted numbers, coded by their gaps (some
1.6 bytes a mer), and what it learns comes back to it, so no table has a row per read and mer, and none of a size that grows is broadcast.

A block is one row: up to BASES bases of different sequences, with their reads. Equal reads of a block are one sequence of several reads. A mer and its
reverse complement are one number, mixed so that ranges of numbers are even; N, which counts as A on either strand, breaks that
pairing, so mers over an N are counted for the one strand that has them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbucket.operators.kmers import _CODE, _both, _places, _rolled
from seqbucket.operators.skew import HOT
from seqbucket.session import materialize

#: Bases of a block; mers of a range of numbers, over all blocks.
#: Members of a bucket after which its whole table is cleared instead of theirs.
#: Rows of one sequence in a task.
BASES, RANGE, MANY, HOT_SEQ = 3_000_000, 1 << 21, 1000, 20_000
#: Odd, so that multiplying by it modulo a power of two loses nothing.
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Block:
    """Sequences of a block: ids of all reads, those of one sequence side by side; reps, how many each has; codes of all sequences side by side, above
    3 where no base is known; sizes. key, off and rc are the sequences' buckets, where they have them; asks, the mers that
    are asked for (None: all); shared, whether others may hold a sequence's key."""

    def __init__(self, ids, reps, codes, sizes, key=None, off=None, rc=None, shared=None, asks=None):
        self.ids, self.reps, self.codes, self.sizes = ids, reps, codes, sizes
        self.key, self.off, self.rc, self.shared, self.asks = key, off, rc, shared, asks

    def dump(self) -> bytes:
        bad = np.flatnonzero(self.codes > 3).astype(np.int32)
        quads = np.concatenate([np.where(self.codes > 3, 0, self.codes), np.zeros(-len(self.codes) % 4, np.uint8)]).reshape(-1, 4)
        packed = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
        return pickle.dumps((self.ids, self.reps, packed, bad, self.sizes, self.key, self.off, self.rc, self.shared, self.asks), 5)

    @staticmethod
    def load(data: bytes) -> Block:
        ids, reps, packed, bad, sizes, *rest = pickle.loads(data)
        codes = np.stack([packed & 3, packed >> 2 & 3, packed >> 4 & 3, packed >> 6], axis=1).ravel()[: int(sizes.sum())]
        codes[bad] = 4
        return Block(ids, reps, codes, sizes, *rest)

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def mers(self, k: int) -> tuple[np.ndarray, ...]:
        """Of each window: forward and backward mer, place in its sequence, sequence, whether it has an unknown base."""
        starts = self.starts()
        forward, backward = _both(self.codes, k)
        at, owner = _places(starts, len(forward), k)
        bad = np.concatenate([[0], np.cumsum(self.codes > 3)])
        return forward[at], backward[at], at - starts[owner], owner, bad[at + k] > bad[at]


def _turned(mer: np.ndarray, k: int) -> np.ndarray:
    """The reverse complement of each mer."""
    left, out = mer.copy(), np.zeros_like(mer)
    for _ in range(k):
        out = out << 2 | (3 - (left & 3))
        left >>= 2
    return out


def mixed(mer: np.ndarray, k: int) -> np.ndarray:
    return mer.astype(np.uint64) * _MIX & np.uint64((1 << 2 * k) - 1)


def unmixed(number: np.ndarray, k: int) -> np.ndarray:
    """The mers that were mixed to these numbers."""
    return (number * np.uint64(pow(int(_MIX), -1, 1 << 2 * k)) & np.uint64((1 << 2 * k) - 1)).astype(np.int64)


def _paired(mer: np.ndarray, turned: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of a mer and its reverse complement, and whether the mer is the smaller of both."""
    return mixed(np.minimum(mer, turned), k), mer <= turned


def _numbers(forward: np.ndarray, backward: np.ndarray, bad: np.ndarray, k: int) -> list[np.ndarray]:
    """Number and side of each window's forward mer, then of its backward mer. These two are turns of each other but where a base is unknown."""
    number, smaller = _paired(forward, backward, k)
    out = [number, smaller, number.copy(), backward <= forward]
    if bad.any():
        for i, mer in ((0, forward[bad]), (2, backward[bad])):
            out[i][bad], out[i + 1][bad] = _paired(mer, _turned(mer, k), k)
    return out


def _close(numbers: np.ndarray) -> bytes:
    """Numbers in ascending order, by their gaps: bytes of the same weight side by side."""
    gaps = np.diff(numbers, prepend=np.uint64(0))
    most = int(gaps[1:].max()) if len(gaps) > 1 else 0
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max)
    rest = gaps[1:].astype(kind)
    return pickle.dumps((gaps[:1], np.dtype(kind).itemsize, rest.view(np.uint8).reshape(len(rest), rest.itemsize).T.tobytes()), 5)


def _open(data: bytes) -> np.ndarray:
    first, wide, rest = pickle.loads(data)
    rest = np.ascontiguousarray(np.frombuffer(rest, np.uint8).reshape(wide, -1).T).view(f"u{wide}").ravel()
    return np.cumsum(np.concatenate([first, rest.astype(np.uint64)]), dtype=np.uint64)


def counted(numbers: np.ndarray, n: np.ndarray) -> bytes:
    """Numbers in ascending order and their counts, most of which are 1."""
    several = np.flatnonzero(n != 1).astype(np.int32)
    return pickle.dumps((_close(numbers), several, n[several]), 5)


def recounted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    packed, several, counts = pickle.loads(data)
    numbers = _open(packed)
    n = np.ones(len(numbers), np.int64)
    n[several] = counts
    return numbers, n


def pack(reads: DataFrame, k: int, assigned: DataFrame | None = None) -> DataFrame:
    """reads(read_id, seq) -> (block, windows, data), written: the reads of k letters or more in blocks, equal rows once. assigned(read_id, key, off, rc): their
    buckets; reads that it doesn't have are left out. Equal sequences meet in a task, by the shuffle that makes rows different;
    those of more than HOT_SEQ rows in several, as their rows are counted before."""
    own, most = ("key", "off", "rc") if assigned is not None else (), BASES
    rows = reads.select("read_id", "seq") if assigned is None else reads.select("read_id", "seq").join(assigned.select("read_id", *own), "read_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        bases, n, number = 0, 0, TaskContext.get().partitionId() << 32

        def close() -> pa.RecordBatch:
            texts, where = zip(*((t[0], t[1:]) for t in held))
            sizes = np.array([len(t) for t in texts], np.int32)
            codes = _CODE[np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8)]
            ids = np.fromiter((i for some in held.values() for i in some), np.int64)
            reps = np.array([len(some) for some in held.values()], np.int64)
            more = [np.array(c, np.int64) for c in zip(*where)] if own else []
            data = Block(ids, reps, codes, sizes, *more).dump()
            windows = int(sizes.sum()) - (k - 1) * len(sizes)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([windows]), pa.array([data], pa.binary())], names=["block", "windows", "data"])

        for b in batches:
            for i, *what in zip(*(c.to_pylist() for c in b.columns[: 2 + len(own)])):
                if what[0] is None or len(what[0]) < k:
                    continue
                some = held.get(what := tuple(what))
                if some is None:
                    held[what] = some = []
                    bases += len(what[0])
                some.append(i)
                n += 1
                if bases >= most or 3 * n >= most:
                    yield close()
                    held, bases, n, number = {}, 0, 0, number + 1
        if held:
            yield close()

    hashed = F.xxhash64("seq")
    counts = reads.select(hashed.alias("_hash")).groupBy("_hash").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SEQ)
    hot = counts.orderBy(F.desc("n"), "_hash").limit(HOT).select("_hash", F.ceil(F.col("n") / HOT_SEQ).alias("_salts"))
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("read_id"), F.col("_salts"))).alias("_salt")
    rows = rows.join(F.broadcast(hot), hashed == F.col("_hash"), "left").select("read_id", "seq", *own, salt)
    rows = rows.repartition("seq", "_salt").distinct()
    return materialize(rows.mapInArrow(run, "block long, windows long, data binary"), "blocks")


def _asked(blocks: DataFrame, k: int, offers: Callable, least: int) -> DataFrame:
    """(block, found): found are, in order, the mers that a block asks for and that sums over all blocks' offers reach `least` for, in packed ranges.
    offers(Block) -> numbers in ascending order, their counts for both strands, for the smaller mer only and for the other only, and the numbers
    asked for (None: the same)."""
    spark = blocks.sparkSession
    total = blocks.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE, 1)
    bits = min(ceil(log2(parts)), 2 * k)
    borders = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(2 * k - bits)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1)):
                numbers, counts, asks = offers(Block.load(data.as_py()))
                cuts, rows = np.searchsorted(numbers, borders), []
                wanted = None if asks is None else [_close(x) for x in np.split(asks, np.searchsorted(asks, borders[1:-1]))]
                for i in range(1 << bits):
                    lo, hi = cuts[i], cuts[i + 1]
                    n = counts[:, lo:hi]
                    odd = np.flatnonzero((n[0] != 1) | (n[1] != 0) | (n[2] != 0)).astype(np.int32)
                    rows.append((i, block, pickle.dumps((_close(numbers[lo:hi]), odd, n[:, odd], wanted and wanted[i]), 5)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["range", "block", "asked"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> pa.RecordBatch | None:
            offered, weights, wants = [], [], []
            for block, asked in held:
                of, odd, n, asks = pickle.loads(asked)
                mine = _open(of)
                weight = np.zeros((3, len(mine)), np.int64)
                weight[0] = 1
                weight[:, odd] = n
                offered.append(mine)
                weights.append(weight)
                wants.append(mine if asks is None else _open(asks))
            numbers, weight = np.concatenate(offered), np.concatenate(weights, axis=1)
            if not len(numbers):
                return None
            order = np.argsort(numbers)
            numbers = numbers[order]
            first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
            sums = np.add.reduceat(weight[:, order], first, axis=1)
            smaller, other = sums[0] + sums[1], sums[0] + sums[2]
            enough = np.maximum(smaller, other) >= least
            numbers, smaller, other = numbers[first][enough], smaller[enough], other[enough]
            if not len(numbers):
                return None
            rows = []
            for (block, _), want in zip(held, wants):
                place = np.minimum(np.searchsorted(numbers, want), len(numbers) - 1)
                place = place[numbers[place] == want]
                if len(place):
                    n = np.stack([smaller[place], other[place]])
                    small = n.astype(np.uint8) if n.max() < 256 else n.astype(np.uint32) if n.max() < 1 << 32 else n
                    rows.append((at, block, pickle.dumps((_close(numbers[place]), small), 5)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["range", "block", "found"]) if rows else None

        for b in batches:
            for i, block, asked in zip(*(c.to_pylist() for c in b.columns)):
                if i != at:
                    if held and (out := close()):
                        yield out
                    at, held = i, []
                held.append((block, asked))
        if held and (out := close()):
            yield out

    asked = blocks.select("block", "data").mapInArrow(ask, "range int, block long, asked binary")
    found = asked.repartition("range").sortWithinPartitions("range").mapInArrow(answer, "range int, block long, found binary")
    return found.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("range", "found"))), lambda x: x["found"]).alias("found"))


def _learned(found: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in ascending order, and their counts for the smaller mer and for the other."""
    parts = [pickle.loads(x) for x in found or []]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros((2, 0), np.int64)
    return np.concatenate([_open(x) for x, _ in parts]), np.concatenate([n.astype(np.int64) for _, n in parts], axis=1)


def _counts(number: np.ndarray, smaller: np.ndarray, known: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The count of each mer, 0 where it isn't known."""
    if not len(known):
        return np.zeros(len(number), np.int64)
    place = np.minimum(np.searchsorted(known, number), len(known) - 1)
    return np.where(known[place] == number, n[np.where(smaller, 0, 1), place], 0)


def _held(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a block's mers, and how many reads hold them: on both strands, only the smaller mer, only the other."""
    forward, backward, _, owner, bad = block.mers(k)
    number, smaller, number_b, smaller_b = _numbers(forward, backward, bad, k)
    side = lambda s: np.where(s[bad], 1, 2)
    numbers = np.concatenate([number[~bad], number[bad], number_b[bad]])
    own = np.concatenate([owner[~bad], owner[bad], owner[bad]]).astype(np.uint64)
    kind = np.concatenate([np.zeros(np.count_nonzero(~bad), np.int64), side(smaller), side(smaller_b)]).astype(np.uint64)
    if not len(numbers):
        return numbers, np.zeros((3, 0), np.int64)
    wide = int(own.max()).bit_length()
    if 2 * k + wide + 2 <= 64:
        packed = np.sort(numbers << np.uint64(wide + 2) | own << np.uint64(2) | kind)
        numbers, own, kind = packed >> np.uint64(wide + 2), packed >> np.uint64(2) & np.uint64((1 << wide) - 1), packed & np.uint64(3)
    else:
        by = np.lexsort((kind, own, numbers))
        numbers, own, kind = numbers[by], own[by], kind[by]
    # a read counts once for a side; what it holds on both strands leaves nothing for one of them
    new = np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (own[1:] != own[:-1])])
    start = np.flatnonzero(new)
    whole = kind[start][np.cumsum(new) - 1] == 0
    keep = new | (~whole & np.concatenate([[True], kind[1:] != kind[:-1]]))
    numbers, own, kind = numbers[keep], own[keep], kind[keep]
    reps = block.reps[own.astype(np.int64)]
    first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    return numbers[first], np.stack([np.add.reduceat(np.where(kind == s, reps, 0), first) for s in range(3)])


def _best(weights: np.ndarray, key: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of each sequence's rows, which are side by side, the first of those with the smallest key of those with the largest weight."""
    ranges = lambda o: np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
    over = lambda f, v, cuts: np.repeat(f.reduceat(v, cuts), np.diff(np.concatenate([cuts, [len(v)]])))
    top = np.flatnonzero(weights == over(np.maximum, weights, ranges(own)))
    hit = top[key[top] == over(np.minimum, key[top], ranges(own[top]))]
    return hit[ranges(own[hit])]


def popular(blocks: DataFrame, k: int) -> DataFrame:
    """The blocks, written, with each sequence in the one of its mers that most reads hold, as in assign.popularity, and asking for the
    mers that several reads hold."""

    def offers(block: Block):
        return *_held(block, k), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, windows, data, found in zip(*(c.to_pylist() for c in b.columns)):
                block = Block.load(data)
                known, n = _learned(found)
                forward, backward, at, owner, bad = block.mers(k)
                f, f_side, r, r_side = _numbers(forward, backward, bad, k)
                pair = lambda a, b: np.stack([a, b], axis=1).ravel()
                key, own = pair(forward, backward), np.repeat(owner, 2)
                weight = np.maximum(pair(_counts(f, f_side, known, n), _counts(r, r_side, known, n)), 1)
                hit = _best(weight, key, own)
                rc, off = hit & 1, at[hit >> 1]
                off = np.where(rc == 1, block.sizes[own[hit]] - k - off, off)
                made = Block(block.ids, block.reps, block.codes, block.sizes, key[hit], off, rc, weight[hit] > 1, _close(known))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([windows]), pa.array([made.dump()], pa.binary())], names=["block", "windows", "data"])

    found = _asked(blocks, k, offers, 2)
    return materialize(blocks.join(found, "block", "left").select("block", "windows", "data", "found").mapInArrow(run, "block long, windows long, data binary"), "blocks")


def members(blocks: DataFrame) -> DataFrame:
    """(read_id, key, off, rc) of the reads of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                x = Block.load(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (x.ids, *(np.repeat(c, x.reps) for c in (x.key, x.off, x.rc)))], names=["read_id", "key", "off", "rc"])

    return blocks.select("data").mapInArrow(run, "read_id long, key long, off long, rc long")


def scores(blocks: DataFrame, k: int, gram: int, alone: bool = False) -> DataFrame:
    """(read_id, key, off, rc, score) as in assign.overlap_scores. alone: only of reads that are alone in their bucket.

    Another read of a candidate bucket holds the bucket's key too, so only mers that several reads hold are asked for. Reads
    and members then meet by bucket, two bits a base; a bucket's 8-mers are held by the task that works on it, a table of fixed size."""

    def offers(block: Block):
        number, smaller = _paired(block.key, _turned(block.key, k), k)
        order = np.argsort(number)
        number = number[order]
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        zero = np.zeros(len(number), np.int64)
        reps = block.reps[order]
        counts = np.stack([np.add.reduceat(c, first) for c in (zero, np.where(smaller[order], reps, 0), np.where(smaller[order], 0, reps))])
        asks = _held(block, k)[0] if block.asks is None else _open(block.asks)
        return number[first], counts, asks

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        for b in batches:
            for data, found in zip(*(c.to_pylist() for c in b.columns)):
                block = Block.load(data)
                known, n = _learned(found)
                forward, backward, at, owner, bad = block.mers(k)
                f, f_side, r, r_side = _numbers(forward, backward, bad, k)
                hits = []
                for mer, number, side, rc in ((forward, f, f_side, 0), (backward, r, r_side, 1)):
                    size = _counts(number, side, known, n)
                    i = np.flatnonzero(size)
                    hits.append((owner[i], mer[i], 2 * at[i] + rc, size[i]))
                own, key, scan, size = (np.concatenate(c) for c in zip(*hits))
                by = np.lexsort((scan, key, own))
                own, key, scan, size = own[by], key[by], scan[by], size[by]
                new = np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])])[: len(own)]
                at_home = key == block.key[own]
                lonely = np.ones(len(block.reps), bool)
                lonely[own[at_home & (size > 1)]] = False
                new &= ~at_home | (size > 1)
                if alone:
                    new &= lonely[own]
                own, key, scan, at_home = own[new], key[new], scan[new], at_home[new]
                rc = scan & 1
                off = np.where(rc == 1, block.sizes[own] - k - (scan >> 1), scan >> 1)
                wide, ends = -(-block.sizes.astype(np.int64) // 4), np.cumsum(block.reps)
                place = np.concatenate([[0], np.cumsum(wide)])
                texts = [_two_bits(block, 4 * place, turned) for turned in (False, True)]
                stored = np.flatnonzero(block.shared) if block.shared is not None else np.arange(len(block.reps))
                ids = block.ids.tobytes()
                columns = [
                    np.concatenate([block.key[stored], key]),
                    np.concatenate([np.full(len(stored), -1), off * 4 + rc * 2 + at_home]),
                    np.concatenate([block.sizes[stored], block.sizes[own]]),
                    np.concatenate([block.reps[stored], block.reps[own]]),
                    [texts[t][place[i] : place[i + 1]] for i, t in zip(np.concatenate([stored, own]).tolist(), np.concatenate([block.rc[stored], rc]).tolist())],
                    [None] * len(stored) + [ids[8 * (ends[i] - block.reps[i]) : 8 * ends[i]] for i in own.tolist()],
                ]
                for a in range(0, len(columns[0]), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 10_000], t) for c, t in zip(columns, kinds)], names=["key", "place", "size", "reps", "seq", "ids"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key and place, so that a bucket's members come first."""
        model, touched, at = np.zeros(1 << 2 * gram, np.int8), [], None
        for b in batches:
            keys, places, sizes, reps = (c.to_numpy() for c in b.columns[:4])
            seqs, ids = (b.column(i).to_pylist() for i in (4, 5))
            codes = np.frombuffer(b"".join(seqs), np.uint8)
            codes = np.stack([codes & 3, codes >> 2 & 3, codes >> 4 & 3, codes >> 6], axis=1).ravel()
            grams = _rolled(codes, gram)
            starts = np.concatenate([[0], np.cumsum(-(-sizes.astype(np.int64) // 4) * 4)]).tolist()
            out = []
            for i, (key, place, size, n) in enumerate(zip(keys.tolist(), places.tolist(), sizes.tolist(), reps.tolist())):
                if key != at:
                    for g in touched if len(touched) < MANY else [slice(None)]:
                        model[g] = 0
                    touched, at = [], key
                mine = grams[starts[i] : starts[i] + max(size - gram + 1, 0)]
                if place < 0:
                    # a gram that stands twice in a member counts once; two members are as good as any number
                    model[mine] = np.minimum(model[mine] + min(n, 2), 2)
                    if len(touched) < MANY:
                        touched.append(mine)
                elif touched:
                    got = np.count_nonzero(model[mine] > (place & 1))
                    if got:
                        out.append((i, got))
            if out:
                hit = np.array(out)
                own = [np.frombuffer(ids[i], np.int64) for i in hit[:, 0]]
                place, many = places[hit[:, 0]].astype(np.int64), np.array([len(x) for x in own])
                columns = [np.concatenate(own), *(np.repeat(c, many) for c in (keys[hit[:, 0]], place >> 2, place >> 1 & 1, hit[:, 1]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["read_id", "key", "off", "rc", "score"])

    found = _asked(blocks, k, offers, 1)
    met = blocks.join(found, "block", "left").select("data", "found").mapInArrow(rows, "key long, place int, size int, reps long, seq binary, ids binary")
    met = met.repartition("key").sortWithinPartitions("key", "place")
    return met.mapInArrow(score, "read_id long, key long, off long, rc long, score long")


def _two_bits(block: Block, place: np.ndarray, turned: bool) -> bytes:
    """The sequences or their reverse complements, N as A, from their places on, four bases a byte; what is left of a last byte is 0."""
    at = np.arange(len(block.codes)) - np.repeat(block.starts()[:-1], block.sizes)
    if turned:
        at = np.repeat(block.sizes, block.sizes) - 1 - at
    c = np.zeros(int(place[-1]), np.uint8)
    c[np.repeat(place[:-1], block.sizes) + at] = np.where(block.codes < 4, 3 - block.codes if turned else block.codes, 0)
    c = c.reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes()
