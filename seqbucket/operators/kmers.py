"""Tables of mers of reads. Mers are BIGINTs of two bits a base, in the order of the strings (k up to 31)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Code of each byte: A, C, G, T 0 to 3; anything else 4.
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _i


def _joined(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, codes of all reads side by side, and where each read begins (and the end)."""
    ids, seqs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
    data = "".join(s or "" for s in seqs).encode("ascii", "replace")
    starts = np.concatenate([[0], np.cumsum([len(s or "") for s in seqs])]).astype(np.int64)
    return ids, _CODE[np.frombuffer(data, np.uint8)], starts


def _rolled(codes: np.ndarray, k: int, reverse: bool = False) -> np.ndarray:
    """The mer from each place on, or its reverse complement; codes above 3 must be gone."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # mers of 1, 2, 4 ... bases; those of which k is the sum are put together
    part, size, out, have = codes.astype(np.int64), 1, np.zeros(n, np.int64), 0
    while True:
        if k & size:
            piece = part[have : have + n]
            out = out | piece << 2 * have if reverse else out << 2 * size | piece
            have += size
        if 2 * size > k:
            return out
        part = part[:-size] | part[size:] << 2 * size if reverse else part[:-size] << 2 * size | part[size:]
        size *= 2


def _places(starts: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a mer lies in one read, and the read's number."""
    i = np.arange(max(n, 0))
    owner = np.searchsorted(starts, i, side="right") - 1
    inside = i + k <= starts[owner + 1]
    return i[inside], owner[inside]


def _both(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward mers, and those of the reverse complement; N counts as A on either strand."""
    known = codes < 4
    return _rolled(np.where(known, codes, 0), k), _rolled(np.where(known, 3 - codes, 0), k, True)


def _firsts(key: np.ndarray, scan: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each read's equal keys the one of the smallest scan. Where all three fit in a number, numbers are
    sorted, which is much faster than sorting places by three columns."""
    if not len(key):
        return key, scan, own
    low = int(scan.max()).bit_length()
    if 2 * k + low + int(own.max()).bit_length() <= 63:
        packed = np.sort(own << (2 * k + low) | key << low | scan)
        packed = packed[np.concatenate([[True], np.diff(packed >> low) != 0])]
        return packed >> low & ((1 << 2 * k) - 1), packed & ((1 << low) - 1), packed >> (2 * k + low)
    by = np.lexsort((scan, key, own))
    first = by[np.concatenate([[True], (np.diff(key[by]) != 0) | (np.diff(own[by]) != 0)])]
    return key[first], scan[first], own[first]


def _mapped(df: DataFrame, row_id: str, seq: str, names: list[str], f: Callable) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in f(*_joined(b))], names=names)

    return df.select(row_id, seq).mapInArrow(run, schema)


def candidates(df: DataFrame, row_id: str, seq: str, k: int = 15, both: bool = True) -> DataFrame:
    """(row_id, key, off, rc): the different mers of each read and, with both, of its reverse complement,
    each where it is met first: window p gives the forward mer at off p, then the reverse one at off L-k-p.
    Letters other than A, C, G, T count as A. Reads shorter than k have none."""

    def f(ids, codes, starts):
        forward, backward = _both(codes, k)
        at, owner = _places(starts, len(forward), k)
        off = at - starts[owner]
        key, scan, own = forward[at], 2 * off, owner
        if both:
            pair = lambda a, b: np.stack([a, b], axis=1).ravel()
            key, scan, own = pair(key, backward[at]), pair(scan, scan + 1), pair(owner, owner)
        key, scan, own = _firsts(key, scan, own, k)
        rc = scan & 1
        size = np.diff(starts)[own]
        return ids[own], key, np.where(rc == 1, size - k - (scan >> 1), scan >> 1), rc

    return _mapped(df, row_id, seq, [row_id, "key", "off", "rc"], f)


def candidate_counts(df: DataFrame, row_id: str, seq: str, k: int = 15, both: bool = True) -> DataFrame:
    """(key, n): the candidates' keys without their places, in how many reads of a batch each is; to be added up over the batches."""

    def f(_, codes, starts):
        forward, backward = _both(codes, k)
        at, owner = _places(starts, len(forward), k)
        key, own = forward[at], owner
        if both:
            key, own = np.concatenate([key, backward[at]]), np.concatenate([own, own])
        if not len(key):
            return [[]] * 2
        if 2 * k + int(own.max()).bit_length() <= 63:
            shift = int(own.max()).bit_length()
            packed = np.sort(key << shift | own)
            key = packed[np.concatenate([[True], np.diff(packed) != 0])] >> shift
        else:
            key = np.sort(_firsts(key, np.zeros(len(key), np.int64), own, k)[0])
        first = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
        return key[first], np.diff(np.concatenate([first, [len(key)]]))

    return _mapped(df, row_id, seq, ["key", "n"], f)


def best_known(df: DataFrame, row_id: str, seq: str, known: Broadcast, k: int = 15, both: bool = True) -> DataFrame:
    """(row_id, key, off, rc): of the candidates of each read the one of the largest weight, then the smallest key. known: keys in ascending
    order, and their weights; other keys weigh 1."""

    def f(ids, codes, starts):
        forward, backward = _both(codes, k)
        at, owner = _places(starts, len(forward), k)
        if not len(at):
            return [[]] * 4
        off = at - starts[owner]
        key, scan, own = forward[at], 2 * off, owner
        if both:
            pair = lambda a, b: np.stack([a, b], axis=1).ravel()
            key, scan, own = pair(key, backward[at]), pair(scan, scan + 1), pair(owner, owner)
        keys, weights = known.value
        place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        weight = np.where(keys[place] == key, weights[place], 1) if len(keys) else np.ones(len(key), np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(own) != 0]))
        sizes = np.diff(np.concatenate([cuts, [len(own)]]))
        top = np.flatnonzero(weight == np.repeat(np.maximum.reduceat(weight, cuts), sizes))
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(own[top]) != 0]))
        low = np.repeat(np.minimum.reduceat(key[top], cuts), np.diff(np.concatenate([cuts, [len(top)]])))
        hit = top[key[top] == low]
        hit = hit[np.concatenate([[True], np.diff(own[hit]) != 0])]
        rc, size = scan[hit] & 1, np.diff(starts)[own[hit]]
        return ids[own[hit]], key[hit], np.where(rc == 1, size - k - (scan[hit] >> 1), scan[hit] >> 1), rc

    return _mapped(df, row_id, seq, [row_id, "key", "off", "rc"], f)


def smallest(df: DataFrame, row_id: str, seq: str, k: int = 15, both: bool = True) -> DataFrame:
    """(row_id, key, off, rc): of candidates, the one with the smallest key of each read."""

    def f(ids, codes, starts):
        forward, backward = _both(codes, k)
        at, owner = _places(starts, len(forward), k)
        if not len(at):
            return [[]] * 4
        off = at - starts[owner]
        size = starts[owner + 1] - starts[owner]
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(owner) != 0]))
        here = np.minimum(forward[at], backward[at]) if both else forward[at]
        low = np.repeat(np.minimum.reduceat(here, cuts), np.diff(np.concatenate([cuts, [len(at)]])))
        hits = np.flatnonzero(here == low)
        hits = hits[np.concatenate([[True], np.diff(owner[hits]) != 0])]
        rc = (forward[at[hits]] != low[hits]).astype(np.int64)
        return ids[owner[hits]], low[hits], np.where(rc == 1, size[hits] - k - off[hits], off[hits]), rc

    return _mapped(df, row_id, seq, [row_id, "key", "off", "rc"], f)


def held_grams(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(key, gram): the different mers of each row, under the row's key; other letters than A, C, G, T count as A."""

    def f(ids, codes, starts):
        all_ = _rolled(np.where(codes < 4, codes, 0), k)
        at, owner = _places(starts, len(all_), k)
        packed = np.unique(owner << 2 * k | all_[at])
        return ids[packed >> 2 * k], packed & ((1 << 2 * k) - 1)

    return _mapped(df, key, seq, [key, "gram"], f)


def read_mers(df: DataFrame, row_id: str, seq: str, k: int) -> DataFrame:
    """(row_id, off, key, rc_key): the mer at each place of each read, rolled on from the one before, and its
    reverse complement. Other letters than A, C, G, T count as A on either strand; reads shorter than k have none."""

    def f(ids, codes, starts):
        forward, backward = _both(codes, k)
        at, owner = _places(starts, len(forward), k)
        return ids[owner], at - starts[owner], forward[at], backward[at]

    return _mapped(df, row_id, seq, [row_id, "off", "key", "rc_key"], f)


def grams(df: DataFrame, row_id: str, seq: str, k: int, n_as_a: bool = True) -> DataFrame:
    """(row_id, gram): every mer of every place; with n_as_a false, places with another letter than A, C,
    G, T are left out."""

    def f(ids, codes, starts):
        known = codes < 4
        all_ = _rolled(np.where(known, codes, 0), k)
        at, owner = _places(starts, len(all_), k)
        if not n_as_a:
            bad = np.concatenate([[0], np.cumsum(~known)])
            ok = bad[at + k] == bad[at]
            at, owner = at[ok], owner[ok]
        return ids[owner], all_[at]

    return _mapped(df, row_id, seq, [row_id, "gram"], f)


def slices(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """The mers of each text, of every place; other letters than A, C, G, T count as A."""
    codes = _CODE[np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8)]
    all_, at = _rolled(np.where(codes < 4, codes, 0), k), 0
    for t in texts:
        yield all_[at : at + max(len(t) - k + 1, 0)]
        at += len(t)
