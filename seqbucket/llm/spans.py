"""Long exact spans shared between records, found with compact windows.

The tokens of a text are its overlapping grams, with a hash each. A node of the Cartesian tree of these hashes is the smallest token
(the leftmost of several) of an interval (left, root, right) that ends where a smaller one stands. Every stretch of `span` characters has one root:
the node of the smallest of its tokens. The stretches of one root are a compact window; only nodes whose interval is as long as a
stretch have one, about two in a stretch's length. With several hashes the windows of each are joined by their intervals: what lies in one window of each
hash is a window with the signatures of all.

Equal stretches have equal roots at equal places, so a stretch can only stand in two records if its windows'
signatures are equal. Windows meet by signature and are then verified character by character: a text that stands in two records is
shared as it stands, and where texts differ, their stretches are compared. Nothing is paired: all steps ask
a group only for its smallest and its largest record."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from seqbucket.operators.skew import salted_lookup
from seqbucket.session import materialize

#: Length of a token, hashes, characters worked on at once. One hash loses no shared stretch; more make groups smaller and windows more.
GRAM, HASHES, CHARS = 24, 1, 1 << 18
#: Different texts of one signature in a batch, and rows of one in a task, beyond which its stretches are compared each for itself.
TEXTS, GROUP = 256, 50_000

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=8)
def _table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    return _table(base, 1 << n.bit_length())[:n]


def gram_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the width characters from each place on, from running sums of a polynomial in the characters."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + _U(1)) * _powers(_STEP, len(codes)), dtype=np.uint64)])
    return _mix((sums[width:] - sums[:-width]) * _powers(_BACK, n))


def _runs(texts: list[str | None], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, about CHARS characters at a time: the row and the first character of each piece, code points
    side by side, and where each piece begins (and the end). A longer text comes in pieces that overlap."""
    at: list[tuple[int, int, int]] = []
    size = 0

    def run() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        joined = "".join(texts[i][a:b] for i, a, b in at)
        starts = np.concatenate([[0], np.cumsum([b - a for _, a, b in at])])
        row, first, _ = np.array(at, np.int64).T
        return row, first, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts

    for i, t in enumerate(texts):
        for a in range(0, len(t or "") - overlap, CHARS):
            b = min(len(t), a + CHARS + overlap)
            at.append((i, a, b))
            size += b - a
            if size >= CHARS:
                yield run()
                at, size = [], 0
    if at:
        yield run()


def _smaller(h: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the next one to the left whose h isn't larger and the next one to the right whose h is smaller, or one at
    least reach away. The first and the last h are the smallest of all.

    All places jump at once: between a place and the one it points at nothing is smaller, so it may go on to where that one points."""
    n = len(h)
    place, out = np.arange(n), []
    for step, differs in ((-1, np.greater), (1, np.greater_equal)):
        to = place + step
        to[[0, -1]] = 0, n - 1
        # neighbours first, without looking places up
        at = np.flatnonzero(differs(h[:-2], h[1:-1]) if step < 0 else differs(h[2:], h[1:-1])) + 1
        while len(at):
            there = to[to[at]]
            to[at] = there
            on = differs(h[there], h[at])
            on &= (at - there) * -step < reach
            at = at[on]
        out.append(to)
    return out[0], out[1]


def compact_windows(codes: np.ndarray, starts: np.ndarray, span: int, gram: int, hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts side by side -> first and last stretch of each compact window, in order, and its signature."""
    tokens = gram_hashes(codes, gram)
    reach, n = span - gram + 1, len(tokens)
    if n < reach:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.ones(n, bool)
    for b in starts[1:-1]:
        inside[max(b - gram + 1, 0) : b] = False
    found = []
    for k in range(hashes):
        # tokens over the border of two texts are smaller than any other
        h = np.concatenate([[_U(0)], np.where(inside, _mix(tokens + _U(k)) | _U(1), _U(0)), [_U(0)]])
        left, right = _smaller(h, reach)
        root = np.arange(n + 2)
        first, last = np.maximum(left + 1, root - reach + 1), np.minimum(root, right - reach)
        held = np.flatnonzero((first <= last) & (h > 0))
        by = held[np.argsort(first[held])]
        found.append((first[by] - 1, last[by] - 1, root[by] - 1, h[by]))
    if hashes == 1:
        first, last, _, signature = found[0]
        return first, last, signature
    # each stretch lies in one window of each hash: windows of all hashes are what lies between two borders
    first = np.unique(np.concatenate([f for f, _, _, _ in found]))
    last = np.unique(np.concatenate([x for _, x, _, _ in found]))
    signature, lead = np.zeros(len(first), np.uint64), None
    for f, _, root, h in found:
        at = np.searchsorted(f, first, side="right") - 1
        lead = root[at] if lead is None else lead
        signature = _mix(signature * _U(_STEP) ^ h[at] ^ (root[at] - lead).astype(np.int64).view(np.uint64))
    return first, last, signature


#: Kinds of rows that meet: a signature whose stretches are compared each for itself, a window, a shared run, a window of such a signature.
MARK, WINDOW, SHARED, APART = range(4)
_ROW = pa.schema([("shard", pa.int64()), ("signature", pa.int64()), ("kind", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("start", pa.int64()), ("reach", pa.int64()), ("text", pa.string())])
_FOUND = pa.schema([("kind", pa.int32()), ("rec_id", pa.int64()), ("high", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("text", pa.string())])


def _spark(schema: pa.Schema) -> T.StructType:
    kinds = {pa.int64(): T.LongType(), pa.int32(): T.IntegerType(), pa.string(): T.StringType()}
    return T.StructType([T.StructField(f.name, kinds[f.type]) for f in schema])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _near(places: list[tuple[int, int]], span: int) -> Iterator[tuple[int, int, int]]:
    """(record, start) of one text -> (record, start, reach): starts no more than span apart, whose stretches cover all characters from the first
    to the last, as in a run of one letter or of a few that repeat, become one row."""
    places = sorted(places)
    i = 0
    while i < len(places):
        rec, start = places[i]
        last = start
        i += 1
        while i < len(places) and places[i][0] == rec and places[i][1] - last <= span:
            last = places[i][1]
            i += 1
        yield rec, start, last - start


def _together(signature: int, rows: list[tuple[int, int, str]], span: int, most: int) -> Iterator[tuple]:
    """Windows (record, start, text) of a batch with one signature. A text of two records is shared, whatever comes from elsewhere: only
    one row of it goes on, with the smallest and the largest record, and asks nothing (start -1)."""
    texts: dict[str, list] = {}
    for rec, start, text in rows:
        texts.setdefault(text, []).append((rec, start))
    apart = len(texts) > most
    if apart:
        yield (signature, signature, MARK, 0, 0, -1, 0, None)
    for text, places in texts.items():
        low, high = min(places)[0], max(places)[0]
        for rec, start, reach in _near(places, span):
            if low < high:
                yield (rec * 31 + start, signature, SHARED, rec, start + reach + len(text) - span, start, 0, None)
            else:
                yield (rec * 31 + start if apart else signature, signature, APART if apart else WINDOW, rec, rec, start, reach, text)
        if low < high:
            yield (low * 31 + high if apart else signature, signature, APART if apart else WINDOW, low, high, -1, 0, text)


def _windows(batches: Iterator[pa.RecordBatch], span: int, gram: int, hashes: int, most: int) -> Iterator[pa.RecordBatch]:
    """(rec_id, text) -> the compact windows of each text; what a batch can decide is decided in it, so a window that
    most records hold is sent once a batch."""
    for b in batches:
        ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
        recs, begins, signatures, contents = [], [], [], []
        for row, base, codes, starts in _runs(texts, span - 1):
            first, last, signature = compact_windows(codes, starts, span, gram, hashes)
            own = np.searchsorted(starts, first, side="right") - 1
            begin = first - starts[own] + base[own]
            recs.append(ids[row[own]])
            begins.append(begin)
            signatures.append(signature.view(np.int64))
            contents += [texts[r][s : s + m] for r, s, m in zip(row[own].tolist(), begin.tolist(), (last - first + span).tolist())]
        if not contents:
            continue
        rec, begin, signature = np.concatenate(recs), np.concatenate(begins), np.concatenate(signatures)
        by = np.argsort(signature, kind="stable")
        new = np.concatenate([[True], np.diff(signature[by]) != 0])
        alone = new & np.concatenate([new[1:], [True]])
        one = by[alone]
        n = len(one)
        columns = [signature[one], signature[one], np.full(n, WINDOW, np.int32), rec[one], rec[one], begin[one], np.zeros(n, np.int64), [contents[i] for i in one.tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW)], schema=_ROW)
        more, cuts = by[~alone], np.flatnonzero(new[~alone])
        out: list[tuple] = []
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(more)]):
            at = more[lo:hi]
            out += _together(int(signature[at[0]]), [(r, s, contents[i]) for r, s, i in zip(rec[at].tolist(), begin[at].tolist(), at.tolist())], span, most)
        if out:
            # places of shards wrap round, as numbers of eight bytes do
            out = [((r[0] + (1 << 63)) % (1 << 64) - (1 << 63), *r[1:]) for r in out]
            yield _batch(out, _ROW)


def _verified(rows: list[tuple], span: int) -> Iterator[tuple]:
    """Windows (low, high, start, reach, text) of one signature -> their shared runs. Characters are compared."""
    texts: dict[str, list] = {}
    for low, high, start, reach, text in rows:
        held = texts.setdefault(text, [low, high, []])
        held[0], held[1] = min(held[0], low), max(held[1], high)
        if start >= 0:
            held[2].append((low, start, reach))
    if min(t[0] for t in texts.values()) == max(t[1] for t in texts.values()):
        return
    stretches: dict[str, tuple[int, int]] = {}
    if len(texts) > 1:
        for text, (low, high, _) in texts.items():
            for i in range(len(text) - span + 1):
                part = text[i : i + span]
                a, b = stretches.get(part, (low, high))
                stretches[part] = a if a < low else low, b if b > high else high
    for text, (low, high, places) in texts.items():
        if not places:
            continue
        last = len(text) - span
        if low < high:
            runs = [(0, last)]
        else:
            hit = [i for i in range(last + 1) if (x := stretches.get(text[i : i + span])) and x[0] < x[1]]
            runs = [(a, a + n) for _, a, n in _near([(0, i) for i in hit], span)]
        for rec, start, reach in places:
            for a, b in runs:
                yield (SHARED, rec, rec, start + a, start + reach + b, None)


def _met(batches: Iterator[pa.RecordBatch], span: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature and kind -> shared runs, and the windows whose stretches are compared each for itself. One signature's rows are
    held, `most` of them at most."""
    at, held, apart = None, [], False

    def close() -> list[tuple]:
        return list(_verified(held, span)) if len(held) > 1 else []

    def free(rows: list[tuple]) -> list[tuple]:
        return [(APART, low, high, start, start + reach, text) for low, high, start, reach, text in rows]

    for b in batches:
        if not b.num_rows:
            continue
        signature, kind = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        out: list[tuple] = []
        # a window whose signature stands nowhere else asks in vain
        new = np.concatenate([[True], np.diff(signature) != 0])
        alone = new & np.concatenate([new[1:], [False]]) & (kind == WINDOW)
        alone[:1] &= at is None or signature[:1] != at
        keep = b.filter(pa.array(~alone))
        for _, sig, k, lo, hi, start, reach, text in zip(*(c.to_pylist() for c in keep.columns)):
            if sig != at:
                out += close()
                at, held, apart = sig, [], False
            if k == MARK:
                apart = True
            elif k == WINDOW:
                row = (lo, hi, start, reach, text)
                if apart:
                    out += free([row])
                else:
                    held.append(row)
                    if len(held) > most:
                        out += free(held)
                        held, apart = [], True
            elif k == SHARED:
                out.append((SHARED, lo, lo, start, hi, None))
            else:
                out += free([(lo, hi, start, reach, text)])
        if out:
            yield _batch(out, _FOUND)
    if out := close():
        yield _batch(out, _FOUND)


def shared_spans(df: DataFrame, row_id: str, text: str, span: int = 64, gram: int = GRAM, hashes: int = HASHES, texts: int = TEXTS, group: int = GROUP) -> DataFrame:
    """(row_id, start_pos, end_pos): the maximal runs of characters that lie in a stretch of span characters
    which also stands, character by character, in the text of a row with another row_id. Positions count
    characters from 0; end_pos is the place after the last. Rows without an id are left out; null texts and texts shorter than span have no
    runs; a row delivered twice (equal row_id) shares nothing with itself. Texts are read whole.

    Windows are shuffled once, by signature. A signature with more than `texts` different texts in a batch, or `group` rows in a task, isn't
    worked on in one group: its stretches go on for themselves, and hot ones are counted map-side and looked up over salts."""
    gram = min(gram, span)
    source = df.select(F.col(row_id).cast("bigint").alias("rec_id"), F.col(text).alias("_text")).where((F.length("_text") >= span) & F.col("rec_id").isNotNull())
    windows = source.mapInArrow(lambda it: _windows(it, span, gram, hashes, texts), _spark(_ROW))
    met = windows.repartition("shard").sortWithinPartitions("signature", "kind").mapInArrow(lambda it: _met(it, span, group), _spark(_FOUND))
    met = materialize(met, "windows")
    hits = met.where(F.col("kind") == SHARED).select("rec_id", "lo", "hi")
    apart = met.where(F.col("kind") == APART)
    if not apart.isEmpty():
        hits = hits.unionByName(_stretch_hits(apart, span))
    by_place = W.partitionBy("rec_id").orderBy("lo", "hi")
    gap = F.coalesce(F.col("lo") > F.max("hi").over(by_place.rowsBetween(W.unboundedPreceding, -1)) + span, F.lit(False))
    runs = hits.withColumn("_run", F.sum(gap.cast("int")).over(by_place))
    return runs.groupBy("rec_id", "_run").agg(F.min("lo").alias("start_pos"), (F.max("hi") + span).alias("end_pos")).select(F.col("rec_id").alias(row_id), "start_pos", "end_pos")


def _stretch_hits(apart: DataFrame, span: int) -> DataFrame:
    """Windows (rec_id, high, lo, hi, text) -> (rec_id, lo, hi) of their shared stretches, each looked up by its characters."""
    each = F.transform(F.sequence(F.lit(1), F.length("text") - span + 1), lambda i: F.substr("text", i, F.lit(span)))
    parts = materialize(apart.select("rec_id", "high", "lo", "hi", F.posexplode(each).alias("_i", "part")), "stretches")
    shared = parts.groupBy("part").agg(F.count("*").alias("n"), F.min("rec_id").alias("_low"), F.max("high").alias("_high")).where("_low < _high").select("part", "n")
    asked = parts.where("lo >= 0").select("rec_id", "part", (F.col("lo") + F.col("_i")).alias("lo"), (F.col("hi") + F.col("_i")).alias("hi"))
    return salted_lookup(asked, shared, "part", "n", "lo").select("rec_id", "lo", "hi")


def shared_share(df: DataFrame, row_id: str, text: str, span: int = 64) -> DataFrame:
    """(row_id, n_chars, n_shared, share): for each row_id with a text, how much of it is shared; the share of an
    empty text is 0."""
    runs = shared_spans(df, row_id, text, span).groupBy(row_id).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("_n"))
    sizes = df.where(F.col(text).isNotNull()).groupBy(row_id).agg(F.max(F.length(text)).cast("bigint").alias("n_chars"))
    shared = F.coalesce("_n", F.lit(0))
    return sizes.join(runs, row_id, "left").select(row_id, "n_chars", shared.alias("n_shared"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("share"))
