"""Evaluation texts leaking into training text: an FM-index over the words of each shard of the corpus.

A word is a maximal run of ASCII letters and digits, its case ignored; it stands in the index as the rank of
its 64-bit hash among the shard's words. Phrases are searched backwards through the ranks of a wavelet
matrix over the Burrows-Wheeler transform; their places come from sampled suffix positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyarrow.parquet import ParquetFile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqbucket.session import materialize

#: Words of a phrase; bytes of text in a shard, and words at most; distance of sampled positions; words of items in one block.
PHRASE, SHARD, SHARD_WORDS, SAMPLE, ITEM_WORDS = 12, 6 << 20, 2 << 20, 16, 1 << 20

_LOWER = np.zeros(256, np.uint64)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _LOWER[_c] = _LOWER[ord(chr(_c).upper())] = _c
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and byte after the last of each word."""
    codes = _LOWER[np.frombuffer(data, np.uint8)]
    inside = np.concatenate([[False], codes > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    sizes = ends - starts
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    powers = np.cumprod(np.full(int(sizes.max()) + 1, _STEP, np.uint64), dtype=np.uint64)
    letters = codes[inside[1:-1]]
    sums = np.add.reduceat((letters * np.uint64(0xC2B2AE3D27D4EB4F)) * powers[within], np.cumsum(sizes) - sizes, dtype=np.uint64)
    h = sums ^ (sums >> np.uint64(29))
    return h * np.uint64(0xBF58476D1CE4E5B9) + sizes.astype(np.uint64), starts, ends


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array, by prefix doubling of those suffixes that aren't told apart yet. symbols end with one that stands nowhere else."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.concatenate([[True], np.diff(symbols[order]) != 0])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.concatenate([new[1:], [True]])
    open_, length = order[~alone], 1
    while len(open_):
        key = rank[open_] * n + rank[open_ + length]
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        old = rank[open_]
        i = np.arange(len(open_))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(old) != 0]), i, 0))
        new = np.concatenate([[True], np.diff(key) != 0])
        rank[open_] = old + np.maximum.accumulate(np.where(new, i, 0)) - group
        open_ = open_[~(new & np.concatenate([new[1:], [True]]))]
        length *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit of the symbol at a time."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        now = sequence
        for level in reversed(range(self.levels)):
            bit = ((now >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 - len(bit) % 64, bool)]), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        self.start = np.zeros(symbols, np.int64)
        there, first = np.unique(now, return_index=True)
        self.start[there] = first

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often symbol stands in the first end places."""
        at = end.astype(np.int64)
        for k, level in enumerate(reversed(range(self.levels))):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & mask)
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at - self.start[symbol]


class FMIndex:
    """texts: one array of word hashes each. No occurrence crosses texts."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(sizes + 1) - (sizes + 1)
        joined = np.concatenate([*texts, np.zeros(0, np.uint64)])
        self.vocabulary, codes = np.unique(joined, return_inverse=True)
        n, d = len(joined) + len(texts), len(texts)
        word_at = np.arange(len(joined)) + np.repeat(np.arange(d), sizes)
        # a text ends with a symbol of its own, smaller than any word
        symbols = np.empty(n, np.int64)
        symbols[word_at] = codes + d
        symbols[self.begin + sizes] = np.arange(d)
        order = suffix_order(symbols)
        plain = np.zeros(n, np.int64)
        plain[word_at] = codes + 1
        self.last = plain[order - 1]
        counts = np.bincount(plain, minlength=len(self.vocabulary) + 1)
        self.less = np.cumsum(counts) - counts
        self.matrix = WaveletMatrix(self.last, len(self.vocabulary) + 1)
        taken = (order % SAMPLE == 0) | (self.last == 0)
        self.taken, self.samples, self.nth = taken, order[taken], np.cumsum(taken) - 1
        self.n = n

    def count(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phrases: word hashes, one phrase a row -> the rows of the index that begin with each, [low, high)."""
        at = np.minimum(np.searchsorted(self.vocabulary, phrases), max(0, len(self.vocabulary) - 1))
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        if not len(self.vocabulary) or not len(phrases):
            return low, high
        live = np.flatnonzero((self.vocabulary[at] == phrases).all(axis=1))
        symbols = at[live] + 1
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for j in reversed(range(phrases.shape[1])):
            c = symbols[:, j]
            lo, hi = self.less[c] + self.matrix.rank(c, lo), self.less[c] + self.matrix.rank(c, hi)
            keep = lo < hi
            live, symbols, lo, hi = live[keep], symbols[keep], lo[keep], hi[keep]
        low[live], high[live] = lo, hi
        return low, high

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and word number of the suffixes in these rows: backwards to a sampled position, at the
        latest at the text's first word."""
        place = np.zeros(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            here = self.taken[rows[todo]]
            done = todo[here]
            place[done] = self.samples[self.nth[rows[done]]] + steps
            todo = todo[~here]
            c = self.last[rows[todo]]
            rows[todo] = self.less[c] + self.matrix.rank(c, rows[todo])
            steps += 1
        text = np.searchsorted(self.begin, place, side="right") - 1
        return text, place - self.begin[text]


def all_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words, of a long text piece by piece; pieces end outside words (a word longer than a piece stays whole)."""
    if len(data) <= SHARD:
        return words(data)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + SHARD)
        while end < len(data) and _LOWER[data[end]] and _LOWER[data[end - 1]]:
            end += 1
        h, a, b = words(data[at:end])
        parts.append((h, a + at, b + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))


_HIT = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())]
#: A piece of a text in the index: number of the text, number of its first word, hashes.
Piece = tuple[int, int, np.ndarray]


class Phrases:
    """All phrases of size consecutive words of some items, as hashes."""

    def __init__(self, items: list[tuple[int, np.ndarray]], size: int):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.size = size
        self.hashes = np.concatenate([np.zeros((0, size), np.uint64), *(np.lib.stride_tricks.sliding_window_view(w, size) for _, w in items)])
        self.item = np.repeat(np.arange(len(items)), [len(w) - size + 1 for _, w in items])

    def hits(self, index: FMIndex, pieces: list[Piece]) -> np.ndarray:
        """Rows (text, item id, word) of all places of all phrases."""
        low, high = index.count(self.hashes)
        n = high - low
        rows = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        piece, word = index.locate(rows)
        text, base = (np.array([p[i] for p in pieces], np.int64) for i in (0, 1))
        return np.stack([text[piece], np.repeat(self.ids[self.item], n), word + base[piece]], axis=1)


_ITEM = [("id", pa.int64()), ("words", pa.binary())]


def item_words(items: DataFrame, item_id: str, item_text: str, size: int) -> DataFrame:
    """(id, words): the word hashes of each item of size words or more, eight bytes a word."""
    source = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [(i, all_words(t.encode("utf-8", "surrogatepass"))[0]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            held = [(i, w.tobytes()) for i, w in held if len(w) >= size]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], t) for k, (_, t) in enumerate(_ITEM)], names=[n for n, _ in _ITEM])

    return source.mapInArrow(run, T.StructType([T.StructField("id", T.LongType()), T.StructField("words", T.BinaryType())]))


class Asked:
    """The items' words in the files of a table that all machines can read. A task goes through them block by block for
    each of its shards; if they all fit in a block, it keeps that."""

    def __init__(self, files: list[str], size: int):
        self.files, self.size, self.kept = files, size, None

    def blocks(self) -> Iterator[Phrases]:
        if self.kept is not None:
            yield from self.kept
            return
        held, n, out = [], 0, 0
        for name in self.files:
            fs, path = FileSystem.from_uri(name)
            with fs.open_input_file(path) as f:
                for b in ParquetFile(f).iter_batches(batch_size=256):
                    for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                        held.append((i, np.frombuffer(w, np.uint64)))
                        n += len(held[-1][1])
                        if n >= ITEM_WORDS:
                            yield Phrases(held, self.size)
                            held, n, out = [], 0, out + 1
        last = Phrases(held, self.size)
        if not out:
            self.kept = [last] if held else []
        if held:
            yield last


def _spans(docs: list[tuple[int, bytes]], found: list[tuple], hits: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Hits of one item in one text that overlap or touch, merged; in characters."""
    if not len(hits):
        return
    doc, item, word = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))].T
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(word) > size)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    chars, at = None, -1
    for d, i, a, b in zip(doc[first].tolist(), item[first].tolist(), word[first].tolist(), (word[last] + size - 1).tolist()):
        if d != at:
            at = d
            chars = np.cumsum((np.frombuffer(docs[d][1], np.uint8) & 0xC0) != 0x80, dtype=np.int64)
        _, starts, ends = found[d]
        yield docs[d][0], i, int(chars[starts[a]]) - 1, int(chars[ends[b] - 1])


def _search(docs: list[tuple[int, bytes]], asked: Asked) -> Iterator[tuple[int, int, int, int]]:
    """Spans of a shard's texts. The shard is indexed once, for all blocks of items. A text of many words is indexed in pieces that overlap by a phrase less a word."""
    found = [all_words(data) for _, data in docs]
    over = asked.size - 1
    hits, pieces, held = [np.zeros((0, 3), np.int64)], [], 0

    def search() -> None:
        index = FMIndex([h for _, _, h in pieces])
        hits.extend(block.hits(index, pieces) for block in asked.blocks())

    for d, (h, _, _) in enumerate(found):
        for at in range(0, max(1, len(h) - over), SHARD_WORDS):
            pieces.append((d, at, h[at : at + SHARD_WORDS + over]))
            held += len(pieces[-1][2])
            if held >= SHARD_WORDS:
                search()
                pieces, held = [], 0
    if pieces:
        search()
    yield from _spans(docs, found, np.concatenate(hits), asked.size)


def leaked_spans(corpus: DataFrame, row_id: str, text: str, items: DataFrame, item_id: str, item_text: str, size: int = PHRASE) -> DataFrame:
    """(doc_id, item_id, start_char, end_char): where size or more consecutive words of an item stand in a
    text, whatever is between the words; hits of one item that overlap or touch are one span. A text may
    hold several items. Null texts, items without an id, and texts or items of fewer words have no rows; repeated rows repeat theirs.

    The corpus is read once; tasks index their rows shard by shard and keep one shard at a time. The items are hashed by Spark and written to
    the shared folder; each shard is asked for them block by block, ITEM_WORDS words at a time. Nothing goes through the driver but the files' names, and nothing is shuffled."""
    source = corpus.select(F.col(row_id).cast("bigint"), F.col(text)).where(F.col(text).isNotNull())
    asked = Asked(materialize(item_words(items, item_id, item_text, size), "items").inputFiles(), size)
    arrow = pa.schema(_HIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(docs: list) -> Iterator[pa.RecordBatch]:
            found = list(zip(*_search(docs, asked))) if docs else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], schema=arrow)

        docs: list = []
        held = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = t.encode("utf-8", "surrogatepass")
                docs.append((i, data))
                held += len(data)
                if held >= SHARD:
                    yield from flush(docs)
                    docs, held = [], 0
        yield from flush(docs)

    return source.mapInArrow(run, T.StructType([T.StructField(n, T.LongType()) for n, _ in _HIT]))


def leaked(corpus: DataFrame, row_id: str, text: str, items: DataFrame, item_id: str, item_text: str, size: int = PHRASE) -> DataFrame:
    """(doc_id, item_id): each text with each item of which it holds size consecutive words."""
    return leaked_spans(corpus, row_id, text, items, item_id, item_text, size).select("doc_id", "item_id").distinct()
