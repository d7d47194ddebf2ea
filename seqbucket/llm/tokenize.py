"""Encoding of a whole corpus with a byte-level BPE of the tokenizers library, and the way back.

Null and empty texts have the ids []. Strings that look like special tokens are ordinary text. Texts of any
length are encoded whole. Rows are independent: one pass over the table, no shuffle."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters handed to the library at once; a longer text goes alone. Words whose ids a worker keeps, and
#: the longest of them.
CHARS, WORDS, WORD = 1 << 20, 1 << 18, 64

# fixed values: the words of a byte-level vocabulary, as far as they are made of printable ASCII and line breaks
_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e]*")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """One copy in each Python worker; it reads the file, which every machine must have."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=1)
def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary -> the byte: printable Latin-1
    stands for itself, the other bytes for the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    t, to_byte = _tokenizer(path), byte_characters()
    return [bytes(to_byte.get(c, 0x3F) for c in t.id_to_token(i) or "") for i in range(t.get_vocab_size())]


def _groups(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Different non-empty texts, some at a time, each with the places where it stands."""
    places: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        if t:
            places.setdefault(t, []).append(i)
    at: list[list[int]] = []
    group: list[str] = []
    size = 0
    for t, where in places.items():
        if group and size + len(t) > CHARS:
            yield at, group
            at, group, size = [], [], 0
        at.append(where)
        group.append(t)
        size += len(t)
    if group:
        yield at, group


@lru_cache(maxsize=2)
def _splits_plainly(path: str) -> bool:
    """Whether the vocabulary cuts texts into words by the usual rule and changes nothing before."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    pre = d.get("pre_tokenizer") or {}
    return d.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


class Encoder:
    """Ids of texts by the library. Merges never cross words, so of a plain text the library encodes each
    different word once, and the worker keeps the ids; any other text it encodes whole."""

    def __init__(self, path: str):
        self.tokenizer, self.by_words = _tokenizer(path), _splits_plainly(path)
        self.known: dict[str, list[int]] = {}

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        words = [_WORDS.findall(t) if self.by_words and _PLAIN.fullmatch(t) else None for t in texts]
        new = list({w for ws in words if ws is not None for w in ws} - self.known.keys())
        self.known.update(zip(new, self._library(new)))
        whole = iter(self._library([t for t, ws in zip(texts, words) if ws is None]))
        out = [
            np.asarray(next(whole), np.int32) if ws is None else np.fromiter(chain.from_iterable(map(self.known.__getitem__, ws)), np.int32)
            for ws in words
        ]
        for w in new:
            if len(w) > WORD:
                del self.known[w]
        if len(self.known) > WORDS:
            self.known.clear()
        return out


def encode(df: DataFrame, row_id: str, text: str, path: str = TOKENIZER, offsets: bool = False) -> DataFrame:
    """(row_id, ids), one row per row of df. With offsets also starts and ends: the characters that each
    token covers; a character that is split over several tokens is covered by each of them."""
    array = T.ArrayType(T.IntegerType())
    names = ["ids", "starts", "ends"] if offsets else ["ids"]
    kind = df.schema[row_id].dataType
    schema = T.StructType([T.StructField(row_id, kind), *(T.StructField(n, array) for n in names)])
    lists = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            out = [[()] * len(texts) for _ in names]
            for places, group in _groups(texts):
                if offsets:
                    found = encoder.tokenizer.encode_batch(group, add_special_tokens=False)
                    rows = [[np.asarray(x, np.int32) for x in (e.ids, *zip(*e.offsets))] for e in found]
                else:
                    rows = [[ids] for ids in encoder(group)]
                for where, values in zip(places, rows):
                    for o, v in zip(out, values):
                        for i in where:
                            o[i] = v
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, lists) for o in out)], names=[row_id, *names])

    return df.select(row_id, text).mapInArrow(run, schema)


def decode(df: DataFrame, row_id: str, ids: str, path: str = TOKENIZER) -> DataFrame:
    """(row_id, text): the bytes of all ids, joined before they are read as UTF-8, so that characters split
    over tokens come back whole. An empty or null list gives the empty text; bytes that are no UTF-8 (a
    list cut inside a character) become U+FFFD; unknown ids count as no bytes."""
    kind = df.schema[row_id].dataType
    schema = T.StructType([T.StructField(row_id, kind), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for b in batches:
            texts = [
                b"".join(table[i] for i in x if i is not None and 0 <= i < len(table)).decode("utf-8", "replace") if x else ""
                for x in b.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[row_id, "text"])

    return df.select(row_id, ids).mapInArrow(run, schema)


def round_trip(df: DataFrame, row_id: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(row_id, n_chars, digest): length and MD5 of the text that the ids of each row decode to; a null text counts as empty."""
    back = decode(encode(df, row_id, text, path), row_id, "ids", path)
    return back.select(row_id, F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))
