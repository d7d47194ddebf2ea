"""Rows that fail to parse: text of an export into typed read records, and the failures with their reasons.

    text   := record (line-break record)*        many records; bare columns have no line break
    text   := record*                            a block of records whose starts are known: line breaks are content
    record := column ("," column)*
    column := '"' (char | '""')* '"' | bare      bare has no quote

A record whose quotes are broken ends at an anchor, where reading goes on. In a block the anchors are the known
starts of its records. Where they aren't known, an anchor is a line that begins like a record and at which one with four columns parses."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STREAMS = {"FASTA_TYPE": ">", "FASTQ_TYPE": "@"}
REASONS = ("quoting", "columns", "stream_type", "header", "qual")

_QUOTED = re.compile(r'"((?:[^"]|"")*)"')
_BARE = re.compile(r'[^",]*')
_BARE_LINE = re.compile(r'[^",\r\n]*')
_BREAK = re.compile(r"\r\n|\r|\n")
#: A line that begins like a record: type of stream, comma, first character of a header and one that isn't white space.
_LIKELY = re.compile(r'(?:\r\n|\r|\n)(?="?(?:FASTA|FASTQ)_TYPE"?,"?[>@]\S)')
_QUAL = re.compile(r"[!-~]*\Z")


class Malformed(Exception):
    def __init__(self, at: int):
        self.at = at


@dataclass
class Record:
    start: int
    end: int = 0
    columns: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    reason: str | None = None
    at: int | None = None


class Grammar:
    """Recursive descent over one text. starts: where the records of a block begin, in ascending order from 0."""

    def __init__(self, text: str, starts: list[int] | None = None):
        self.text, self.pos, self.end = text, 0, len(text)
        self.anchors = None if starts is None else [*starts, len(text)]
        self.bare = _BARE_LINE if starts is None else _BARE

    def records(self) -> Iterator[Record]:
        if self.anchors is not None:
            for self.pos, self.end in zip(self.anchors, self.anchors[1:]):
                yield self.record()
            return
        while self.pos < len(self.text):
            yield self.record()
            if m := _BREAK.match(self.text, self.pos):
                self.pos = m.end()

    def record(self) -> Record:
        rec = Record(self.pos)
        try:
            self.columns(rec)
        except Malformed as e:
            rec.reason, rec.at = "quoting", e.at
            self.pos = self.next_anchor(rec.start)
        rec.end = self.pos
        return rec if rec.reason else judged(rec)

    def columns(self, rec: Record) -> None:
        while True:
            rec.starts.append(self.pos)
            rec.columns.append(self.column())
            if self.pos >= self.end or self.text[self.pos] != ",":
                break
            self.pos += 1
        if self.pos < self.end and (self.anchors is not None or not _BREAK.match(self.text, self.pos)):
            raise Malformed(self.pos)

    def column(self) -> str:
        if self.text.startswith('"', self.pos, self.end):
            if not (m := _QUOTED.match(self.text, self.pos, self.end)):
                raise Malformed(self.pos)
            self.pos = m.end()
            return m[1].replace('""', '"')
        m = self.bare.match(self.text, self.pos, self.end)
        self.pos = m.end()
        return m[0]

    def next_anchor(self, start: int) -> int:
        """Where the record that began at start ends, its quotes being broken."""
        if self.anchors is not None:
            return self.end
        for m in _LIKELY.finditer(self.text, start):
            if self.parses(m.end()):
                return m.start()
        return len(self.text)

    def parses(self, at: int) -> bool:
        """Whether a record with four columns stands there, by the same descent."""
        probe, self.pos = Record(at), at
        try:
            self.columns(probe)
        except Malformed:
            return False
        return len(probe.columns) == 4


def judged(rec: Record) -> Record:
    """The first failing rule about columns and values, with its place."""

    def fail(reason: str, column: int) -> Record:
        rec.reason, rec.at = reason, rec.starts[min(column, len(rec.starts) - 1)]
        return rec

    if len(rec.columns) != 4:
        return fail("columns", 4)
    stream, header, seq, qual = rec.columns
    if stream not in STREAMS:
        return fail("stream_type", 0)
    if header[:1] != STREAMS[stream] or not header[1:2].strip():
        return fail("header", 1)
    if stream == "FASTA_TYPE":
        return fail("qual", 3) if qual else rec
    bases, quals = (x.replace("\r", "").replace("\n", "") for x in (seq, qual))
    return rec if len(bases) == len(quals) and _QUAL.match(quals) else fail("qual", 3)


PARSED = T.StructType(
    [
        T.StructField("record_no", T.LongType(), False),
        T.StructField("reason", T.StringType()),
        T.StructField("error_pos", T.LongType()),
        T.StructField("stream_type", T.StringType()),
        T.StructField("header", T.StringType()),
        T.StructField("seq", T.StringType()),
        T.StructField("qual", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)
_ARROW = [("record_no", pa.int64()), ("reason", pa.string()), ("error_pos", pa.int64())] + [
    (n, pa.string()) for n in ("stream_type", "header", "seq", "qual", "raw")
]


def _row(number: int, rec: Record, text: str) -> tuple:
    if rec.reason:
        return (number, rec.reason, rec.at - rec.start, None, None, None, None, text[rec.start : rec.end])
    return (number, None, None, *rec.columns, None)


def _block(texts: list[str]) -> Iterator[tuple]:
    """One row for each text: they are read side by side as a block, and a broken one ends where the next begins."""
    joined = "".join(texts)
    ends = list(accumulate(map(len, texts)))
    for rec in Grammar(joined, [0, *ends[:-1]] if texts else []).records():
        yield _row(0, rec, joined)


def _many(text: str) -> Iterator[tuple]:
    yield from (_row(n, rec, text) for n, rec in enumerate(Grammar(text).records()))


def parse_records(df: DataFrame, row_id: str, text: str | Column, single: bool = True) -> DataFrame:
    """One row per record of each text: row_id, record_no (from 0 in its text), then either reason,
    error_pos (characters from the record's start) and raw, or stream_type, header, seq and qual.

    single: a text is one record, and line breaks in it are content; the texts of a batch are parsed as one
    block. Otherwise a text holds many records, which end at line breaks outside quotes or, with broken quotes, at the next line
    at which a record parses. A null or empty text is one failure, `columns`. Rows are independent: no shuffle, no state.
    Nothing is trimmed, and a text of any length is read whole. Columns of df other than these two are
    left out, so none can clash."""
    source = df.select(F.col(row_id).cast("bigint").alias("_id"), (F.col(text) if isinstance(text, str) else text).alias("_text"))
    schema = T.StructType([T.StructField(row_id, T.LongType()), *PARSED.fields])
    arrow = pa.schema([(row_id, pa.int64()), *_ARROW])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            full = [(i, t) for i, t in zip(ids, texts) if t]
            out = [(i, 0, "columns", 0, None, None, None, None, t) for i, t in zip(ids, texts) if not t]
            if single:
                out += [(i, *row) for (i, _), row in zip(full, _block([t for _, t in full]))]
            else:
                out += [(i, *row) for i, t in full for row in _many(t)]
            cols = list(zip(*out)) or [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return source.mapInArrow(parse, schema)


def exports(df: DataFrame, file: str, line: str, text: str, lines: int = 256) -> DataFrame:
    """(file, block, text): the lines of each file in their order, `lines` of them side by side as one text. Blocks are bounded, so
    a file that holds most of the rows is spread; null and empty lines, and lines without a file or number, are left out."""
    rows = df.where(F.col(file).isNotNull() & F.col(line).isNotNull() & (F.col(text) != "")).select(file, F.col(line).alias("_line"), F.col(text).alias("_text")).distinct()
    groups = rows.groupBy(file, F.floor(F.col("_line") / lines).alias("block")).agg(F.sort_array(F.collect_list(F.struct("_line", "_text"))).alias("_l"))
    return groups.select(file, "block", F.array_join(F.col("_l._text"), "\n").alias("text"))


def valid(parsed: DataFrame, row_id: str) -> DataFrame:
    return parsed.where("reason is null").select(row_id, "record_no", "stream_type", "header", "seq", "qual")


def failed(parsed: DataFrame, row_id: str) -> DataFrame:
    return parsed.where("reason is not null").select(row_id, "record_no", "reason", "error_pos", "raw")
