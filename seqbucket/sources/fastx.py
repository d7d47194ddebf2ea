"""FASTA and FASTQ files as DataFrames, one row per record, and back.

read_fasta is a Spark text scan, split inside files. The data source `fastx` reads records of
several lines, compressed files and mates in lock-step, one task per file or pair of files; files of four-line records, which
read_fastq is told of by four_lines, are split into ranges of bytes."""

from __future__ import annotations

import bz2
import glob
import gzip
import io
import lzma
import os
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from seqbucket.session import scratch

SCHEMA = "file string, pair int, ordinal bigint, mate int, header string, seq string, qual string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


#: Bytes of a range of a file of four-line records.
SPLIT = 64 << 20
#: Records of a batch.
ROWS = 10_000
PACKED = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}


class FastxError(ValueError):
    pass


def write_fasta(df: DataFrame, path: str, width: int | None = None) -> str:
    """df(header, seq), headers without `>`; lines of width characters."""
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n") if width else F.col("seq")
    df.select(F.concat(F.lit(">"), "header", F.lit("\n"), lines)).write.text(path)
    return path


def write_fastq(df: DataFrame, path: str) -> str:
    df.select(F.concat(F.lit("@"), "header", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")).write.text(path)
    return path


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, header, seq): a record ends where a line begins with `>`; its lines are joined. Files are split."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\A>", "").alias("v"))
    parts = F.split("v", r"\r?\n", 2)
    seq = F.when(F.size(parts) > 1, F.regexp_replace(parts[1], r"[\r\n]", "")).otherwise("")
    return rows.where(F.length(F.trim("v")) > 0).select("file", parts[0].alias("header"), seq.alias("seq"))


def read_fastq(spark: SparkSession, path: str, four_lines: bool = False, split_bytes: int = SPLIT) -> DataFrame:
    """The data source's rows. four_lines: each record has four lines, which is checked; files that aren't compressed are then read in ranges of
    split_bytes, and ordinal is the byte at which a record begins, which also rises within a file."""
    spark.dataSource.register(FastxSource)
    reader = spark.read.format("fastx")
    return (reader.option("layout", "four").option("split", split_bytes) if four_lines else reader).load(path)


def line_modulo(spark: SparkSession, path: str, n: int = 1, split_bytes: int = SPLIT) -> DataFrame:
    """(file, line): of every four lines the one numbered n, from 0: the headers without their @, the bases, or (3) the qualities."""
    name = {0: "header", 1: "seq", 3: "qual"}[n]
    return read_fastq(spark, path, True, split_bytes).select("file", F.col(name).alias("line"))


def _raw(path: str):
    """A file's bytes, with seek: local or shared files directly, others through pyarrow's file systems."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return open(url.path if url.scheme else path, "rb")
    from pyarrow.fs import FileSystem

    fs, name = FileSystem.from_uri(path)
    return io.BufferedReader(fs.open_input_file(name))


def _open(path: str) -> io.TextIOBase:
    """A file's text; .gz, .bz2 and .xz unpacked."""
    unpack = PACKED.get(os.path.splitext(path)[1])
    return io.TextIOWrapper(unpack(_raw(path)) if unpack else _raw(path), encoding="utf-8", newline="\n")


def _size(path: str) -> int:
    with _raw(path) as f:
        return f.seek(0, 2)


def parse(lines: Iterator[str], name: str = "") -> Iterator[tuple[str, str, str | None]]:
    """(header, seq, qual) of FASTA or FASTQ, by the first character; records may take several lines. A
    quality ends where it is as long as the bases, so it may begin with @ or +."""
    lines = (x.rstrip("\r\n") for x in lines)
    line = next((x for x in lines if x), None)
    if line is None:
        return
    if line[0] == ">":
        while line is not None:
            header, parts = line[1:], []
            line = None
            for x in lines:
                if x.startswith(">"):
                    line = x
                    break
                parts.append(x)
            yield header, "".join(parts), None
        return
    while line is not None:
        if not line.startswith("@"):
            raise FastxError(f"{name}: header missing at {line[:40]!r}")
        header, parts = line[1:], []
        for x in lines:
            if x.startswith("+"):
                break
            parts.append(x)
        else:
            raise FastxError(f"{name}: file ends inside record {header!r}")
        seq, qual = "".join(parts), ""
        while len(qual) < len(seq):
            x = next(lines, None)
            if x is None:
                raise FastxError(f"{name}: file ends inside record {header!r}")
            qual += x
        if len(qual) != len(seq):
            raise FastxError(f"{name}: record {header!r} has {len(seq)} bases and {len(qual)} qualities")
        yield header, seq, qual
        line = next((x for x in lines if x), None)


def _first_record(f, start: int, name: str) -> int | None:
    """The byte at which the first four-line record at or after start begins; None if there is none. A line of qualities may begin with @ as
    a header does, but two lines after it stand bases, which don't begin with +."""
    if start == 0:
        return 0
    f.seek(start - 1)
    f.readline()
    at, lines = f.tell(), []
    while len(lines) < 7 and (x := f.readline()):
        lines.append((at, x))
        at = f.tell()
    for (at, head), (_, plus) in zip(lines[:4], lines[2:]):
        if head[:1] == b"@" and plus[:1] == b"+":
            return at
    if len(lines) < 7:
        return None  # the rest of the record before
    raise FastxError(f"{name}: no four-line record at byte {start}")


def four_line_records(f, start: int, end: int, name: str = "") -> Iterator[pa.RecordBatch]:
    """(file, pair, ordinal, mate, header, seq, qual) without file and pair, of the records that begin from start to before end."""
    at = _first_record(f, start, name)
    if at is None or at >= end:
        return
    f.seek(at)
    data = f.read(end - at)
    if not data.endswith(b"\n"):
        data += f.readline()
    lines = data.split(b"\n")
    if not lines[-1]:
        lines.pop()
    while len(lines) % 4:
        x = f.readline()
        if not x:
            # blank lines may follow the last record
            while len(lines) % 4 and not lines[-1].strip():
                lines.pop()
            if len(lines) % 4:
                raise FastxError(f"{name}: file ends inside record {lines[len(lines) // 4 * 4][1:41].decode('utf-8', 'replace')!r}")
            break
        lines.append(x.rstrip(b"\n"))
    begins = at + np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])[:-1:4] if lines else np.zeros(0, np.int64)
    lines = [x.rstrip(b"\r") for x in lines]
    for lo in range(0, len(lines), 4 * ROWS):
        part = lines[lo : lo + 4 * ROWS]
        header, seq, plus, qual = (part[i::4] for i in range(4))
        if not part[-4].strip() and not any(x.strip() for x in part[-4:]):
            header, seq, plus, qual = (x[:-1] for x in (header, seq, plus, qual))
        for h, s, p, q in zip(header, seq, plus, qual):
            if h[:1] != b"@":
                raise FastxError(f"{name}: header missing at {h[:40].decode('utf-8', 'replace')!r}")
            if p[:1] != b"+" or len(s) != len(q):
                raise FastxError(f"{name}: record {h[1:41].decode('utf-8', 'replace')!r} has {len(s)} bases and {len(q)} qualities")
        text = lambda xs: pa.array(xs, pa.binary()).cast(pa.string())
        place = pa.array(begins[lo // 4 : lo // 4 + len(header)], pa.int64())
        yield pa.RecordBatch.from_arrays([place, pa.nulls(len(header), pa.int32()), text([h[1:] for h in header]), text(seq), text(qual)], names=["ordinal", "mate", "header", "seq", "qual"])


class _Files(InputPartition):
    def __init__(self, number: int, paths: tuple[str, ...], start: int = 0, end: int | None = None):
        self.number, self.paths, self.start, self.end = number, paths, start, end


def _listed(path: str) -> list[str]:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        return path.split(",")
    out = []
    for p in (url.path if url.scheme else path).split(","):
        if os.path.isdir(p):
            out += sorted(x for x in glob.glob(os.path.join(p, "*")) if os.path.basename(x)[0] not in "._")
        elif matched := sorted(glob.glob(p)):
            out += matched
        else:
            raise FileNotFoundError(p)
    return out


class FastxSource(DataSource):
    """spark.read.format("fastx").load(path); option path2: the second mates' files, in the same order.
    Option strict: mates of different number are an error; otherwise reading ends with the shorter file.
    Option layout `four`: FASTQ of four lines a record, in ranges of option split bytes."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FastxReader:
        return FastxReader(self.options)


class FastxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.first = _listed(options["path"])
        self.second = _listed(options["path2"]) if options.get("path2") else None
        self.four = options.get("layout") == "four" and self.second is None
        self.split = int(options.get("split", SPLIT))
        self.strict = str(options.get("strict", "false")).lower() == "true"
        if self.second is not None and len(self.first) != len(self.second):
            raise FastxError(f"{len(self.first)} files of first mates and {len(self.second)} of second")

    def partitions(self) -> list[InputPartition]:
        if self.four:
            sizes = [None if os.path.splitext(p)[1] in PACKED else _size(p) for p in self.first]
            cuts = [(i, p, a, None if n is None else min(n, a + self.split)) for i, (p, n) in enumerate(zip(self.first, sizes)) for a in range(0, n or 1, self.split)]
            return [_Files(i, (p,), a, b) for i, p, a, b in cuts]
        return [_Files(i, p) for i, p in enumerate(zip(self.first, self.second) if self.second else ((p,) for p in self.first))]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if part.end is not None:
            with _raw(part.paths[0]) as f:
                for b in four_line_records(f, part.start, part.end, part.paths[0]):
                    own = [pa.array([part.paths[0]] * b.num_rows, pa.string()), pa.array([part.number] * b.num_rows, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*own, *b.columns], names=["file", "pair", *b.schema.names])
            return
        rows, fields = self.rows(part), pa.schema([(n, pa.int32() if n in ("pair", "mate") else pa.int64() if n == "ordinal" else pa.string()) for n in NAMES])
        while held := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)

    def rows(self, part: _Files) -> Iterator[tuple]:
        """Records of one file, or of two in lock-step."""
        if len(part.paths) == 1:
            with _open(part.paths[0]) as f:
                for n, (header, seq, qual) in enumerate(parse(f, part.paths[0])):
                    yield part.paths[0], part.number, n, None, header, seq, qual
            return
        with _open(part.paths[0]) as f, _open(part.paths[1]) as g:
            both = parse(f, part.paths[0]), parse(g, part.paths[1])
            for n in range(1 << 62):
                a, b = (next(x, None) for x in both)
                if a is None or b is None:
                    if self.strict and (a is not None or b is not None):
                        raise FastxError(f"{part.paths[0]} and {part.paths[1]} have different numbers of records")
                    return
                if (a[2] is None) != (b[2] is None):
                    raise FastxError(f"{part.paths[0]} and {part.paths[1]} are of different formats")
                yield part.paths[0], part.number, n, 1, *a
                yield part.paths[1], part.number, n, 2, *b
