"""Read libraries: a format with its files, checked before anything is read; and listings of files by size."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbucket.functions import library
from seqbucket.sources.fastx import PACKED, FastxSource

EXTENSIONS = (".fa", ".fq", ".fasta", ".fastq")


@dataclass
class ReadLibrary:
    name: str | None = None
    first: list[str] = field(default_factory=list)
    second: list[str] = field(default_factory=list)
    unmated: list[str] = field(default_factory=list)

    @property
    def format_name(self) -> str:
        return (self.name or ("IU" if self.first or self.second else "U")).upper()

    def faults(self) -> list[str]:
        """What is wrong with the library, in words; nothing if it can be read."""
        out = []
        paired = library.parse(self.format_name)[0] == 1
        if paired and (not self.first or len(self.first) != len(self.second)):
            out.append(f"{self.format_name} needs as many first as second files: {len(self.first)}, {len(self.second)}")
        if paired == bool(self.unmated):
            out.append(f"{self.format_name} {'takes no' if paired else 'needs'} files of single reads")
        for path in [*self.first, *self.second, *self.unmated]:
            base, ext = os.path.splitext(path.lower())
            if ext in PACKED:
                ext = os.path.splitext(base)[1]
            if ext not in EXTENSIONS:
                out.append(f"{path}: the name ends with none of {', '.join(EXTENSIONS)}")
            if "://" not in path and not os.path.isfile(path):
                out.append(f"{path}: no such file")
        return out

    def __str__(self) -> str:
        return f"{self.format_name}: " + (", ".join(f"({a}, {b})" for a, b in zip(self.first, self.second)) or ", ".join(self.unmated))

    def load(self, spark: SparkSession) -> DataFrame:
        if wrong := self.faults():
            raise ValueError("; ".join(wrong))
        spark.dataSource.register(FastxSource)
        reader = spark.read.format("fastx")
        df = reader.option("path2", ",".join(self.second)).load(",".join(self.first)) if self.first else reader.load(",".join(self.unmated))
        return df.withColumn("lib_name", F.lit(self.format_name))


def from_options(options: list[tuple[str, list[str]]]) -> list[ReadLibrary]:
    """Libraries from pairs (option, values) in the order given: `l` begins a library, to which the file
    options 1, 2 and r after it belong; a repeated file option replaces its files. Libraries without files
    are left out."""
    out = [ReadLibrary()]
    for name, values in options:
        if name == "l":
            library.parse(values[0])
            out.append(ReadLibrary(values[0]))
        else:
            setattr(out[-1], {"1": "first", "2": "second", "r": "unmated"}[name], list(values))
    return [x for x in out if x.first or x.second or x.unmated]


def listing(spark: SparkSession, folder: str, pattern: str = ".*") -> DataFrame:
    """(path, name, length) of the files below a folder whose name matches; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), "length").where(F.col("name").rlike(pattern))


def only(libraries: list[ReadLibrary]) -> ReadLibrary:
    """The one library of the options; none or several are an error."""
    if len(libraries) != 1:
        raise ValueError(f"just one read library is taken, not {len(libraries)}")
    return checked(libraries)[0]


def paired(libraries: list[ReadLibrary]) -> list[ReadLibrary]:
    """The libraries of mates; those of single reads are left out."""
    return checked([x for x in libraries if library.parse(x.format_name)[0] == 1])


def checked(libraries: list[ReadLibrary]) -> list[ReadLibrary]:
    if wrong := [w for x in libraries for w in x.faults()]:
        raise ValueError("; ".join(wrong))
    return libraries
