"""python -m seqbucket COMMAND: encode, decode, canonicalize, compare, merge, setcover, debruijn.

Each command is a few DataFrame operations on files; errors end with a status other than 0. encode and merge take their files from -i (and -2), or
as read libraries: -l FORMAT begins one, and -1, -2 (first and second mates) and -r (single reads) name its files. encode takes
just one library; merge takes several and leaves those of single reads out."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbucket import __version__
from seqbucket.functions import dna, library
from seqbucket.operators import archive, assign, cover, graph
from seqbucket.operators.kmers import grams
from seqbucket.session import materialize
from seqbucket.sources import fastx, libraries


def load(spark: SparkSession, path: str, path2: str | None = None, strict: bool = False) -> DataFrame:
    """(read_id, ordinal, mate, header, seq, qual); ids number the records in order of the files."""
    spark.dataSource.register(fastx.FastxSource)
    reader = spark.read.format("fastx").option("strict", str(strict).lower())
    df = (reader.option("path2", path2) if path2 else reader).load(path)
    number = F.col("pair").cast("bigint") * (1 << 40) + F.col("ordinal")
    return df.withColumn("seq", dna.ingest(F.col("seq"))).withColumn("read_id", F.when(F.col("mate") == 2, -1 - number).otherwise(number))


def paired(df: DataFrame) -> DataFrame:
    """(header, s1, s2, q1, q2) of mates that were read in lock-step."""
    a = df.where("mate = 1").select("pair", "ordinal", "header", F.col("seq").alias("s1"), F.col("qual").alias("q1"))
    b = df.where("mate = 2").select("pair", "ordinal", F.col("seq").alias("s2"), F.col("qual").alias("q2"))
    return a.join(b, ["pair", "ordinal"])


def encode(spark: SparkSession, path: str, out: str, k: int = assign.K, both: bool = True, path2: str | None = None, lib: str | None = None, strict_length: bool = False) -> None:
    """Reads, or mates merged by their library's orientation, into an archive. Reads shorter than k are an error."""
    kind = library.parse(lib or ("IU" if path2 else "U"))
    rows = load(spark, path, path2)
    if path2:
        rows = paired(rows).select((F.col("pair").cast("bigint") * (1 << 40) + F.col("ordinal")).alias("read_id"), dna.merged(F.col("s1"), F.col("s2"), F.lit(kind[1])).alias("seq"), F.length("s1").alias("len1"))
    else:
        rows = rows.withColumn("len1", F.length("seq"))
    low, high = rows.agg(F.min(F.length("seq")), F.max(F.length("seq"))).first()
    if low is not None and low < k:
        raise ValueError(f"a read has {low} bases, fewer than k = {k}")
    if strict_length and low != high:
        raise ValueError(f"reads have from {low} to {high} bases")
    packed = archive.rotated(rows, assign.popularity(rows.select("read_id", "seq"), k, both), k)
    number = kind[0] | kind[1] << 1 | kind[2] << 3
    archive.write(packed.join(rows.select("read_id", "len1"), "read_id").withColumn("format_id", F.lit(number)), out)


def decode(spark: SparkSession, path: str, out: str) -> None:
    """FASTA, one file folder for single reads, two (out_1, out_2) for mates. A record's name is its place in the archive: reads
    alone in their bucket come first, then the buckets in the order of their keys."""
    rows = spark.read.parquet(path)
    bad = archive.faults(rows).first()
    if bad:
        raise ValueError(f"archive breaks its rule {bad['fault']!r} in read {bad['read_id']}")
    places = archive.placed(rows)
    numbered = archive.ordinals(places, places.groupBy("key").agg(F.count("*").alias("n")))
    back = materialize(numbered.select(F.col("ordinal").cast("string").alias("header"), archive.sequence().alias("seq"), "len1", "format_id"), "decoded")
    kind = library.unpacked(F.col("format_id"))
    if back.where(kind[0] == 1).isEmpty():
        fastx.write_fasta(back, out)
        return
    tail = F.expr("substring(seq, len1 + 1)")
    second = F.when(kind[1].isin(1, 2), dna.revcomp(tail)).otherwise(tail)
    fastx.write_fasta(back.select(F.concat("header", F.lit("/1")).alias("header"), F.expr("substring(seq, 1, len1)").alias("seq")), f"{out}_1")
    fastx.write_fasta(back.select(F.concat("header", F.lit("/2")).alias("header"), second.alias("seq")), f"{out}_2")


def canonicalize(df: DataFrame, compat: bool = False) -> DataFrame:
    """(header, seq, qual) in order of the canonical sequence, N as A; qualities turn with their bases unless compat."""
    turned = dna.revcomp(F.col("seq")) < F.col("seq")
    qual = F.col("qual") if compat else F.when(turned, F.reverse("qual")).otherwise(F.col("qual"))
    return df.select("header", dna.n_to_a(dna.canonical(F.col("seq"))).alias("seq"), qual.alias("qual")).orderBy("seq")


def canonical_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(canon, n_a, n_b) where two read sets differ as multisets of canonical sequences."""
    both = a.select(dna.canonical(F.col("seq")).alias("canon"), F.lit(0).alias("s")).unionByName(b.select(dna.canonical(F.col("seq")).alias("canon"), F.lit(1).alias("s")))
    return both.groupBy("canon").agg(F.count_if(F.col("s") == 0).alias("n_a"), F.count_if(F.col("s") == 1).alias("n_b")).where("n_a <> n_b")


def _save(df: DataFrame, out: str) -> None:
    """FASTQ where all records have qualities as long as their bases, else FASTA."""
    plain = df.where("qual is null or length(qual) <> length(seq)").isEmpty()
    (fastx.write_fastq if plain else fastx.write_fasta)(df, out)


def merged(spark: SparkSession, path: str, path2: str, lib: str | None = None) -> DataFrame:
    """(header, seq, qual) of mates as one read each, by their library's orientation."""
    orient = library.parse(lib or "IU")[1]
    qual = F.concat("q1", F.when(F.lit(orient).isin(1, 2), F.reverse("q2")).otherwise(F.col("q2")))
    return paired(load(spark, path, path2)).select("header", dna.merged(F.col("s1"), F.col("s2"), F.lit(orient)).alias("seq"), qual.alias("qual"))


class _Files(argparse.Action):
    """Keeps the options of libraries in the order in which they are given."""

    def __call__(self, parser: argparse.ArgumentParser, namespace: argparse.Namespace, values: object, option: str | None = None) -> None:
        given = values if isinstance(values, list) else [values]
        namespace.libraries = [*(namespace.libraries or []), (option.lstrip("-")[0], given)]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqbucket", description=__doc__)
    p.add_argument("-v", "--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("encode", "decode", "canonicalize", "compare", "merge", "setcover", "debruijn"):
        c = sub.add_parser(name)
        libs = name in ("encode", "merge")
        c.add_argument("-i", "--input", required=not libs)
        if name == "compare":
            c.add_argument("-2", "--input2", required=True)
        else:
            c.add_argument("-o", "--output", required=True)
        if libs:
            c.add_argument("-l", "--library", dest="libraries", action=_Files, choices=sorted(library.FORMATS), type=str.upper)
            for option in ("-1", "-2", "-r"):
                c.add_argument(option, dest="libraries", action=_Files, nargs="+", metavar="FILE")
        if name in ("encode", "setcover", "debruijn"):
            c.add_argument("-b", "--bucket", type=int, default=assign.K, choices=range(1, 32), metavar="K")
        if name == "encode":
            c.add_argument("-n", "--norc", action="store_true")
    return p


def read_libraries(a: argparse.Namespace) -> list[libraries.ReadLibrary]:
    """The libraries of the options; -i counts as the files of first mates where -2 is given, else of single reads."""
    given = list(a.libraries or [])
    if a.input:
        given.append(("1" if any(n == "2" for n, _ in given) else "r", a.input.split(",")))
    return libraries.from_options(given)


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"seqbucket {a.command}").getOrCreate()
    try:
        if a.command == "encode":
            lib = libraries.only(read_libraries(a))
            encode(spark, ",".join(lib.first or lib.unmated), a.output, a.bucket, not a.norc, ",".join(lib.second) or None, lib.format_name)
        elif a.command == "decode":
            decode(spark, a.input, a.output)
        elif a.command == "canonicalize":
            _save(canonicalize(load(spark, a.input)), a.output)
        elif a.command == "compare":
            first = canonical_diff(load(spark, a.input), load(spark, a.input2)).first()
            if first:
                print(f"differ: {first['canon']} stands {first['n_a']} times in the first, {first['n_b']} in the second", file=sys.stderr)
                return 1
        elif a.command == "merge":
            parts = [merged(spark, ",".join(x.first), ",".join(x.second), x.format_name) for x in libraries.paired(read_libraries(a))]
            if not parts:
                raise ValueError("no library of mates to merge")
            _save(reduce(DataFrame.unionByName, parts), a.output)
        elif a.command == "setcover":
            assign.named(cover.set_cover(cover.postings(load(spark, a.input), a.bucket)), a.bucket).write.parquet(a.output)
        else:
            nodes = grams(load(spark, a.input), "read_id", "seq", a.bucket, n_as_a=False).select(F.col("gram").alias("kmer")).distinct()
            graph.collapsed_paths(nodes, graph.edges(nodes, a.bucket)).write.parquet(a.output)
    except (ValueError, FileNotFoundError) as e:
        print(f"seqbucket: {e}", file=sys.stderr)
        return 2
    return 0
