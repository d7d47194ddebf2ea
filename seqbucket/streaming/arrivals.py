"""Reads that arrive as a stream: counts per time window and mer counts, kept up by Structured Streaming.

The stream's source are Parquet files with the columns of `reads`. Late rows are counted as long
as the watermark lets them in; a window's state is dropped once the watermark has passed it, so state is bounded by the windows that are still open. Mers
are too many for a state with a row for each: a batch's counts are kept packed, without any state, and added up over the batches when they are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seqbucket.functions import dna
from seqbucket.operators import blocks
from seqbucket.operators.kmers import _CODE, _places, _rolled
from seqbucket.operators.skew import written_lookup
from seqbucket.session import materialize, ship


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """path: a folder, or a single file, which a stream only takes as a pattern."""
    ship(spark)
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def _timed(stream: DataFrame, late: str) -> DataFrame:
    return stream.where("loaded_at is not null").withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withWatermark("loaded_at", late)


def window_counts(stream: DataFrame, width: str = "1 day", late: str = "30 days") -> DataFrame:
    """(window_start, run_no, n, n_bases): deliveries and their bases per window of loaded_at and run. A null
    loaded_at is in no window; a null seq counts with 0 bases."""
    counts = _timed(stream, late).groupBy(F.window("loaded_at", width).alias("w"), "run_no").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("seq"), F.lit(0))).alias("n_bases"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "run_no", "n", "n_bases")


def mer_counts(stream: DataFrame, k: int = 15, width: str = "1 day") -> DataFrame:
    """(window_start, k, n, packed): packed counts of the mers of all deliveries per window of loaded_at, n mers in each; run_to_end adds them up. Nothing is
    too late, as there is no state that it could come too late for."""
    most = blocks.BASES
    rows = stream.where("loaded_at is not null and seq is not null").withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    rows = rows.select(F.window("loaded_at", width)["start"].cast("timestamp_ntz").alias("window_start"), dna.ingest(F.col("seq")).alias("seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: list[np.ndarray] = []
        texts: list[str] = []
        bases = 0

        def close() -> Iterator[pa.RecordBatch]:
            at = np.concatenate(starts)
            codes = _CODE[np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8)]
            begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            place, owner = _places(begins, len(codes) - k + 1, k)
            bad = np.concatenate([[0], np.cumsum(codes > 3)])
            known = bad[place + k] == bad[place]
            place, owner = place[known], owner[known]
            numbers = blocks.mixed(_rolled(np.where(codes < 4, codes, 0), k)[place], k)
            windows, which = np.unique(at, return_inverse=True)
            by = np.argsort(which[owner], kind="stable") if len(windows) > 1 else slice(None)
            parts = np.split(numbers[by], np.cumsum(np.bincount(which[owner], minlength=len(windows)))[:-1])
            for window, part in zip(windows, parts):
                if len(part):
                    part = np.sort(part)
                    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                    packed = blocks.counted(part[first], np.diff(np.concatenate([first, [len(part)]])))
                    columns = [pa.array([window], pa.timestamp("us")), pa.array([k], pa.int32()), pa.array([len(first)], pa.int64()), pa.array([packed], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["window_start", "k", "n", "packed"])

        for b in batches:
            for c in range(0, b.num_rows, 10_000):
                some = b.slice(c, 10_000)
                starts.append(some.column(0).to_numpy(zero_copy_only=False).astype("datetime64[us]"))
                texts += some.column(1).to_pylist()
                bases += sum(map(len, texts[-some.num_rows :]))
                if bases >= most:
                    yield from close()
                    starts, texts, bases = [], [], 0
        if texts:
            yield from close()

    return rows.mapInArrow(run, "window_start timestamp_ntz, k int, n long, packed binary")


def _added_up(packed: DataFrame) -> DataFrame:
    """Packed counts of mers -> (window_start, gram, n). A window is split into ranges of numbers by how many mers it has, so a task holds one range,
    and its counts cross the shuffle packed."""
    span = blocks.RANGE
    totals = materialize(packed.groupBy("window_start").agg(F.sum("n").alias("total"), F.count("*").alias("rows")), "totals")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (k, data, total) in enumerate(zip(*(b.column(j).to_pylist() for j in (1, 2, 3)))):
                numbers, n = blocks.recounted(data)
                bits = min(max(total // span, 1).bit_length(), 2 * k)
                borders = np.searchsorted(numbers, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(2 * k - bits))
                parts = [blocks.counted(x, y) for x, y in zip(np.split(numbers, borders), np.split(n, borders)) if len(x)]
                ranges = np.flatnonzero(np.diff(np.concatenate([[0], borders, [len(numbers)]])))
                start = pa.array([b.column(0)[i].as_py()] * len(parts), pa.timestamp("us"))
                columns = [start, pa.array([k] * len(parts), pa.int32()), pa.array(ranges, pa.int32()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["window_start", "k", "range", "packed"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            (window, k, _), parts = at, [blocks.recounted(x) for x in held]
            numbers, n = (np.concatenate(c) for c in zip(*parts))
            if len(parts) > 1:
                order = np.argsort(numbers)
                numbers = numbers[order]
                first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
                numbers, n = numbers[first], np.add.reduceat(n[order], first)
            for i in range(0, len(numbers), 100_000):
                text = _letters(blocks.unmixed(numbers[i : i + 100_000], k), k)
                size = len(text)
                grams = pa.StringArray.from_buffers(size, pa.py_buffer(np.arange(0, (size + 1) * k, k, dtype=np.int32)), pa.py_buffer(text.ravel()))
                start = pa.array(np.full(size, np.datetime64(window, "us")), pa.timestamp("us"))
                yield pa.RecordBatch.from_arrays([start, grams, pa.array(n[i : i + 100_000], pa.int64())], names=["window_start", "gram", "n"])

        for b in batches:
            for *key, data in zip(*(c.to_pylist() for c in b.columns)):
                if key != at:
                    if held:
                        yield from close()
                    at, held = key, []
                held.append(data)
        if held:
            yield from close()

    rows = written_lookup(packed, totals, "window_start", "rows", "packed").select("window_start", "k", "packed", "total")
    ranges = rows.mapInArrow(cut, "window_start timestamp_ntz, k int, range int, packed binary")
    by = ("window_start", "k", "range")
    return ranges.repartition(*by).sortWithinPartitions(*by).mapInArrow(add, "window_start timestamp_ntz, gram string, n long")


def _letters(mers: np.ndarray, k: int) -> np.ndarray:
    """The mers' letters, a row of k bytes each."""
    five = np.frombuffer(b"ACGT", np.uint8)[np.arange(1024)[:, None] >> np.arange(8, -1, -2) & 3]
    out = np.empty((len(mers), k), np.uint8)
    for end in range(k, 0, -5):
        out[:, max(end - 5, 0) : end] = five[mers >> 2 * (k - end) & 1023][:, max(5 - end, 0) :]
    return out


def run_to_end(counts: DataFrame, out: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Runs the stream over all that is there and reads its results. A batch gives only the groups that it changed (mode update), which go to a folder of the
    batch, so nothing already written is written again; of each group, by keys, the latest batch's row counts, while packed counts of mers are added up. A batch
    that is run again after a failure replaces its folder. The checkpoint lets a later run go on where this one ended."""

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return latest(counts.sparkSession, out, keys, counts)


def latest(spark: SparkSession, out: str, keys: list[str], like: DataFrame) -> DataFrame:
    """The current row of each group, from the batches written so far; of packed counts their sums."""
    rows = spark.read.schema(StructType([*like.schema.fields, StructField("batch", LongType())])).parquet(out)
    if "packed" in like.columns:
        return _added_up(rows.drop("batch"))
    rest = [c for c in like.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*").select(*like.columns)
