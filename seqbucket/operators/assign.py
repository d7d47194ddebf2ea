"""Data-dependent bucketing of reads: each read goes to one of its mers.

popularity: to the mer that most reads hold; free of order, one count and one lookup.
overlap: rounds on top of it that move a read to the bucket whose other members share most 8-mers with it.
sequential: reads in order of id against the buckets so far, over all reads, exactly, in rounds of joins.
Ties go to the smallest key everywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbucket.functions import dna
from seqbucket.functions.kmer import code_mer
from seqbucket.operators import blocks
from seqbucket.operators.kmers import best_known, candidate_counts, candidates, held_grams, slices, smallest
from seqbucket.operators.skew import SMALL, dense_codes, salted_lookup, written_lookup
from seqbucket.session import materialize, release

K, GRAM = 15, 8


def shared_mers(reads: DataFrame, k: int = K, both: bool = True) -> DataFrame:
    """(key, pop): the mers that several reads hold, on either strand with both, and how many do."""
    return materialize(candidate_counts(reads, "read_id", "seq", k, both).groupBy("key").agg(F.sum("n").alias("pop")).where("pop > 1"), "popularity")


def popularity(reads: DataFrame, k: int = K, both: bool = True, shared: DataFrame | None = None) -> DataFrame:
    """reads(read_id, seq) -> (read_id, key, off, rc): of the mers of a read the one that most reads hold,
    on either strand. Reads shorter than k are left out. shared: shared_mers of these reads, if they are at hand."""
    shared = shared_mers(reads, k, both) if shared is None else shared
    if shared.count() <= SMALL:
        # a written table of a checked size: reads look it up where they are cut into mers, and nothing is shuffled
        table = shared.orderBy("key").toArrow()
        known = reads.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("key", "pop")))
        return best_known(reads, "read_id", "seq", known, k, both)
    # a mer of one read only can win only as the smallest of a read that shares none
    hits = salted_lookup(candidates(reads, "read_id", "seq", k, both), shared, "key", "pop", "read_id").select("read_id", "key", "off", "rc", "pop")
    lone = smallest(reads, "read_id", "seq", k, both).withColumn("pop", F.lit(1).cast("bigint"))
    best = F.max_by(F.struct("key", "off", "rc"), F.struct(F.col("pop"), -F.col("key"), -F.col("off")))
    return hits.unionByName(lone).groupBy("read_id").agg(best.alias("b")).select("read_id", "b.key", "b.off", "b.rc")


def stored(reads: DataFrame, assigned: DataFrame) -> DataFrame:
    """Adds to assigned the sequence as its bucket holds it (turned, N as A: f) and the places of N in it."""
    turned = F.when(F.col("rc") == 1, dna.revcomp(F.col("seq"))).otherwise(dna.normalize(F.col("seq")))
    return assigned.join(reads.select("read_id", "seq"), "read_id").withColumn("seq", turned).withColumn("f", dna.n_to_a(F.col("seq")))


def bucket_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("key").agg(F.count("*").alias("n"))


def onsies(assigned: DataFrame) -> DataFrame:
    """Reads that are alone in their bucket. Counted map-side; no bucket is gathered."""
    lone = assigned.groupBy("key").agg(F.count("*").alias("n"), F.min("read_id").alias("read_id")).where("n = 1")
    return assigned.join(lone.select("read_id"), "read_id", "left_semi")


def without_onsies(assigned: DataFrame) -> DataFrame:
    lone = assigned.groupBy("key").agg(F.count("*").alias("n"), F.min("read_id").alias("read_id")).where("n = 1")
    return assigned.join(lone.select("read_id"), "read_id", "left_anti")


def bucket_model(reads: DataFrame, assigned: DataFrame) -> DataFrame:
    """(key, gram, n): the 8-mers of each bucket's stored reads, and how many of its reads hold them. A read's 8-mers carry
    their bucket and are made different in its task, so there is one shuffle."""
    held = stored(reads, assigned)
    return held_grams(held.select("key", "f"), "key", "f", GRAM).groupBy("key", "gram").agg(F.count("*").alias("n"))


def overlap_scores(reads: DataFrame, assigned: DataFrame | None = None, k: int = K, alone: bool = False) -> DataFrame:
    """(read_id, key, off, rc, score): for each candidate bucket that another read is in, the places of the
    read, in the candidate's direction, whose 8-mer another read of the bucket holds. assigned (None: by popularity) has each read in one
    of its candidates, equal reads in the same. alone: only of reads that are alone in their bucket."""
    held = blocks.popular(blocks.pack(reads, k), k) if assigned is None else blocks.pack(reads, k, assigned)
    return blocks.scores(held, k, GRAM, alone)


def overlap(reads: DataFrame, k: int = K, rounds: int = 1, movers: str = "all") -> DataFrame:
    """(read_id, key, off, rc) after rounds of moving reads to the bucket of the highest score; a read
    without any score above 0 stays. movers `onsies` moves only reads that are alone."""
    held = blocks.popular(blocks.pack(reads, k), k)
    best = F.max_by(F.struct("key", "off", "rc"), F.struct(F.col("score"), -F.col("key")))
    for i in range(rounds):
        # where a read is now scores 0, below any bucket that it may move to
        all_ = blocks.members(held).withColumn("score", F.lit(0).cast("bigint")).unionByName(blocks.scores(held, k, GRAM, movers == "onsies"))
        now = materialize(all_.groupBy("read_id").agg(best.alias("b")).select("read_id", "b.*"), "assigned")
        held = blocks.pack(reads, k, now) if i + 1 < rounds else held
    return now if rounds else blocks.members(held)


#: Reads of a bucket that one task works on in order.
IN_ORDER = 20_000


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, member, seq), sorted by key and block -> the set of 8-mers that each block's members hold, as bits; none is an empty set."""
    bits, at = np.zeros(1 << 2 * GRAM, bool), None

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["key", "block", "bits"])

    for b in batches:
        for key, block, member, held in zip(*(b.column(i).to_pylist() for i in range(3)), slices(b.column(3).to_pylist(), GRAM)):
            if (key, block) != at:
                if at is not None:
                    yield close()
                bits[:], at = False, (key, block)
            if member:
                bits[held] = True
    if at is not None:
        yield close()


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of blocks, sorted by key and block -> for each block after the first the set of all before it."""
    sums, at = np.zeros(1 << 2 * GRAM - 3, np.uint8), None
    for b in batches:
        out = []
        for key, block, bits in zip(*(c.to_pylist() for c in b.columns)):
            if key != at:
                sums, at = np.zeros_like(sums), key
            out.append((key, block, sums.tobytes()))
            sums = sums | np.frombuffer(bits, np.uint8)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], names=["key", "block", "bits"])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, block, read_id, member, seq, bits), sorted by the first three -> (key, read_id, score) above 0: the
    places of seq whose 8-mer an earlier member of the bucket holds. A row with bits tells what the blocks before hold. Only one bucket's 8-mers are held."""
    model, now, some = np.zeros(1 << 2 * GRAM, bool), None, False
    for b in batches:
        keys, blocks, ids, member, seqs, bits = (c.to_pylist() for c in b.columns)
        score = np.zeros(len(keys), np.int64)
        for i, (at, held) in enumerate(zip(zip(keys, blocks), slices([s or "" for s in seqs], GRAM))):
            if at != now:
                if some:
                    model[:] = False
                now, some = at, False
            if bits[i] is not None:
                model[:], some = np.unpackbits(np.frombuffer(bits[i], np.uint8)).astype(bool), True
                continue
            if some:
                score[i] = np.count_nonzero(model[held])
            if member[i] and score[i] < len(held):
                model[held], some = True, True
        hit = np.flatnonzero(score)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in hit], pa.int64()) for c in (keys, ids, score.tolist())], names=["key", "read_id", "score"])


def _scores(asked: DataFrame, hot: bool) -> DataFrame:
    """asked(key, block, read_id, member, seq) -> (key, read_id, score). hot: some buckets have several blocks, which are worked on at once: first what
    each holds, then what those before it hold, a set of fixed size a block, then the scores."""
    none = F.lit(None)
    rows = asked.withColumn("bits", none.cast("binary"))
    if hot:
        spread = lambda df, *by: df.repartition(*by).sortWithinPartitions("key", "block")
        kind = "key long, block long, bits binary"
        several = asked.where("block > 0").select("key").distinct()
        parts = asked.join(several, "key", "left_semi").select("key", "block", "member", "seq")
        sums = spread(spread(parts, "key", "block").mapInArrow(_held, kind), "key").mapInArrow(_before, kind)
        rows = rows.unionByName(sums.select("key", "block", F.lit(-(1 << 63)).alias("read_id"), F.lit(False).alias("member"), none.cast("string").alias("seq"), "bits"))
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "read_id").mapInArrow(_scored, "key long, read_id long, score long")


def in_blocks(pairs: DataFrame, sizes: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """Adds block, from 0 in the order of read_id in each key, and tells whether a key has several: only keys of more than `most` rows are
    numbered, by ranges. sizes(key, n): the rows of each key."""
    large = materialize(sizes.where(F.col("n") > most), "large")
    whole = pairs.withColumn("block", F.lit(0).cast("bigint"))
    if large.isEmpty():
        return whole, False
    order = ["key", "read_id"]
    coded = dense_codes(written_lookup(pairs, large, "key", "n", "read_id").drop("n").repartitionByRange(*order).sortWithinPartitions(*order))
    first = materialize(coded.groupBy("key").agg(F.min("code").alias("_first"), F.count("*").alias("n")), "first")
    found = written_lookup(coded, first, "key", "n", "read_id")
    cut = found.withColumn("block", F.floor((F.col("code") - F.col("_first")) / most)).select(*pairs.columns, "block")
    return whole.join(large.select("key"), "key", "left_anti").unionByName(cut.select(whole.columns)), True


def sequential(reads: DataFrame, k: int = K, in_order: int = IN_ORDER) -> DataFrame:
    """(read_id, key, off, rc) by the sequential rule over all reads: a read goes to the candidate bucket, made by earlier
    reads, with the highest overlap, else to its smallest key.

    A read's bucket is a function of the buckets of reads before it. Each round works out all reads against the
    buckets of the round before; where nothing changes, the result is that of the sequential rule, the only
    one that fits itself. The first read is right from the first round on and each round makes at least one more
    right, so rounds end; they are as many as the longest chain of reads of which each changes the next. A round
    scores only buckets that reads came to or left, in blocks of in_order reads, so a bucket that a third of all reads may go to is spread. Only the smallest key of a read opens a bucket, so other
    keys, and reads before the first that could open, are never looked at."""
    spark = reads.sparkSession
    low = materialize(smallest(reads, "read_id", "seq", k), "smallest")
    opened = low.groupBy("key").agg(F.count("*").alias("n"), F.min("read_id").alias("opener"))
    pairs = salted_lookup(candidates(reads, "read_id", "seq", k), opened, "key", "n", "read_id").where("opener <= read_id").select("read_id", "key", "off", "rc")
    pairs = materialize(pairs, "pairs")
    several = materialize(pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "several")
    pairs = salted_lookup(pairs, several, "key", "n", "read_id").drop("n")
    turned = F.when(F.col("rc") == 1, dna.revcomp(F.col("seq"))).otherwise(dna.normalize(F.col("seq")))
    pairs, hot = in_blocks(pairs.join(reads.select("read_id", "seq"), "read_id").withColumn("seq", dna.n_to_a(turned)), several, in_order)
    pairs = materialize(pairs, "pairs")
    asked = pairs.select("read_id").distinct()
    now = materialize(low.select("read_id", "key").join(asked, "read_id", "left_semi"), "assigned")
    scores = spark.createDataFrame([], "key long, read_id long, score long")
    moved = pairs.select("key").distinct()
    before: list[DataFrame] = []
    while True:
        at = F.coalesce(F.col("key") == F.col("_at"), F.lit(False)).alias("member")
        again = pairs.join(moved, "key", "left_semi").join(now.select("read_id", F.col("key").alias("_at")), "read_id").select("key", "block", "read_id", at, "seq")
        fresh = _scores(again, hot)
        old, scores = scores, materialize(scores.join(moved, "key", "left_anti").unionByName(fresh), "scores")
        top = scores.groupBy("read_id").agg((-F.max(F.struct("score", (-F.col("key")).alias("neg")))["neg"]).alias("_to"))
        first = low.select("read_id", F.col("key").alias("_low"))
        next_ = now.join(first, "read_id").join(top, "read_id", "left").select("read_id", F.coalesce("_to", "_low").alias("key"), F.col("key").alias("was"))
        next_ = materialize(next_, "assigned")
        changed = next_.where("key <> was")
        if changed.isEmpty():
            break
        moved = materialize(changed.select(F.explode(F.array("key", "was")).alias("key")).distinct(), "moved")
        now = next_.select("read_id", "key")
        release(*before)
        before = [old, next_]
    places = pairs.select("read_id", "key", "off", "rc").unionByName(low.select("read_id", "key", "off", "rc")).distinct()
    return places.join(now, ["read_id", "key"]).unionByName(low.join(asked, "read_id", "left_anti").select("read_id", "key", "off", "rc"))


def named(assigned: DataFrame, k: int = K, key: str = "key") -> DataFrame:
    """Keys as strings."""
    return assigned.withColumn(key, code_mer(F.col(key), k))
