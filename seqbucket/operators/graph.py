"""De Bruijn graphs over mers: edges, degrees, and paths collapsed by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbucket.session import materialize, release


def edges(nodes: DataFrame, k: int) -> DataFrame:
    """nodes(kmer), different BIGINT codes -> (src, dst): dst is src without its first base and with one more. Nodes meet where the last k - 1
    bases of one are the first of the other, at most four on either side; each is shuffled once a side."""
    tail = F.col("kmer").bitwiseAND(F.lit((1 << (2 * (k - 1))) - 1))
    ends = nodes.select(F.col("kmer").alias("src"), tail.alias("_core"))
    begins = nodes.select(F.col("kmer").alias("dst"), F.shiftright("kmer", 2).alias("_core"))
    return ends.join(begins, "_core").select("src", "dst")


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(kmer, n_in, n_out) of every node, added up in one shuffle. Links from or to what is no node are left out."""
    flag = lambda c, node, into, out: F.struct(F.col(c).alias("kmer"), F.lit(node).alias("node"), F.lit(into).alias("n_in"), F.lit(out).alias("n_out"))
    ends = links.select(F.explode(F.array(flag("dst", 0, 1, 0), flag("src", 0, 0, 1))).alias("e")).select("e.*")
    rows = ends.unionByName(nodes.select(flag("kmer", 1, 0, 0).alias("e")).select("e.*")).groupBy("kmer")
    return rows.agg(F.sum("node").alias("_n"), F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")).where("_n > 0").select("kmer", "n_in", "n_out")


def path_starts(degree: DataFrame) -> DataFrame:
    """Nodes at which a path begins: one way out, and not just one way in."""
    return degree.where("n_in <> 1 and n_out = 1").select("kmer")


def collapsed_paths(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(start, stop, n_nodes): from each path start along single ways out to the first node without one.
    A walk that never leaves single ways out (it runs into a cycle) has stop null and n_nodes null.

    Each round doubles the length of all walks, so there are about log2(longest path) rounds; when no walk
    from a start has moved, the rest run in cycles."""
    degree = materialize(degrees(nodes, links), "degrees")
    single = degree.where("n_out = 1").select(F.col("kmer").alias("src"))
    hop = materialize(links.join(single, "src", "left_semi").select("src", "dst", F.lit(1).cast("bigint").alias("len")), "hops")
    # walks(start, at, len): at is reached after len steps; a walk whose `at` has no single way out has ended
    walks = path_starts(degree).join(hop, F.col("kmer") == F.col("src")).select(F.col("kmer").alias("start"), F.col("dst").alias("at"), "len")
    walks = materialize(walks, "walks")
    n, steps = nodes.count(), 1
    done = None
    while True:
        open_ = walks.join(hop.select(F.col("src").alias("at"), F.col("dst").alias("_to"), F.col("len").alias("_by")), "at", "left")
        open_ = materialize(open_, "walks")
        ended = open_.where("_to is null").select("start", F.col("at").alias("stop"), (F.col("len") + 1).alias("n_nodes"))
        done = ended if done is None else done.unionByName(ended)
        walks = open_.where("_to is not null").select("start", F.col("_to").alias("at"), (F.col("len") + F.col("_by")).alias("len"))
        if walks.isEmpty():
            return done
        if steps > n:
            return done.unionByName(walks.select("start", F.lit(None).cast("bigint").alias("stop"), F.lit(None).cast("bigint").alias("n_nodes")))
        a, b = hop.alias("a"), hop.alias("b")
        joined = a.join(b, F.col("a.dst") == F.col("b.src"), "left")
        before, hop = hop, materialize(joined.select("a.src", F.coalesce("b.dst", "a.dst").alias("dst"), (F.col("a.len") + F.coalesce("b.len", F.lit(0))).alias("len")), "hops")
        release(before)
        steps *= 2
