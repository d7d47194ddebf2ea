"""Queries of the read operators over the tables, beside their SQL.

Reads are taken once per read_id, in upper case and without white space; null and empty seq are left out.
A mate without a library counts as IU, a single read as U."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqbucket import cli
from seqbucket.functions import dna, library
from seqbucket.functions.kmer import code_mer, mer_key
from seqbucket.operators import archive, assign, cover, graph, partition
from seqbucket.operators.kmers import candidates, grams, read_mers
from seqbucket.operators.skew import dense_codes
from seqbucket.plans.problems import KEY_SQL
from seqbucket.session import materialize, scratch, table
from seqbucket.sources import fastx
from seqbucket.streaming import arrivals

K = assign.K
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ---- shared SQL -----------------------------------------------------------------------------------------

NORM = "regexp_replace({0}, '[^ACGT]', 'N', 'g')"
RC = "reverse(translate(regexp_replace({0}, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"
READS = """r AS (SELECT DISTINCT read_id, run_no, upper(lib_name) AS lib, ordinal, mate, header, upper(regexp_replace(seq, '\\s', '', 'g')) AS seq, qual FROM reads WHERE seq IS NOT NULL),
s AS (SELECT * FROM r WHERE seq <> '')"""
FORMS = f"{READS}, n AS (SELECT read_id, {NORM.format('seq')} AS u, {RC.format('seq')} AS v, replace({NORM.format('seq')}, 'N', 'A') AS f, replace({RC.format('seq')}, 'N', 'A') AS r, length(seq) AS l FROM s)"
CANDS = f"""{FORMS},
o AS (SELECT *, unnest(range(0, greatest(l - {K - 1}, 0))) AS p FROM n),
c AS (SELECT read_id, substr(f, p + 1, {K}) AS key, p AS off, CAST(0 AS BIGINT) AS rc, 2 * p AS scan FROM o
  UNION ALL SELECT read_id, substr(r, l - {K} - p + 1, {K}), l - {K} - p, 1, 2 * p + 1 FROM o),
one AS (SELECT read_id, key, arg_min(off, scan) AS off, arg_min(rc, scan) AS rc FROM c GROUP BY read_id, key)"""
ASSIGNED = f"""{CANDS},
pop AS (SELECT key, count(*) AS pop FROM one GROUP BY key),
asg AS (SELECT read_id, key, off, rc FROM (SELECT one.*, row_number() OVER (PARTITION BY read_id ORDER BY pop DESC, key) AS rn FROM one JOIN pop USING (key)) WHERE rn = 1)"""
ROTATED = f"""{ASSIGNED},
st AS (SELECT asg.read_id, key, off, rc, CASE rc WHEN 1 THEN r ELSE f END AS f, CASE rc WHEN 1 THEN v ELSE u END AS u FROM asg JOIN n USING (read_id)),
rot AS (SELECT *, substr(f, off + {K} + 1) || substr(f, 1, off) AS body FROM st)"""
PLACED = f"{ROTATED}, pl AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY off, body, read_id) - 1 AS pos FROM rot), ch AS (SELECT *, pos // 256 AS sub_id FROM pl)"
PAIRS = f"""{READS}, p AS (SELECT a.run_no, a.ordinal, coalesce(a.lib, 'IU') AS lib, a.read_id AS id1, b.read_id AS id2, a.header AS h1, a.seq AS s1, b.seq AS s2, a.qual AS q1, b.qual AS q2
  FROM s a JOIN s b ON a.run_no = b.run_no AND a.ordinal = b.ordinal AND a.mate = 1 AND b.mate = 2),
pf AS (SELECT p.*, orientation FROM p JOIN libformats ON lib = lib_name)"""
MERGED = f"{NORM.format('s1')} || CASE WHEN orientation IN (1, 2) THEN {RC.format('s2')} ELSE {NORM.format('s2')} END"
GRAPH = f"""{READS}, w AS (SELECT seq, unnest(range(1, greatest(length(seq) - {K - 2}, 1))) AS i FROM s),
mers AS (SELECT substr(seq, i, {K}) AS kmer FROM w WHERE regexp_full_match(substr(seq, i, {K}), '[ACGT]*')),
nodes AS (SELECT DISTINCT kmer FROM mers),
edges AS (SELECT a.kmer AS src, b.kmer AS dst FROM nodes a JOIN nodes b ON substr(a.kmer, 2) = substr(b.kmer, 1, {K - 1})),
deg AS (SELECT kmer, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out FROM nodes LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON i.dst = kmer LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = kmer)"""
LCP = "coalesce(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: substr({0}, i, 1) <> substr({1}, i, 1))[1] - 1, least(length({0}), length({1})))"
HEX = """CASE WHEN {0} = '' THEN '' ELSE array_to_string(list_transform(range(0, CAST(ceil(length({0}) / 4.0) AS BIGINT)), lambda g: printf('%02X',
  CAST(list_sum(list_transform(range(0, 4), lambda j: greatest(strpos('AGCT', substr({0} || 'AAA', g * 4 + j + 1, 1)) - 1, 0) * CAST(power(4, j) AS BIGINT))) AS BIGINT))), '') END"""


def query(sql: str | None = None) -> Callable:
    """Registers a query with its SQL, which may begin with the names of shared parts."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- shared views ---------------------------------------------------------------------------------------


def delivered(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """read_id, seq and the columns asked for, of all deliveries."""
    t = table(spark, d, "reads").where("seq is not null").withColumn("lib", F.upper("lib_name"))
    return t.select("read_id", dna.ingest(F.col("seq")).alias("seq"), *more)


def all_reads(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """read_id, seq and the columns asked for, once per read: a redelivered row repeats all of them, so only these columns are read
    and made distinct. lib is lib_name in upper case."""
    return delivered(spark, d, *more).distinct()


def reads(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return all_reads(spark, d, *more).where("seq <> ''")


def seqs(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d)


def kept(spark: SparkSession, d: str) -> DataFrame:
    """seqs, for operators that read them several times."""
    return materialize(seqs(spark, d), "reads")


def assigned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = kept(spark, d)
    return rows, assign.popularity(rows)


def rotated(spark: SparkSession, d: str) -> DataFrame:
    return archive.rotated(*assigned(spark, d))


def pairs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Mates of one run and ordinal; more: `header` of the first (h1), `qual` of both (q1, q2)."""
    r = reads(spark, d, "run_no", "ordinal", "mate", "lib", *more)
    names = [n for n in ("seq", "qual", "header") if n == "seq" or n in more]
    a = r.where("mate = 1").select("run_no", "ordinal", F.coalesce("lib", F.lit("IU")).alias("lib"), F.col("read_id").alias("id1"), *(F.col(n).alias(f"{n[0]}1") for n in names))
    b = r.where("mate = 2").select("run_no", "ordinal", F.col("read_id").alias("id2"), *(F.col(n).alias(f"{n[0]}2") for n in names if n != "header"))
    return a.join(b, ["run_no", "ordinal"]).withColumn("orientation", library.orientation(F.col("lib")))


def graph_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All different mers, and their edges."""
    nodes = materialize(grams(seqs(spark, d), "read_id", "seq", K, n_as_a=False).select(F.col("gram").alias("kmer")).distinct(), "nodes")
    return nodes, graph.edges(nodes, K)


def ranked(rows: DataFrame, *by: str) -> DataFrame:
    """rank in the order of `by`, from 1: ranges are sorted and numbered, no window over all rows."""
    return dense_codes(rows.repartitionByRange(*by).sortWithinPartitions(*by)).withColumn("rank", F.col("code") + 1)


def per_read(f: Callable[[Column], Column], sql: str, name: str) -> None:
    """A query (read_id, v) of a scalar function of seq."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return seqs(spark, d).select("read_id", f(F.col("seq")).alias("v"))

    run.__name__ = name
    query(f"WITH {FORMS} SELECT s.read_id, {sql} AS v FROM s JOIN n USING (read_id)")(run)


# ---- scalar functions -----------------------------------------------------------------------------------

_joined = lambda c: F.array_join(c.cast("array<string>"), ",")
_places = "array_to_string(list_filter(range(0, l), lambda i: substr({0}, i + 1, 1) = 'N'), ',')"
per_read(dna.revcomp, "v", "q_revcomp")
per_read(dna.revcomp_case, "reverse(translate(seq, 'acgtACGT', 'tgcaTGCA'))", "q_revcomp_case")
per_read(dna.normalize, "u", "q_normalize")
per_read(dna.canonical, "least(seq, v)", "q_canonical")
per_read(lambda c: dna.n_to_a(dna.canonical(c)), "replace(least(seq, v), 'N', 'A')", "q_canonical_n2a")
per_read(dna.two_bit_hex, HEX.format("f"), "q_twobit_encode")
per_read(lambda c: dna.two_bit_decode(dna.two_bit_hex(c), F.length(c)), "f", "q_twobit_decode")
per_read(lambda c: _joined(dna.n_positions(dna.normalize(c))), _places.format("u"), "q_nlocs")
per_read(lambda c: _joined(F.array_sort(dna.mirrored(dna.n_positions(dna.normalize(c)), F.length(c)))), _places.format("v"), "q_nlocs_flip")
per_read(lambda c: dna.patch_n(dna.n_to_a(dna.normalize(c)), dna.n_positions(dna.normalize(c))), "u", "q_npatch")


@query(f"WITH {ROTATED} SELECT read_id, body AS v FROM rot")
def q_permute(spark: SparkSession, d: str) -> DataFrame:
    return rotated(spark, d).select("read_id", F.col("body").alias("v"))


@query(f"WITH {ROTATED} SELECT read_id, f AS v FROM rot")
def q_unpermute(spark: SparkSession, d: str) -> DataFrame:
    return rotated(spark, d).select("read_id", dna.unpermute(F.col("body"), F.col("key"), F.col("off").cast("int")).alias("v"))


@query(f"WITH {READS}, t AS (SELECT seq, lag(seq) OVER (ORDER BY seq) AS prev FROM (SELECT DISTINCT seq FROM s)) SELECT seq, CAST({LCP.format('seq', 'prev')} AS BIGINT) AS lcp FROM t WHERE prev IS NOT NULL")
def q_lcp(spark: SparkSession, d: str) -> DataFrame:
    """Of neighbours in the order of all different sequences; neighbours meet by their ranks."""
    rows = ranked(seqs(spark, d).select("seq").distinct(), "seq")
    prev = rows.select((F.col("rank") + 1).alias("rank"), F.col("seq").alias("prev"))
    return rows.join(prev, "rank").select("seq", dna.lcp(F.col("seq"), F.col("prev"), F.length("seq")).cast("bigint").alias("lcp"))


_GRAMS = f"{FORMS}, g AS (SELECT read_id, CAST(0 AS BIGINT) AS rc, f AS x, unnest(range(1, greatest(l - 4, 1))) AS i FROM n UNION ALL SELECT read_id, 1, r, unnest(range(1, greatest(l - 4, 1))) FROM n)"


def _both_grams(spark: SparkSession, d: str, k: int = 6) -> DataFrame:
    """(read_id, rc, gram) of every place, of the reads and of their reverse complements."""
    rows = seqs(spark, d)
    both = [grams(rows.select("read_id", dna.n_to_a(f(F.col("seq"))).alias("seq")), "read_id", "seq", k).withColumn("rc", F.lit(i).cast("bigint")) for i, f in enumerate((dna.normalize, dna.revcomp))]
    return both[0].unionByName(both[1])


@query(f"WITH {_GRAMS} SELECT rc, substr(x, i, 6) AS gram, count(*) AS n FROM g GROUP BY ALL")
def q_gram_profile(spark: SparkSession, d: str) -> DataFrame:
    """Counts of 6-mers of either strand."""
    return assign.named(_both_grams(spark, d).groupBy("rc", "gram").agg(F.count("*").alias("n")), 6, "gram")


@query(f"WITH {_GRAMS} SELECT read_id, rc, substr(x, i, 6) AS gram, count(*) AS n FROM g GROUP BY ALL")
def q_gram_vector(spark: SparkSession, d: str) -> DataFrame:
    """The vector of 6-mer counts of each read and of its reverse complement; zeros are left out."""
    return assign.named(_both_grams(spark, d).groupBy("read_id", "rc", "gram").agg(F.count("*").alias("n")), 6, "gram")


@query(f"""WITH {PLACED}, t AS (SELECT key, pos, substr(body, 1, length(body) - off) AS rest FROM pl),
p AS (SELECT a.key, a.pos, b.pos AS back, {LCP.format('a.rest', 'b.rest')} AS lcp FROM t a JOIN t b ON a.key = b.key AND b.pos BETWEEN a.pos - 8 AND a.pos - 1)
SELECT key, pos, pos - back AS back, CAST(min(lcp) OVER (PARTITION BY key, pos ORDER BY back DESC) AS BIGINT) AS low FROM p""")
def q_running_prefix(spark: SparkSession, d: str) -> DataFrame:
    """For each read of a bucket the smallest common prefix with the 1 to 8 reads before it."""
    return partition.running_prefix(archive.placed(rotated(spark, d)), 8)


# ---- mates and libraries --------------------------------------------------------------------------------


@query(f"WITH {PAIRS} SELECT run_no, ordinal, id1, id2 FROM p")
def q_pair_zip(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("run_no", "ordinal", "id1", "id2")


@query(f"WITH {PAIRS} SELECT id1, {MERGED} AS v FROM pf")
def q_pair_merge_seq(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("id1", dna.merged(F.col("s1"), F.col("s2"), F.col("orientation")).alias("v"))


@query(f"WITH {PAIRS} SELECT id1, h1, {MERGED} AS v, q1 || CASE WHEN orientation IN (1, 2) THEN reverse(q2) ELSE q2 END AS qual FROM pf")
def q_merge_pairs(spark: SparkSession, d: str) -> DataFrame:
    """With the first mate's header, and the second's qualities turned as its bases are."""
    qual = F.concat("q1", F.when(F.col("orientation").isin(1, 2), F.reverse("q2")).otherwise(F.col("q2")))
    return pairs(spark, d, "header", "qual").select("id1", "h1", dna.merged(F.col("s1"), F.col("s2"), F.col("orientation")).alias("v"), qual.alias("qual"))


@query(f"WITH {PAIRS} SELECT id1, s1 || s2 AS v FROM p")
def q_merge_pairs_naive(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("id1", F.concat("s1", "s2").alias("v"))


@query(f"WITH {PAIRS} SELECT id1, {NORM.format('s1')} AS m1, {NORM.format('s2')} AS m2 FROM pf")
def q_pair_split(spark: SparkSession, d: str) -> DataFrame:
    """Mates out of their merged sequence, cut after the first."""
    p = pairs(spark, d).withColumn("m", dna.merged(F.col("s1"), F.col("s2"), F.col("orientation")))
    tail = F.expr("substring(m, length(s1) + 1)")
    return p.select("id1", F.expr("substring(m, 1, length(s1))").alias("m1"), F.when(F.col("orientation").isin(1, 2), dna.revcomp(tail)).otherwise(tail).alias("m2"))


@query(f"""WITH {READS} SELECT lib, CAST(lib_type AS BIGINT) AS lib_type, CAST(orientation AS BIGINT) AS orientation, CAST(strandedness AS BIGINT) AS strandedness, CAST(format_id AS BIGINT) AS format_id, CAST(format_id AS BIGINT) AS repacked,
  CASE lib_type WHEN 0 THEN 'single' ELSE 'paired' END || ',' || (['same', 'away', 'toward', 'none'])[orientation + 1] || ',' || (['SA', 'AS', 'S', 'A', 'U'])[strandedness + 1] AS described, n
FROM (SELECT coalesce(lib, CASE WHEN mate IS NULL THEN 'U' ELSE 'IU' END) AS lib, count(*) AS n FROM r GROUP BY 1) JOIN libformats ON lib = lib_name""")
def q_libformat(spark: SparkSession, d: str) -> DataFrame:
    """Formats of the reads' libraries, packed, unpacked and in words, with their numbers of reads."""
    lib = F.coalesce("lib", F.when(F.col("mate").isNull(), "U").otherwise("IU")).alias("lib")
    t = all_reads(spark, d, "lib", "mate").groupBy(lib).agg(F.count("*").alias("n"))
    parts = library.lib_type(F.col("lib")), library.orientation(F.col("lib")), library.strandedness(F.col("lib"))
    number = library.format_id(*parts)
    back = library.unpacked(number)
    cols = dict(lib_type=back[0], orientation=back[1], strandedness=back[2], format_id=number, repacked=library.format_id(*back))
    return t.select("lib", *(c.cast("bigint").alias(n) for n, c in cols.items()), library.described(*parts).alias("described"), "n").where("format_id is not null")


@query("""SELECT lib_name, CAST(CASE WHEN lib_type = 0 THEN orientation = 3 AND strandedness IN (2, 3, 4)
  WHEN orientation = 0 THEN strandedness IN (2, 3, 4) ELSE orientation IN (1, 2) AND strandedness IN (0, 1, 4) END AS BIGINT) AS valid FROM libformats""")
def q_libformat_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "libformats").select("lib_name", library.is_valid(F.col("lib_type"), F.col("orientation"), F.col("strandedness")).cast("bigint").alias("valid"))


# ---- mers -----------------------------------------------------------------------------------------------


@query(f"WITH {FORMS}, o AS (SELECT *, unnest(range(0, greatest(l - {K - 1}, 0))) AS off FROM n) SELECT read_id, off, substr(f, off + 1, {K}) AS kmer, substr(r, l - {K} - off + 1, {K}) AS rc_kmer FROM o")
def q_kmers(spark: SparkSession, d: str) -> DataFrame:
    """The mer at each place of each read, and its reverse complement."""
    t = read_mers(seqs(spark, d), "read_id", "seq", K)
    return assign.named(assign.named(t.withColumnRenamed("key", "kmer").withColumnRenamed("rc_key", "rc_kmer"), key="kmer"), key="rc_kmer")


@query(f"WITH {CANDS} SELECT read_id, count(*) AS n, CAST(sum(rc) AS BIGINT) AS n_rc, min(key) AS low, max(key) AS high, CAST(sum(off) AS BIGINT) AS offs FROM one GROUP BY read_id")
def q_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The candidate keys of each read, summed up."""
    t = candidates(seqs(spark, d), "read_id", "seq", K).groupBy("read_id")
    t = t.agg(F.count("*").alias("n"), F.sum("rc").alias("n_rc"), F.min("key").alias("low"), F.max("key").alias("high"), F.sum("off").alias("offs"))
    return assign.named(assign.named(t, key="low"), key="high")


@query(f"WITH {GRAPH} SELECT n, count(*) AS kmers FROM (SELECT kmer, count(*) AS n FROM mers GROUP BY kmer) GROUP BY n")
def q_kmer_count(spark: SparkSession, d: str) -> DataFrame:
    """The spectrum: how many different mers stand at n places."""
    counts = grams(seqs(spark, d), "read_id", "seq", K, n_as_a=False).groupBy("gram").agg(F.count("*").alias("n"))
    return counts.groupBy("n").agg(F.count("*").alias("kmers"))


@query(f"WITH m AS (SELECT DISTINCT entry_id, {KEY_SQL} AS key, cnt FROM mer_counts) SELECT key, CAST(sum(cnt) // 2 AS BIGINT) AS n FROM m WHERE key IS NOT NULL GROUP BY key HAVING sum(cnt) > 1")
def q_count_decay(spark: SparkSession, d: str) -> DataFrame:
    """Counts of mer_counts halved; those of one or less are dropped."""
    m = table(spark, d, "mer_counts").select("entry_id", mer_key(F.col("mer")).alias("key"), "cnt").where("key is not null").distinct()
    return m.groupBy("key").agg(F.sum("cnt").alias("n")).where("n > 1").select("key", F.expr("n div 2").alias("n"))


_POSTS = f"{READS}, w AS (SELECT read_id, seq, unnest(range(1, greatest(length(seq) - {K - 2}, 1))) AS i FROM s), posts AS (SELECT DISTINCT read_id, substr(seq, i, {K}) AS key FROM w WHERE regexp_full_match(substr(seq, i, {K}), '[ACGT]*'))"


@query(f"WITH {_POSTS} SELECT key, count(*) AS n FROM posts GROUP BY key")
def q_postings(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the posting lists of all mers."""
    return assign.named(cover.postings(seqs(spark, d), K).groupBy("key").agg(F.count("*").alias("n")))


@query(f"WITH {GRAPH} SELECT src, dst FROM edges")
def q_dbg_edges(spark: SparkSession, d: str) -> DataFrame:
    """Of the graph of all mers, as in the next three."""
    return assign.named(assign.named(graph_of(spark, d)[1], key="src"), key="dst")


@query(f"WITH {GRAPH} SELECT n_in, n_out, count(*) AS n FROM deg GROUP BY ALL")
def q_dbg_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(*graph_of(spark, d)).groupBy("n_in", "n_out").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH} SELECT kmer FROM deg WHERE n_in <> 1 AND n_out = 1")
def q_dbg_path_starts(spark: SparkSession, d: str) -> DataFrame:
    return assign.named(graph.path_starts(graph.degrees(*graph_of(spark, d))), key="kmer")


@query(f"""WITH RECURSIVE {GRAPH},
one AS MATERIALIZED (SELECT src, dst FROM edges JOIN deg ON src = kmer AND n_out = 1),
begins AS (SELECT kmer FROM deg WHERE n_in <> 1 AND n_out = 1),
most AS MATERIALIZED (SELECT count(*) AS n FROM nodes),
walk AS (SELECT kmer AS start, kmer AS here, CAST(1 AS BIGINT) AS n_nodes FROM begins
  UNION ALL SELECT start, dst, n_nodes + 1 FROM walk JOIN one ON here = src WHERE n_nodes <= (SELECT n FROM most)),
ends AS (SELECT start, here AS stop, n_nodes FROM walk WHERE here NOT IN (SELECT src FROM one))
SELECT kmer AS start, stop, n_nodes FROM begins LEFT JOIN ends ON start = kmer""")
def q_dbg_paths(spark: SparkSession, d: str) -> DataFrame:
    """Collapsed paths; one that runs into a cycle has no stop."""
    return assign.named(assign.named(graph.collapsed_paths(*graph_of(spark, d)), key="start"), key="stop")


# ---- assignment -----------------------------------------------------------------------------------------


@query(f"WITH {ASSIGNED} SELECT read_id, key, off, rc FROM asg")
def q_assign_popularity(spark: SparkSession, d: str) -> DataFrame:
    return assign.named(assigned(spark, d)[1])


@query(f"WITH {ASSIGNED} SELECT key, count(*) AS n FROM asg GROUP BY key")
def q_bucket_sizes(spark: SparkSession, d: str) -> DataFrame:
    return assign.named(assign.bucket_sizes(assigned(spark, d)[1]))


@query(f"WITH {ASSIGNED} SELECT read_id, key FROM asg WHERE key IN (SELECT key FROM asg GROUP BY key HAVING count(*) = 1)")
def q_onsies(spark: SparkSession, d: str) -> DataFrame:
    return assign.named(assign.onsies(materialize(assigned(spark, d)[1], "assigned"))).select("read_id", "key")


@query(f"WITH {ASSIGNED} SELECT read_id, key FROM asg WHERE key IN (SELECT key FROM asg GROUP BY key HAVING count(*) > 1)")
def q_without_onsies(spark: SparkSession, d: str) -> DataFrame:
    return assign.named(assign.without_onsies(materialize(assigned(spark, d)[1], "assigned"))).select("read_id", "key")


@query(f"""WITH {ASSIGNED} SELECT (SELECT count(*) FROM s) AS n_reads, CAST((SELECT sum(length(seq)) FROM s) AS BIGINT) AS n_bases, count(*) AS n_buckets, count(*) FILTER (n = 1) AS n_onsies, max(n) AS largest
FROM (SELECT key, count(*) AS n FROM asg GROUP BY key)""")
def q_summary(spark: SparkSession, d: str) -> DataFrame:
    rows, a = assigned(spark, d)
    total = rows.agg(F.count("*").alias("n_reads"), F.sum(F.length("seq")).alias("n_bases"))
    sizes = assign.bucket_sizes(a).agg(F.count("*").alias("n_buckets"), F.count_if(F.col("n") == 1).alias("n_onsies"), F.max("n").alias("largest"))
    one = F.lit(1).alias("_")
    return total.select("*", one).join(sizes.select("*", one), "_").drop("_")


_MODEL = f"""{ROTATED},
sg AS (SELECT DISTINCT read_id, key, substr(f, i, 8) AS gram FROM (SELECT read_id, key, f, unnest(range(1, greatest(length(f) - 6, 1))) AS i FROM st)),
model AS (SELECT key, gram, count(*) AS n FROM sg GROUP BY ALL)"""
_SCORES = f"""{_MODEL},
sz AS (SELECT key, count(*) AS n FROM asg GROUP BY key),
prof AS (SELECT read_id, rc, substr(x, i, 8) AS gram, count(*) AS times FROM (
  SELECT read_id, 0 AS rc, f AS x, unnest(range(1, greatest(l - 6, 1))) AS i FROM n UNION ALL SELECT read_id, 1, r, unnest(range(1, greatest(l - 6, 1))) FROM n) GROUP BY ALL),
cand AS (SELECT one.*, asg.key AS own FROM one JOIN sz USING (key) JOIN asg ON asg.read_id = one.read_id WHERE one.key <> asg.key OR sz.n > 1),
score AS (SELECT c.read_id, c.key, c.off, c.rc, CAST(sum(times) AS BIGINT) AS score FROM cand c JOIN prof p ON c.read_id = p.read_id AND c.rc = p.rc
  JOIN model m ON m.key = c.key AND m.gram = p.gram LEFT JOIN sg g ON g.read_id = c.read_id AND g.gram = p.gram
  WHERE m.n > 1 OR c.key <> c.own OR g.gram IS NULL GROUP BY ALL),
best AS (SELECT read_id, key, off, rc FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY score DESC, key) AS rn FROM score) WHERE rn = 1)"""


@query(f"WITH {_MODEL} SELECT key, count(*) AS n_grams, CAST(sum(n) AS BIGINT) AS held FROM model GROUP BY key")
def q_bucket_model(spark: SparkSession, d: str) -> DataFrame:
    rows, a = assigned(spark, d)
    model = assign.bucket_model(rows, materialize(a, "assigned"))
    return assign.named(model.groupBy("key").agg(F.count("*").alias("n_grams"), F.sum("n").alias("held")))


@query(f"WITH {_SCORES} SELECT read_id, key, score FROM score")
def q_overlap_score(spark: SparkSession, d: str) -> DataFrame:
    return assign.named(assign.overlap_scores(delivered(spark, d))).select("read_id", "key", "score")


@query(f"WITH {_SCORES} SELECT a.read_id, coalesce(b.key, a.key) AS key, coalesce(b.off, a.off) AS off, coalesce(b.rc, a.rc) AS rc FROM asg a LEFT JOIN best b ON a.read_id = b.read_id")
def q_assign_overlap(spark: SparkSession, d: str) -> DataFrame:
    """One round of moving reads to the bucket they overlap most."""
    return assign.named(assign.overlap(delivered(spark, d)))


@query(f"""WITH {_SCORES} SELECT a.read_id, coalesce(b.key, a.key) AS key, coalesce(b.off, a.off) AS off, coalesce(b.rc, a.rc) AS rc
FROM asg a JOIN sz ON a.key = sz.key LEFT JOIN best b ON a.read_id = b.read_id AND sz.n = 1""")
def q_reassign_onsies(spark: SparkSession, d: str) -> DataFrame:
    return assign.named(assign.overlap(delivered(spark, d), movers="onsies"))


@query()
def q_assign_fold(spark: SparkSession, d: str) -> DataFrame:
    """The sequential rule over all reads."""
    return assign.named(assign.sequential(kept(spark, d)))


@query(f"WITH {_POSTS} SELECT key, count(*) AS n FROM posts GROUP BY key ORDER BY n DESC, key LIMIT 1")
def q_setcover_round1(spark: SparkSession, d: str) -> DataFrame:
    return assign.named(cover.best_key(cover.postings(seqs(spark, d), K)))


@query(f"""WITH RECURSIVE {_POSTS}, left_ AS (SELECT read_id, key, 0 AS round, false AS done FROM posts
  UNION ALL SELECT read_id, key, round + 1, wins FROM (SELECT *, bool_or(wins) OVER (PARTITION BY read_id) AS taken FROM (SELECT *, bool_and(top) OVER (PARTITION BY key) AS wins FROM (
    SELECT *, key = first_value(key) OVER (PARTITION BY read_id ORDER BY n DESC, key) AS top FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM left_ WHERE NOT done)))) WHERE wins OR NOT taken)
SELECT read_id, key, round FROM left_ WHERE done""")
def q_setcover(spark: SparkSession, d: str) -> DataFrame:
    return assign.named(cover.set_cover(cover.postings(seqs(spark, d), K)))


# ---- archive --------------------------------------------------------------------------------------------


@query(f"WITH {PLACED} SELECT key, sub_id, count(*) AS n, min(off) AS first_off, max(off) AS last_off FROM ch GROUP BY ALL")
def q_subbuckets(spark: SparkSession, d: str) -> DataFrame:
    return archive.placed(rotated(spark, d)).groupBy("key", "sub_id").agg(F.count("*").alias("n"), F.min("off").alias("first_off"), F.max("off").alias("last_off"))


@query(f"WITH {PLACED} SELECT read_id, sub_id, CAST(off - coalesce(lag(off) OVER (PARTITION BY key, sub_id ORDER BY pos), 0) AS BIGINT) AS delta FROM ch")
def q_offset_delta(spark: SparkSession, d: str) -> DataFrame:
    return archive.deltas(archive.placed(rotated(spark, d))).select("read_id", "sub_id", "delta")


@query(f"WITH {ROTATED} SELECT read_id, off FROM rot")
def q_offset_restore(spark: SparkSession, d: str) -> DataFrame:
    return archive.restored(archive.deltas(archive.placed(rotated(spark, d))).drop("off")).select("read_id", "off")


@query(f"WITH {PLACED} SELECT DISTINCT key, sub_id, CASE WHEN sub_id = 0 THEN key END AS key_stored FROM ch")
def q_key_carry(spark: SparkSession, d: str) -> DataFrame:
    chunks = archive.placed(rotated(spark, d)).select("key", "sub_id").distinct()
    return archive.elided(chunks).select(F.col("key_read").alias("key"), "sub_id", "key_stored")


@query(f"WITH {PLACED} SELECT read_id, row_number() OVER (ORDER BY CASE WHEN n = 1 THEN 0 ELSE 1 END, key, pos) - 1 AS ordinal FROM ch JOIN (SELECT key, count(*) AS n FROM ch GROUP BY key) USING (key)")
def q_ordinal(spark: SparkSession, d: str) -> DataFrame:
    places = archive.placed(rotated(spark, d))
    return archive.ordinals(places, places.groupBy("key").agg(F.count("*").alias("n"))).select("read_id", "ordinal")


@query(f"WITH {ASSIGNED} SELECT read_id, row_number() OVER (ORDER BY reverse(u), read_id) AS rank FROM n WHERE read_id IN (SELECT read_id FROM asg WHERE key IN (SELECT key FROM asg GROUP BY key HAVING count(*) = 1))")
def q_onsie_order(spark: SparkSession, d: str) -> DataFrame:
    """Reads alone in their bucket in the order of their reversed letters."""
    rows, a = assigned(spark, d)
    lone = rows.join(assign.onsies(materialize(a, "assigned")).select("read_id"), "read_id", "left_semi")
    return ranked(lone.select("read_id", F.reverse(dna.normalize(F.col("seq"))).alias("back")), "back", "read_id").select("read_id", "rank")


@query(f"WITH {FORMS} SELECT row_number() OVER (ORDER BY least(seq, v)) AS rank, least(seq, v) AS canon FROM s JOIN n USING (read_id)")
def q_canonical_sorted(spark: SparkSession, d: str) -> DataFrame:
    return ranked(seqs(spark, d).select("read_id", dna.canonical(F.col("seq")).alias("canon")), "canon", "read_id").select("rank", "canon")


@query(f"WITH {FORMS} SELECT least(seq, v) AS canon, count(*) FILTER (mate = 1) AS n_first, count(*) FILTER (mate = 2) AS n_second FROM s JOIN n USING (read_id) WHERE mate IN (1, 2) GROUP BY 1 HAVING count(*) FILTER (mate = 1) <> count(*) FILTER (mate = 2)")
def q_canon_compare(spark: SparkSession, d: str) -> DataFrame:
    """First and second mates as multisets of canonical sequences: what one has more often than the other."""
    r = reads(spark, d, "mate").where("mate in (1, 2)").groupBy(dna.canonical(F.col("seq")).alias("canon"))
    return r.agg(F.count_if(F.col("mate") == 1).alias("n_first"), F.count_if(F.col("mate") == 2).alias("n_second")).where("n_first <> n_second")


def _written(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "archive")
    archive.write(rotated(spark, d), path)
    return spark.read.parquet(path)


@query(f"WITH {ASSIGNED} SELECT read_id, u AS seq FROM n JOIN asg USING (read_id)")
def q_archive_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d).select("read_id", archive.sequence().alias("seq"))


@query(f"WITH {ASSIGNED} SELECT count(*) AS n_reads, count(*) AS n_back, CAST(0 AS BIGINT) AS n_differ FROM asg")
def q_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Reads and decoded reads as multisets."""
    back = _written(spark, d).select(archive.sequence().alias("seq"), F.lit(-1).alias("one"))
    there = seqs(spark, d).where(F.length("seq") >= K).select(dna.normalize(F.col("seq")).alias("seq"), F.lit(1).alias("one"))
    sums = there.unionByName(back).groupBy("seq").agg(F.count_if(F.col("one") == 1).alias("a"), F.count_if(F.col("one") == -1).alias("b"))
    return sums.agg(F.sum("a").alias("n_reads"), F.sum("b").alias("n_back"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("n_differ"))


_DAMAGE = f"""{PLACED}, damaged AS (SELECT read_id, CASE read_id % 5 WHEN 0 THEN '' ELSE key END AS key, CASE read_id % 5 WHEN 1 THEN length(body) + 1 ELSE off END AS off,
  CASE read_id % 5 WHEN 2 THEN 'N' || body ELSE body END AS body, read_id % 5 = 3 AS beyond FROM rot)"""


@query(f"""WITH {_DAMAGE} SELECT read_id, CASE WHEN key = '' THEN 'key' WHEN off > length(body) THEN 'offset' WHEN regexp_matches(body, '[^ACGT]') THEN 'letters' ELSE 'nlocs' END AS fault
FROM damaged WHERE key = '' OR off > length(body) OR regexp_matches(body, '[^ACGT]') OR beyond""")
def q_archive_check(spark: SparkSession, d: str) -> DataFrame:
    """The rules of an archive's rows, over rows of which four in five are damaged, each rule by some."""
    hit = lambda i: F.col("read_id") % 5 == i
    rows = rotated(spark, d).withColumn("off", F.when(hit(1), F.length("body") + 1).otherwise(F.col("off")))
    rows = rows.withColumn("key", F.when(hit(0), "").otherwise(F.col("key")))
    rows = rows.withColumn("nlocs", F.when(hit(3), F.array(F.length("body") + F.length("key"))).otherwise(F.col("nlocs")))
    return archive.faults(rows.withColumn("body", F.when(hit(2), F.concat(F.lit("N"), "body")).otherwise(F.col("body")))).select("read_id", "fault")


@query(f"""WITH {PLACED}, moved AS (SELECT key, sub_id, CASE WHEN sub_id % 2 = 0 THEN -off ELSE off END AS off, CASE WHEN sub_id % 2 = 1 THEN pos + 1 ELSE pos END AS pos FROM ch),
steps AS (SELECT key, sub_id, pos, off < lag(off) OVER (PARTITION BY key, sub_id ORDER BY pos) AS falls FROM moved)
SELECT key, sub_id, CASE WHEN sub_id % 2 = 1 THEN 'range' ELSE 'order' END AS fault FROM steps GROUP BY key, sub_id HAVING sub_id % 2 = 1 OR bool_or(falls)""")
def q_chunk_check(spark: SparkSession, d: str) -> DataFrame:
    """The rules of an archive's chunks, over even chunks with their offsets turned round and odd ones moved by a place."""
    even = F.col("sub_id") % 2 == 0
    rows = archive.placed(rotated(spark, d)).withColumn("off", F.when(even, -F.col("off")).otherwise(F.col("off")))
    return archive.chunk_faults(rows.withColumn("pos", F.when(even, F.col("pos")).otherwise(F.col("pos") + 1)))


@query(f"WITH {PLACED}, ord AS (SELECT read_id, row_number() OVER (ORDER BY CASE WHEN n = 1 THEN 0 ELSE 1 END, key, pos) - 1 AS ordinal FROM ch JOIN (SELECT key, count(*) AS n FROM ch GROUP BY key) USING (key)) SELECT '>' || ordinal || chr(10) || u AS record FROM ord JOIN n USING (read_id)")
def q_decode_fasta(spark: SparkSession, d: str) -> DataFrame:
    """Decoded reads as FASTA records, named by their ordinals."""
    places = archive.placed(rotated(spark, d))
    numbered = archive.ordinals(places, places.groupBy("key").agg(F.count("*").alias("n")))
    return numbered.select(F.concat(F.lit(">"), F.col("ordinal").cast("string"), F.lit("\n"), archive.sequence()).alias("record"))


@query()
def q_partition(spark: SparkSession, d: str) -> DataFrame:
    """Buckets cut into ranges with a common prefix."""
    return partition.partition(archive.placed(rotated(spark, d)), K)


# ---- checks, scans, report ------------------------------------------------------------------------------


@query(f"WITH {READS} SELECT read_id, length(seq) AS len FROM r WHERE length(seq) < {K}")
def q_short_reads(spark: SparkSession, d: str) -> DataFrame:
    return all_reads(spark, d).select("read_id", F.length("seq").cast("bigint").alias("len")).where(F.col("len") < K)


@query(f"WITH {READS} SELECT run_no, min(length(seq)) AS shortest, max(length(seq)) AS longest, count(*) AS n, CAST(min(length(seq)) = max(length(seq)) AS BIGINT) AS uniform FROM s GROUP BY run_no")
def q_length_check(spark: SparkSession, d: str) -> DataFrame:
    size = F.length("seq").cast("bigint")
    t = reads(spark, d, "run_no").groupBy("run_no").agg(F.min(size).alias("shortest"), F.max(size).alias("longest"), F.count("*").alias("n"))
    return t.withColumn("uniform", (F.col("shortest") == F.col("longest")).cast("bigint"))


@query("WITH f AS (SELECT DISTINCT rec_id, header, seq FROM fasta_records WHERE header IS NOT NULL AND seq IS NOT NULL) SELECT substr(regexp_replace(header, '[\\r\\n]+', ' ', 'g'), 2) AS header, regexp_replace(seq, '[\\r\\n]', '', 'g') AS seq FROM f")
def q_scan_fasta(spark: SparkSession, d: str) -> DataFrame:
    """fasta_records written as FASTA files, 60 characters a line, and read back."""
    t = table(spark, d, "fasta_records").where("header is not null and seq is not null").select("rec_id", "header", "seq").distinct()
    name = F.expr("substring(regexp_replace(header, '[\\\\r\\\\n]+', ' '), 2)")
    path = fastx.write_fasta(t.select(name.alias("header"), F.regexp_replace("seq", "[\\r\\n]", "").alias("seq")), scratch(spark, "fasta"), width=60)
    return fastx.read_fasta(spark, path).select("header", "seq")


@query(f"WITH {READS} SELECT coalesce(header, '') AS header, seq, qual FROM s WHERE length(qual) = length(seq) AND NOT regexp_matches(qual, '[^!-~]')")
def q_scan_fastq(spark: SparkSession, d: str) -> DataFrame:
    """Reads with proper qualities written as FASTQ files and read back."""
    t = reads(spark, d, "header", "qual").where("length(qual) = length(seq) and not rlike(qual, '[^!-~]')").select(F.coalesce("header", F.lit("")).alias("header"), "seq", "qual")
    return fastx.read_fastq(spark, fastx.write_fastq(t, scratch(spark, "fastq")), four_lines=True, split_bytes=1 << 20).select("header", "seq", "qual")


@query(f"WITH {READS} SELECT seq AS line, count(*) AS n FROM s WHERE length(qual) = length(seq) AND NOT regexp_matches(qual, '[^!-~]') GROUP BY seq")
def q_scan_lines(spark: SparkSession, d: str) -> DataFrame:
    """Of the same files the second of every four lines, counted."""
    t = reads(spark, d, "header", "qual").where("length(qual) = length(seq) and not rlike(qual, '[^!-~]')").select(F.coalesce("header", F.lit("")).alias("header"), "seq", "qual")
    lines = fastx.line_modulo(spark, fastx.write_fastq(t, scratch(spark, "fastq")), 1, 1 << 20)
    return lines.groupBy("line").agg(F.count("*").alias("n"))


@query(f"WITH {READS} SELECT coalesce(header, '') AS header, seq, qual FROM s WHERE length(qual) = length(seq) AND NOT regexp_matches(qual, '[^!-~]')")
def q_scan_fastq_lines(spark: SparkSession, d: str) -> DataFrame:
    """Files whose records take several lines, read back one task a file."""
    t = reads(spark, d, "header", "qual").where("length(qual) = length(seq) and not rlike(qual, '[^!-~]')")
    wrapped = [F.regexp_replace(c, "(.{30})(?=.)", "$1\n").alias(c) for c in ("seq", "qual")]
    t = t.select(F.coalesce("header", F.lit("")).alias("header"), *wrapped)
    return fastx.read_fastq(spark, fastx.write_fastq(t, scratch(spark, "fastq"))).select("header", "seq", "qual")


@query(f"WITH {PAIRS} SELECT s1, s2, count(*) AS n FROM p GROUP BY s1, s2")
def q_scan_mates(spark: SparkSession, d: str) -> DataFrame:
    """Mates written as two sets of FASTA files, read back in lock-step, and counted."""
    p = materialize(pairs(spark, d).select(F.col("id1").cast("string").alias("header"), "s1", "s2"), "mates")
    first, second = (fastx.write_fasta(p.select("header", F.col(c).alias("seq")), scratch(spark, c)) for c in ("s1", "s2"))
    spark.dataSource.register(fastx.FastxSource)
    rows = spark.read.format("fastx").option("path2", second).option("strict", "true").load(first)
    a = rows.where("mate = 1").select("pair", "ordinal", "header", F.col("seq").alias("s1"))
    b = rows.where("mate = 2").select("pair", "ordinal", "header", F.col("seq").alias("s2"))
    return a.join(b, ["pair", "ordinal", "header"]).groupBy("s1", "s2").agg(F.count("*").alias("n"))


@query(f"WITH {FORMS} SELECT CAST(read_id AS VARCHAR) AS header, replace(least(seq, v), 'N', 'A') AS seq FROM s JOIN n USING (read_id)")
def q_canonical_file(spark: SparkSession, d: str) -> DataFrame:
    """Canonicalized reads in order, written as FASTA and read back."""
    rows = seqs(spark, d).select(F.col("read_id").cast("string").alias("header"), "seq", F.lit(None).cast("string").alias("qual"))
    return fastx.read_fasta(spark, fastx.write_fasta(cli.canonicalize(rows), scratch(spark, "canonical"))).select("header", "seq")


@query(f"WITH {READS} SELECT coalesce(header, '') AS header, seq, qual FROM s WHERE length(qual) = length(seq) AND NOT regexp_matches(qual, '[^!-~]')")
def q_fastq_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """FASTQ that is read, checked, written again and read."""
    again = fastx.write_fastq(q_scan_fastq_lines(spark, d), scratch(spark, "rewritten"))
    return fastx.read_fastq(spark, again, four_lines=True).select("header", "seq", "qual")


_SIZES = "SELECT coalesce(lang, '-') AS dataset, coalesce(source, '-') AS method, sum(n_chars) AS size FROM documents GROUP BY 1, 2"


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """(dataset, method, size): lang is the data set, source the method; null is `-`."""
    t = table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("-")).alias("dataset"), F.coalesce("source", F.lit("-")).alias("method"))
    return t.agg(F.sum("n_chars").alias("size"))


def _methods(spark: SparkSession, d: str, most: int = 200) -> list[str]:
    """All methods of the data, each a column of the report; more than `most` of them are an error."""
    found = [r["method"] for r in _sizes(spark, d).select("method").distinct().orderBy("method").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} methods make no table")
    return found


@query(f"SELECT * FROM (PIVOT ({_SIZES}) ON method USING CAST(sum(size) AS BIGINT) GROUP BY dataset)")
def q_size_report(spark: SparkSession, d: str) -> DataFrame:
    """Sizes per data set, a column per method."""
    return _sizes(spark, d).groupBy("dataset").pivot("method", _methods(spark, d)).agg(F.sum("size"))


@query(f"""WITH z AS ({_SIZES}), m AS (SELECT DISTINCT method FROM z), x AS (SELECT DISTINCT dataset FROM z)
SELECT dataset || ' & ' || string_agg(coalesce(CAST(CAST(size AS BIGINT) AS VARCHAR), ''), ' & ' ORDER BY method) AS line FROM x CROSS JOIN m LEFT JOIN z USING (dataset, method) GROUP BY dataset""")
def q_size_latex(spark: SparkSession, d: str) -> DataFrame:
    """The size report as lines of a table."""
    t = q_size_report(spark, d)
    return t.select(F.concat_ws(" & ", "dataset", *(F.coalesce(F.col(f"`{m}`").cast("string"), F.lit("")) for m in t.columns[1:])).alias("line"))


@query(f"WITH z AS ({_SIZES}) SELECT dataset, '{{' || string_agg('\"' || method || '\":' || CAST(CAST(size AS BIGINT) AS VARCHAR), ',' ORDER BY method) || '}}' AS report FROM z WHERE size IS NOT NULL GROUP BY dataset")
def q_size_json(spark: SparkSession, d: str) -> DataFrame:
    """The size report as one JSON object per data set."""
    pairs = F.array_sort(F.collect_list(F.struct("method", F.col("size").cast("bigint"))))
    return _sizes(spark, d).where("size is not null").groupBy("dataset").agg(F.to_json(F.map_from_entries(pairs)).alias("report"))


@query("SELECT date_trunc('day', loaded_at) AS window_start, run_no, count(*) AS n, CAST(sum(coalesce(length(seq), 0)) AS BIGINT) AS n_bases FROM reads WHERE loaded_at IS NOT NULL GROUP BY ALL")
def q_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of reads per day and run, counted by a stream."""
    counts = arrivals.window_counts(arrivals.arriving(spark, f"{d}/reads.parquet"))
    return arrivals.run_to_end(counts, scratch(spark, "stream"), scratch(spark, "stream-checkpoint"), ["window_start", "run_no"])


@query(f"""WITH w AS (SELECT loaded_at, upper(regexp_replace(seq, '\\s', '', 'g')) AS seq FROM reads WHERE loaded_at IS NOT NULL AND seq IS NOT NULL),
m AS (SELECT loaded_at, seq, unnest(range(1, greatest(length(seq) - {K - 2}, 1))) AS i FROM w)
SELECT date_trunc('day', loaded_at) AS window_start, substr(seq, i, {K}) AS gram, count(*) AS n FROM m WHERE regexp_full_match(substr(seq, i, {K}), '[ACGT]{{{K}}}') GROUP BY ALL""")
def q_stream_mers(spark: SparkSession, d: str) -> DataFrame:
    """The mers of all deliveries of reads per day, counted by a stream."""
    counts = arrivals.mer_counts(arrivals.arriving(spark, f"{d}/reads.parquet"), K)
    return arrivals.run_to_end(counts, scratch(spark, "stream"), scratch(spark, "stream-checkpoint"), ["window_start", "gram"])


@query(f"WITH {READS} SELECT read_id, row_number() OVER (ORDER BY md5(CAST(read_id AS VARCHAR) || ':7'), read_id) AS rank FROM s")
def q_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """Reads in an order by chance that a seed fixes."""
    return ranked(seqs(spark, d).select("read_id", F.md5(F.concat(F.col("read_id").cast("string"), F.lit(":7"))).alias("h")), "h", "read_id").select("read_id", "rank")
