"""Read operators against plain restatements, round trips and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from seqbucket.functions import dna, library
from seqbucket.functions.kmer import code_mer, mer_code, mer_key
from seqbucket.operators import archive, assign, blocks, cover, graph
from seqbucket.operators.kmers import candidate_counts, candidates, smallest
from seqbucket.operators.partition import best_ranges, common_prefix, partition, running_prefix
from seqbucket.operators.skew import salted_lookup
from seqbucket.plans import queries

COMP = {"A": "T", "C": "G", "G": "C", "T": "A"}


def rc(s):
    return "".join(COMP.get(c, "N") for c in reversed(s))


def sample(n=120, seed=1, size=40):
    rnd = random.Random(seed)
    genome = "".join(rnd.choice("ACGT") for _ in range(300))
    out = []
    for i in range(n):
        a = rnd.randrange(300 - size)
        s = list(genome[a : a + rnd.choice([size, size - 7])])
        if rnd.random() < 0.3:
            s[rnd.randrange(len(s))] = "N"
        s = "".join(s)
        out.append((i, rc(s) if rnd.random() < 0.5 else s))
    extra = ["A" * 40, "A" * 40, "N" * 40, "ACGTACGTACGT", "ACG", "", "ACGTNRYKACGTTTGACCA", "ACGTACGT" * 5]
    return out + [(1000 + i, s) for i, s in enumerate(extra)]


def cand(s, k):
    f = "".join(c if c in COMP else "A" for c in s)
    r = rc(s).replace("N", "A")
    out = {}
    for p in range(len(s) - k + 1):
        out.setdefault(f[p : p + k], (p, 0))
        o = len(s) - k - p
        out.setdefault(r[o : o + k], (o, 1))
    return out


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(sample(), "read_id long, seq string").repartition(5).withColumn("key", F.lit("clash"))


def test_scalars(spark, rows, reads):
    s = F.col("seq")
    got = rows(
        reads.select(
            "read_id", dna.revcomp(s), dna.canonical(s), dna.two_bit_decode(dna.two_bit_hex(s), F.length(s)),
            dna.patch_n(dna.n_to_a(dna.normalize(s)), dna.n_positions(dna.normalize(s))), dna.revcomp(dna.revcomp(s)),
        )
    )
    for i, s in sample():
        u = "".join(c if c in COMP else "N" for c in s)
        assert (i, rc(s), min(s, rc(s)), u.replace("N", "A"), u, u) in got


def test_nulls(spark):
    df = spark.createDataFrame([(None,)], "seq string")
    s = F.col("seq")
    for f in (dna.revcomp, dna.canonical, dna.two_bit_hex, dna.n_positions, dna.ingest, mer_key):
        assert df.select(f(s)).first()[0] is None


def test_lcp_and_case(spark):
    df = spark.createDataFrame([("ACGT", "ACGA"), ("", "A"), ("AC", "AC"), ("T", "A")], "a string, b string")
    got = [r[0] for r in df.select(dna.lcp(F.col("a"), F.col("b"), F.lit(3))).collect()]
    assert got == [3, 0, 2, 0]
    assert df.limit(1).select(dna.revcomp_case(F.lit("aCgN"))).first()[0] == "NcGt"


def test_keys(spark, rows):
    mers = ["ACGTACGTACGTACG", "cgtacgtacgtacgt", "ACGTACGTACGTACN", "ACGT", None, "", "A" * 16, "TTTTTTTTTTTTTTT", "ACGTACGTACGTACG\n"]
    df = spark.createDataFrame([(m,) for m in mers], "mer string").select("mer", mer_key(F.col("mer")).alias("k"))
    got = [r["k"] for r in df.collect()]
    assert got == ["ACGTACGTACGTACG", "ACGTACGTACGTACG", None, None, None, None, None, "A" * 15, None]
    back = df.where("k is not null").select("k", code_mer(mer_code(F.col("k"))).alias("b"))
    assert all(r["k"] == r["b"] for r in back.collect())


@pytest.mark.parametrize("k", [4, 9, 15, 31])
def test_candidates(spark, reads, k):
    got: dict = {}
    for r in assign.named(candidates(reads, "read_id", "seq", k), k).collect():
        got.setdefault(r["read_id"], {})[r["key"]] = (r["off"], r["rc"])
    assert got == {i: cand(s, k) for i, s in sample() if len(s) >= k}
    counts: dict = {}
    for r in assign.named(candidate_counts(reads, "read_id", "seq", k), k).collect():
        counts[r["key"]] = counts.get(r["key"], 0) + r["n"]
    assert counts == {m: sum(m in c for c in got.values()) for m in set().union(*got.values())}
    low = {r["read_id"]: (r["key"], r["off"], r["rc"]) for r in assign.named(smallest(reads, "read_id", "seq", k), k).collect()}
    assert low == {i: (min(c), *c[min(c)]) for i, c in got.items()}


def popularity(data, k):
    pop: dict = {}
    for _, s in data:
        for m in cand(s, k):
            pop[m] = pop.get(m, 0) + 1
    out = {}
    for i, s in data:
        if len(s) >= k:
            c = cand(s, k)
            best = min(c, key=lambda m: (-pop[m], m))
            out[i] = (best, *c[best])
    return out


@pytest.mark.parametrize("small", [1 << 19, 0])
def test_popularity_whatever_the_order(spark, reads, monkeypatch, small):
    monkeypatch.setattr(assign, "SMALL", small)
    for k in (9, 4):
        want = popularity(sample(), k)
        for df in (reads, reads.orderBy(F.rand(1)).repartition(3)):
            got = {r["read_id"]: (r["key"], r["off"], r["rc"]) for r in assign.named(assign.popularity(df, k), k).collect()}
            assert got == want


def in_order(data, k):
    """The sequential rule, a read at a time."""
    models: dict = {}
    out = {}
    for i, s in sorted(data):
        if len(s) < k:
            continue
        c, turned = cand(s, k), ("".join(x if x in COMP else "A" for x in s), rc(s).replace("N", "A"))
        g = [[t[p : p + 8] for p in range(len(t) - 7)] for t in turned]
        best, top = min(c), 0
        for m in sorted(c):
            model = models.get(m)
            score = sum(x in model for x in g[c[m][1]]) if model else 0
            if score > top:
                best, top = m, score
        models.setdefault(best, set()).update(g[c[best][1]])
        out[i] = (best, *c[best])
    return out


@pytest.mark.parametrize("block", [20_000, 4])
def test_sequential_rule(spark, block):
    """A third of the reads share a key; in blocks of 4 reads their bucket is worked on by several tasks at once."""
    rnd = random.Random(6)
    data = sample() + [(3000 + i, "ACGTTGCAACGTAAGG" + "".join(rnd.choice("ACGT") for _ in range(rnd.randrange(12)))) for i in range(60)]
    df = spark.createDataFrame(data, "read_id long, seq string").repartition(5)
    got = {r["read_id"]: (r["key"], r["off"], r["rc"]) for r in assign.named(assign.sequential(df, 9, block), 9).collect()}
    assert got == in_order(data, 9)


def scores(data, at, k):
    """For each read the places whose 8-mer another read of a candidate bucket holds, by brute force."""
    turned = {i: ("".join(x if x in COMP else "A" for x in s), rc(s).replace("N", "A")) for i, s in data}
    g = lambda t: [t[p : p + 8] for p in range(len(t) - 7)]
    out = {}
    for i, s in data:
        for m, (off, d) in cand(s, k).items() if len(s) >= k else ():
            held = {x for j, (key, _, r) in at.items() if key == m and j != i for x in g(turned[j][r])}
            if n := sum(x in held for x in g(turned[i][d])):
                out[i, m] = (off, d, n)
    return out


@pytest.mark.parametrize("limit", [100_000, 5])
def test_overlap_scores_split_hot_keys(spark, monkeypatch, limit):
    """A third of the reads hold one key; with a limit of 5 rows it is split in both lookups."""
    data = sample(60) + [(2000 + i, "ACGTTGCAACGTAAGG" + "ACGT"[i % 4] * (i % 9)) for i in range(40)]
    df = spark.createDataFrame(data, "read_id long, seq string").repartition(3)
    lookup = assign.salted_lookup
    monkeypatch.setattr(assign, "salted_lookup", lambda *a, **o: lookup(*a, **{**o, "limit": limit}))
    at = assign.popularity(df, 9)
    where = {r["read_id"]: (r["key"], r["off"], r["rc"]) for r in assign.named(at, 9).collect()}
    got = {(r["read_id"], r["key"]): (r["off"], r["rc"], r["score"]) for r in assign.named(assign.overlap_scores(df, at, k=9), 9).collect()}
    assert got == scores(data, where, 9)


@pytest.mark.parametrize("bases,mers", [(3_000_000, 1 << 21), (300, 64)])
def test_overlap_scores_in_blocks(spark, monkeypatch, bases, mers):
    """Reads in one block and in many, over few ranges of mers and many: the scores are those of the plain rule, for
    reads with N, their reverse complements and copies too."""
    monkeypatch.setattr(blocks, "BASES", bases)
    monkeypatch.setattr(blocks, "RANGE", mers)
    data = sample() + [(2000 + i, s) for i, s in sample(20)] + [(5000 + i, rc(s)) for i, s in sample(20)] + [(8000 + i, "ACGTTGCAACGTAAGG" + "ACGT"[i % 4] * (i % 9)) for i in range(40)]
    df = spark.createDataFrame(data, "read_id long, seq string").repartition(3)
    where = popularity(data, 9)
    want = scores(data, where, 9)
    got = {(r["read_id"], r["key"]): (r["off"], r["rc"], r["score"]) for r in assign.named(assign.overlap_scores(df, k=9), 9).collect()}
    assert got == want


@pytest.mark.parametrize("hot", [20_000, 3])
def test_overlap_in_blocks(spark, monkeypatch, hot):
    """Reads delivered twice count once, equal reads go to the same bucket, and one that scores nowhere stays. Copies meet in one task or, beyond `hot`
    rows, in several."""
    monkeypatch.setattr(blocks, "HOT_SEQ", hot)
    data = sample() + [(2000 + i, s) for i, s in sample(20)] + [(8000 + i, "ACGTTGCAACGTAAGG" + "ACGT"[i % 4] * (i % 9)) for i in range(40)]
    df = spark.createDataFrame(data + data[::3], "read_id long, seq string").repartition(3)
    want = popularity(data, 9)
    for (i, key), (off, d, _) in sorted(scores(data, want, 9).items(), key=lambda x: (-x[1][2], x[0][1]), reverse=True):
        want[i] = (key, off, d)
    got = [(r["read_id"], (r["key"], r["off"], r["rc"])) for r in assign.named(assign.overlap(df, 9), 9).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_overlap_scores_shuffle_few_bytes_a_mer(spark):
    """Reads that hardly share a mer: what is shuffled is a few bytes a mer, not a row for each strand of it."""
    rnd = random.Random(7)
    data = [(i, "".join(rnd.choices("ACGT", k=100))) for i in range(4000)]
    df = spark.createDataFrame(data, "read_id long, seq string").repartition(2)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assign.overlap_scores(df).count()
    assert written() - before < 8 * 86 * len(data)


def test_archive_round_trip(spark, rows, reads):
    packed = archive.rotated(reads, assign.popularity(reads, 9), 9)
    assert archive.faults(packed).count() == 0
    want = sorted(((i, "".join(c if c in COMP else "N" for c in s)) for i, s in sample() if len(s) >= 9), key=repr)
    assert rows(packed.select("read_id", archive.sequence())) == want
    placed = archive.placed(packed)
    back = archive.restored(archive.deltas(placed).drop("off"))
    assert rows(back.select("read_id", "off")) == rows(packed.select("read_id", "off"))
    broken = packed.withColumn("off", F.lit(99))
    assert broken.count() == archive.faults(broken).count()
    for column, rule in (("key", "key"), ("off", "offset"), ("body", "offset")):
        assert {r["fault"] for r in archive.faults(packed.withColumn(column, F.lit(None).cast(packed.schema[column].dataType))).collect()} == {rule}


def test_more_than_a_chunk_of_equal_reads(spark):
    df = spark.range(600).select(F.col("id").alias("read_id"), F.lit("ACGTTGCAACGTAAGG").alias("seq"))
    placed = archive.placed(archive.rotated(df, assign.popularity(df)))
    assert sorted(r["n"] for r in placed.groupBy("sub_id").agg(F.count("*").alias("n")).collect()) == [88, 256, 256]
    assert sorted(r["delta"] for r in archive.deltas(placed).select("delta").collect())[:597] == [0] * 597
    assert archive.chunk_faults(placed).collect() == []
    gone = archive.chunk_faults(placed.where("pos <> 300")).collect()
    assert [(r["sub_id"], r["fault"]) for r in gone] == [(1, "range")]
    falls = archive.chunk_faults(placed.withColumn("off", F.when(F.col("pos") == 599, F.col("off") - 1).otherwise(F.col("off")))).collect()
    assert [(r["sub_id"], r["fault"]) for r in falls] == [(2, "order")]
    sizes = placed.groupBy("key").agg(F.count("*").alias("n"))
    assert sorted(r["ordinal"] for r in archive.ordinals(placed, sizes).collect()) == list(range(600))


def test_places_over_partitions(spark, rows):
    """A bucket that fills several partitions, others that end or begin in one, and partitions without a row."""
    rnd = random.Random(2)
    data = [(i, rnd.choice(["AAAA"] * 5 + ["CCCC", "GGGG", "ACGT"]), rnd.randrange(3), "ACGT"[rnd.randrange(4)]) for i in range(500)]
    df = spark.createDataFrame(data, "read_id long, key string, off long, body string")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = rows(archive.placed(df).select("read_id", "pos", "sub_id"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, at = [], {}
    for i, key, _, _ in sorted(data, key=lambda r: (r[1], r[2], r[3], r[0])):
        at[key] = at.get(key, -1) + 1
        want.append((i, at[key], at[key] // 256))
    assert got == sorted(want, key=repr)
    assert archive.placed(df.where("read_id < 0")).collect() == []


def test_onsies(spark, rows, reads):
    a = assign.popularity(reads, 9)
    sizes: dict = {}
    for key, _, _ in popularity(sample(), 9).values():
        sizes[key] = sizes.get(key, 0) + 1
    assert assign.onsies(a).count() == sum(n == 1 for n in sizes.values())
    assert assign.without_onsies(a).count() == sum(n for n in sizes.values() if n > 1)
    moved = assign.overlap(reads, 9, movers="onsies")
    assert moved.count() == a.count()


def test_set_cover(spark, reads):
    posts = cover.postings(reads, 9)
    lists: dict = {}
    for i, s in sample():
        for p in range(len(s) - 8):
            if set(s[p : p + 9]) <= set(COMP):
                lists.setdefault(s[p : p + 9], set()).add(i)
    assert posts.count() == sum(map(len, lists.values()))
    want = {}
    while any(lists.values()):
        best = min(lists, key=lambda m: (-len(lists[m]), m))
        for i in list(lists[best]):
            want[i] = best
            for v in lists.values():
                v.discard(i)
    got = {r["read_id"]: r["key"] for r in assign.named(cover.set_cover(posts), 9).collect()}
    assert got == want


def test_paths(spark, rows):
    links = [(1, 2), (2, 3), (3, 4), (5, 5), (6, 7), (7, 8), (8, 6), (9, 6), (10, 11), (10, 12), (20, 21)]
    nodes = sorted({x for e in links for x in e} | {99})
    n, e = spark.createDataFrame([(x,) for x in nodes], "kmer long"), spark.createDataFrame(links, "src long, dst long")
    got = rows(graph.collapsed_paths(n, e))
    assert got == sorted([(1, 4, 4), (9, None, None), (6, None, None), (20, 21, 2)], key=repr)
    assert (99, 0, 0) in rows(graph.degrees(n, e))


def test_partition_saves_most():
    rnd = random.Random(3)
    rows = sorted(("".join(rnd.choice("AC") for _ in range(12)), 0) for _ in range(9))
    core = 4

    def cost(a, b):
        p = min((common_prefix(rows[b][0], rows[j][0], 99) for j in range(a, b)), default=0)
        return (b - a) * -(-(core + p) // 4) - 2

    def best(i):
        return 0 if i < 0 else max(cost(j, i) + best(j - 1) for j in range(i + 1))

    got = list(best_ranges(rows, core))
    assert sum(cost(a, b) for a, b, _ in got) == best(len(rows) - 1)
    assert [a for a, _, _ in got] == [0, *(b + 1 for _, b, _ in got[:-1])] and got[-1][1] == len(rows) - 1
    assert list(best_ranges([], core)) == [] and list(best_ranges(rows, core, compat=True))


def test_running_prefix(spark, rows):
    bodies = {"A": ["AAAC", "AACC", "AACG", "C", "CA"], "B": ["G"], "C": [""] * 4}
    df = spark.createDataFrame([(k, i, 0, b) for k, bs in bodies.items() for i, b in enumerate(bs)], "key string, pos long, off long, body string")
    shared = lambda x: min(common_prefix(x[-1], y, 99) for y in x[:-1])
    want = [(k, i, m, shared(bs[i - m : i + 1])) for k, bs in bodies.items() for i in range(len(bs)) for m in range(1, min(i, 3) + 1)]
    assert rows(running_prefix(df, 3)) == sorted(want, key=repr)


def test_release(spark, tmp_path):
    from seqbucket.session import materialize, release

    df = materialize(spark.range(3), "x")
    path = df.inputFiles()[0]
    release(df, spark.range(1))
    assert not __import__("os").path.exists(path.removeprefix("file://"))


def test_shared_dir_on_a_cluster():
    from types import SimpleNamespace as N

    from seqbucket.session import shared_dir

    conf = N(get=lambda *_: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(N(sparkContext=N(master="spark://a:7077", getConf=lambda: conf), conf=conf))


def test_the_largest_task_of_a_hot_key(spark):
    """A key holds a third of the rows: after the lookup no task has more than a few times its even part."""
    n, parts = 60_000, 16
    df = spark.range(n).select(F.col("id").alias("read_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("key"))
    keyed = df.groupBy("key").agg(F.count("*").alias("n"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(before, ("false", str(parts), "-1")):
            spark.conf.set(c, v)
        found = salted_lookup(df, keyed, "key", "n", "read_id", limit=500)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and max(sizes) < 2 * n / parts
        places = df.select("read_id", "key", F.lit(0).alias("pos"))
        numbered = archive.ordinals(places, keyed)
        assert numbered.count() == n
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_libraries(spark):
    assert library.MAX_ID == max(k | o << 1 | s << 3 for k in (0, 1) for o in range(4) for s in range(5))
    numbers = {"IU": 37, "ISF": 5, "ISR": 13, "U": 38, "OU": 35, "OSF": 3, "OSR": 11, "SF": 22, "MU": 33, "MSF": 17, "MSR": 25, "SR": 30}
    df = spark.createDataFrame([(n.lower(),) for n in numbers] + [("zz",), (None,)], "n string")
    parts = library.lib_type(F.col("n")), library.orientation(F.col("n")), library.strandedness(F.col("n"))
    got = {r[0]: r[1:] for r in df.select("n", library.format_id(*parts), library.is_valid(*parts), library.described(*parts)).collect()}
    assert {n: got[n.lower()][0] for n in numbers} == numbers and got["zz"][0] is None and got[None][0] is None
    assert all(got[n.lower()][1] for n in numbers) and got["isf"][2] == "paired,toward,SA"
    with pytest.raises(ValueError):
        library.parse("XX")


def test_empty(spark):
    df = spark.createDataFrame([], "read_id long, seq string")
    a = assign.popularity(df)
    assert a.collect() == [] and archive.placed(archive.rotated(df, a)).collect() == []
    assert cover.set_cover(cover.postings(df, 15)).collect() == []


def test_graph_and_postings_of_all_mers(spark, rows, tmp_path):
    data = [(1, "ACGTTGCAACGTTGCATGCCA"), (2, "acgttgcaacgttgcatg"), (3, "TTGACCANGTACGATTACAGGATCCA"), (4, "ACG"), (5, "ACGTTGCAACGTTGCAAC"), (6, None)]
    df = spark.createDataFrame(data, "read_id long, seq string")
    df.selectExpr("read_id", "1L run_no", "'U' lib_name", "read_id ordinal", "1 mate", "'' header", "seq", "'' qual").write.parquet(f"{tmp_path}/reads.parquet")
    mers = {i: {s.upper()[p : p + 15] for p in range(len(s) - 14)} for i, s in data if s}
    mers = {i: {m for m in ms if set(m) <= set(COMP)} for i, ms in mers.items()}
    posts = {m: sum(m in ms for ms in mers.values()) for m in set().union(*mers.values())}
    links = {a: [a[1:] + b for b in "ACGT" if a[1:] + b in posts] for a in posts}
    n_in = {m: sum(m in to for to in links.values()) for m in posts}
    assert 1 in posts.values() and max(posts.values()) > 1
    q = lambda name: queries.QUERIES[name](spark, str(tmp_path))
    assert rows(q("q_postings")) == sorted(posts.items(), key=repr)
    assert rows(q("q_dbg_edges").select("src", "dst")) == sorted([(a, b) for a, to in links.items() for b in to], key=repr)
    assert q("q_dbg_degrees").agg(F.sum("n")).collect()[0][0] == len(posts)
    starts = [m for m in posts if n_in[m] != 1 and len(links[m]) == 1]
    assert rows(q("q_dbg_path_starts")) == sorted([(m,) for m in starts], key=repr)

    def end(m):
        size = 1
        while len(links[m]) == 1 and size <= len(posts):
            m, size = links[m][0], size + 1
        return (m, size) if size <= len(posts) else (None, None)

    assert rows(q("q_dbg_paths").select("start", "stop", "n_nodes")) == sorted([(m, *end(m)) for m in starts], key=repr)


def test_sequential_rule_over_all_reads(spark, tmp_path):
    """As many reads as once went to two shards: the registered query gives what the rule gives, a read at a time."""
    rnd = random.Random(5)
    genome = "".join(rnd.choice("ACGT") for _ in range(3000))
    data = []
    for i in range(4200):
        a = rnd.randrange(2960)
        s = [rnd.choice("ACGT") if rnd.random() < 0.02 else c for c in genome[a : a + 40]]
        data.append((i, rc(s) if i % 2 else "".join(s)))
    df = spark.createDataFrame(data, "read_id long, seq string").repartition(5)
    df.selectExpr("read_id", "1L run_no", "'U' lib_name", "read_id ordinal", "1 mate", "'' header", "seq", "'' qual").write.parquet(f"{tmp_path}/reads.parquet")
    want = {(i, *x) for i, x in in_order(data, 15).items()}
    got = {tuple(r) for r in queries.q_assign_fold(spark, str(tmp_path)).select("read_id", "key", "off", "rc").collect()}
    assert got == want


def test_partition_over_block_borders(spark):
    rnd = random.Random(4)
    bodies = {k: sorted("".join(rnd.choice("AC") for _ in range(12)) for _ in range(n)) for k, n in (("A", 100), ("B", 37), ("C", 1))}
    df = spark.createDataFrame([(k, i, 0, b) for k, bs in bodies.items() for i, b in enumerate(bs)], "key string, pos long, off long, body string")
    for block in (5, 16):
        got = sorted(tuple(r) for r in partition(df, 4, block=block, window=6).collect())
        assert all(bodies[k][i][:p] == bodies[k][a][:p] for k, _, a, b, p in got for i in range(a, b + 1))
        assert got == [(k, a // block, a, b, p) for k, bs in bodies.items() for a, b, p in best_ranges([(x, 0) for x in bs], 4, 6)]
    assert any(a // 16 != b // 16 for _, _, a, b, _ in got)
