"""FASTA and FASTQ files: layouts, mates, errors, the command line, the stream."""

import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seqbucket import cli
from seqbucket.operators import blocks
from seqbucket.sources import fastx
from seqbucket.sources.fastx import FastxError, FastxSource, parse
from seqbucket.streaming import arrivals


def test_layouts():
    assert list(parse(iter([">a b\n", "AC\n", "GT\r\n", ">c\n", ">d\n", "A"]))) == [("a b", "ACGT", None), ("c", "", None), ("d", "A", None)]
    assert list(parse(iter(["@a\n", "AC\n", "GT\n", "+\n", "@+\n", "II\n", "\n", "@b\n", "\n", "+b\n", "\n"]))) == [("a", "ACGT", "@+II"), ("b", "", "")]
    assert list(parse(iter([]))) == [] and list(parse(iter(["\n"]))) == []


@pytest.mark.parametrize("lines,what", [(["@a", "AC"], "ends inside"), (["@a", "AC", "+", "I"], "ends inside"), (["@a", "AC", "+", "III"], "qualities"), (["@a", "A", "+", "I", "x"], "header missing")])
def test_errors(lines, what):
    with pytest.raises(FastxError, match=what):
        list(parse(iter(lines)))


def test_split_scan(spark, rows, tmp_path):
    (tmp_path / "a.fa").write_text(">x 1\nAC\nGT\n>y\n\n>z\nNN")
    (tmp_path / "empty.fa").write_text("")
    got = rows(fastx.read_fasta(spark, str(tmp_path)).select("header", "seq"))
    assert got == [("x 1", "ACGT"), ("y", ""), ("z", "NN")]


def test_round_trips(spark, rows, tmp_path):
    df = spark.createDataFrame([(f"r{i}", "ACGT" * (i % 40), "I" * 4 * (i % 40)) for i in range(100)], "header string, seq string, qual string").repartition(3)
    fa = fastx.write_fasta(df, str(tmp_path / "fa"), width=60)
    assert rows(fastx.read_fasta(spark, fa).select("header", "seq")) == rows(df.select("header", "seq"))
    fq = fastx.write_fastq(df, str(tmp_path / "fq"))
    assert rows(fastx.read_fastq(spark, fq).select("header", "seq", "qual")) == rows(df)


def test_mates_and_compressed_files(spark, rows, tmp_path):
    with gzip.open(tmp_path / "1.fq.gz", "wt") as f:
        f.write("@a/1\nAA\n+\nII\n@b/1\nCC\n+\nII\n")
    (tmp_path / "2.fq").write_text("@a/2\nGG\n+\nII\n")
    spark.dataSource.register(FastxSource)
    load = lambda **o: spark.read.format("fastx").options(path2=str(tmp_path / "2.fq"), **o).load(str(tmp_path / "1.fq.gz"))
    assert rows(load().select("ordinal", "mate", "seq")) == [(0, 1, "AA"), (0, 2, "GG")]
    with pytest.raises(Exception, match="different numbers"):
        load(strict="true").collect()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("fastx").load(str(tmp_path / "nowhere")).collect()


def test_command_line(spark, rows, tmp_path):
    a, b, out = (str(tmp_path / x) for x in ("1.fa", "2.fa", "out"))
    first, second = ["ACGTACGTACGTACGTACGNTT", "TTGACCATTGACCAGGTACCAT"], ["GGGTTTACACGATTACAGATTACA", "CCATACCATGGTACCATAGGTACA"]
    for path, seqs in ((a, first), (b, second)):
        with open(path, "w") as f:
            f.write("".join(f">r{i}\n{s}\n" for i, s in enumerate(seqs)))
    cli.encode(spark, a, out, path2=b, lib="IU")
    cli.decode(spark, out, out + "d")
    for n, want in ((1, first), (2, second)):
        assert sorted(r["seq"] for r in fastx.read_fasta(spark, f"{out}d_{n}").collect()) == sorted(want)
    cli.encode(spark, a, out + "s")
    cli.decode(spark, out + "s", out + "t")
    assert cli.canonical_diff(cli.load(spark, a), cli.load(spark, out + "t")).count() == 0
    assert cli.canonical_diff(cli.load(spark, a), cli.load(spark, b)).count() == 4
    assert [r["seq"] for r in cli.canonicalize(cli.load(spark, a)).collect()] == ["AAACGTACGTACGTACGTACGT", "ATGGTACCTGGTCAATGGTCAA"]
    names = lambda p: sorted(r["header"] for r in fastx.read_fasta(spark, p).collect())
    assert names(out + "t") == ["0", "1"] and names(f"{out}d_1") == ["0/1", "1/1"]
    with pytest.raises(ValueError, match="fewer than"):
        cli.encode(spark, a, out + "x", k=25)


@pytest.mark.parametrize("end", ["", "\n", "\n\n\n"])
def test_four_line_files_are_split(spark, rows, tmp_path, end):
    """Every range gives the records that begin in it, wherever it is cut; qualities may begin with @ or +."""
    import io

    records = [(f"r{i} @x", "ACGT" * (i % 5), "@+@I" * (i % 5)) for i in range(40)]
    text = "\r\n".join(f"@{h}\r\n{s}\r\n+{h if i % 2 else ''}\r\n{q}" for i, (h, s, q) in enumerate(records)) if end == "" else "\n".join(f"@{h}\n{s}\n+\n{q}" for h, s, q in records) + end
    data = text.encode()
    for size in (1, 7, 64, 1000, len(data)):
        got, places = [], []
        for a in range(0, len(data), size):
            for b in fastx.four_line_records(io.BytesIO(data), a, min(len(data), a + size)):
                got += list(zip(*(b.column(n).to_pylist() for n in ("header", "seq", "qual"))))
                places += b.column("ordinal").to_pylist()
        if records[-1][1] or end:
            assert got == records and places == sorted(set(places)) and all(data[p : p + 2] == b"@r" for p in places)
    (tmp_path / "a.fq").write_bytes(data)
    with gzip.open(tmp_path / "b.fq.gz", "wb") as f:
        f.write(data if end != "\n\n\n" else data.rstrip(b"\n") + b"\n")
    df = fastx.read_fastq(spark, str(tmp_path), four_lines=True, split_bytes=300)
    assert rows(df.select("header", "seq", "qual")) == sorted(records * 2, key=repr)
    assert df.rdd.getNumPartitions() > 2
    assert rows(fastx.line_modulo(spark, str(tmp_path / "a.fq"), 3, 300).select("line")) == sorted([(q,) for _, _, q in records], key=repr)


@pytest.mark.parametrize("text,what", [("@a\nAC\n+\nI\n", "qualities"), ("@a\nAC\n+\n", "ends inside"), ("a\nAC\n+\nII\n", "header missing"), ("@a\nAC\nGT\n+\nII\nII\n", "qualities|ends inside")])
def test_files_that_break_the_four_lines(text, what):
    import io

    with pytest.raises(FastxError, match=what):
        list(fastx.four_line_records(io.BytesIO(text.encode()), 0, len(text)))


def test_stream(spark, rows, tmp_path):
    src = str(tmp_path / "reads")
    df = spark.createDataFrame([(i, i % 2, "ACGTACGTACGTACGTA" if i % 3 else None) for i in range(20)], "read_id long, run_no int, seq string")
    df.withColumn("loaded_at", F.expr("timestamp'2025-01-01' + make_interval(0, 0, 0, cast(read_id % 3 as int))")).repartition(4).write.parquet(src)
    stream = arrivals.window_counts(arrivals.arriving(spark, src, 1))
    counts = arrivals.run_to_end(stream, str(tmp_path / "o"), str(tmp_path / "c"), ["window_start", "run_no"])
    assert sum(r["n"] for r in counts.collect()) == 20 and counts.count() == 6
    mers = arrivals.run_to_end(arrivals.mer_counts(arrivals.arriving(spark, src, 1)), str(tmp_path / "p"), str(tmp_path / "q"), ["window_start", "gram"])
    assert sum(r["n"] for r in mers.collect()) == 13 * 3
    assert len(list((tmp_path / "o").glob("batch=*"))) >= 4
    # what comes later is added to what is there, and the rest isn't written again
    df.limit(4).withColumn("loaded_at", F.expr("timestamp'2025-01-01'")).coalesce(1).write.mode("append").parquet(src)
    counts = arrivals.run_to_end(stream, str(tmp_path / "o"), str(tmp_path / "c"), ["window_start", "run_no"])
    assert sum(r["n"] for r in counts.collect()) == 24 and counts.count() == 6


@pytest.mark.parametrize("bases,mers", [(3_000_000, 1 << 21), (50, 8)])
def test_mer_counts_of_a_stream(spark, rows, tmp_path, monkeypatch, bases, mers):
    """Every delivery counts, however late it is and over whatever batches a window comes; there is no state. k is odd and even, above and below 5."""
    monkeypatch.setattr(blocks, "BASES", bases)
    monkeypatch.setattr(blocks, "RANGE", mers)
    texts = ["ACGTNACGTACGTTT", "acgt acgt\tttt", "AC", "", None, "A" * 20, "NNNNNNNNNNNN", "ACGTRACGTACCCTTTACGA"]
    days = ["2025-06-01", "2025-06-02", "2025-01-01", "2025-06-02"]
    data = [(i, texts[i % 8], f"{days[i // 10]} 0{i % 10}:00:00" if i % 13 else None) for i in range(40)]
    src = str(tmp_path / "reads")
    for part in range(4):
        df = spark.createDataFrame(data[part * 10 : part * 10 + 10], "read_id long, seq string, at string")
        df.select("read_id", "seq", F.col("at").cast("timestamp").alias("loaded_at")).coalesce(1).write.mode("append").parquet(src)
    for k in (15, 8, 3):
        want: dict = {}
        for _, s, at in data:
            s = "".join((s or "").upper().split())
            for g in (s[p : p + k] for p in range(len(s) - k + 1)) if at else ():
                if set(g) <= set("ACGT"):
                    want[at[:10], g] = want.get((at[:10], g), 0) + 1
        stream = arrivals.mer_counts(arrivals.arriving(spark, src, 1), k)
        counts = arrivals.run_to_end(stream, str(tmp_path / f"o{k}"), str(tmp_path / f"c{k}"), ["window_start", "gram"])
        assert [n for n, _ in counts.dtypes] == ["window_start", "gram", "n"]
        assert rows(counts) == sorted([(datetime.fromisoformat(d), g, n) for (d, g), n in want.items()], key=repr)
        assert len(list((tmp_path / f"o{k}").glob("batch=*"))) == 4 and not list((tmp_path / f"c{k}").glob("state/*"))


def test_closed_windows_leave_the_state(spark, tmp_path):
    src = tmp_path / "reads"
    for i, day in enumerate(("2025-01-01", "2025-03-01", "2025-05-01", "2025-07-01")):
        df = spark.createDataFrame([(i, 1, "ACGT")], "read_id long, run_no int, seq string")
        df.withColumn("loaded_at", F.lit(day).cast("timestamp")).coalesce(1).write.mode("append").parquet(str(src))
    counts = arrivals.window_counts(arrivals.arriving(spark, str(src), 1), late="1 day")
    query = counts.writeStream.outputMode("update").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_libraries_of_the_command_line(spark, rows, tmp_path, capsys):
    a, b, out = (str(tmp_path / x) for x in ("1.fa", "2.fa", "out"))
    for p, seq in ((a, "ACGTACGTACGTACGTACGG"), (b, "TTTGACCATTGACCAGGTAC")):
        with open(p, "w") as f:
            f.write(f">r\n{seq}\n")
    assert cli.main(["encode", "-l", "IU", "-1", a, "-2", b, "-o", out]) == 0
    assert spark.read.parquet(out).count() == 1
    assert cli.main(["encode", "-i", a, "-2", b, "-o", out + "i"]) == 0 and spark.read.parquet(out + "i").first()["len1"] == 20
    assert cli.main(["encode", "-l", "IU", "-1", a, "-2", b, "-l", "U", "-r", a, "-o", out + "x"]) == 2
    assert "just one read library" in capsys.readouterr().err
    assert cli.main(["encode", "-o", out + "x"]) == 2 and cli.main(["encode", "-l", "IU", "-1", a, "-o", out + "x"]) == 2
    assert cli.main(["merge", "-l", "MU", "-1", a, "-2", b, "-l", "U", "-r", a, "-l", "IU", "-1", a, "-2", b, "-o", out + "m"]) == 0
    assert fastx.read_fasta(spark, out + "m").count() == 2
    assert cli.main(["merge", "-r", a, "-o", out + "n"]) == 2
    for k in ("0", "32"):
        with pytest.raises(SystemExit):
            cli.main(["encode", "-i", a, "-b", k, "-o", out + "k"])


def test_libraries(spark, rows, tmp_path):
    from seqbucket.sources.libraries import ReadLibrary, from_options, listing

    a, b = (str(tmp_path / x) for x in ("a.FA", "b.fa"))
    for p in (a, b):
        with open(p, "w") as f:
            f.write(">r\nACGT\n")
    libs = from_options([("r", ["x.fa"]), ("l", ["ou"]), ("1", ["old"]), ("1", [a]), ("2", [b]), ("l", ["sf"])])
    assert libs == [ReadLibrary(None, unmated=["x.fa"]), ReadLibrary("ou", [a], [b])]
    assert libs[0].format_name == "U" and len(libs[0].faults()) == 1
    assert str(libs[0]) == "U: x.fa" and str(libs[1]) == f"OU: ({a}, {b})"
    assert rows(libs[1].load(spark).select("lib_name", "mate", "seq")) == [("OU", 1, "ACGT"), ("OU", 2, "ACGT")]
    assert len(ReadLibrary("IU", [a], []).faults()) == 1 and len(ReadLibrary("U", [], [], [str(tmp_path)]).faults()) == 2
    with pytest.raises(ValueError, match="no such file"):
        libs[0].load(spark)
    assert rows(listing(spark, str(tmp_path), r"\.fa$").select("name", "length")) == [("b.fa", 8)]
