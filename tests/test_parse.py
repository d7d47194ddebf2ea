"""Parsing of export records: reasons, edge cases, recovery."""

import pytest
from pyspark.sql import functions as F

from seqbucket.operators.parse import Grammar, exports, failed, parse_records, valid

CASES = [
    ("FASTA_TYPE,>a,ACGT,", None),
    ('"FASTA_TYPE",">a, ""b""","AC\nGT",""', None),
    ("FASTQ_TYPE,@a,AC\r\nGT,II\nII", None),
    ("FASTQ_TYPE,@a,,", None),
    ("FASTA_TYPE,>a,ACGT", "columns"),
    ("FASTA_TYPE,>a,ACGT,,", "columns"),
    ("", "columns"),
    (None, "columns"),
    ('FASTA_TYPE,>a"b,ACGT,', "quoting"),
    ('FASTA_TYPE,">a,ACGT,', "quoting"),
    ('FASTA_TYPE,">a" ,ACGT,', "quoting"),
    ('x,"', "quoting"),
    ("fasta_type,>a,ACGT,", "stream_type"),
    (" FASTA_TYPE,>a,ACGT,", "stream_type"),
    ("FASTA_TYPE,@a,ACGT,", "header"),
    ("FASTA_TYPE,>,ACGT,", "header"),
    ("FASTQ_TYPE,@ a,ACGT,IIII", "header"),
    ("FASTQ_TYPE,@a,ACGT,III", "qual"),
    ("FASTQ_TYPE,@a,ACGT,III I"[:-1] + "I", "qual"),
    ("FASTQ_TYPE,@a,ACGT,III\x7f", "qual"),
    ("FASTA_TYPE,>a,ACGT,I", "qual"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, p, "clash", "clash") for i, (p, _) in enumerate(CASES)], "raw_id long, payload string, reason string, seq string")
    out = parse_records(df, "raw_id", "payload")
    got = {r["raw_id"]: r["reason"] for r in out.collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    good = {r["raw_id"]: (r["header"], r["seq"], r["qual"]) for r in valid(out, "raw_id").collect()}
    assert good[1] == ('>a, "b"', "AC\nGT", "")
    places = {r["raw_id"]: r["error_pos"] for r in failed(out, "raw_id").collect()}
    assert places[8] == 13 and places[14] == 11 and places[17] == 19


def test_empty_table(spark):
    df = spark.createDataFrame([], "raw_id long, payload string")
    assert parse_records(df, "raw_id", "payload").collect() == []


def read(text, starts=None):
    return [(r.reason, r.columns if not r.reason else text[r.start : r.end]) for r in Grammar(text, starts).records()]


def test_recovers_at_the_next_record():
    text = 'FASTA_TYPE,>a,AC,\nFASTQ_TYPE,"@b,GG,II\nFASTA_TYPE,">c, x",GT,\n\nFASTQ_TYPE,@d,A,I\n'
    assert read(text) == [
        (None, ["FASTA_TYPE", ">a", "AC", ""]),
        ("quoting", 'FASTQ_TYPE,"@b,GG,II'),
        (None, ["FASTA_TYPE", ">c, x", "GT", ""]),
        ("columns", ""),
        (None, ["FASTQ_TYPE", "@d", "A", "I"]),
    ]


def test_anchors_are_parsed_before_they_count():
    """What follows the first line break only looks like a record; the header after the second begins with a comma."""
    text = 'FASTQ_TYPE,"@b,GG,II\nFASTA_TYPE,>c\nFASTA_TYPE,">,x",AC,\nFASTA_TYPE,>d"e,A,'
    assert read(text) == [("quoting", 'FASTQ_TYPE,"@b,GG,II\nFASTA_TYPE,>c'), (None, ["FASTA_TYPE", ">,x", "AC", ""]), ("quoting", 'FASTA_TYPE,>d"e,A,')]


def test_a_block_resumes_at_its_records():
    """An open quote doesn't reach into the next record, whatever stands there; each text is one row in its place."""
    texts = [p for p, _ in CASES if p]
    starts = [sum(map(len, texts[:i])) for i in range(len(texts))]
    got = [reason for reason, _ in read("".join(texts), starts)]
    assert got == [want for p, want in CASES if p]
    assert read("", []) == []


def test_exports(spark, rows):
    lines = ["FASTA_TYPE,>a,AC,", 'FASTQ_TYPE,"@b,GG,II', 'FASTA_TYPE,">c, x",GT,', None, "", "x"]
    df = spark.createDataFrame([(f, i, t, "x") for f in ("f", None) for i, t in enumerate(lines * 100)] + [("f", 0, lines[0], "x")], "file_name string, line_no long, payload string, text string")
    blocks = exports(df, "file_name", "line_no", "payload", lines=7)
    assert all(r["text"].count("\n") < 7 for r in blocks.collect())
    found = parse_records(blocks.withColumn("id", F.col("block")), "id", "text", single=False)
    assert rows(found.groupBy("reason").count()) == sorted([("columns", 100), ("quoting", 100), (None, 200)], key=repr)


@pytest.mark.parametrize("size", [100_000])
def test_very_long_text(spark, size):
    df = spark.createDataFrame([(1, "FASTQ_TYPE,@a," + "A" * size + "," + "I" * size), (2, '"' * (2 * size + 1))], "raw_id long, payload string")
    got = {r["raw_id"]: r["reason"] for r in parse_records(df, "raw_id", "payload").select("raw_id", "reason").collect()}
    assert got == {1: None, 2: "quoting"}


def test_null_ids_and_repeated_rows(spark, rows):
    df = spark.createDataFrame([(None, "x"), (1, "x"), (1, "x")], "raw_id long, payload string")
    assert rows(failed(parse_records(df, "raw_id", "payload"), "raw_id").select("raw_id", "reason")) == [(1, "columns"), (1, "columns"), (None, "columns")]
