"""Queries of the general training-data operators over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbucket.functions.kmer import mer_key
from seqbucket.operators import parse, skew
from seqbucket.session import materialize, table

KEY_SQL = """CASE WHEN regexp_full_match(mer, '[ACGTacgt]{15}')
  THEN least(upper(mer), translate(reverse(upper(mer)), 'ACGT', 'TGCA')) END"""


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_records(table(spark, d, "raw_records"), "raw_id", "payload")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that fail, with the first reason; a redelivered row counts once."""
    return parse.failed(_parsed(spark, d), "raw_id").select("raw_id", "reason").distinct()


def p3_errors(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that fail, with the reason and the place of the error, in characters from 0."""
    return parse.failed(_parsed(spark, d), "raw_id").select("raw_id", "reason", "error_pos").distinct()


def p3_exports(spark: SparkSession, d: str) -> DataFrame:
    """(file_name, n_valid, n_failed): the lines of each export read as one text, block by block, without knowing where its records begin."""
    blocks = parse.exports(table(spark, d, "raw_records"), "file_name", "line_no", "payload").withColumn("block_id", F.xxhash64("file_name", "block"))
    blocks = materialize(blocks, "exports")
    found = parse.parse_records(blocks, "block_id", "text", single=False).groupBy("block_id").agg(F.count_if(F.col("reason").isNull()).alias("n_valid"), F.count_if(F.col("reason").isNotNull()).alias("n_failed"))
    return blocks.select("block_id", "file_name").join(found, "block_id").groupBy("file_name").agg(F.sum("n_valid").alias("n_valid"), F.sum("n_failed").alias("n_failed"))


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return parse.valid(_parsed(spark, d), "raw_id").drop("record_no").distinct()


def _postings(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a key. Repeats of a row add no new pair and need no removal."""
    return table(spark, d, "postings").select("post_id", mer_key(F.col("mer")).alias("mer"), "rlist").where("mer is not null")


def p6_reads(spark: SparkSession, d: str) -> DataFrame:
    """For every key the number of different reads in all its rlist values."""
    return skew.distinct_per_key(_postings(spark, d), "mer", "rlist", "post_id").withColumnRenamed("n_items", "n_reads")


def p6_lists(spark: SparkSession, d: str) -> DataFrame:
    """The reads of every key, in parts of about 4096."""
    t = skew.items_per_key(_postings(spark, d), "mer", "rlist", "post_id")
    return t.select("mer", "part", "parts", F.array_join(F.col("items").cast("array<string>"), ",").alias("reads"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The keys to which at least 1 % of all distinct (key, read id) pairs belong."""
    return skew.heavy_keys(p6_reads(spark, d), "mer", "n_reads")


QUERIES = {f.__name__: f for f in (p3_found, p3_errors, p3_exports, p3_loaded, p6_found, p6_lists, p6_reads)}

_COL = '"(?:[^"]|"")*"|[^",]*'
_UNQUOTE = "CASE WHEN starts_with({0}, '\"') THEN replace(substr({0}, 2, length({0}) - 2), '\"\"', '\"') ELSE {0} END"
_PARSED_SQL = f"""
WITH raw AS (SELECT DISTINCT raw_id, payload FROM raw_records),
cut AS (
  SELECT raw_id, payload,
    regexp_full_match(payload, '(?:{_COL})(?:,(?:{_COL}))*') AS quotes_ok,
    regexp_full_match(payload, '(?:{_COL})(?:,(?:{_COL})){{3}}') AS four,
    {", ".join(f"regexp_extract(payload, '^({_COL}),({_COL}),({_COL}),({_COL})$', {i}) AS c{i}" for i in range(1, 5))}
  FROM raw),
cols AS (SELECT raw_id, payload, quotes_ok, four, {", ".join(f"{_UNQUOTE.format(f'c{i}')} AS {n}" for i, n in enumerate(("stream_type", "header", "seq", "qual"), 1))} FROM cut),
judged AS (
  SELECT raw_id, payload, stream_type, header, seq, qual, CASE
    WHEN payload IS NULL OR payload = '' THEN 'columns'
    WHEN NOT quotes_ok THEN 'quoting'
    WHEN NOT four THEN 'columns'
    WHEN stream_type NOT IN ('FASTA_TYPE', 'FASTQ_TYPE') THEN 'stream_type'
    WHEN NOT regexp_matches(header, CASE stream_type WHEN 'FASTA_TYPE' THEN '^>[^\\s]' ELSE '^@[^\\s]' END) THEN 'header'
    WHEN stream_type = 'FASTA_TYPE' AND qual <> '' THEN 'qual'
    WHEN stream_type = 'FASTQ_TYPE' AND (length(regexp_replace(qual, '[\\r\\n]', '', 'g')) <> length(regexp_replace(seq, '[\\r\\n]', '', 'g'))
      OR NOT regexp_full_match(regexp_replace(qual, '[\\r\\n]', '', 'g'), '[!-~]*')) THEN 'qual' END AS reason
  FROM cols)
"""
_ERROR_SQL = f"""
, whole AS (SELECT raw_id, reason, coalesce(payload, '') AS t, regexp_extract(coalesce(payload, ''), '^(?:(?:{_COL}),)*') AS done FROM judged),
rest AS (SELECT *, substr(t, length(done) + 1) AS tail, regexp_extract_all(done, '(?:{_COL}),') AS cols FROM whole WHERE reason IS NOT NULL)
SELECT raw_id, reason, CAST(CASE reason
  WHEN 'quoting' THEN length(done) + CASE WHEN starts_with(tail, '"') THEN length(regexp_extract(tail, '^"(?:[^"]|"")*"')) ELSE length(regexp_extract(tail, '^[^",]*')) END
  WHEN 'columns' THEN coalesce(list_sum(list_transform(cols[1:4], lambda x: length(x))), 0)
  WHEN 'header' THEN length(cols[1]) WHEN 'qual' THEN length(done) ELSE 0 END AS BIGINT) AS error_pos FROM rest
"""
_READS_SQL = f"""
WITH pairs AS (SELECT DISTINCT key, id FROM (SELECT {KEY_SQL} AS key, unnest(rlist) AS id FROM postings) WHERE key IS NOT NULL AND id IS NOT NULL)
"""
SQL = {
    "p3_found": _PARSED_SQL + "SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_errors": _PARSED_SQL + _ERROR_SQL,
    "p3_loaded": _PARSED_SQL + "SELECT raw_id, stream_type, header, seq, qual FROM judged WHERE reason IS NULL",
    "p6_lists": _READS_SQL
    + """, parted AS (SELECT key, id, CAST(ceil(count(*) OVER (PARTITION BY key) / 4096.0) AS BIGINT) AS parts FROM pairs),
hashed AS (SELECT *, CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % parts AS part FROM parted)
SELECT key AS mer, part, parts, string_agg(id, ',' ORDER BY id) AS reads FROM hashed GROUP BY key, part, parts""",
    "p6_reads": _READS_SQL + "SELECT key AS mer, count(*) AS n_reads FROM pairs GROUP BY key",
    "p6_found": _READS_SQL + "SELECT key AS mer FROM pairs GROUP BY key HAVING count(*) * 100 >= (SELECT count(*) FROM pairs)",
}
