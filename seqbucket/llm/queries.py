"""Queries of the llm operators over the tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbucket.functions.kmer import mer_code, mer_key
from seqbucket.llm import collapse, frequent, leak, seen, spans, tokenize, truncated
from seqbucket.plans.problems import KEY_SQL
from seqbucket.session import table


def _arrivals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    """Records in order of entry_id, keys known before, and about how many rows both have."""
    records, known = table(spark, d, "mer_counts"), table(spark, d, "known_mers")
    code = mer_code(mer_key(F.col("mer"))).alias("key")
    rows = records.count() + known.count()
    return records.select(F.col("entry_id").alias("order_id"), code).where("key is not null"), known.select(code).where("key is not null"), rows


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of mer_counts whose key is in known_mers or in an earlier record."""
    records, known, rows = _arrivals(spark, d)
    return seen.seen_before(records, seen.build(known, rows), rows).withColumnRenamed("order_id", "entry_id")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often the sets answer wrongly, in theory and as audited over all first occurrences, at three sizes of the
    target range; p1_found takes the last."""
    records, known, rows = _arrivals(spark, d)
    found = [seen.error_rates(records, known, rows, bits=bits) for bits in (8, 16, seen.BITS)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def p1_keys(spark: SparkSession, d: str) -> DataFrame:
    """(keys, asked, wrong): different keys that the sets hold, first occurrences among the records, and those answered `seen`."""
    return seen.error_rates(*_arrivals(spark, d)).select("keys", "asked", "wrong")


def _kinds(spark: SparkSession, d: str, f: Callable[..., DataFrame]) -> DataFrame:
    """f of the values of reads.seq by their reads, and of the keys of postings by the sum of cnt."""
    reads = f(table(spark, d, "reads"), "read_id", "seq")
    mers = f(table(spark, d, "postings").withColumn("key", mer_key(F.col("mer"))), "post_id", "key", "cnt")
    return reads.select(F.lit("seq").alias("kind"), "*").unionByName(mers.select(F.lit("cnt").alias("kind"), "*"))


def p2_bounds(spark: SparkSession, d: str) -> DataFrame:
    """(kind, item, n, n_low, n_high, sure): the 20 seq values of most reads, and the 20 keys with the largest
    sum of postings.cnt, with exact weights, the summary's bounds, and whether these are the heaviest for sure."""
    return _kinds(spark, d, frequent.top)


def p2_top(spark: SparkSession, d: str) -> DataFrame:
    return p2_bounds(spark, d).select("kind", "item", "n", "sure")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_bounds(spark, d).select("kind", "item")


def p2_heavy(spark: SparkSession, d: str) -> DataFrame:
    """(kind, item, n): all items that hold more than a thousandth of the weight of all deliveries."""
    return _kinds(spark, d, frequent.above)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Maximal runs of characters of seq that lie in 64 or more shared with another record."""
    return spans.shared_spans(table(spark, d, "fasta_records"), "rec_id", "seq")


def p4_share(spark: SparkSession, d: str) -> DataFrame:
    """How much of each record's seq is shared."""
    return spans.shared_share(table(spark, d, "fasta_records"), "rec_id", "seq")


def _fasta(spark: SparkSession, d: str) -> DataFrame:
    return collapse.canonical_records(table(spark, d, "fasta_records"), "rec_id", "header", "seq")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """For every group of alike records each rec_id but the smallest, with the smallest."""
    return collapse.copies(_fasta(spark, d))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, n_copies): one row per different record, the smallest rec_id for all its copies."""
    return collapse.collapse(_fasta(spark, d)).select(F.col("first").alias("rec_id"), F.col("n").alias("n_copies"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"), "doc_id", "text")


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The ids with the characters that each covers."""
    return tokenize.encode(table(spark, d, "documents"), "doc_id", "text", offsets=True)


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.round_trip(table(spark, d, "documents"), "doc_id", "text")


def _leak(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text"


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items of which they hold 12 consecutive words."""
    return leak.leaked(*_leak(spark, d))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans to remove."""
    return leak.leaked_spans(*_leak(spark, d))


def _texts(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "documents"), "doc_id", "source", "text"


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncated.judged(*_texts(spark, d)).where("cut = 1").select("doc_id").distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return truncated.rates(*_texts(spark, d))


def p9_routes(spark: SparkSession, d: str) -> DataFrame:
    """How many texts of each source were cut by a limit or by a transfer."""
    return truncated.routes(*_texts(spark, d))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """The lengths at which each source cuts."""
    return truncated.limits(truncated.shapes(*_texts(spark, d)))


QUERIES = {f.__name__: f for f in (p1_found, p1_keys, p1_rates, p2_bounds, p2_found, p2_heavy, p2_top, p4_found, p4_share, p5_found, p5_records, p7_ids, p7_offsets, p7_round_trip, p8_found, p8_spans, p9_found, p9_limits, p9_rates, p9_routes)}

_TOP_SQL = f"""
WITH seqs AS (SELECT seq AS item, count(DISTINCT read_id) AS n FROM reads WHERE seq IS NOT NULL GROUP BY seq ORDER BY n DESC, item LIMIT 20),
posts AS (SELECT DISTINCT post_id, {KEY_SQL} AS item, cnt FROM postings),
mers AS (SELECT item, CAST(sum(cnt) AS BIGINT) AS n FROM posts WHERE item IS NOT NULL AND cnt IS NOT NULL GROUP BY item ORDER BY n DESC, item LIMIT 20)
"""
_HEAVY_SQL = f"""
WITH posts AS (SELECT DISTINCT post_id, {KEY_SQL} AS item, cnt FROM postings),
seqs AS (SELECT seq AS item, count(DISTINCT read_id) AS n FROM reads WHERE seq IS NOT NULL GROUP BY seq),
mers AS (SELECT item, CAST(sum(cnt) AS BIGINT) AS n FROM posts WHERE item IS NOT NULL AND cnt > 0 GROUP BY item)
SELECT 'seq' AS kind, item, n FROM seqs WHERE n * 1000 > (SELECT count(seq) FROM reads)
UNION ALL SELECT 'cnt', item, n FROM mers WHERE n * 1000 > (SELECT sum(cnt) FROM postings WHERE cnt > 0 AND {KEY_SQL} IS NOT NULL)
"""
_SPANS_SQL = """
WITH recs AS (SELECT DISTINCT rec_id, seq FROM fasta_records WHERE seq IS NOT NULL),
places AS (SELECT rec_id, seq, unnest(range(0, greatest(length(seq) - 63, 0))) AS pos FROM recs),
cut AS (SELECT rec_id, pos, substr(seq, pos + 1, 64) AS part FROM places),
shared AS (SELECT part FROM cut GROUP BY part HAVING min(rec_id) < max(rec_id)),
hits AS (SELECT rec_id, pos FROM cut JOIN shared USING (part)),
steps AS (SELECT rec_id, pos, CASE WHEN pos > lag(pos) OVER w + 64 THEN 1 ELSE 0 END AS step FROM hits WINDOW w AS (PARTITION BY rec_id ORDER BY pos)),
runs AS (SELECT rec_id, pos, sum(step) OVER (PARTITION BY rec_id ORDER BY pos) AS run FROM steps),
found AS (SELECT rec_id, min(pos) AS start_pos, max(pos) + 64 AS end_pos FROM runs GROUP BY rec_id, run)
"""
_CANON_SQL = """
WITH canon AS (
  SELECT DISTINCT rec_id, lower(regexp_replace(seq, '[^\\p{L}]', '', 'g')) AS letters,
    list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce(header, '')), '^\\s*>', ''), '[\\s;|,]+'), lambda x: x <> ''))) AS attributes
  FROM fasta_records WHERE seq IS NOT NULL),
grouped AS (SELECT letters, attributes, min(rec_id) AS keep_id, count(*) AS n FROM canon GROUP BY ALL)
"""
_SEEN_SQL = f"""
WITH recs AS (SELECT DISTINCT entry_id, {KEY_SQL} AS key FROM mer_counts),
known AS (SELECT DISTINCT {KEY_SQL} AS key FROM known_mers),
firsts AS (SELECT key, min(entry_id) AS first FROM recs WHERE key IS NOT NULL GROUP BY key)
"""
_WORDS_SQL = """
WITH words AS (
  SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents),
asked AS (
  SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM eval_items),
held AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 10, 1))) AS i, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: w[i:i + 11])) AS p FROM words),
phrases AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: w[i:i + 11])) AS p FROM asked)
"""
SQL = {
    "p1_found": _SEEN_SQL + "SELECT entry_id FROM recs JOIN firsts USING (key) WHERE entry_id > first OR key IN (SELECT key FROM known WHERE key IS NOT NULL)",
    "p1_keys": _SEEN_SQL
    + """, fresh AS (SELECT * FROM firsts WHERE key NOT IN (SELECT key FROM known WHERE key IS NOT NULL)),
again AS (SELECT entry_id FROM recs JOIN firsts USING (key) WHERE entry_id > first OR key IN (SELECT key FROM known WHERE key IS NOT NULL))
SELECT (SELECT count(*) FROM fresh) + (SELECT count(key) FROM known) AS keys, (SELECT count(*) FROM fresh) AS asked, (SELECT count(*) FROM fresh JOIN again ON entry_id = first) AS wrong""",
    "p2_found": _TOP_SQL + "SELECT 'seq' AS kind, item FROM seqs UNION ALL SELECT 'cnt' AS kind, item FROM mers",
    "p2_heavy": _HEAVY_SQL,
    "p2_top": _TOP_SQL + "SELECT 'seq' AS kind, item, n, CAST(1 AS BIGINT) AS sure FROM seqs UNION ALL SELECT 'cnt', item, n, 1 FROM mers",
    "p4_found": _SPANS_SQL + "SELECT rec_id, start_pos, end_pos FROM found",
    "p4_share": _SPANS_SQL
    + """SELECT rec_id, n_chars, n_shared, CASE WHEN n_chars > 0 THEN n_shared / n_chars ELSE 0.0 END AS share
FROM (SELECT rec_id, length(seq) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS n_shared
  FROM recs LEFT JOIN (SELECT rec_id, sum(end_pos - start_pos) AS n FROM found GROUP BY rec_id) USING (rec_id))""",
    "p5_found": _CANON_SQL + "SELECT keep_id, rec_id AS copy_id FROM canon JOIN grouped USING (letters, attributes) WHERE rec_id <> keep_id",
    "p5_records": _CANON_SQL + "SELECT keep_id AS rec_id, n AS n_copies FROM grouped",
    "p7_round_trip": "SELECT doc_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents",
    "p8_found": _WORDS_SQL + "SELECT DISTINCT doc_id, item_id FROM held JOIN phrases USING (p)",
    "p8_spans": _WORDS_SQL
    + """, hits AS (SELECT DISTINCT doc_id, item_id, i FROM held JOIN phrases USING (p)),
steps AS (SELECT doc_id, item_id, i, CASE WHEN i > lag(i) OVER w + 12 THEN 1 ELSE 0 END AS step FROM hits WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY i)),
runs AS (SELECT doc_id, item_id, i, sum(step) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS run FROM steps),
spans AS (SELECT doc_id, item_id, min(i) AS a, max(i) + 11 AS b FROM runs GROUP BY doc_id, item_id, run),
parts AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+')) AS part, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+'), 1) AS n
  FROM documents WHERE doc_id IN (SELECT doc_id FROM spans)),
ends AS (SELECT doc_id, part, sum(length(part)) OVER w AS stop, count(*) FILTER (regexp_matches(part, '^[A-Za-z0-9]')) OVER w AS i FROM parts WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
marks AS (SELECT doc_id, i, CAST(stop - length(part) AS BIGINT) AS start_char, CAST(stop AS BIGINT) AS end_char FROM ends WHERE regexp_matches(part, '^[A-Za-z0-9]'))
SELECT s.doc_id, item_id, x.start_char, y.end_char FROM spans s JOIN marks x ON x.doc_id = s.doc_id AND x.i = s.a JOIN marks y ON y.doc_id = s.doc_id AND y.i = s.b""",
    "p9_limits": """
WITH t AS (SELECT DISTINCT source, text FROM documents WHERE regexp_matches(text, '[^\\s\\p{Z}]')),
x AS (SELECT source, 'chars' AS unit, length(text) AS length FROM t UNION ALL SELECT source, 'bytes', strlen(text) FROM t),
c AS (SELECT source, unit, length, count(*) AS n FROM x GROUP BY ALL),
s AS (SELECT *, sum(n) OVER a - n AS s, sum(n * n) OVER a - n * n AS q, count(*) OVER p AS tested, greatest(coalesce(max(n) OVER b, 0), coalesce(max(n) OVER f, 0)) AS top FROM c
  WINDOW p AS (PARTITION BY source, unit), a AS (PARTITION BY source, unit ORDER BY length RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING),
    b AS (PARTITION BY source, unit ORDER BY length RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY source, unit ORDER BY length RANGE BETWEEN 1 FOLLOWING AND 12 FOLLOWING)),
m AS (SELECT *, CASE WHEN s > top THEN greatest(1.0, ((q - top * top) / 23.0 - ((s - top) / 23.0) ** 2) / ((s - top) / 23.0)) ELSE 1.0 END AS spread,
  n * ln(n * 25.0 / (n + s)) + CASE WHEN s > 0 THEN s * ln(s * 25.0 / (24.0 * (n + s))) ELSE 0.0 END AS exponent FROM s)
SELECT source, unit, length, n FROM m WHERE n > 5.0 * s / 24 + 1 AND ln(tested) - exponent / spread < ln(0.001) QUALIFY n = max(n) OVER (PARTITION BY source, length)""",
}
