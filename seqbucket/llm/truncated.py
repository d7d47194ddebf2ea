"""Text cut off by field limits, and by transfers that broke off.

Limits. Per source, the lengths of all texts are counted, in characters and in bytes. A length that many more texts
have than its neighbours is a limit of that source; a text of that length that ends without a terminal mark was cut by it.

Transfers. A transfer may break off at any length and leaves no spike, so its texts are told by what is missing. What a source's texts are like is
counted too: a shape of last line, or lines, that nearly all of them have close its layout, and a text without them is cut. So is one that
is plainly unfinished: a hunk with fewer lines than its head announces, a diff without a body, a trailer without its
value, a word broken by an ellipsis or a replacement character, a paragraph without its sentence mark, a last word that is the beginning of one much more
frequent in last lines. Column `by` says which way a text was found."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from seqbucket.session import materialize

#: Neighbours to either side of a length, how many times their mean a spike has, how likely a source without limits
#: may show one at all, the share from which a line is expected in all of its
#: texts, and texts without it that every source is taken to have besides (three standard errors, so that a few texts prove nothing).
NEAR, TIMES, CHANCE, USUAL, SURE = 12, 5.0, 0.001, 0.8, 9
#: A last word is a fragment of a longer one that begins with it if that stands in so many last lines, and in
#: so many times more. A line of a layout has so many characters at most.
OFTEN, MORE, LONGEST = 5, 10, 40

WHOLE, OPEN, BROKEN, DOTS = 0, 1, 2, 3

_LINE = re.compile(r"\r\n|\r|\n")
_HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")
_DIFF = re.compile(r"diff --git a/(\S+) b/(\S+)\Z")
_BINARY = re.compile(r"Binary files \S+ and \S+ differ\s*\Z")
_TRAILER = re.compile(r"[A-Z][A-Za-z]*(-[A-Za-z]+)*:(?: (\S.*))?")
_FIELD = re.compile(r"[A-Z][A-Za-z-]*:\s+\S")
_RUN = re.compile(r"[^\W_]+")
_PATH = re.compile(r"#\s+\S+\.\w+\Z")
_WORD = re.compile(r"[^\W\d_]+")
_END = tuple(".?!。！？:;)>}]\"'`")
#: Sentence marks and closing signs of scripts without case; Thai, Lao and Khmer letters stand in no sentence with a mark.
_MARKS = tuple(".?!。．｡！？：；…:;।॥؟؛۔።፧፨။།׃)>}]\"'`）〉》」』】〕］｝”’»")
_UNMARKED = ("THAI ", "LAO ", "KHMER ")


def _caseless(letter: str) -> bool:
    """Of a script without case whose sentences end in a mark."""
    return unicodedata.category(letter) == "Lo" and not unicodedata.name(letter, "").startswith(_UNMARKED)


def _unbalanced(line: str) -> bool:
    return line.count("(") > line.count(")") or line.count('"') % 2 == 1 or line.count("`") % 2 == 1


def _trailer(line: str) -> int | None:
    """A line `Key: value`: WHOLE if the value ends as an address or a number does, BROKEN if it doesn't though it is one word or the key is
    of several, or if there is none; None if the line is no such one."""
    m = _TRAILER.fullmatch(line)
    if not m:
        return None
    value = m[2] or ""
    one = len(value.split()) <= 1
    if value.endswith(">") or (value and one and value[-1].isdigit()):
        return WHOLE
    return BROKEN if one or m[1] else None


def _patch(lines: list[str], midline: bool) -> int:
    """lines from the last `diff --git` on; midline: no line break follows."""
    if not (m := _DIFF.match(lines[0].rstrip())) or len(lines) == 1:
        return BROKEN
    heads = [i for i, x in enumerate(lines) if x.startswith("@@ ")]
    last = lines[-1]
    if heads:
        m = _HUNK.match(lines[heads[-1]])
        if not m:
            return BROKEN
        old, new = (int(x) if x is not None else 1 for x in m.groups())
        for line in lines[heads[-1] + 1 :]:
            if old <= 0 and new <= 0:
                return OPEN if _trailer(last.strip()) is None else _trailer(last.strip())
            if line[:1] != "+":
                old -= line[:1] != "\\"
            if line[:1] != "-":
                new -= line[:1] != "\\"
        if old > 0 or new > 0:
            return BROKEN
        return BROKEN if midline and _unbalanced(last) else OPEN
    if any(x.startswith("GIT binary patch") for x in lines):
        blocks = [x for x in lines if x.startswith(("literal ", "delta "))]
        return WHOLE if len(blocks) == 2 and len(last) == 66 else BROKEN
    if last.startswith("Binary files "):
        return WHOLE if _BINARY.match(last) else BROKEN
    if re.match(r"(new mode|new file mode|deleted file mode) \d{6}\s*\Z", last) or re.match(r"rename to \S", last):
        return OPEN
    return BROKEN


def _message(lines: list[str], midline: bool) -> int:
    """Lines of a message without its head, the last not blank."""
    last = lines[-1].strip()
    state = _trailer(last) if len(lines) > 1 else None
    if state is not None:
        return state
    if last.startswith("#"):
        return WHOLE if _PATH.match(last) else BROKEN if midline else OPEN
    if last.endswith(_END):
        return WHOLE
    blank = next((i for i in reversed(range(len(lines))) if not lines[i].strip()), None)
    if not midline or blank is None:
        return OPEN
    # a quotation may begin and end anywhere; a paragraph of the message's own begins like a sentence
    paragraph = "".join(lines[blank + 1 :]).strip()
    if _caseless(paragraph[0]):
        return OPEN if paragraph.endswith(_MARKS) else BROKEN
    return BROKEN if paragraph[0].isupper() and (len(paragraph) == 1 or paragraph != paragraph.upper()) else OPEN


def ending(text: str) -> int:
    """How a non-blank text ends: WHOLE, OPEN (nothing tells), BROKEN, or DOTS (three dots)."""
    body = text.rstrip("\r\n")
    lines = _LINE.split(body)
    tail = body.rstrip()
    midline = text == body
    if midline and (tail.endswith(("�", " [")) or (tail.endswith("…") and tail[-2:-1].strip())):
        return BROKEN
    if midline and tail.endswith("..."):
        return DOTS
    diffs = [i for i, x in enumerate(lines) if x.startswith("diff --git")]
    if diffs:
        # a line of one blank is a hunk's
        return _patch(lines[diffs[-1] :], midline)
    while len(lines) > 1 and not lines[-1].strip():
        lines.pop()
    blank = next((i for i, x in enumerate(lines) if not x.strip()), len(lines))
    if sum(bool(_FIELD.match(x)) for x in lines[:blank]) > 1:
        # a head of fields is no message
        lines = lines[blank + 1 :]
    return _message(lines, midline) if lines else BROKEN


def _shape(text: str) -> str:
    """Digits as 9, letters as a, runs of both by their length: lines that differ only in their words and numbers are alike."""
    return _RUN.sub(lambda m: "9" if m[0].isdigit() else "a" if m[0].isalpha() else f"x{len(m[0])}", text)


def _head(line: str) -> str | None:
    """What a layout repeats in a line: a word and the shape of a number or mark after it, the name of a field, or signs alone."""
    words = line.split(None, 2)
    shape = _shape(words[1]) if len(words) == 2 else ""
    if re.search(r"9|x\d", shape):
        return f"{words[0]} {shape}"
    return words[0] if words[0].endswith(":") or not _RUN.search(line) else None


def layout(text: str) -> tuple[list[str], str | None, str | None]:
    """The heads of the lines that are in no diff, the last line's if it has a shape in it, and the last line's shape. Heads and shapes of more than LONGEST characters
    are no part of a layout."""
    lines = [x for x in _LINE.split(text) if x.strip()]
    heads, old, new, skip = set(), 0, 0, False
    for x in lines:
        if old > 0 or new > 0:
            old -= x[:1] not in ("+", "\\")
            new -= x[:1] not in ("-", "\\")
        elif x.startswith("diff --git"):
            skip = True
        elif m := _HUNK.match(x):
            old, new = (int(v) if v is not None else 1 for v in m.groups())
            skip = False
        elif not skip:
            heads.add(_head(x) or "")
    last = lines[-1].strip()
    shape, head = _shape(last) if len(last) <= LONGEST else None, _head(last)
    return sorted(h for h in heads if 0 < len(h) <= LONGEST), head if head and " " in head else None, shape


_SHAPE = [("row_id", pa.int64()), ("source", pa.string()), ("digest", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("state", pa.int64()), ("heads", pa.list_(pa.string())), ("last_head", pa.string()), ("last_shape", pa.string()), ("last_word", pa.string()), ("line_words", pa.list_(pa.string()))]


def _last_words(text: str, state: int) -> tuple[str | None, list[str]]:
    """Of a message without a diff: the word it ends in, where nothing tells whether that is its end; and the
    words of its last line that isn't blank."""
    if "diff --git" in text:
        return None, []
    line = _LINE.split(text.rstrip())[-1]
    found = _WORD.findall(line)
    bare = state == OPEN and found and text.endswith(found[-1])
    return (found[-1] if bare else None), sorted(set(found))


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_SHAPE)
    for b in batches:
        out = []
        for i, s, h, t in zip(*(c.to_pylist() for c in b.columns)):
            if t.strip():
                state = ending(t)
                out.append((i, s, h, len(t), len(t.encode("utf-8", "surrogatepass")), state, *layout(t), *_last_words(t, state)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def shapes(df: DataFrame, row_id: str, source: str, text: str) -> DataFrame:
    """(row_id, source, digest, chars, bytes, state, heads, last_head, last_shape, last_word, line_words) of each text that isn't null, empty or blank."""
    kind = lambda t: T.StringType() if t == pa.string() else T.LongType() if t == pa.int64() else T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField(n, kind(t)) for n, t in _SHAPE])
    rows = df.select(F.col(row_id).cast("bigint"), F.col(source).cast("string"), F.xxhash64(text), F.col(text)).where(F.col(text).isNotNull())
    return rows.mapInArrow(_shapes, schema)


def limits(shape: DataFrame) -> DataFrame:
    """(source, unit, length, n): the spikes of each source's histograms of lengths, as far as a spike in
    characters and one in bytes at the same length tell the unit: that of the larger count. Copies of a text
    count once, so that a text that is often repeated is no spike.

    A spike is a count n that chance doesn't explain. If a length is as likely as each of its w = 2 * NEAR neighbours,
    which hold s texts together, n of the n + s texts is binomial with 1 / (w + 1); the tail is bounded by
    Chernoff's bound and multiplied by the number of lengths of the source. Where neighbours differ more than
    Poisson counts do (short texts from few patterns), the exponent is divided by their variance over their
    mean, without the largest of them, which may be a limit too. Nothing depends on the source's size."""
    each = shape.select("source", "digest", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("_x"))
    once = each.select("source", "_x.unit", "_x.length", "digest").distinct()
    counts = once.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    by = W.partitionBy("source", "unit")
    near = by.orderBy("length")
    around, before, after = near.rangeBetween(-NEAR, NEAR), near.rangeBetween(-NEAR, -1), near.rangeBetween(1, NEAR)
    w, n, s, top = 2.0 * NEAR, F.col("n"), F.col("_s"), F.col("_top")
    sums = counts.select("*", (F.sum("n").over(around) - n).alias("_s"), (F.sum(n * n).over(around) - n * n).alias("_q"),
        F.greatest(F.coalesce(F.max("n").over(before), F.lit(0)), F.coalesce(F.max("n").over(after), F.lit(0))).alias("_top"), F.count("*").over(by).alias("_tested"))
    mean = (s - top) / (w - 1)
    spread = F.when(s > top, F.greatest(F.lit(1.0), ((F.col("_q") - top * top) / (w - 1) - mean * mean) / mean)).otherwise(1.0)
    exponent = n * F.log(n * (w + 1) / (n + s)) + F.when(s > 0, s * F.log(s * (w + 1) / (w * (n + s)))).otherwise(0.0)
    spikes = sums.where((n > TIMES * s / w + 1) & (F.log("_tested") - exponent / spread < F.log(F.lit(CHANCE))))
    best = W.partitionBy("source", "length")
    return spikes.withColumn("_most", F.max("n").over(best)).where("n = _most").select("source", "unit", "length", "n")


def _prefix_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) -> (word, h, n): a 64-bit hash of each beginning of each word, eight bytes a letter however long it is; word stands only beside its
    own hash."""
    for b in batches:
        words, n = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
        if not words:
            continue
        size = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner, ends = np.repeat(np.arange(len(words)), size), np.cumsum(size)
        place = np.arange(len(codes)) - (ends - size)[owner]
        powers = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
        sums = np.cumsum(codes * powers[place], dtype=np.uint64)
        h = sums - np.concatenate([np.zeros(1, np.uint64), sums])[ends - size][owner] + place.astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        whole = pa.nulls(len(codes), pa.string()) if not len(codes) else pa.array(np.where(place == size[owner] - 1, np.array(words, object)[owner], None), pa.string())
        yield pa.RecordBatch.from_arrays([whole, pa.array(h.view(np.int64)), pa.array(n[owner], pa.int64())], names=["word", "h", "n"])


def fragments(shape: DataFrame) -> DataFrame:
    """(word): words of last lines that begin a much more frequent one. A word is looked up among the
    beginnings of all others, by their hashes, so nothing is paired and a word of any length costs a row a letter."""
    words = shape.select(F.explode("line_words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    starts = words.mapInArrow(_prefix_hashes, "word string, h long, n long")
    # one row a hash: the word that it is, how often that stands, and how often the most frequent longer one does
    found = starts.groupBy("h").agg(F.max("word").alias("word"), F.max(F.when(F.col("word").isNotNull(), F.col("n"))).alias("n"), F.max(F.when(F.col("word").isNull(), F.col("n"))).alias("most"))
    return found.where("word is not null and most is not null").where((F.col("most") >= OFTEN) & (F.col("most") >= MORE * F.col("n"))).select("word")


def layouts(shape: DataFrame) -> DataFrame:
    """(source, heads, shapes): the heads of lines, and the shape of last line, that at least USUAL of a source's texts have. There are few, as each
    stands in most texts."""
    n = F.count("*").alias("n")
    sizes = shape.groupBy("source").agg(F.count("*").alias("_all"))
    found = shape.select("source", F.lit("head").alias("kind"), F.explode("heads").alias("v")).unionByName(shape.select("source", F.lit("shape").alias("kind"), F.col("last_shape").alias("v")).where("v is not null"))
    counts = found.groupBy("source", "kind", "v").agg(n).withColumnRenamed("source", "_of")
    usual = sizes.join(counts, sizes["source"].eqNullSafe(counts["_of"])).where(F.col("n") >= USUAL * (F.col("_all") + SURE))
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("v")))
    return usual.groupBy("source").agg(of("head").alias("heads"), of("shape").alias("shapes"))


def judged(df: DataFrame, row_id: str, source: str, text: str) -> DataFrame:
    """(row_id, source, chars, bytes, state, at_limit, cut, by): for each text whether it was cut (0 or 1), and by what: `limit`, `transfer` or null. A source that is null is a source of its own."""
    shape = materialize(shapes(df, row_id, source, text), "shapes")
    spikes = limits(shape).groupBy(F.col("source").alias("_of")).agg(
        F.collect_set(F.when(F.col("unit") == "chars", F.col("length"))).alias("_chars"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("length"))).alias("_bytes")
    )
    usual = layouts(shape).select(F.col("source").alias("_source"), F.col("heads").alias("_heads"), F.col("shapes").alias("_shapes"))
    known = shape.select(F.col("source").alias("_name")).distinct()
    traits = known.join(spikes, known["_name"].eqNullSafe(spikes["_of"]), "left").join(usual, known["_name"].eqNullSafe(usual["_source"]), "left").drop("_of", "_source")
    asked = shape.where("last_word is not null")
    part = asked.join(fragments(shape).withColumn("_part", F.lit(True)), F.col("last_word") == F.col("word"), "left").drop("word")
    shape = part.unionByName(shape.where("last_word is null").withColumn("_part", F.lit(None).cast("boolean")))
    rows = shape.join(traits, shape["source"].eqNullSafe(traits["_name"]), "left")
    # a limit in bytes that falls into a character leaves up to three bytes less
    slack = F.when(F.col("bytes") > F.col("chars"), 3).otherwise(0)
    at_limit = F.coalesce(F.array_contains("_chars", F.col("chars")), F.lit(False)) | F.coalesce(
        F.exists("_bytes", lambda x: (x >= F.col("bytes")) & (x - F.col("bytes") <= slack)), F.lit(False)
    )
    # dots may stand within the limit, and blanks before them be gone
    dotted = lambda c: F.coalesce(F.exists("_" + c, lambda x: F.col(c).between(x - 4, x)), F.lit(False))
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    ends = F.coalesce(F.array_contains("_shapes", F.col("last_shape")), F.lit(False))
    missing = F.when(has("_shapes"), ~ends).otherwise(has("_heads") & (F.size(F.array_except("_heads", "heads")) > 0))
    closed = ~missing & (ends | F.coalesce(F.array_contains("_heads", F.col("last_head")), F.lit(False)))
    state = F.when(closed & (F.col("state") == OPEN), WHOLE).otherwise(F.col("state"))
    by_limit = (at_limit & (state != WHOLE)) | ((state == DOTS) & (dotted("chars") | dotted("bytes")))
    by = F.when(by_limit, "limit").when((((state == BROKEN) | F.coalesce("_part", F.lit(False))) & ~F.coalesce(closed, F.lit(False))) | F.coalesce(missing, F.lit(False)), "transfer")
    out = rows.select(F.col("row_id").alias(row_id), F.col("source").alias(source), "chars", "bytes", "state", at_limit.cast("int").alias("at_limit"), by.alias("by"))
    return out.withColumn("cut", F.col("by").isNotNull().cast("int"))


def routes(df: DataFrame, row_id: str, source: str, text: str) -> DataFrame:
    """(source, by, n): how many texts of each source were found by which way."""
    return judged(df, row_id, source, text).where("cut = 1").groupBy(source, "by").agg(F.count("*").alias("n"))


def rates(df: DataFrame, row_id: str, source: str, text: str) -> DataFrame:
    """(source, n_texts, n_cut, share): how often each source truncates, of its non-blank texts."""
    return judged(df, row_id, source, text).groupBy(source).agg(F.count("*").alias("n_texts"), F.sum("cut").cast("bigint").alias("n_cut"), F.avg("cut").alias("share"))
