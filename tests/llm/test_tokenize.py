"""Token ids against the library's own, and the way back."""

import hashlib
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqbucket.llm.tokenize import TOKENIZER, Encoder, _tokenizer, byte_characters, decode, encode, round_trip, token_bytes

TEXTS = [None, "", " ", "hello world", "<|endoftext|>", "naïve 😀 日本語 \r\n\tx", "a" * 5000, "\x00\x01", "x" * 300_000 + " end", "hello world"]


def test_ids(spark):
    t = _tokenizer(TOKENIZER)
    df = spark.createDataFrame([(i, x, [1]) for i, x in enumerate(TEXTS)], "doc_id long, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in encode(df, "doc_id", "text").collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(TEXTS)}
    assert 50256 not in got[4]
    digests = {r["doc_id"]: (r["n_chars"], r["digest"]) for r in round_trip(df, "doc_id", "text").collect()}
    assert digests == {i: (len(x or ""), hashlib.md5((x or "").encode()).hexdigest()) for i, x in enumerate(TEXTS)}


def test_offsets_cover_the_text(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in encode(df, "doc_id", "text", offsets=True).collect():
        n = len(TEXTS[r["doc_id"]] or "")
        covered = set()
        for a, b in zip(r["starts"], r["ends"]):
            covered |= set(range(a, b))
        assert len(r["ids"]) == len(r["starts"]) and covered == set(range(n))


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=40))
def test_bytes_of_ids(text):
    table = token_bytes(TOKENIZER)
    ids = _tokenizer(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert b"".join(table[i] for i in ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\r'strevmldAZ09_-.<|>é日\x1c\x0b", max_size=40), max_size=5))
def test_by_words_as_the_library_does(texts):
    library = [e.ids for e in _tokenizer(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    encoder = Encoder(TOKENIZER)
    assert encoder.by_words
    for _ in range(2):
        assert [x.tolist() for x in encoder(texts)] == library


def test_kept_words_are_bounded(monkeypatch):
    from seqbucket.llm import tokenize

    monkeypatch.setattr(tokenize, "WORDS", 3)
    encoder = Encoder(TOKENIZER)
    encoder(["a " + "b" * 100])
    assert set(encoder.known) == {"a"}
    encoder(["a b c d e f"])
    assert not encoder.known


def test_byte_table():
    assert sorted(byte_characters().values()) == list(range(256))


def test_split_characters_and_unknown_ids(spark, rows):
    ids = _tokenizer(TOKENIZER).encode("😀", add_special_tokens=False).ids
    assert len(ids) > 1
    df = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, [10**6, None]), (4, None)], "doc_id long, ids array<int>")
    got = dict(rows(decode(df, "doc_id", "ids")))
    assert got[1] == "😀" and got[2] == "�" and got[3] == "" and got[4] == ""


@pytest.mark.parametrize("schema", ["doc_id long, text string"])
def test_empty(spark, schema):
    assert encode(spark.createDataFrame([], schema), "doc_id", "text").collect() == []


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert [len(r["ids"]) for r in encode(df, "doc_id", "text").collect()] == [1, 1, 1]
