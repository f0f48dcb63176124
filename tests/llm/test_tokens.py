"""Encoding against the library itself, exact round trips, offsets, and texts of every kind."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm.tokens import BATCH_CHARS, TOKENIZER, byte_alphabet, char_spans, count_tokens, decode, decode_ids, encode, spans, token_bytes, tokenizer

TEXTS = ["", None, "plain words, 123", "<|endoftext|> is text", "  \t\r\n　 ", "接続が 1029 ミリ秒", "🧑🏽‍🔧 Zoë", "\x00\x01﻿", "a" * 200_000, "word " * 30_000]


def plain(text):
    return tokenizer(TOKENIZER).encode(text or "", add_special_tokens=False).ids


def test_ids_counts_and_round_trip(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id int, text string, ids string").repartition(3)
    got = {r.doc_id: r.ids for r in encode(df).collect()}
    assert got == {k: plain(t) for k, t in enumerate(TEXTS)} and got[0] == got[1] == []
    assert 50256 not in got[3]
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()} == {k: len(v) for k, v in got.items()}
    assert {r.doc_id: r.text for r in decode(encode(df)).collect()} == {k: t or "" for k, t in enumerate(TEXTS)}
    empty = df.limit(0)
    assert encode(empty).count() == decode(encode(empty)).count() == 0
    assert decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>")).first().text == ""


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip_and_spans(text):
    ids = plain(text)
    assert decode_ids(ids) == text
    begins, ends = char_spans(text, ids)
    assert all(a < b for a, b in zip(begins, ends)) and (not text or (begins[0] == 0 and ends[-1] == len(text)))
    assert all(b0 <= a1 + 1 and a1 <= b0 for b0, a1 in zip(ends, begins[1:]))


def test_split_characters():
    ids = plain("🧑")
    assert len(ids) > 1 and decode_ids(ids[:1]) == "�" and decode_ids(ids) == "🧑"
    assert [tuple(map(int, x)) for x in zip(*char_spans("🧑", ids))] == [(0, 1)] * len(ids)


def test_tables(spark):
    assert sorted(byte_alphabet().values()) == list(range(256))
    assert len(token_bytes(TOKENIZER)) == 50_257
    r = spans(spark.createDataFrame([(1, "naïve 接続"), (2, None)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert r[0].ends[-1] == 8 and r[1].ids == r[1].begins == []
    with pytest.raises(Exception):
        decode_ids([10**6])
    assert BATCH_CHARS > 0
