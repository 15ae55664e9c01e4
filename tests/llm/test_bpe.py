import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geostrata.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder_of(bpe.vocabulary("byte_bpe_50k"))


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = "aábc de ​　\n\t'’sßöđ中文😀🤷‍♀️́ὠ0١٢ⅷ²᠎\x85\x1c﻿--==_"


def test_ids_equal_the_library(encoder, reference):
    r = random.Random(1)
    texts = ["", " ", "\n\n", "a" * 3000, " " * 2000, "=-" * 900, "<|endoftext|>", "don't I'll we've", *["".join(r.choice(ODD) for _ in range(r.randint(1, 50))) for _ in range(3000)]]
    assert all(encoder.encode(t) == reference(t) for t in texts)


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(encoder, reference, text):
    ids = encoder.encode(text)
    assert ids == reference(text)
    machine = bpe.Utf8Machine()
    assert "".join(machine.feed(encoder.bytes_of[i]) for i in ids) + machine.end() == text


@settings(max_examples=200, deadline=None)
@given(data=st.binary(max_size=40), cut=st.integers(0, 40))
def test_utf8_machine_equals_the_decoder(data, cut):
    machine = bpe.Utf8Machine()
    assert machine.feed(data[:cut]) + machine.feed(data[cut:]) + machine.end() == data.decode("utf-8", "replace")


def test_transducer_emits_with_bounded_lookahead(encoder):
    state, lag = 0, 0
    for byte in b"the unbelievable internationalization of things" * 3:
        state, _ = encoder.step[state].get(byte) or encoder._make(state, byte)
        lag = max(lag, *(len(way[0]) for way in encoder.states[state]))
    assert lag <= 12


def test_caches_are_emptied(monkeypatch, encoder, reference):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 5)
    monkeypatch.setattr(bpe, "KEPT_STATES", 20)
    text = "many different words come along and every one of them needs states, letters und Wörter"
    assert encoder.encode(text) == reference(text)


def test_frames(spark, reference):
    long = "word " * 40_000
    rows = [(1, "Hello  world", "x"), (2, "", "x"), (3, None, None), (4, "Hello  world", "x"), (None, "a", "x"), (5, long, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(df, "doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, list(r["ids"])) for r in got) == sorted((r[0] or 0, reference(r[1] or "")) for r in rows)
    counts = {r["doc_id"]: r["tokens"] for r in bpe.count_tokens(df, "doc_id", "text").collect()}
    assert counts[5] == len(reference(long)) and counts[2] == counts[3] == 0
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {r[0]: r[1] or "" for r in rows}
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0
    odd = spark.createDataFrame([(1, [50_000_000, None, 65])], "doc_id long, ids array<int>")
    assert bpe.decode(odd, "doc_id").first()["text"].startswith("��")
    with pytest.raises(ValueError):
        bpe.encode(df, "doc_id", "text", "no_such")


def test_batches_and_counts(encoder):
    texts = ["hello  world", None, "", "naïve 漢字 " * 3, "x" * 200 + " 123456", "hello  world"]
    ends, ids = encoder.encode_batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [encoder.encode(t) for t in texts]
    assert encoder.encode_batch(texts, counts_only=True)[0].tolist() == ends.tolist()
    assert [t.tolist() for t in encoder.encode_batch([])] == [[0], []]


def test_tokens_that_stay_apart_are_those_that_merging_leaves(encoder):
    rng = np.random.default_rng(5)
    for left, right in rng.integers(0, 50_256, (3000, 2)).tolist():
        data = encoder.bytes_of[left] + encoder.bytes_of[right]
        whole = all(encoder.merge(encoder.bytes_of[t]) == [encoder.bytes_of[t]] for t in (left, right))
        if whole:
            assert encoder._stay_apart(left, right) == (encoder.merge(data) == [encoder.bytes_of[left], encoder.bytes_of[right]])


def odd_texts(n):
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789  \n\t'\"éß漢字кир😀\x1c\x85\xa0½ΑΣσİ\u2581"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(n)] + ["<|endoftext|> <s>", " ", "  a  ", "x" * 500, "naïve " * 200]


def test_words_equal_the_library():
    library = tokenizers.Tokenizer.from_file("/opt/tokenizers/word_bpe_49k.json")
    library.encode_special_tokens = True
    ours = bpe.encoder_of(bpe.vocabulary("word_bpe_49k"))
    assert all(ours.encode(t) == library.encode(t, add_special_tokens=False).ids for t in odd_texts(800))
    assert ours.encode("") == ours.encode(None) == []


def test_pieces_equal_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    ours = bpe.encoder_of(bpe.vocabulary("piece_bpe_32k"))
    assert all(ours.encode(t) == library.encode(t) for t in odd_texts(800))
    assert ours.encode("") == ours.encode(None) == []
    back = b"".join(ours.bytes_of[i] for i in ours.encode("Ein Satz, 漢字 und 😀."))
    assert back.decode() == " Ein Satz, 漢字 und 😀."


def test_unknown_vocabulary():
    with pytest.raises(ValueError):
        bpe.vocabulary("no_such_tokenizer")


def test_what_is_kept_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_IDS", 500)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 40)
    want = [encoder.merge(b"q" * n) for n in (3, 70)]
    for _ in range(30):
        ends, ids = encoder.encode_batch(["q" * 3, "q" * 70, f"w{random.random()}" * 9])
        assert [encoder.bytes_of[i] for i in ids[: ends[2]].tolist()] == want[0] + want[1]
        assert len(encoder.flat) < 5000 and len(encoder.begins) < 500
