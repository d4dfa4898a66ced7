"""Contiguous rank arrays against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from edges import TEXTS, documents, no_documents
from test_tokens import BYTES, WORDS, by_id, library
from test_units import BITS

from quittance.llm import rank_merges
from quittance.llm.queries import QUERIES, table

SF_DIR = "/root/testdata/sf0.001"


def expected(texts):
    coded = library(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)
    back = library(WORDS)
    return [(e.ids, back.decode(e.ids, skip_special_tokens=False)) for e in coded]


def found(texts):
    table = rank_merges.TokenTable(WORDS)
    coded = [np.frombuffer(i, "<u4") for i in rank_merges.RankEncoder(WORDS).encode(texts)]
    return [(ids.tolist(), table.decode(ids).decode()) for ids in coded]


def test_every_code_point():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 97 == 0)]
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)} b{chr(c)}." for c in points]
    assert found(texts) == expected(texts)


def test_mixtures_and_special_strings():
    random.seed(11)
    bits = [*BITS, "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "'RE", "ǅ"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 20))) for _ in range(5000)]
    assert found(texts) == expected(texts)


def test_words_around_the_length_where_the_heap_takes_over(monkeypatch):
    random.seed(5)
    texts = ["".join(random.choices("abé中", k=n)) for n in (1, 2, 31, 32, 95, 96, 97, 400, 5000)]
    texts += ["aa" * 60, "z" * 96, "z" * 97]
    assert found(texts) == expected(texts)
    words = ["".join(random.choices("theraion", k=random.randint(1, 30))) for _ in range(300)]
    scanned = found(words)
    monkeypatch.setattr(rank_merges, "SHORT_BYTES", 0)
    assert found(words) == scanned == expected(words)


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"one{i} two{i % 7}, three{i % 50}! <|endoftext|> {'x' * 50}{i}" for i in range(300)]
    monkeypatch.setattr(rank_merges, "REMEMBERED", 10)
    small = rank_merges.RankEncoder(WORDS)
    got = [np.frombuffer(small.encode([t])[0], "<u4").tolist() for t in texts]
    assert got == [ids for ids, _ in expected(texts)]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        rank_merges.RankEncoder(BYTES)  # white space is part of its words
    with pytest.raises(ValueError):
        rank_merges.TokenTable(BYTES)


def test_odd_rows(spark):
    coded = rank_merges.encode(documents(spark), WORDS, round_trip=True)
    assert coded.columns.count("ids") == 1 and "lang" in coded.columns
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in coded.collect()]
    wanted = expected([t for _, t in TEXTS])
    assert by_id(got) == by_id([(d, *w) for (d, _), w in zip(TEXTS, wanted, strict=True)])
    back = rank_merges.decode(rank_merges.encode(documents(spark), WORDS), WORDS)
    assert by_id((r["doc_id"], r["decoded"]) for r in back.collect()) == by_id((d, t) for d, _, t in got)
    assert rank_merges.encode(no_documents(spark), WORDS, round_trip=True).count() == 0


def test_ids_without_a_token_and_missing_ids(spark):
    df = spark.createDataFrame([(np.array([320, 60_000], "<u4").tobytes(),), (None,)], "ids binary")
    text = library(WORDS).decode([320, 60_000], skip_special_tokens=False)
    assert {r["decoded"] for r in rank_merges.decode(df, WORDS).collect()} == {text, ""}


def test_query(spark):
    rows = table(spark, SF_DIR, "documents").collect()
    wanted = {}
    for r, (ids, text) in zip(rows, expected([r["text"] for r in rows]), strict=True):
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        wanted[r["doc_id"]] = (len(ids), digest, hashlib.sha256(text.encode()).hexdigest())
    got = QUERIES["op13_bpe"](spark, SF_DIR)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == wanted
