"""Exact encoding against the sentencepiece library."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from strikeloom.llm.pieces import encode_documents, encoder_of

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER = encoder_of(open(PATH, "rb").read())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aeinthrsEN ▁　\t\n.,!1ßéü漢字</>\x00ﬁ😀", max_size=80))
def test_same_ids_as_the_library(text):
    ids = ENCODER.encode(text)
    assert ids == LIBRARY.encode(text)
    assert ENCODER.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["", " ", " " * 3000, "a" * 5000, "ab" * 2000 + " " * 40 + "x", "<s>x</s>", "the" * 3000, "Donaudampfschifffahrt" * 100])
def test_runs_and_long_words(text):
    assert ENCODER.encode(text) == LIBRARY.encode(text)


def test_every_piece_encodes_as_the_library_does():
    pieces = [LIBRARY.id_to_piece(i).replace("▁", " ") for i in range(259, LIBRARY.get_piece_size(), 7)]
    assert [ENCODER.encode(p) for p in pieces] == LIBRARY.encode(pieces)


def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in encode_documents(docs, PATH).collect()}
    for r in docs.collect():
        ids = LIBRARY.encode(r.text)
        assert got[r.doc_id].ids == ids and got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_nulls_repeats_empty_tables_and_clashes(spark):
    docs = spark.createDataFrame([(1, None, 9), (1, None, 9), (None, "a b", 9), (2, "", 9)], "doc_id long, text string, n_tokens int")
    got = encode_documents(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 0), (1, 0), (2, 0)]
    assert encode_documents(docs.limit(0), PATH).count() == 0
