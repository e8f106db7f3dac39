"""Encoding and decoding by merged pieces against the sentencepiece library."""

import hashlib
import random

import pytest
import sentencepiece

from kbforge.llm import pieces, queries

from test_llm import SF, documents, odd_documents

PARTS = ["a", "b", " ", "  ", "▁", "é", "😀", "the", "ing", "\x00", "\n", "\t", "<s>", "<0x0A>", "日本", "क", "﻿", "́", "　", "ll", "."]


@pytest.fixture(scope="module")
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model_path):
    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def test_agenda_equals_the_library(library):
    random.seed(13)
    texts = ["", " ", " " * 3000, "▁" * 300] + ["".join(random.choices(PARTS, k=random.randint(1, 40))) for _ in range(5000)]
    texts.append("".join(random.choices("abcdefghij ", k=60000)).replace(" ", "k"))  # one very long word
    encoder = pieces.MergeEncoder(library)
    assert [encoder.encode(t) for t in library.normalize(texts)] == library.encode(texts)
    assert all(encoder._short(t) == encoder._long(t) for t in library.normalize(texts) if len(t) < 400)


def test_whole_texts_without_words(library):
    encoder = pieces.MergeEncoder(library)
    encoder.by_word = False
    texts = ["the  quick brown fox", "a▁b", "x" * 500]
    assert [encoder.encode(t) for t in library.normalize(texts)] == library.encode(texts)


def test_differing_ids_raise(library):
    encoder = pieces.MergeEncoder(library)
    encoder.encode("▁the▁other")
    encoder.fresh["▁the"] = (1, 2)
    with pytest.raises(ValueError):
        encoder.check(library, ["the other"], [library.encode("the other")])


def test_memo_has_a_bound(library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 10)
    encoder = pieces.MergeEncoder(library)
    for k in range(5):
        texts = [" ".join(f"w{k}x{j}" for j in range(20))]
        encoder.check(library, texts, [encoder.encode(t) for t in library.normalize(texts)])
        assert len(encoder.memo) <= 10


def test_documents_round_trip(spark, model_path, library):
    rows = documents(spark).select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_pieces(spark, SF).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = library.encode(r.text or "")
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert len(got) == len(rows)


def test_odd_tables(spark, model_path, library):
    odd = odd_documents(spark)
    found = pieces.encode_pieces(odd, model_path).collect()
    want = [(r.doc_id, library.encode(r.text or "")) for r in odd.collect()]
    assert sorted(map(str, ((r.doc_id, r.ids) for r in found))) == sorted(map(str, want))
    assert pieces.encode_pieces(odd.limit(0), model_path).collect() == []
