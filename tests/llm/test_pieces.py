"""Merge rounds and decoding against the library that the model is made for."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from lorecairn.llm import pieces, queries
from lorecairn.llm.textarrays import chunks

FILE = f"{queries.TOKENIZERS_FOLDER}/{queries.PIECES}"


@pytest.fixture(scope="module")
def model():
    with open(FILE, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def odd_texts():
    draw = random.Random(3)

    def made(letters, n):
        return "".join(draw.choice(letters) for _ in range(n))

    texts = ["", " ", "▁a", "▁▁ ▁", "a\x00b", "  a   b " + " " * 37, "\n\n", "🎉x​", "<s>x</s><0x0A>", "⁇", " " * 5000, "a" * 9000]
    texts += [made("abcdefghij", 7000), made("abcde ", 2000), *(made([chr(c) for c in r], 2000) for r in (range(0x20, 0x2FFF), range(0x4E00, 0x9FFF)))]
    texts += [made(" ethaoinsrELO_-▁\n\tä=*#", draw.randrange(1, 60)) for _ in range(3000)]
    return texts + [made([*"     ", "th", "e", "ing", "==", "----", "\n"], draw.randrange(1, 400)) for _ in range(300)]


def encoded(encoder, texts):
    lists, back = [], []
    for chunk in chunks(pa.array(texts, pa.string()), 1 << 16):
        ids, first = encoder.encode(chunk)
        lists += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        back += encoder.decode(ids, first)
    return lists, back


@pytest.mark.parametrize("long", [pieces.LONG, 0, 10**9])
def test_rounds_and_heap_equal_the_library(model, library, monkeypatch, long):
    monkeypatch.setattr(pieces, "LONG", long)
    texts = odd_texts()
    if long > pieces.ENCODE_BYTES:
        texts = [t for t in texts if len(t) < 5000]
    lists, back = encoded(pieces.encoder_of(model), texts)
    assert lists == library.encode(texts)
    assert back == [library.decode(x) for x in lists]


def test_slices_of_a_long_text(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 50)
    texts = [t for t in odd_texts() if len(t) < 5000][:1500]
    assert encoded(pieces.encoder_of(model), ["", *texts, "", ""])[0] == library.encode(["", *texts, "", ""])


def test_any_ids_decode_as_in_the_library(model, library):
    draw = random.Random(5)
    kinds = [lambda: draw.randrange(3, 32000), lambda: draw.randrange(1, 260), lambda: 259, lambda: 28705]
    lists = [[draw.choice(kinds)() for _ in range(draw.randrange(30))] for _ in range(3000)]
    first = np.append(0, np.cumsum([len(x) for x in lists]))
    got = pieces.encoder_of(model).decode(np.array([i for x in lists for i in x]), first)
    assert got == [library.decode(x) for x in lists]


def test_rows_of_any_kind(spark, model, library, awkward, rows, nothing):
    got = pieces.decode(pieces.encode(awkward, model, end=True), model)
    want = Counter((r[0], tuple(library.encode(r[1] or "", add_eos=True)), (r[1] or "").replace("▁", " ")) for r in rows)
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in got.collect()) == want
    assert pieces.decode(pieces.encode(nothing, model), model).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.text for r in pieces.decode(nulls, model).collect()] == ["", ""]


def test_query_equals_the_library(spark, folder, library):
    got = {r.doc_id: r for r in queries.op11_sentencepiece(spark, folder).collect()}
    docs = queries.read(spark, folder, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode(text or "", add_eos=True)
        row = got[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_kinds_of_model_with_other_rules_are_refused(model):
    from sentencepiece import sentencepiece_model_pb2 as format_

    read = format_.ModelProto()
    read.ParseFromString(model)
    read.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError, match="only byte-pair models"):
        pieces.PieceModel.load(read.SerializeToString())
