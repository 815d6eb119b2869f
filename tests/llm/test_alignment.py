"""Aligned tokens against the two libraries and a plain merge."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lorecairn.llm import alignment, queries
from lorecairn.llm.tables import written
from lorecairn.llm.token_counts import byte_of_character


def content(name):
    with open(f"{queries.TOKENIZERS_FOLDER}/{name}", "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def files():
    return content(queries.BYTE_LEVEL), content(queries.PIECES)


@pytest.fixture(scope="module")
def by_hand(files):
    one, two = Tokenizer.from_str(files[0].decode()), sentencepiece.SentencePieceProcessor(model_proto=files[1])
    one.encode_special_tokens = True
    byte = byte_of_character()
    names = {i: bytes(byte.get(c, 0) for c in t) for t, i in json.loads(files[0])["model"]["vocab"].items()}

    def groups(text):
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids
        b = two.encode(text or "")
        shown = [[names[i] for i in a], [bytes([i - 3]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]]
        if not text or any(b"".join(x) != (" " + text).encode() for x in shown):
            return []
        ends = [dict(zip(np.cumsum([len(y) for y in x]).tolist(), range(1, len(x) + 1), strict=True)) for x in shown]
        cuts = [(ends[0][e], ends[1][e]) for e in sorted(ends[0].keys() & ends[1].keys())]
        return [(a[i:p], b[j:q]) for (i, j), (p, q) in zip([(0, 0), *cuts], cuts, strict=False)]

    def table(rows):
        all_groups = [(doc_id, groups(text)) for doc_id, text in rows]
        counts = Counter((a[-1], b[-1]) for _, found in all_groups for a, b in found)
        top = Counter()
        for (_, b), n in counts.items():
            top[b] = max(top[b], n)
        out = Counter()
        for doc_id, found in all_groups:
            links = [(a[-1], b[-1]) for a, b in found]
            shown = ";".join("|".join(",".join(map(str, x)) for x in g) for g in found)
            out[
                doc_id,
                sum(len(a) for a, _ in found),
                sum(len(b) for _, b in found),
                len(found),
                len(found),
                sum(counts[x] == top[x[1]] for x in links),
                sum(counts[x] for x in links),
                hashlib.sha256(shown.encode()).hexdigest() if found else "",
            ] += 1
        return out

    return table


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_pieces_find_every_common_end(piece):
    draw = random.Random(piece)
    for _ in range(200):
        a, b = (np.array(sorted(draw.sample(range(60), draw.randrange(0, 40)))) for _ in range(2))
        i, j = alignment.common_ends(a, b, piece)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(int((a <= e).sum()), int((b <= e).sum())) for e in sorted({*a.tolist()} & {*b.tolist()})]
        assert (np.diff(i) > 0).all()


def test_pieces_have_equal_work():
    a, b = np.arange(1, 100_001), np.array([100_000])
    split = alignment.crossings(a, b, np.arange(0, 100_002, 100))
    assert set(np.diff(split).tolist()) <= {99, 100}


def described(docs, files):
    aligned = written(alignment.align(docs, *files), "aligned")
    return Counter(map(tuple, alignment.describe(aligned, alignment.link_counts(aligned)).collect()))


@pytest.mark.parametrize("tiny", [False, True])
def test_tables_equal_the_libraries(spark, awkward, rows, files, by_hand, monkeypatch, tiny):
    if tiny:
        for name, value in (("PIECE", 5), ("DESCRIBE_TOKENS", 40), ("CHUNK_BYTES", 300)):
            monkeypatch.setattr(alignment, name, value)
    odd = ["▁a", "a▁b c", "<|endoftext|> x", "<s>x</s><0x0A>", "🎉 ﬁ x", "a\x00b", "  two  \n\n\t x's", " ", "\n", "Ünder " * 5, "1234567 don't", "日本語 text", "é"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").unionByName(more)
    assert described(docs, files) == by_hand([(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(odd)])


def test_no_rows(nothing, files):
    assert described(nothing, files) == Counter()


def test_query(spark, folder, by_hand):
    docs = queries.read(spark, folder, "documents").select("doc_id", "text").collect()
    assert Counter(map(tuple, queries.op13_token_alignment(spark, folder).collect())) == by_hand(map(tuple, docs))


def test_parts_are_tokenised_like_the_whole(files):
    draw = random.Random(11)
    one = alignment.tokenizer_of(files[0])
    letters = [*"ab c'  \n1é!\t\u00a0\u3000\u2003\x1c\x85", "th ", "'s ", " x", " 's", " 12 ", "<|endoftext|>", " — "]
    for _ in range(500):
        texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(20)]
        data = [t.encode() for t in texts]
        offsets = np.append(0, np.cumsum([len(x) for x in data]))
        ids, first = one.encode(np.frombuffer(b"".join(data), dtype=np.uint8), offsets)
        whole = [x.ids for x in one.library.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == whole


@pytest.mark.parametrize("tokens", [40, 1 << 18])
def test_packed_lists_give_the_same_rows(spark, awkward, files, monkeypatch, tokens):
    monkeypatch.setattr(alignment, "DESCRIBE_TOKENS", tokens)
    arrays, packed = (written(alignment.align(awkward, *files, packed=x), "aligned") for x in (False, True))
    assert [t for _, t in packed.dtypes[1:]] == ["binary"] * 4
    rows = [Counter(map(tuple, alignment.describe(x, alignment.link_counts(x)).collect())) for x in (arrays, packed)]
    assert rows[0] == rows[1] and sum(rows[0].values()) == awkward.count()
