from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, score double, shard int, leaks string, size string, copies string"
WORDS = [a + b for a in "bcdfglmnprst" for b in ("a", "en", "ior", "uth")]


def sentence(draw: random.Random, words: int) -> str:
    return " ".join(draw.choice(WORDS) + draw.choice(WORDS) for _ in range(words))


@pytest.fixture(scope="session")
def rows():
    """Near and exact copies, a shared passage, and every awkward case; other columns have clashing names."""
    draw = random.Random(7)
    texts = [sentence(draw, draw.randint(5, 60)) for _ in range(60)]
    passage = sentence(draw, 12)
    for i in range(0, 30):
        texts[i] += "\n" + passage
    for i in range(20):
        words = texts[i].split(" ")
        words[draw.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [texts[3]] * 12
    texts += ["", " \t\n", "one", "one two", "One TWO", None, "a\x1cb c d", "x " * 4000, "..!!", "Der Der Der Der"]
    made = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}" if i % 5 else None, 1.5, 3, "a", "b", "c") for i, t in enumerate(texts)]
    made += [made[5], made[5], (None, texts[0], None, None, None, None, None, None, None), (None, None, *[None] * 7)]
    return made


@pytest.fixture(scope="session")
def awkward(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
