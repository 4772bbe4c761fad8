import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, h1 string, rep string, score string, carry string, label string, `row` string, `odd name` int"


def made(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, lang, src, None if t is None else len(t), 7, "x", "y", None, "c", None, "r", 1) for d, t, lang, src in rows], SCHEMA)


def sentences(seed, n, words=40, vocabulary=600):
    rng = random.Random(seed)
    v = ["".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(1, 9))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(v) for _ in range(rng.randint(1, 2 * words))) for _ in range(n)]


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls, empties, white space, a very long text and word, ties, repeated rows, near copies."""
    base = sentences(1, 30)
    long = " ".join(sentences(2, 1, 30_000))
    rows = [(i, t, ["en", "fr"][i % 2], f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100, None, "en", "s0"), (101, "", None, "s1"), (102, " \n\t ", "fr", None), (None, "no id here " * 30, "en", None), (None, None, None, None)]
    rows += [(103, long, "en", "s0"), (104, long + " end", "en", "s1"), (105, "x" * 200_000, "en", "s2"), (106, "12 34 -- !!", "en", "s2")]
    rows += [(5, base[5], "en", "s2"), (5, base[5], "en", "s2"), (107, base[7], "fr", "s1"), (108, base[7].upper(), "fr", "s1"), (5, "another text under a used id", "en", "s0")]
    rows += [(109, "日本語 テキスト é ñ 😀 ▁ <s> <|endoftext|> \x00 end", None, "s0"), (110, "one", "en", "s0"), (111, "one two", "en", "s0")]
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return made(spark, awkward_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return made(spark, [])
