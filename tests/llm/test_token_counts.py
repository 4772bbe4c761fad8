import random

import public_tokenizers
import pytest
import sentencepiece
from quern.llm import token_counts
from tests.conftest import SF

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(1)
    of = lambda chars, n, many: ["".join(rng.choice(chars) for _ in range(rng.randint(1, n))) for _ in range(many)]
    found = ["", " ", "\n\n \n\t a\r\n b", "日本語 テキスト é ñ 😀 ▁ <s> </s> <unk> <|endoftext|> \x00 end", " " * 5000 + "x", "x" * 100_000, "<0x41> [INST]"]
    found += [" " * k + word + " " * j for k in range(0, 90, 3) for j in (0, 15, 16, 33, 64) for word in ("", "the", "\n")]
    return found + of("the ining  onat", 60, 2000) + of("the", 300, 200) + of("ab", 300, 200) + of("=-_/*#.", 200, 200)


def test_counts_are_the_library_s(library):
    found = texts()
    assert token_counts.counter(MODEL).counts(found) == [len(x) for x in library.encode(found)]


def test_any_pieces_side_by_side(library):
    """Out-of-order pieces next to their own parts and to copies of themselves."""
    rng, pieces = random.Random(2), [library.id_to_piece(i).replace("▁", " ") for i in range(300, 32_000)]
    found = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    found += [p * rng.randint(2, 6) for p in pieces[:: 7]]
    assert token_counts.counter(MODEL).counts(found) == [len(x) for x in library.encode(found)]


def test_small_pieces_of_texts_and_a_full_store(library):
    count = token_counts.MergeCounter(MODEL)
    count.AT_ONCE, count.KEPT = 50, 20
    found = texts()[:400] + ["some words  again and   again " * 40]
    assert count.counts(found) == [len(x) for x in library.encode(found)]


def test_awkward_rows(spark, awkward, awkward_rows, library):
    got = sorted(map(tuple, token_counts.counted(awkward, MODEL, 50).collect()), key=str)
    want = [(d, len((t or "").encode()), len(library.encode(t or ""))) for d, t, _, _ in awkward_rows]
    assert got == sorted(((*r, r[2] > 50) for r in want), key=str)


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: len(library.encode(r["text"] or "")) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.counted(docs, MODEL).collect()} == want


def test_empty(spark, empty):
    assert token_counts.counted(empty, MODEL).collect() == []
