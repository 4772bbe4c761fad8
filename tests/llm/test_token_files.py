import random
import zlib

import numpy as np
import pytest
from quern.llm import token_files as T
from quern.llm.queries import vocabulary

BPE = vocabulary("byte_bpe_50k.json")


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids


def test_round_trip_in_document_order(spark, awkward, awkward_rows):
    out, files = T.write(awkward, BPE)
    got = T.read(spark, out, files, digest=False).collect()
    assert sum(f[2] for f in files) == sum(len(r["ids"]) for r in got)
    want = sorted((-1 if d is None else d, library_ids(t) + [0]) for d, t, _, _ in awkward_rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in got) == want
    at, rows = 0, sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] is not None for r in rows] == sorted(r["doc_id"] is not None for r in rows)
    assert [r["doc_id"] or 0 for r in rows] == sorted(r["doc_id"] or 0 for r in rows)
    for r in rows:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        at += r["n_tokens"]
    digests = {(r["start"], r["ids_crc32"]) for r in T.read(spark, out, files).collect()}
    assert digests == {(r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got}


def test_empty_table(spark, empty):
    out, files = T.write(empty, BPE)
    assert files == [] and T.read(spark, out, files).collect() == []


def test_any_token_is_addressed_directly():
    rng = random.Random(4)
    ids = np.array([rng.choice([0, 1, 255, 256, 65535, 65536, 1 << 24, 2**32 - 1]) for _ in range(3000)], "<u4")
    f = T.DacFile(b"".join(T.DacWriter.pack(ids, [1, None], np.array([1000, 3000]))))
    assert [f.token(i) for i in range(len(ids))] == ids.tolist()
    for a, b in [(0, 3000), (7, 8), (511, 513), (1000, 1000), (2999, 3000)]:
        assert f.tokens(a, b).tolist() == ids[a:b].tolist()
    assert f.doc(1).tolist() == ids[1000:].tolist() and f.null.tolist() == [0, 1]
    with pytest.raises(IndexError):
        f.token(3000)
    with pytest.raises(ValueError):
        T.DacFile(b"\0" * 64)


def test_encoder_is_the_library():
    enc, rng = T.Encoder(BPE), random.Random(1)
    parts = list(" \n\t\r ab'sItll'9é!.,½²ǆ—“”日本カЖ한\xa0　\x85\x1c") + ["  ", "'ll", "the", "<|endoftext|>", " word"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert enc(text) == enc._whole(text), text
    assert enc.cut
