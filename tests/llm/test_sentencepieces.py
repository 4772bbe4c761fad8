import hashlib
import random

import numpy as np
from quern.llm import sentencepieces as S
from quern.llm.queries import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


def test_encoder_is_the_library():
    enc, rng = S.encoder(MODEL), random.Random(2)
    parts = [" ", "  ", "   ", "\n", "\t", "a", "b", "the", "ing", "er", "é", "日本", "aaaa", "1", ".", ",", "<s>", "<0x41>", "▁", "\0", "😀", "qu", "---", "Я", "́"]
    for k in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) if k % 2 else "".join(rng.choice("abcdeiounrstlh") for _ in range(rng.randint(0, 60)))
        want = enc.library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == want, text


def test_backtracking_is_merging():
    enc, rng = S.encoder(MODEL), random.Random(3)
    for _ in range(1500):
        word = "▁" + "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(1, 30)))
        assert enc.backtracked(word) == enc.merged(word)


def test_rows(awkward, awkward_rows, empty):
    lib = S.encoder(MODEL).library
    want = []
    for d, t, _, _ in awkward_rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, S.digests(awkward, MODEL).collect()), key=key) == sorted(want, key=key)
    assert S.digests(empty, MODEL).collect() == []
    back = {(r["doc_id"], r["text"]) for r in S.decoded(S.encoded(awkward, MODEL), MODEL).collect()}
    assert back == {(d, lib.decode(lib.encode(t or "", add_bos=True, add_eos=True))) for d, t, _, _ in awkward_rows}
