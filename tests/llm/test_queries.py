"""Registered queries over whole tables of the smallest size against brute force and SQL."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from quern.llm import mixing, queries, sharding
from tests.conftest import SF
from tests.llm.test_ngram_join import brute
from tests.test_catalog import rows as plain_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def run(spark, name):
    return queries.QUERIES[name](spark, SF).toPandas()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert plain_rows(run(spark, name)) == plain_rows(con.sql(queries.ORACLES[name]).df())


def test_op1(spark, documents):
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in run(spark, "op1_token_files").itertuples()}
    for d, text in sorted(zip(documents.doc_id, documents.text)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(documents)


def test_op2(spark, documents):
    got = run(spark, "op2_ngram_join")
    want = brute(list(zip(documents.doc_id.tolist(), documents.text)), 3, 90, 100)
    assert sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in got.itertuples()), key=str) == want


def test_op3(spark, documents):
    """The mix block by block: each block of a source's stream is taken as often as the plan says."""
    got = run(spark, "op3_source_mix")
    size = {d: len(WORD.findall(t or "")) for d, t in zip(documents.doc_id, documents.text)}
    order = {d: hashlib.md5(f"1:{d}".encode()).hexdigest() for d in size}
    sources = {}
    for d, s in zip(documents.doc_id, documents.source):
        sources.setdefault(s, []).append(d)
    plan = {p[0]: p for p in mixing.plan([(s, sum(size[d] for d in ds)) for s, ds in sources.items()], mixing.BLOCK, 3, mixing.SHARDS, 1)}
    want = {}
    for s, ds in sources.items():
        _, total, target, blocks, per, quotas, steps, offsets = plan[s]
        times = []
        for k, q in enumerate(quotas):
            n = min(per, blocks - k * per)
            times += [q // n + ((steps[k] * i + offsets[k]) % n < q % n) for i in range(n)]
        assert sum(times) == sum(quotas) and len(times) == blocks
        stream = [d for d in sorted(ds, key=lambda d: (order[d], d)) for _ in range(size[d])]
        taken = dict.fromkeys(ds, 0)
        for i, d in enumerate(stream):
            taken[d] += times[i // mixing.BLOCK]
        want |= {d: (size[d], total, target, taken[d]) for d in ds}
    assert {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in got.itertuples()} == want


def test_op6(spark, documents):
    """Slots from the largest on, each to the lightest shard; places by slot, then by id."""
    got = run(spark, "op6_sharding")
    recs = sharding.records(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    loads = recs.groupby("vslot")["size"].sum()
    shard, free = {}, [0] * 16
    for v in sorted(loads.index, key=lambda v: (-loads[v], v)):
        shard[v] = int(np.argmin(free))
        free[shard[v]] += int(loads[v])
    recs["shard"] = recs.vslot.map(shard)
    recs = recs.sort_values(["shard", "vslot", "doc_id"])
    recs["slot"] = recs.groupby("shard").cumcount()
    want = {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot) for r in recs.itertuples()}
    assert {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot) for r in got.itertuples()} == want
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got.itertuples()} == {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in zip(documents.doc_id, documents.text)}


def test_op7(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op7_media").itertuples()}
    for d, text in zip(documents.doc_id, documents.text):
        raw = (text or "").encode()
        p = raw + b"\xff" * (max(576, math.ceil(len(raw) / 576) * 576) - len(raw))
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


def test_op8(spark, documents):
    got = run(spark, "op8_language_id").merge(documents[["doc_id", "lang"]])
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.95 and len(got) == len(documents)


def test_op9(spark, documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in run(spark, "op9_sentencepieces").itertuples()}
    for d, text in zip(documents.doc_id, documents.text):
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_op10(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    got = run(spark, "op10_quality")
    assert len(got) == len(documents) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    known = got.merge(labels)
    assert ((known.score >= 0.5) == (known.quality == 1)).mean() > 0.8
