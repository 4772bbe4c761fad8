import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from quern.llm import ngram_join as N
from quern.llm.common import among
from tests.llm.conftest import made

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    """doc_id, set size and component of rows (a row is a node); links by counting shared shingles."""
    sets, parent, met = [shingles(t, k) for _, t, *_ in rows], list(range(len(rows))), defaultdict(list)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in met[x])
        for j, o in shared.items():
            if den * o >= num * (len(s) + len(sets[j]) - o):
                parent[top(i)] = top(j)
        for x in s:
            met[x].append(i)
    low = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted(((str(d), len(s), low.get(top(i))) for i, ((d, *_), s) in enumerate(zip(rows, sets))), key=str)


def got(docs, k, num, den):
    return sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in N.join(docs, k, num, den).collect()), key=str)


def near_copies(seed, n=500):
    rng = random.Random(seed)
    v = [c * 3 for c in "abcdefghijkl"]
    base = [[rng.choice(v) for _ in range(rng.choice([1, 2, 3, 5, 12, 30, 80]))] for _ in range(30)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(v)
        rows.append((i, rng.choice([" ", "\n\t", "  "]).join(w), "en", "s"))
    return rows


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100), (2, 70, 100)])
def test_against_brute_force(spark, k, num, den):
    rows = near_copies(k)
    assert got(made(spark, rows), k, num, den) == brute(rows, k, num, den)


@pytest.mark.parametrize("cell,meet", [(60, 5), (200, 1 << 12)])
def test_groups_dealt_into_cells(spark, monkeypatch, cell, meet):
    monkeypatch.setattr(N, "CELL", cell)
    monkeypatch.setattr(N, "MEET", meet)
    monkeypatch.setattr(N, "STAND", 1)
    rows = near_copies(8, 300)
    assert got(made(spark, rows), 3, 80, 100) == brute(rows, 3, 80, 100)


def test_a_chain_longer_than_its_cells(spark, monkeypatch):
    """Sets that link with their neighbours only, dealt over many cells, are one component."""
    monkeypatch.setattr(N, "CELL", 250)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 60]), "en", "s") for i in range(60)] + [(100, " ".join(words[:59]) + " x", "en", "s"), (101, "apart from all", "en", "s")]
    assert got(made(spark, rows), 2, 90, 100) == brute(rows, 2, 90, 100)


def test_the_bitmap_lets_every_key_through(spark):
    rows = spark.range(2000).selectExpr("id as key")
    found = {r["key"] for r in among(rows, spark.range(0, 2000, 7).selectExpr("id as key"), 1 << 16).collect()}
    assert found >= set(range(0, 2000, 7)) and len(found) < 400


def test_awkward_rows(awkward, awkward_rows, empty):
    assert got(awkward, 3, 90, 100) == brute(awkward_rows, 3, 90, 100)
    assert N.join(empty).collect() == []


def test_rows_of_one_id_are_told_apart(spark):
    rows = [(1, "a b c d e f", "en", "s"), (5, "a b c d e f", "en", "s"), (5, "wholly different words stand here", "en", "s"), (None, "a b c d e f", "en", "s"), (None, "only rows without an id", "en", "s"), (None, "only rows without an id", "en", "s")]
    assert got(made(spark, rows), 3, 90, 100) == brute(rows, 3, 90, 100)


def test_search_meets_every_set_it_must():
    rng = np.random.default_rng(5)
    base = rng.choice(4000, 120, replace=False)
    sets = []
    for _ in range(150):
        s = base.copy()
        s[rng.integers(0, 120, rng.integers(0, 14))] = rng.integers(4000, 9000)
        sets.append(np.unique(np.concatenate([s[: rng.integers(100, 121)], rng.integers(9000, 9020, 3)])).astype(np.uint64))
    for num in (80, 90):
        index = N.Index(sets, num, 100)
        for q in range(0, 150, 7):
            want = [j for j in range(150) if j != q and 100 * (o := len(np.intersect1d(sets[q], sets[j]))) >= num * (len(sets[q]) + len(sets[j]) - o)]
            assert sorted(index.search(q).tolist()) == want


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(6)
    for num in (80, 90):
        for _ in range(300):
            n = int(rng.integers(9, 400))
            a = rng.integers(0, 2**62, n).astype(np.uint64)
            d = n * (100 - num) // (2 * 100)
            b = np.concatenate([a[d:], rng.integers(0, 2**62, max(0, d - 1)).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            o = len(np.intersect1d(a, b))
            if 100 * o >= num * (len(a) + len(b) - o) and len(a) != len(b):
                pa, pb = N.part_hashes([a, b], num, 100)
                assert len(np.intersect1d(pa, pb))


def test_words_in_slices(monkeypatch):
    text = ("Some Words\twith\x0bspace " * 50 + "x" * 300 + " end ").encode() * 3
    whole = N.word_hashes(np.frombuffer(text, "u1"))
    monkeypatch.setattr(N, "SLICE", 64)
    N._powers.cache_clear()
    parts = N.word_hashes(np.frombuffer(text, "u1"))
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert len(whole[0]) == len(WORD.findall(text.decode()))
    N._powers.cache_clear()


def test_hot_parts_are_dealt_over_salts(spark, monkeypatch):
    """Near copies that share parts, all of them hot: the result is that of no hot part at all."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(i, " ".join([*base[:-1], f"x{i}"]), "en", "s") for i in range(60)] + [(100 + i, " ".join(base), "en", "s") for i in range(30)]
    rows += [(200 + i, " ".join(rng.choice(words) for _ in range(50)), "en", "s") for i in range(40)] + [(None, " ".join(base), "en", "s")]
    docs = made(spark, rows)
    plain = sorted(map(tuple, N.join(docs, 3, 90, 100).collect()), key=str)
    monkeypatch.setattr(N, "HOT", 2)
    monkeypatch.setattr(N, "SALTS", 7)
    assert sorted(map(tuple, N.join(docs, 3, 90, 100).collect()), key=str) == plain
    assert sum(r[2] == 0 for r in plain) == 91 or sum(r[2] == 0 for r in plain) == 90


def test_a_shared_part_costs_few_bytes(spark):
    """Parts go to their buckets in some 5 bytes each, however many buckets there are, and meet as they did one by one."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(20, 300)], rng.integers(0, 2**62, 20).astype(np.uint64)])) for _ in range(400)]
    parts, names = N.part_hashes(sets, 80, 100), [N.identity(s) for s in sets]
    hot = np.sort(parts[0][:3])
    for buckets in (1, 40, 2000):
        rows = [b for b in N.bundles(parts, names, hot, buckets)]
        n = sum(map(len, parts))
        assert sum(b["a"].nbytes + b["b"].nbytes for b in rows if b["kind"][0].as_py() == N.PLAIN) < 6 * n + 12 * 2 * buckets
        table = N.pa.Table.from_batches(rows)
        met, named = {}, {}
        for bucket in sorted(set(table["bucket"].to_pylist())):
            for kind in (N.PLAIN, N.WARM, N.NAMES):
                some = table.filter((N.pa.compute.field("bucket") == bucket) & (N.pa.compute.field("kind") == kind))
                for r in N.meetings(some).to_pylist() if len(some) else []:
                    if kind == N.NAMES:
                        named[r["at"]] = (r["h1"], r["half"])
                    else:
                        met.setdefault(r["part"], []).append(r["at"])
        assert sorted(named.values()) == sorted((a, b & N._HALF) for a, b in names)
        want = {}
        for p, (a, b) in zip(parts, names):
            for x in p.tolist():
                want.setdefault(x, []).append((a, b & N._HALF))
        want = sorted(sorted(v) for x, v in want.items() if len(v) > 1 or x in hot)
        assert sorted(sorted(named[at] for at in v) for v in met.values()) == want


def test_short_texts_of_common_words_are_kept_apart():
    """Texts of few words with passages in common don't pass for alike, so they make no group; links are all kept."""
    rng = random.Random(12)
    common = [" ".join(f"w{rng.randrange(60)}" for _ in range(9)) for _ in range(12)]
    texts = [" ".join([*(f"v{rng.randrange(3000)}" for _ in range(rng.randint(1, 12))), *rng.sample(common, 3)]) for _ in range(400)]
    texts += [t + " more" for t in texts[:40]]
    sets = N.shingle_sets(texts, 5)
    index = N.Sketches(np.array(list(map(len, sets))), [N.sketch(s) for s in sets], 80, 100)
    linked = [{j for j in range(len(sets)) if j != i and 100 * (o := len(np.intersect1d(s, sets[j]))) >= 80 * (len(s) + len(sets[j]) - o)} for i, s in enumerate(sets)]
    passed = [set(index.search(i).tolist()) for i in range(len(sets))]
    assert all(a <= b for a, b in zip(linked, passed))
    assert sum(map(len, linked)) >= 60 and sum(map(len, passed)) < 2 * sum(map(len, linked))
