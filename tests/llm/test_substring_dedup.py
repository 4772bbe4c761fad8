import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from quern.llm import substring_dedup as S
from tests.conftest import SF
from tests.llm.conftest import made


def words(rng, n, v):
    return [rng.choice(v) for _ in range(n)]


def planted(seed, length=51):
    rng = random.Random(seed)
    v = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts = [words(rng, rng.randint(1, 300), v) for _ in range(240)]
    passages, at = [" ".join(words(rng, length, v)) for _ in range(30)], {}
    for k, p in enumerate(passages):
        for j in rng.sample(range(240), 3):
            if j not in at:
                at[j], cut = k, rng.randint(0, len(texts[j]))
                texts[j] = [*texts[j][:cut], p, *texts[j][cut:]]
    return [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)], passages, at


def test_planted_passages_are_caught_and_nothing_else(spark):
    rows, passages, at = planted(5)
    holders = defaultdict(list)
    for j, k in at.items():
        holders[k].append(j)
    want = {j: min(h) for h in holders.values() for j in h if j != min(h)}
    got = S.duplicates(made(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == set(want)
    text = {d: t.encode() for d, t, *_ in rows}
    for r in got:
        part = text[r["doc_id"]][r["start"] : r["stop"]]
        assert part in passages[at[r["doc_id"]]].encode() and r["n_bytes"] == len(part) and want[r["doc_id"]] in r["kept_in"]
    left = {r["doc_id"]: r for r in S.deduplicated(made(spark, rows)).collect()}
    for j in want:
        assert passages[at[j]] not in left[j]["text"] and left[j]["n_chars"] == len(left[j]["text"])
    assert all(left[d]["text"] == t for d, t, *_ in rows if d not in want)


def test_passages_go_to_their_true_ends(spark):
    rows, passages, at = planted(6)
    rows += [(900 + i, t, "en", "s") for i, t in enumerate([rows[0][1], rows[3][1]])]
    text = {d: t.encode() for d, t, *_ in rows}
    got = {}
    for r in S.duplicates(made(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(text[r["doc_id"]][r["start"] : r["stop"]])
    first = {k: min(j for j in at if at[j] == k) for k in at.values()}
    late = [j for j in at if j != first[at[j]]]
    assert late and all(any(passages[at[j]].encode() in part for part in got[j]) for j in late)
    assert got[900] == [text[900]] and got[901] == [text[901]]


def test_spans_grow_by_whole_words():
    assert S.extended(b"one two ", b"xone two ", b" three four", b" three fourth") == (4, 6)
    assert S.extended(b"two ", b"one two ", b" three", b" three four") == (4, 6)
    assert S.extended(b"", b"a ", b"", b"") == (0, 0) and S.extended(b"a ", b"b ", b"\n a", b" a") == (0, 0)


def test_cuts_follow_the_content():
    rng = random.Random(2)
    v = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    body = " ".join(words(rng, 400, v))
    a, b = S.runs_of([body.encode(), ("inserted words here " + body).encode()])
    shift = len("inserted words here ")
    same = {(x, y, d) for x, y, d in a} & {(x - shift, y - shift, d) for x, y, d in b}
    assert len(same) >= len(a) - 3
    assert S.runs_of([b"few words"]) == [[]] and S.runs_of([b""]) == [[]]


def windows(text, n):
    """(start, stop, bytes) of each n words in a row."""
    at = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    return [(a[0], b[1], text[a[0] : b[1]]) for a, b in zip(at, at[n - 1 :])]


def against_brute_force(rows, found):
    """All that an earlier row holds too, in passages of 51 words, is in a span; whatever is in a span stands in a
    passage of WORDS words that an earlier row holds."""
    texts = sorted((d, t.encode()) for d, t in rows)
    first = {n: {} for n in (S.WORDS, 51)}
    for n, seen in first.items():
        for d, t in texts:
            for *_, w in windows(t, n):
                seen.setdefault(w, d)
    spans = defaultdict(list)
    for r in found:
        spans[r["doc_id"]].append((r["start"], r["stop"]))
    wanted = 0
    for d, t in texts:
        for a, b, w in windows(t, 51):
            if first[51][w] < d:
                wanted += 1
                assert any(x <= a and b <= y for x, y in spans[d]), (d, a, b)
        sound = [(a, b) for a, b, w in windows(t, S.WORDS) if first[S.WORDS][w] < d]
        for x, y in spans[d]:
            inside = [(a, b) for a, b in sound if x <= a and b <= y]
            for a, b, _ in windows(t, 1):
                if x <= a and b <= y:
                    assert any(p <= a and b <= q for p, q in inside), (d, x, y)
    return wanted


def test_against_brute_force(spark):
    rng = random.Random(31)
    rows, passages, _ = planted(7, 60)
    rows = [(d, t) for d, t, *_ in rows]
    rows += [(300 + i, " ".join([passages[i][:90], rng.choice(rows)[1], passages[i + 1], passages[i]])) for i in range(20)]
    rows += [(400 + i, rows[i][1]) for i in range(0, 30, 3)]
    assert against_brute_force(rows, S.duplicates(made(spark, [(d, t, "en", "s") for d, t in rows])).collect()) > 1000


def test_a_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert against_brute_force([(r["doc_id"], r["text"] or "") for r in docs.collect()], S.duplicates(docs).collect()) > 100


def test_names_of_its_own_do_not_clash(spark):
    names = ["row", "of_id", "of_text", "id", "h", "spans", "cut", "hits", "start", "_spans", "_span_id", "_span_h", "size"]
    passage = " ".join(f"w{k}" for k in range(80))
    rows = [(i, f"{'x ' * i}{passage} y{i}", i, *["v"] * len(names), {"k": i}) for i in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars int, " + ", ".join(f"`{n}` string" for n in names) + ", m map<string,int>")
    out = S.deduplicated(docs)
    assert out.dtypes == docs.dtypes
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == rows[0][1] and passage not in got[2]["text"] and got[2]["n_chars"] == len(got[2]["text"]) and got[2]["m"] == {"k": 2} and got[2]["h"] == "v"


def test_hash_depends_on_sixteen_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 400, dtype=np.uint8)
    other = data.copy()
    other[:200] = rng.integers(0, 256, 200, dtype=np.uint8)
    assert (S.gear(data)[215:] == S.gear(other)[215:]).all() and (S.gear(data)[:200] != S.gear(other)[:200]).mean() > 0.9


def test_awkward_rows(awkward, awkward_rows, empty):
    got = S.duplicates(awkward).collect()
    assert {r["doc_id"] for r in got} <= {104, 107} and 104 in {r["doc_id"] for r in got}
    out = S.deduplicated(awkward)
    assert out.dtypes == awkward.dtypes and out.count() == len(awkward_rows)
    assert S.duplicates(empty).collect() == [] and S.deduplicated(empty).collect() == []


def test_multibyte_text_is_cut_between_characters(spark):
    passage = " ".join(f"čtvrť{k}ñ" for k in range(60))
    rows = [(1, "první " + passage + " konec", "cs", None), (2, "druhý začátek " + passage, "cs", None)]
    left = {r["doc_id"]: r["text"] for r in S.deduplicated(made(spark, rows)).collect()}
    assert left[1] == rows[0][1] and passage not in left[2] and "�" not in left[2]


def test_slices_hold_all_rows_in_order_and_a_bounded_number_of_items(monkeypatch):
    monkeypatch.setattr(S, "ITEMS", 4)
    lists = [[1, 2], [], [3], [4, 5, 6, 7, 8, 9], [10], [], []]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64()))], ["hits"]) for x in (lists, lists[3:4], [])]
    got = [s["hits"].to_pylist() for s in S.slices(batches, "hits")]
    assert [x for s in got for x in s] == lists + lists[3:4]
    assert all(len(s) == 1 or sum(map(len, s)) <= 4 for s in got)
