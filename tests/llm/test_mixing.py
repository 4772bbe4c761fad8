import random
import re

from quern.llm import mixing as M
from tests.llm.conftest import made

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def highest_quotients(votes, seats, caps):
    got = [0] * len(votes)
    for _ in range(seats):
        open_parties = [i for i in range(len(votes)) if got[i] < caps[i] and votes[i] > 0]
        if not open_parties:
            break
        i = max(open_parties, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def test_apportionment_is_that_of_highest_quotients():
    rng = random.Random(6)
    for _ in range(400):
        votes = [rng.choice([0.0, 1.0, 2.5, rng.random() * 100]) for _ in range(rng.randint(1, 9))]
        seats = rng.randint(0, 60)
        caps = [rng.choice([seats, rng.randint(0, 20)]) for _ in votes]
        assert M.apportion(votes, seats, caps) == highest_quotients(votes, seats, caps)


def test_targets_stop_at_three_times_the_size():
    assert M.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    got = M.targets([10, 1000, 0], [3, 1, 2])
    assert got[0] == 30 and got[2] == 0 and abs(sum(got) - 1010) < 1e-9
    assert M.targets([], []) == []


def test_mix(awkward, awkward_rows, empty):
    rows = [r.asDict() for r in M.mix(awkward).collect()]
    sizes = [len(WORD.findall(t or "")) for _, t, _, _ in awkward_rows]
    assert sorted(r["size"] for r in rows) == sorted(sizes)
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = by.setdefault(r["source"], {"size": r["source_size"], "target": r["target"], "taken": 0, "n": 0})
        s["taken"] += r["taken"]
        s["n"] += r["size"]
    assert all(s["n"] == s["size"] and abs(s["taken"] - s["target"]) <= 3 * M.BLOCK for s in by.values())
    names = sorted(by, key=lambda s: (s is None, s or ""))
    assert [by[s]["target"] for s in names] == M.targets([by[s]["size"] for s in names], [M.cycle_weight(i) for i in range(len(names))])
    again = [r.asDict() for r in M.mix(awkward.repartition(7)).collect()]
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted(rows, key=key) == sorted(again, key=key)
    assert M.mix(empty).collect() == [] and M.mixed_documents(empty).collect() == []


def test_mixed_documents_keep_the_columns(awkward):
    out = M.mixed_documents(awkward)
    assert out.columns == awkward.columns and out.dtypes == awkward.dtypes
    taken = sum(r["taken"] for r in M.mix(awkward).collect())
    words = sum(len(WORD.findall(r["text"] or "")) for r in out.collect())
    assert abs(words - taken) < 0.5 * taken


def test_each_source_ends_within_a_document_of_its_quota(spark):
    rows = [(i, " ".join(["w"] * n), "en", s) for i, (s, n) in enumerate([("one", 50)] + [("few", 3 + 40 * k) for k in range(5)] + [("many", 1 + k % 70) for k in range(900)] + [(None, 10 + k) for k in range(30)])]
    docs = made(spark, rows)
    taken, size, largest = {}, {}, {}
    for r in M.mix(docs).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    for r in M.mixed_documents(docs).collect():
        size[r["source"]] = size.get(r["source"], 0) + len(WORD.findall(r["text"]))
    assert all(abs(size.get(s, 0) - n) <= largest[s] for s, n in taken.items())
