import random

import pytest
from pyspark.sql import functions as F
from quern.operators import ordered as O


def groups(seed, n_groups=60, most=14):
    rng = random.Random(seed)
    return rng, [(g, i) for g in range(n_groups) for i in range(rng.randint(1, most))]


def test_keep_tail_follows_the_loop(spark):
    rng, keys = groups(1)
    rows = [(g, i, rng.choice([0, 1, 50, 300, 900])) for g, i in keys]
    want = set()
    for g in {r[0] for r in rows}:
        mine, tokens, count = [r for r in rows if r[0] == g], 0, 0
        for r in reversed(mine):
            if count and tokens + r[2] > 1200:
                break
            tokens, count = tokens + r[2], count + 1
            want.add(r[:2])
            if tokens >= 500 or count >= 5:
                break
    got = O.keep_tail(spark.createDataFrame(rows, "g int, i int, c int"), ["g"], ["i"], F.col("c"), 500, 5, 1200)
    assert {(r["g"], r["i"]) for r in got.collect()} == want


def test_valid_prefix_with_repeated_ids(spark):
    rng, keys = groups(2)
    rows = [(g, i, [rng.choice("abc") for _ in range(rng.randint(1, 2))] if rng.random() < 0.4 else None, rng.choice("abc") if rng.random() < 0.5 else None) for g, i in keys]
    want = {}
    for g, i, use, result in rows:
        state = want.setdefault(g, [set(), 0, 0])
        state[0] |= set(use or ())
        state[0] -= {result}
        state[1] += 1
        if not state[0]:
            state[2] = state[1]
    got = O.valid_prefix(spark.createDataFrame(rows, "g int, i int, u array<string>, r string"), ["g"], ["i"], "u", "r")
    assert {r["g"]: r["n_valid"] for r in got.collect()} == {g: s[2] for g, s in want.items()}


def test_spill_budget_follows_the_loop(spark):
    rng, keys = groups(3)
    rows = [(g, i, "x" * rng.choice([3, 10, 40, 90, 120]), rng.randint(5, 60), rng.random() < 0.1, rng.random() < 0.1) for g, i in keys]
    want = {}
    for g in {r[0] for r in rows}:
        mine = [list(r) for r in rows if r[0] == g]
        size = {r[1]: len(r[2]) for r in mine}
        done = set()
        rest = []
        for r in mine:
            if r[5]:
                continue
            if len(r[2]) > 100:
                if not r[4]:
                    size[r[1]] = r[3]
                    done.add(r[1])
            else:
                rest.append(r)
        for r in sorted(rest, key=lambda r: (-len(r[2]), r[1])):
            if sum(size.values()) <= 150:
                break
            if not r[4]:
                size[r[1]] = r[3]
                done.add(r[1])
        want |= {(g, r[1]): r[1] in done for r in mine}
    df = spark.createDataFrame(rows, "g int, i int, t string, p int, e boolean, f boolean")
    got = O.spill_budget(df, ["g"], "i", "t", 100, 150, F.col("p"), F.col("e"), F.col("f"))
    assert {(r["g"], r["i"]): r["spilled"] for r in got.collect()} == want


def test_runs_merge_only_where_they_join(spark):
    rows = [(1, i, k, t) for i, (k, t) in enumerate([("u", "a"), ("u", "b"), ("x", "c"), ("u", "d"), ("u", "e")])]
    df = spark.createDataFrame(rows, "g int, i int, k string, t string")
    got = O.merge_runs(df, ["g"], ["i"], "k", "t").orderBy("first_at").collect()
    assert [(r["k"], r["merged"]) for r in got] == [("u", "a\nb"), ("x", "c"), ("u", "d\ne")]
    safe = O.islands(df, ["g"], ["i"], F.lit(1), F.col("k") == "u").orderBy("i").collect()
    assert [r["island"] for r in safe] == [1, 1, 2, 3, 3]


def test_breaker_and_gate(spark):
    rows = [(1, i, ok) for i, ok in enumerate([False, False, False, None, True, False])]
    got = O.breaker(spark.createDataFrame(rows, "g int, i int, ok boolean"), ["g"], ["i"], F.col("ok")).orderBy("i").collect()
    assert [(r["failures"], r["is_open"]) for r in got] == [(1, False), (2, False), (3, True), (4, True), (0, False), (1, False)]
    cases = [(166_999, 0, False), (167_000, 0, True), (167_000, 3, False), (177_000, 3, True)]
    df = spark.createDataFrame(cases, "t int, f int, want boolean").withColumn("got", O.compaction_gate(F.col("t"), F.lit(200_000), F.col("f")))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_accepted_intervals(spark):
    rng = random.Random(5)
    rows = [(g, s, s + rng.randint(1, 9)) for g in range(20) for s in rng.sample(range(60), 12)]
    want = {}
    for g in range(20):
        end = -1
        for _, s, e in sorted(r for r in rows if r[0] == g):
            want[g, s, e] = s >= end
            end = e if s >= end else end
    got = O.accepted_intervals(spark.createDataFrame(rows, "g int, s long, e long"), ["g"], "s", "e")
    assert {(r["g"], r["s"], r["e"]): r["accepted"] for r in got.collect()} == want


def test_sticky_and_budget(spark):
    df = spark.createDataFrame([("a", "long"), ("b", "text"), ("c", "new")], "id string, t string")
    decided = spark.createDataFrame([("a", "short"), ("b", None)], "id string, replacement string")
    got = {r["id"]: (r["t"], r["known"]) for r in O.sticky(df, decided, "id", "t").collect()}
    assert got == {"a": ("short", True), "b": ("text", True), "c": ("new", False)}
    costs = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 3, 1)], "g int, i int, c int")
    assert O.prefix_budget(costs, ["g"], ["i"], F.col("c"), 15).count() == 1


@pytest.mark.parametrize("n,kept", [(1, 0), (4, 3), (5, 4), (11, 9)])
def test_oldest_fifth_goes(spark, n, kept):
    df = spark.createDataFrame([(1, k) for k in range(n)], "g int, group_no int")
    assert O.drop_oldest(df, ["g"]).count() == kept
