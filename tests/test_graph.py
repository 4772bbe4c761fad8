import random

from pyspark.sql import functions as F
from quern.operators import graph as G
from quern.operators import rollup as R
from quern.operators import rules as P


def conflict(a, b):
    def overlap(x, y):
        return x[0] == y[0] or x[1] and y[0].startswith(x[0] + "/") or y[1] and x[0].startswith(y[0] + "/")

    if a[3] or b[3]:
        return True
    return any(overlap(w, o) for w in a[2] for o in b[1] + b[2]) or any(overlap(w, o) for w in b[2] for o in a[1])


def reduced(calls):
    """Edges as a scheduler finds them call by call."""
    above, edges = {}, []
    for i, c in enumerate(calls):
        cand = [j for j in range(i) if conflict(calls[j], c)]
        deps = [j for j in cand if not any(j in above[o] for o in cand if o != j)]
        edges += [(j, i) for j in deps]
        above[i] = set(deps) | {x for j in deps for x in above[j]}
    return sorted(edges)


SCHEMA = "seq int, reads array<struct<path:string,recursive:boolean>>, writes array<struct<path:string,recursive:boolean>>, exclusive boolean"


def test_conflicts_and_frontier(spark):
    for seed in range(4):
        rng = random.Random(seed)
        paths = ["/r", "/r/a", "/r/a/x", "/r/ab", "/r/b"]
        ref = lambda: [(rng.choice(paths), rng.random() < 0.3) for _ in range(rng.randint(0, 2))]  # noqa: B023, E731
        calls = [(i, ref(), ref() if rng.random() < 0.4 else [], rng.random() < 0.08) for i in range(25)]
        df = spark.createDataFrame(calls, SCHEMA)
        edges = G.conflicts(df)
        want = sorted((i, j) for j in range(25) for i in range(j) if conflict(calls[i], calls[j]))
        assert sorted((r["earlier"], r["later"]) for r in edges.collect()) == want
        assert sorted((r["earlier"], r["later"]) for r in G.frontier(edges).collect()) == reduced(calls)
        assert sorted((r["earlier"], r["later"]) for r in G.waiting(G.scheduled(df)).collect()) == reduced(calls)


def test_every_turn_has_its_own_conflicts(spark):
    rng = random.Random(9)
    paths = ["/r", "/r/a", "/r/a/x", "/r/b"]
    turns = {t: [([(rng.choice(paths), rng.random() < 0.3)], [(rng.choice(paths), False)] if rng.random() < 0.4 else [], rng.random() < 0.1) for _ in range(12)] for t in range(4)} | {4: [([("/r", False)], [], False)]}
    df = spark.createDataFrame([(t, 100 * t + i, *c) for t, cs in turns.items() for i, c in enumerate(cs)], "turn int, " + SCHEMA)
    edges = G.conflicts(df, "turn")
    numbered = {t: [(i, *c) for i, c in enumerate(cs)] for t, cs in turns.items()}
    want = sorted((t, 100 * t + i, 100 * t + j) for t, cs in numbered.items() for j in range(len(cs)) for i in range(j) if conflict(cs[i], cs[j]))
    assert sorted(map(tuple, edges.select("turn", "earlier", "later").collect())) == want
    least = sorted((t, 100 * t + i, 100 * t + j) for t, cs in numbered.items() for i, j in reduced(cs))
    kept = G.frontier(edges, "turn")
    assert sorted(map(tuple, kept.select("turn", "earlier", "later").collect())) == least
    schedule = G.scheduled(df, "turn")
    assert sorted(map(tuple, G.waiting(schedule, "turn").select("turn", "earlier", "later").collect())) == least
    stats = {r["turn"]: (r["submitted"], r["dependency_edges"], r["conflicted_calls"]) for r in R.scheduler_stats(schedule, "turn").collect()}
    assert stats == {t: (len(cs), sum(x[0] == t for x in least), len({x[2] for x in least if x[0] == t})) for t, cs in turns.items()}


def test_later_events_are_calls_too(spark):
    from quern.plans import catalog
    from tests.conftest import SF

    got = catalog.QUERIES["conflict_edges"](spark, SF)
    events = catalog.table(spark, SF, "events").count()
    stats = catalog.QUERIES["scheduler_stats"](spark, SF).collect()
    assert sum(r["submitted"] for r in stats) == events and got.where("later >= 60").count() > 0


def test_scheduled_odd_calls(spark):
    """Roots, paths that only begin alike, nulls, no rows, and a turn in which every call meets every other."""
    read, write = lambda *p: ([(x, False) for x in p], []), lambda p, r=False: ([], [(p, r)])
    calls = [read("/a/b"), write("/", True), read("/ab"), write("/a"), read("/a/b"), ([("/", True)], []), write("rel/x"), ([("rel", True)], []), ([], []), (None, None)]
    df = spark.createDataFrame([(None, i, *c, None) for i, c in enumerate(calls)], "turn string, " + SCHEMA)
    got = {r["seq"]: (r["wave"], r["waits_for"]) for r in G.scheduled(df, "turn").collect()}
    assert got == {0: (1, []), 1: (2, [0]), 2: (3, [1]), 3: (3, [1]), 4: (3, [1]), 5: (4, [3]), 6: (1, []), 7: (2, [6]), 8: (1, []), 9: (1, [])}
    assert G.scheduled(df.limit(0), "turn").collect() == []
    one = spark.createDataFrame([(i, *write("/f"), False) for i in range(3000)], SCHEMA)
    chain = G.scheduled(one)
    assert chain.where("wave <> seq + 1 or size(waits_for) <> least(seq, 1)").count() == 0


def test_scheduled_calls(spark):
    def edges(rows):
        df = spark.createDataFrame(rows, "seq int, tool string, category string, path string, concurrent boolean")
        a = df.select("seq", P.access(F.col("tool"), F.col("category"), F.col("path"), F.col("concurrent"), "/p").alias("a")).select("seq", "a.*")
        return G.frontier(G.conflicts(a)).count()

    assert edges([(i, "ReadFile", "read", "/p/a", True) for i in range(2)]) == 0
    assert edges([(i, "WriteFile", "write", "/p/a", False) for i in range(8)]) == 7
    assert edges([(i, "WriteFile", "write", f"/p/{i}", False) for i in range(4)]) == 0
    assert edges([(0, "Grep", "read", "", True), (1, "WriteFile", "write", "/p/sub/f", False)]) == 1
    assert edges([(0, "ReadFile", "read", "/p/a", True), (1, "Bash", "command", "", False), (2, "ReadFile", "read", "/p/b", True)]) == 2
    assert edges([(0, None, None, None, True), (1, "EditFile", "write", "/p/b", False), (2, "ReadFile", "read", "/p/b", True)]) == 2


def test_closure_of_a_cycle_ends(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "x string, y string")
    got = {(r["from"], r["to"]) for r in G.closure(e, "x", "y").collect()}
    assert got == {(a, b) for a in "abc" for b in "abcd" if a != b}


def test_adjacency(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b"), ("c", "b")], "x string, y string")
    assert [(r["y"], r["referenced_by"]) for r in G.inverted(e, "x", "y").collect()] == [("b", ["a", "c"])]
    issues = spark.createDataFrame([("m.py", ["z.py"]), ("n.py", None)], "file string, old array<string>")
    use = spark.createDataFrame([("m.py", "a.py"), ("m.py", "m.py")], "file string, consumer string")
    got = {r["file"]: r["affected_files"] for r in G.affected(issues, use, "file", "old").collect()}
    assert got == {"m.py": ["a.py", "z.py"], "n.py": []}


def test_trees_and_boards(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone")], "id string, parent_id string")
    assert {(r["node"], r["depth"], r["path"]) for r in G.tree(nodes, "id", "parent_id").collect()} == {("a", 0, "a"), ("b", 1, "a/b"), ("c", 2, "a/b/c"), ("d", 0, "d")}
    run = spark.createDataFrame([("b", "a", "running"), ("c", "b", "running"), ("d", "a", "failed")], "id string, parent_id string, status string")
    assert {r["id"]: r["status"] for r in G.cascade(run, "a").collect()} == {"b": "completed", "c": "running", "d": "failed"}
    board = spark.createDataFrame([("1", ["2"], []), ("2", [], ["1", "0"])], "id string, blocks array<string>, blocked_by array<string>")
    assert {(r["before"], r["after"]) for r in G.task_edges(board).collect()} == {("1", "2"), ("0", "2")}
    inc = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "file string, target string")
    got = G.includes(inc, spark.createDataFrame([("a",)], "file string"))
    assert {(r["file"], r["depth"]) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_a_tree_has_no_limit_of_rows_or_levels(spark):
    limits = {"spark.sql.cteRecursionRowLimit": "20", "spark.sql.cteRecursionLevelLimit": "4"}
    nodes = [("0", None), *((str(i), str(i - 1)) for i in range(1, 8)), *((f"x{i}", "0") for i in range(40))]
    want = {(str(i), i, "/".join(map(str, range(i + 1)))) for i in range(8)} | {(f"x{i}", 1, f"0/x{i}") for i in range(40)}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        got = G.tree(spark.createDataFrame(nodes, "id string, up string"), "id", "up").collect()
    finally:
        for k in limits:
            spark.conf.unset(k)
    assert len(got) == len(nodes) and {(r["node"], r["depth"], r["path"]) for r in got} == want


def test_a_tree_with_a_cycle_ends(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("b", "c"), ("c", "b"), ("d", "d"), (None, "a")], "id string, up string")
    got = {(r["node"], r["depth"], r["path"]) for r in G.tree(nodes, "id", "up").collect()}
    assert got == {("a", 0, "a"), ("b", 1, "a/b"), ("c", 2, "a/b/c"), (None, 1, None)}
    assert G.tree(nodes.limit(0), "id", "up").collect() == []
