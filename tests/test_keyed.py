import pytest
from pyspark.sql import functions as F
from quern.operators import keyed as K


def test_first_last_and_layers(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, None), (None, 4, "n"), (None, 5, "m")], "k string, i int, v string")
    assert sorted((r["k"] or "", r["v"]) for r in K.keep_first(df, ["k"], ["i"]).collect()) == [("", "n"), ("a", "x"), ("b", None)]
    assert sorted((r["k"] or "", r["v"]) for r in K.keep_last(df, ["k"], ["i"]).collect()) == [("", "m"), ("a", "y"), ("b", None)]
    project, user = spark.createDataFrame([("a", 1)], "name string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "name string, v int")
    assert {(r["name"], r["v"], r["layer"]) for r in K.precedence([project, user], ["name"], ["name"]).collect()} == {("a", 1, 0), ("b", 3, 1)}
    cmds = spark.createDataFrame([("a", 0, 1, "u"), ("b", 0, 2, "u"), ("a", 1, 9, "p")], "name string, rank int, place int, from string")
    assert {(r["name"], r["from"], r["first_place"]) for r in K.last_wins(cmds, ["name"], "rank", "place").collect()} == {("a", "p", 1), ("b", "u", 2)}


def test_guards(spark):
    df = spark.createDataFrame([("v", "c"), ("v", "c"), ("w", "c")], "variant string, case string")
    with pytest.raises(ValueError, match="duplicate"):
        K.guard_unique(df, ["variant", "case"])
    assert K.guard_unique(df.distinct(), ["variant", "case"]).count() == 2
    names = spark.createDataFrame([("1", "a", ["x"]), ("2", "b", ["a"])], "id string, name string, aliases array<string>")
    assert [r["claim"] for r in K.unique_names(names, "id", "name", "aliases").collect()] == ["a"]


def test_overlay_and_fallbacks(spark):
    base = spark.createDataFrame([("a", "m1", 5), ("b", "m2", 6)], "name string, model string, n int")
    over = spark.createDataFrame([("a", "", 9), ("c", "m3", 0)], "name string, model string, n int")
    got = {r["name"]: (r["model"], r["n"]) for r in K.overlay(base, over, "name", {"model": "", "n": 0}).collect()}
    assert got == {"a": ("m1", 9), "b": ("m2", 6), "c": ("m3", 0)}
    df = spark.createDataFrame([(5, None, "x"), (0, 7, "x"), (None, None, "Big-Model-2"), (None, None, "x")], "e int, f int, m string")
    table = [("big-model", 100), ("model", 50)]
    assert [r["w"] for r in df.select(K.context_window(F.col("e"), F.col("f"), F.col("m"), table, 9).alias("w")).collect()] == [5, 7, 100, 9]


def test_states_and_names(spark):
    cand = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    rec = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "id string, at int, replacement string")
    up = spark.createDataFrame([("a", "up"), ("b", "up")], "id string, replacement string")
    assert {(r["id"], r["replacement"], r["origin"]) for r in K.inherited(cand, rec, up, "id", "at").collect()} == {("a", "new", "own"), ("b", "up", "inherited"), ("c", None, "none")}
    names = spark.createDataFrame([("lead", "a1"), ("a2", "a3")], "name string, ident string")
    ask = spark.createDataFrame([("lead",), ("a3",), ("zz",)], "ask string")
    assert {(r["ask"], r["ident"]) for r in K.resolve_name(ask, "ask", names).collect()} == {("lead", "a1"), ("a3", "a3"), ("zz", None)}
    ids = spark.createDataFrame([("t", 1), ("t", 2), ("u", 3)], "name string, i int")
    assert {r["unique_name"] for r in K.suffixed(ids, "name", ["i"]).collect()} == {"t", "t-2", "u"}
    assert spark.range(1).select(K.add_absent(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))).alias("x")).collect()[0]["x"] == ["b", "a", "c"]


def test_files(spark):
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, content string")
    back = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3"), ("d", None), ("e", None)], "path string, content string")
    assert {r["path"]: r["action"] for r in K.restored(cur, back, "path", "content").collect()} == {"a": "none", "b": "write", "c": "write", "d": "delete", "e": "none"}
    assert {r["path"]: r["change"] for r in K.changes(back.where("content is not null"), cur, "path", "content").collect()} == {"a": "same", "b": "changed", "c": "deleted", "d": "created"}
    with pytest.raises(ValueError, match="no backup"):
        K.selected(back, spark.createDataFrame([("z",)], "path string"), "path")
    assert K.selected(back, spark.createDataFrame([("a",)], "path string"), "path").count() == 1
    files = spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "path string, mtime long")
    reads = spark.createDataFrame([("a", 5), ("b", 1)], "path string, mtime long")
    assert {r["path"]: r["state"] for r in K.stale_reads(reads, files, "path", "mtime").collect()} == {"a": "fresh", "b": "modified", "c": "unread"}
    assert {r["path"] for r in K.needs_reload(reads, files, "path", "mtime").collect()} == {"b", "c"}


def test_selections(spark):
    mem = spark.createDataFrame([("a/x.md",), ("y.md",), ("z.md",)], "filename string")
    names = spark.createDataFrame([("x.md",), ("y.md",), ("gone.md",), ("y.md",)], "name string")
    assert {r["filename"] for r in K.chosen(mem, names, spark.createDataFrame([("y.md",)], "filename string")).collect()} == {"a/x.md"}
    teams = spark.createDataFrame([("t", ["1", "2"])], "team string, member_ids array<string>")
    assert {(r["agent_id"], r["team"]) for r in K.team_of(teams, spark.createDataFrame([("2",), ("9",)], "agent_id string")).collect()} == {("2", "t"), ("9", None)}
    files = spark.createDataFrame([("c",), ("a",), ("b",)], "path string")
    assert [r["path"] for r in K.models_first(files, files.where("path = 'b'")).collect()] == ["b", "a", "c"]
    assert spark.range(1).select(K.sorted_union(F.array(F.lit("b")), F.array(F.lit("a"), F.lit("b"))).alias("x")).collect()[0]["x"] == ["a", "b"]
