import difflib
import random

import pytest
from pyspark.sql import functions as F
from quern.functions import text as T


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).collect()[0]["x"]


def test_html_text(spark):
    page = "<html><script>var a='<p>';</script><STYLE>p{}</style><p>A &amp; B</p>\n \n\n<b>c\t\td</b> &lt;x&gt;</html>"
    assert one(spark, T.html_text(F.lit(page))) == "A & B \n\n c d <x>"


def test_diagnostics(spark):
    out = "src/a.py:3:7: error: bad call\nsrc/a.py:3:7: error: bad call\nb.py:9: careful\nb.py:9: warning: careful now\nt.py:5: in test_x\nnot a line\n"
    got = {(r["issue_type"], r["file"], r["line"], r["column"], r["message"], r["risk"]) for r in T.diagnostics(spark.createDataFrame([(1, out)], "k int, t string"), ["k"], "t").collect()}
    assert got == {
        ("validation_error", "src/a.py", 3, 7, "bad call", "high"), ("validation_error", "b.py", 9, 0, "careful", "medium"), ("validation_error", "b.py", 9, 0, "careful now", "medium"),
        ("validation_error", "t.py", 5, 0, "in test_x", "medium"), ("test_failure", "t.py", 5, 0, "traceback points to this location", "high"),
    }


def test_grep_and_pages(spark):
    df = spark.createDataFrame([(1, "ab\ncd\n\nabc"), (2, "x"), (3, None)], "k int, t string")
    assert [(r["k"], r["line_no"], r["line"]) for r in T.grep(df, ["k"], "t", "^ab").orderBy("line_no").collect()] == [(1, 1, "ab"), (1, 4, "abc")]
    assert [(r["k"], r["line_no"]) for r in T.grep(df, ["k"], "t", "b").orderBy("line_no").collect()] == [(1, 1), (1, 4)]
    assert [r["numbered"] for r in T.paged(df, ["k"], "t", 1, 2).collect()] == ["2\tcd", "3\t"]


def test_frontmatter(spark):
    types = ("user", "project")
    f = lambda t: tuple(one(spark, T.frontmatter(F.lit(t), types)))
    assert f("---\nname: \"A: b\"\ntype: user\ndescription: 'd'\nother: x\n---\nbody") == ("A: b", "d", "user")
    assert f("---\nname: a\nname: b\ntype: odd\n---\n") == ("b", "", "")
    assert f("no block\n---\nname: a\n---\n") == ("", "", "")


def test_scalars(spark):
    v = lambda c: one(spark, c)
    assert v(T.safe_id(F.lit("--a b/c*d--"))) == "a-b-c-d" and v(T.file_id(F.lit("a/b ü-1_!"))) == "abü-1_"
    assert v(T.major(F.lit("v2.10"))) == 2 and v(T.major(F.lit("none"))) is None
    assert [v(T.age_text(T.age_days(F.lit(m), F.lit(10 * 86_400_000)))) for m in (10 * 86_400_000, 9 * 86_400_000, 1, 11 * 86_400_000)] == ["today", "yesterday", "9 days ago", "today"]
    assert [v(T.scaled(F.lit(n))) for n in (999, 1200, 2_500_000)] == ["999", "1.2k", "2.5M"]
    assert [v(T.elapsed(F.lit(0), F.lit(s))) for s in (5, 65)] == ["5s", "1m5s"]
    assert v(T.cut_tokens(F.lit("x" * 20), 4)).startswith("x" * 14 + "\n") and v(T.cut_tokens(F.lit("short"), 4)) == "short"
    assert v(T.first_line(F.lit("\n  \n a \nb"))) == "a" and v(T.first_line(F.lit(""))) == ""
    assert v(T.tag_text(F.lit("x <summary> in </summary> y"))) == "in" and v(T.tag_text(F.lit(" all "))) == "all"
    assert v(T.json_object(F.lit('Sure: {"a": {"b": 1}} done'))) == '{"a": {"b": 1}}' and v(T.json_object(F.lit("{no"))) is None
    assert v(T.cut_lines(F.lit("a\nb\nc"), 2)) == "a\nb" and v(T.cut_lines(F.lit("éé"), 5, 3)) == "éé"
    assert v(T.expanded(F.lit("$EVENT on $TOOL_ARGS.path, $TOOL"), {"EVENT": F.lit("e"), "TOOL": F.lit("t"), "TOOL_ARGS.path": F.lit("p")})) == "e on p, t"
    assert [v(T.placeholder(F.lit(b), F.lit(a))) for b, a in (("do $ARGUMENTS", "x"), ("do", "x"), ("do", ""))] == ["do x", "do\n\nx", "do"]
    assert v(T.with_env(F.lit("${A}-${B}"), {"A": "1"})) == "1-${B}"
    assert tuple(v(T.replaced_once(F.lit("a b a"), F.lit("b"), F.lit("c")))) == ("a c a", None, 1)
    assert [v(T.replaced_once(F.lit("a b a"), F.lit(o), F.lit("c")))["error"] for o in ("a", "z", "")] == ["not unique", "not found", "not found"]
    assert tuple(v(T.slash_command(F.lit(" /Run now  please ")))) == ("run", "now  please") and tuple(v(T.slash_command(F.lit("text")))) == ("", "")
    assert v(T.path_refs(F.lit("see @a/b.py and @a/b.py, mail x@y"))) == ["a/b.py"]
    assert [v(T.output_tier(F.lit("x" * n), 5, 3)) for n in (3, 4, 6)] == ["whole", "truncated", "persisted"]
    assert v(T.tiered_output(F.lit("x" * 4), F.lit("/f"), 5, 3)).startswith("xxx\n") and "/f" in v(T.tiered_output(F.lit("x" * 9), F.lit("/f"), 5, 3))
    assert v(T.manifest_line(F.lit("user"), F.lit("a.md"), F.lit(0), F.lit("d"))) == "- [user] a.md (1970-01-01T00:00:00.000Z): d"
    assert v(T.change_count(F.lit(" M a\n\n?? b\n"))) == 2


def test_exit_codes(spark):
    df = spark.createDataFrame([("grep x f", 1), ("cat f | grep x", 1), ("ls | wc", 1), ("diff a b", 1), ("grep 'a|b", 2), ("true", 0)], "c string, e int")
    assert [r["m"] for r in df.select(T.exit_meaning(F.col("c"), F.col("e")).alias("m")).collect()] == ["no matches", "no matches", None, "files differ", None, "ok"]


def test_relevance(spark):
    rows = [(0, "WebFetch", "fetch a page"), (1, "web_search", "search the web"), (2, "Notes", "web notes"), (3, "Other", None), (4, "WEB", "x")]
    df = spark.createDataFrame(rows, "seq int, name string, description string")
    got = [(r["seq"], r["score"]) for r in T.relevance(df, "Web", "name", "description", "seq", 3).collect()]
    assert got == [(1, 19), (0, 13), (4, 13)]


def test_line_diff(spark):
    rng = random.Random(3)
    pairs = [("\n".join(rng.choice("abc") for _ in range(rng.randint(0, 8))), "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for r in df.select("*", T.line_diff("a", "b").alias("d")).collect():
        a, b, d = r["a"].splitlines(), r["b"].splitlines(), r["d"]
        head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert d["additions"] - d["removals"] == len(b) - len(a) and d["removals"] <= len(a) - head
        assert (a == b) == (d["diff"] == "")
    made = spark.createDataFrame([("b.py", "x\n", "y\n"), ("a.py", "1\n", "1\n"), ("a2.py", "1\n", "2\n")], "path string, before string, after string")
    patch = T.patch(made).collect()[0]["patch"]
    assert patch.index("a2.py") < patch.index("b.py") and "a.py" not in patch.replace("a2.py", "")
    assert patch.endswith("".join(difflib.unified_diff(["x\n"], ["y\n"], "a/b.py", "b/b.py")))


def test_line_diff_runs_without_python(spark):
    """Lines as str.splitlines has them, at every kind of end; no worker holds a batch of texts."""
    rng = random.Random(5)
    made = lambda: "".join(rng.choice(["a", "b", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1e", "\x85", "\u2028", "\u2029"]) for _ in range(rng.randint(0, 9)))
    pairs = [(made(), made()) for _ in range(150)] + [(None, "x\n"), ("x", None), (None, None), ("x\n" * 300, "y\n" * 300), ("1\n2\n3\n4\n5\n6\n7\n8\n9", "1\n2\n3\n4\nV\n6\n7\n8\n9")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("*", T.line_diff("a", "b").alias("d"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        a, b = (r["a"] or "").splitlines(), (r["b"] or "").splitlines()
        head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        tail = next((k for k, (x, y) in enumerate(zip(a[head:][::-1], b[head:][::-1])) if x != y), min(len(a), len(b)) - head)
        gone, come = a[head : len(a) - tail], b[head : len(b) - tail]
        shown = [f"  {t}" for t in a[max(0, head - 3) : head]] + [f"- {t}" for t in gone] + [f"+ {t}" for t in come] + [f"  {t}" for t in (a[len(a) - tail :][:3] if tail else [])]
        assert tuple(r["d"]) == (len(come), len(gone), "\n".join(shown[:200]) if gone or come else ""), r


def test_joined_texts(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "  ")], "g int, p int, t string")
    assert T.ordered_text(df, ["g"], ["p"], "t").collect()[0]["joined"] == "a\n\nb"
    board = spark.createDataFrame([("2", "t", "completed", "x"), ("1", "s", "odd", "")], "id string, title string, status string, assignee string")
    assert T.board(board).collect()[0]["board"] == "[?] #1 s\n[x] #2 t @x"
    mem = spark.createDataFrame([(1, "name: a\ntype: user\ndescription: d\ncontent: c\nmore\n---\nname: b\ntype: odd\ncontent: e\n---\nnothing")], "k int, t string")
    got = [(r["name"], r["type"], r["content"]) for r in T.memory_blocks(mem, ["k"], "t", ["user"], "project").orderBy("block_no").collect()]
    assert got == [("a", "user", "c\nmore"), ("b", "project", "e")]
    assert spark.range(1).select(T.notification(F.lit("7"), F.lit("done"), F.lit("x" * 9), F.lit(61), 5).alias("n")).collect()[0]["n"] == "task 7 done after 1m1s\nxxxxx\n… (truncated)"


@pytest.mark.parametrize("text,keep", [("a" * 10, False)])
def test_freshness(spark, text, keep):
    assert one(spark, T.freshness(F.lit(1))) == "" and "5 days" in one(spark, T.freshness(F.lit(5)))
