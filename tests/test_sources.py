import json
import os

import pytest
from pyspark.sql import functions as F
from quern.operators import conversation as C
from quern.operators import sources_ast as A
from quern.operators.registry import Operator, Registry, checked_output, schema_of
from quern.sources import records, schemas, sinks

MODELS = "from pydantic import BaseModel, Field\n\n\nclass User(BaseModel):\n    name: str = Field(max_items=3)\n\n    class Config:\n        orm_mode = True\n\n\nclass Admin(User):\n    pass\n\n\nclass Loop(Loop2):\n    pass\n\n\nclass Loop2(Loop):\n    pass\n"
API = "import os\nfrom .models import User as U, Admin\n\n\ndef show(u: U, other):\n    x = U(name='é')\n    return u.dict(), x.json(), other.copy(), u.__fields__, U.parse_obj({})\n"


@pytest.fixture
def project(tmp_path):
    for name, text in {"app/__init__.py": "", "app/models.py": MODELS, "app/api.py": API, "bad.py": "def (", "build/x.py": "a = 1", "env2/pyvenv.cfg": "", "env2/lib/y.py": "b = 1", "pyproject.toml": '[project]\ndependencies = ["pydantic>=1.10,<2", "x"]\n[tool.ruff]\n', "requirements.txt": "pydantic==1.10.2  # pin\nother==1\n"}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_project_scan(spark, project):
    files = records.python_files(spark, str(project))
    assert [r["path"] for r in files.collect()] == ["app/__init__.py", "app/api.py", "app/models.py", "bad.py"]
    f = A.facts(files)
    assert {(r["name"], r["target"]) for r in f.where("kind = 'import' and path = 'app/api.py'").collect()} == {("os", "os"), ("U", "app.models.User"), ("Admin", "app.models.Admin")}
    assert f.where("kind = 'error'").count() == 1
    g = {r["node_id"]: r for r in A.graph(f).collect()}
    assert g["app/api.py"]["depends_on"] == ["app/models.py:Admin", "app/models.py:User"]
    assert "app/api.py" in g["app/models.py:User"]["referenced_by"] and "app/models.py:User" in g["app/models.py"]["depends_on"]
    assert [r["path"] for r in records.manifests(spark.createDataFrame([("uv.lock",), ("requirements-dev.txt",), ("x.txt",), ("setup.py",), ("requirements.txt",), ("pyproject.toml",)], "path string")).collect()] == ["pyproject.toml", "setup.py", "requirements-dev.txt", "requirements.txt", "uv.lock"]
    listing = records.files(spark, str(project), "*.toml").select("path", "content").unionByName(spark.createDataFrame([("test_a.py", "")], "path string, content string"))
    assert A.validation_commands(listing).collect()[0]["commands"] == ["python -m pytest -q", "ruff check ."]


def test_record_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.jsonl").write_text('{"type":"user","content":"hi","timestamp":"2024-01-01T00:00:00+00:00"}\nbroken\n{"type":"tool_result","content":[1],"timestamp":"2024-01-01T00:00:01Z","tool_use_id":"t","is_error":true}\n[1]\n')
    got = records.session_records(spark, str(tmp_path / "s")).orderBy("line_no").collect()
    assert [(r["session"], r["type"], r["content"], r["is_error"]) for r in got] == [("a", "user", "hi", False), ("a", "tool_result", "[1]", True)]
    (tmp_path / "i").mkdir()
    (tmp_path / "i/x.json").write_text(json.dumps([{"id": "1", "content": "c", "read": True}]))
    (tmp_path / "i/y.json").write_text("[{")
    assert [(r["inbox"], r["id"]) for r in records.inbox(spark, str(tmp_path / "i")).collect()] == [("x", "1")]
    (tmp_path / "rules.yaml").write_text('- rule: "Bash(git *)"\n  effect: allow\n- rule: Bad\n  effect: deny\n- rule: ReadFile(/etc/*)\n  effect: maybe\n- effect: deny\n  rule: Bash(rm *)\n')
    assert [(r["tool"], r["pattern"], r["effect"]) for r in records.rule_file(spark, str(tmp_path / "rules.yaml"), 0).orderBy("pos").collect()] == [("Bash", "git *", "allow"), ("Bash", "rm *", "deny")]
    (tmp_path / "m/sub").mkdir(parents=True)
    for name, text in {"a.md": "---\nname: n\ndescription: d\ntype: user\n---\n", "MEMORY.md": "index", "sub/b.md": "plain"}.items():
        (tmp_path / "m" / name).write_text(text)
    got = records.memories(spark, str(tmp_path / "m"), "user")
    assert {(r["filename"], r["type"], r["description"]) for r in got.collect()} == {("a.md", "user", "d"), ("sub/b.md", "", "")}
    assert records.unseen_memories(got, got, spark.createDataFrame([("a.md",)], "filename string")).count() == 2
    (tmp_path / "c/Sub Dir").mkdir(parents=True)
    (tmp_path / "c/Sub Dir/Go.md").write_text("# Head\n\nDo it\n")
    (tmp_path / "c/x.md").write_text("---\ndescription: told\n---\nbody")
    cmds = records.commands(spark, str(tmp_path / "c"))
    assert {(r["name"], r["description"]) for r in cmds.collect()} == {("sub-dir:go", "Do it"), ("x", "told")}
    assert records.user_commands(cmds, cmds.where("name = 'x'").withColumn("description", F.lit("p"))).where("name = 'x'").collect()[0]["description"] == "p"
    rep = tmp_path / "r.jsonl"
    rep.write_text('{"tool_use_id":"a","replacement":"x"}\n{"kind":"k","tool_use_id":"b","replacement":"y"}\n{}\n')
    assert [r["kind"] for r in records.replacements(spark, str(rep)).orderBy("tool_use_id").collect()] == ["tool-result", "k"]
    assert spark.range(1).select(records.cache_key(F.lit("u")).alias("k")).collect()[0]["k"] == __import__("hashlib").sha256(b"u").hexdigest()[:16]
    (tmp_path / "tasks.json").write_text(json.dumps([{"id": "1", "title": "t", "status": "pending", "blocks": ["2"]}]))
    assert records.task_board(spark, str(tmp_path / "tasks.json")).count() == 1


def test_sinks(spark, tmp_path):
    changes = spark.createDataFrame([("low",), ("high",)], "risk string")
    issues = spark.createDataFrame([("a.py", "high", ["b.py"]), ("c.py", "low", None)], "file string, risk string, affected_files array<string>")
    nodes = spark.createDataFrame([("a.py", "file", ["x"], [], "a.py"), ("z.py", "file", [], [], "z.py"), ("m", "model", [], [], "b.py")], "node_id string, kind string, depends_on array<string>, referenced_by array<string>, file string")
    assert [r["line"] for r in sinks.migration_report(changes, issues, nodes).collect()] == ["- high: 2", "- low: 2", "- a.py -> x", "- m -> "]
    sinks.artefacts(nodes, issues, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o/semantic-tasks.json")).count() == 1
    runs = spark.createDataFrame([(1, "old", ""), (2, "x" * 20 + "end", "err")], "n int, stdout string, stderr string")
    p = json.loads(sinks.semantic_payload(issues, nodes, runs, 5).collect()[0]["payload"])
    assert p["run"] == {"stdout": "xxend", "stderr": "err"} and [g["node_id"] for g in p["graph"]] == ["a.py", "m"] and len(p["issues"]) == 1
    sinks.write_checkpoint(spark, str(tmp_path / "c.json"), {"b": 1, "a": 2})
    sinks.write_checkpoint(spark, str(tmp_path / "c.json"), {"b": 2, "a": 2})
    assert (tmp_path / "c.json").read_text() == '{"a":2,"b":2}'
    sinks.append_records(changes, str(tmp_path / "app"))
    sinks.append_records(changes, str(tmp_path / "app"))
    assert spark.read.json(str(tmp_path / "app")).count() == 4


def test_conversations(spark):
    rows = [(1, "user", "q", None), (2, "tool_result", "r1", "a"), (3, "tool_result", "r2", "b"), (4, "system", "s", None), (5, "assistant", "x", None), (6, "tool_result", "r3", "c")]
    df = spark.createDataFrame([("s", *r) for r in rows], "s string, n int, type string, content string, tool_use_id string")
    got = C.merged_results(df, ["s"], "n").orderBy("first_at").collect()
    assert [(r["role"], r["content"], [t["tool_use_id"] for t in r["tool_results"] or []]) for r in got] == [("user", "q", []), ("user", "", ["a", "b"]), ("assistant", "x", []), ("user", "", ["c"])]
    keep = '{"kind":"compact_boundary","summary":"so far","keep":["{\\"role\\":\\"assistant\\",\\"content\\":\\"kept\\"}"],"tokens":1}'
    rows = [(1, "tool_result", "r1", "a"), (2, "system", "s", None), (3, "tool_result", "r2", "b"), (4, "compression", "old", None), (5, "compact_boundary", keep, None), (6, "user", None, None)]
    got = C.merged_results(spark.createDataFrame([("s", *r) for r in rows], "s string, n int, type string, content string, tool_use_id string"), ["s"], "n").orderBy("first_at", "part").collect()
    assert [(r["first_at"], r["part"], r["role"], r["content"].removeprefix(C.RESUMED), len(r["tool_results"] or [])) for r in got] == [
        (1, 0, "user", "", 1), (3, 0, "user", "", 1), (4, 0, "user", "old", 0), (5, 0, "user", "so far", 0), (5, 1, "assistant", "kept", 0), (6, 0, "user", "", 0)
    ]
    turns = spark.createDataFrame([("k", 1, "user", "hi", None, None), ("k", 2, "assistant", "ok", [("u1", "Bash", '{"a":1}'), ("u2", "Read", "{}")], [("u2", "done", False)])], "k string, n int, " + schemas.TURN)
    forked = C.forked(turns, ["k"], "n", "<fork>").orderBy("n").collect()
    assert [(t["tool_use_id"], t["content"]) for t in forked[-1]["tool_results"]] == [("u1", "interrupted")] and len(forked) == 3
    with pytest.raises(ValueError):
        C.forked(turns, ["k"], "n", "hi")
    wire = [json.loads(r["message"]) for r in C.wire(turns, "anthropic").where("n = 2").orderBy("part").collect()]
    assert [(m["role"], [b["type"] for b in m["content"]]) for m in wire] == [("user", ["tool_result"]), ("assistant", ["text", "tool_use", "tool_use"])]
    mail = spark.createDataFrame([("a", 2, "x", "two"), ("a", 1, "y", "one"), ("b", 1, "x", "shutdown now")], "m string, n int, from_agent string, content string")
    got = {r["m"]: (r["shutdown"], r["prompt"]) for r in C.next_prompt(mail, ["m"], "n", F.startswith("content", F.lit("shutdown"))).collect()}
    assert got == {"a": (False, "From y: one\nFrom x: two"), "b": (True, "")}
    assert {r["m"]: r["notice"] for r in C.notifications(mail, "m", "n", "content").collect()} == {"a": "one\n\ntwo", "b": "shutdown now"}
    b = spark.range(1).select(C.boundary(F.lit("s"), F.array(F.lit("m")), F.lit(5)).alias("t"))
    assert tuple(b.select(C.parsed_boundary(F.col("t")).alias("x")).collect()[0]["x"]) == ("s", ["m"], 5)
    assert b.select(C.parsed_boundary(F.lit('{"kind":"other"}')).alias("x"), C.parsed_boundary(F.lit("no")).alias("y")).collect()[0] == (None, None)
    s = spark.createDataFrame([(i, f"2024-01-0{i} 00:00:00") for i in range(1, 8)], "i int, at string").withColumn("at", F.col("at").cast("timestamp"))
    day = 86_400_000
    t0 = 1_704_067_200_000
    assert C.changed_since(s, "at", t0).count() == 6 and C.since(s, "i", 5).count() == 3
    assert [C.due(s, "at", t0, t, t0 + 10 * day).collect()[0]["due"] for t in (t0, t0 + 10 * day)] == [True, False]
    state = spark.range(1).select(F.lit(1).alias("a"), F.lit("x").alias("b")).select(C.snapshot(["a", "b"]).alias("t"))
    assert tuple(state.select(C.restored(F.col("t"), "a int, b string").alias("x")).collect()[0]["x"]) == (1, "x")


def test_registry(spark):
    r = Registry()
    spec = {"type": "object", "properties": {"q": {"type": "string"}, "n": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "number"}}, "odd": {"type": "other"}}, "required": ["q"]}
    for i in range(3):
        r.register(Operator(f"op{i}", lambda df, q="x", n=1: df.limit(n), "d", parameters=spec, deferred=i == 2))
    assert [o.name for o in r.visible()] == ["op0", "op1"]
    r.discover("op2")
    r.enable("op0", False)
    assert [s["name"] for s in r.schemas("anthropic")] == ["op1", "op2"] and r.schemas("openai")[0]["type"] == "function"
    assert r.call("op1", spark.range(5), n=2).count() == 2
    with pytest.raises(PermissionError):
        r.call("op0", spark.range(1))
    with pytest.raises(TypeError):
        r.call("op1", spark.range(1), z=1)
    assert r.table(spark).where("deferred and discovered").count() == 1
    s = schema_of(spec)
    assert s.simpleString() == "struct<q:string,n:bigint,tags:array<double>,odd:string>" and not s["q"].nullable
    ok = spark.createDataFrame([('{"q":"a","n":1}',)], "j string")
    assert checked_output(ok, "j", schema_of({"properties": {"q": {"type": "string"}}})).collect()[0]["j"]["q"] == "a"
    assert records.providers('[{"name":"a","protocol":"p","model":"m"}]')
    for bad in ("[]", "[1]", '[{"name":"a"}]'):
        with pytest.raises(ValueError):
            records.providers(bad)
    assert records.servers('[{"name":"a","url":"u"}]')
    with pytest.raises(ValueError):
        records.servers('[{"name":"a","url":"u","command":"c"}]')


def test_more_files(spark, tmp_path):
    for i, name in enumerate(("a.py", "d/b.py", "d/_c.py", "e.txt")):
        (tmp_path / "g" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "g" / name).write_text("x")
        os.utime(tmp_path / "g" / name, (1000 + i, 1000 + i))
    assert [r["path"] for r in records.glob(spark, str(tmp_path / "g"), "**/*.py").collect()] == ["d/_c.py", "d/b.py", "a.py"]
    (tmp_path / "meta").mkdir()
    for k in (1, 2):
        (tmp_path / f"meta/{k}.json").write_text(json.dumps({"id": str(k), "title": "t", "last_active": f"2024-01-0{k}T00:00:00Z"}))
    assert [r["id"] for r in records.session_metas(spark, str(tmp_path / "meta")).collect()] == ["2", "1"]
    for scope in ("u", "p"):
        (tmp_path / scope / "sub").mkdir(parents=True)
        for name in ("b.md", "a.md", "MEMORY.md", "sub/c.md"):
            (tmp_path / scope / name).write_text("m")
    assert [(r["scope"], r["path"]) for r in records.memory_folders(spark, str(tmp_path / "u"), str(tmp_path / "p")).collect()] == [("user", "a.md"), ("user", "b.md"), ("project", "a.md"), ("project", "b.md")]
    turns = spark.createDataFrame([("user", "hi", None, None)], schemas.TURN)
    sinks.append_records(turns, str(tmp_path / "tr"))
    assert records.transcript(spark, str(tmp_path / "tr")).collect()[0]["content"] == "hi"


THOUGHT = "array<struct<thinking:string,signature:string>>"


def test_wire_forms(spark):
    """Roles with quotes, thoughts, several results, bad arguments and null texts in each protocol."""
    calls, results = [("u1", "Bash", '{"a": 1}'), ("u2", "Re\"ad", "{bad")], [("u1", "one", False), ("u2", "two", True)]
    rows = [
        ("k", 1, "us\"er", "hi", None, None, None), ("k", 2, "assistant", "ok", calls, None, [("hm", "s1"), ("so", "s2")]), ("k", 3, "user", "", None, results, None),
        ("k", 4, "assistant", None, calls[:1], [], []), ("k", 5, "assistant", "done", [], [], [("end", "s3")]),
    ]
    df = spark.createDataFrame(rows, f"k string, n int, {schemas.TURN}, thinking {THOUGHT}")

    def sent(protocol):
        return [(r["n"], r["part"], json.loads(r["message"])) for r in C.wire(df, protocol).orderBy("n", "part").collect()]

    use = [{"type": "tool_use", "id": "u1", "name": "Bash", "input": {"a": 1}}, {"type": "tool_use", "id": "u2", "name": 'Re"ad', "input": {}}]
    thought = lambda t, s: {"type": "thinking", "thinking": t, "signature": s}
    back = [{"type": "tool_result", "tool_use_id": i, "content": c, "is_error": e} for i, c, e in results]
    first = {"role": 'us"er', "content": "hi"}
    assert sent("anthropic") == [
        (1, 0, first), (2, 0, {"role": "assistant", "content": [thought("hm", "s1"), thought("so", "s2"), {"type": "text", "text": "ok"}, *use]}), (3, 0, {"role": "user", "content": back}),
        (4, 0, {"role": "assistant", "content": use[:1]}), (5, 0, {"role": "assistant", "content": [thought("end", "s3"), {"type": "text", "text": "done"}]}),
    ]
    reason = lambda t, s: {"type": "reasoning", "id": s, "summary": [{"type": "summary_text", "text": t}]}
    call = [{"type": "function_call", "name": n, "call_id": i, "arguments": a} for i, n, a in (calls[0], ("u2", 'Re"ad', "{}"))]
    items = [
        (1, [first]), (2, [reason("hm", "s1"), reason("so", "s2"), {"role": "assistant", "content": "ok"}, *call]),
        (3, [{"type": "function_call_output", "call_id": i, "output": c} for i, c, _ in results]), (4, call[:1]), (5, [reason("end", "s3"), {"role": "assistant", "content": "done"}]),
    ]
    assert sent("openai") == [(n, i, m) for n, ms in items for i, m in enumerate(ms)]
    fn = [{"id": c["call_id"], "type": "function", "function": {"name": c["name"], "arguments": c["arguments"]}} for c in call]
    messages = [
        (1, [first]), (2, [{"role": "assistant", "content": "ok", "tool_calls": fn, "reasoning_content": "hmso"}]), (3, [{"role": "tool", "tool_call_id": i, "content": c} for i, c, _ in results]),
        (4, [{"role": "assistant", "content": None, "tool_calls": fn[:1]}]), (5, [{"role": "assistant", "content": "done", "reasoning_content": "end"}]),
    ]
    assert sent("openai-compat") == [(n, i, m) for n, ms in messages for i, m in enumerate(ms)]
    with pytest.raises(ValueError):
        C.wire(df, "other")
    more = [("k", 1, "user", "a", None, None, None), ("k", 2, "user", None, None, None, []), ("k", 3, "user", "b", None, results, None), ("k", 4, "user", "c", None, None, None), ("l", 1, "user", "d", None, None, None)]
    got = C.joined_users(spark.createDataFrame(more, df.schema), ["k"], "n").orderBy("k", "n").collect()
    assert [(r["k"], r["n"], r["content"], len(r["tool_results"] or [])) for r in got] == [("k", 1, "a\n", 0), ("k", 3, "b", 2), ("k", 4, "c", 0), ("l", 1, "d", 0)]
