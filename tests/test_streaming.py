import datetime
import json

from quern.streaming import streams as S

DELTA = "stream string, seq long, kind string, text string, call_index int, call_id string, call_name string, arguments string, stop_reason string, input_tokens long, output_tokens long"
ROWS = [
    ("a", 2, "text", "lo", None, None, None, None, None, None, None), ("a", 1, "text", "hel", None, None, None, None, None, None, None),
    ("a", 3, "call", None, 1, "c1", "Bash", '{"x":', None, None, None), ("a", 4, "call", None, 0, "c0", "Read", "{bad", None, None, None), ("a", 5, "call", None, 1, None, None, "1}", None, None, None),
    ("a", 6, "end", None, None, None, None, None, "stop", 10, 3), ("b", 1, "text", "open", None, None, None, None, None, None, None),
]
CALLS = [{"arguments": {}, "id": "c0", "name": "Read"}, {"arguments": {"x": 1}, "id": "c1", "name": "Bash"}]


def check(rows):
    assert len(rows) == 1
    r = rows[0]
    assert (r["stream"], r["text"], r["stop_reason"], r["input_tokens"], r["output_tokens"]) == ("a", "hello", "stop", 10, 3) and json.loads(r["calls"]) == CALLS


HOUR = 3_600_000
TIMED = DELTA + ", at timestamp"


def timed(spark, rows, minute=0):
    """Rows a minute apart, from a minute on."""
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(*r, start + datetime.timedelta(minutes=minute + i)) for i, r in enumerate(rows)], TIMED)


def more(spark, folder, rows, minute=0):
    timed(spark, rows, minute).coalesce(1).write.mode("append").parquet(folder)


def drain(spark, tmp_path):
    src = spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return sorted(S.drained_fold(src, "at", str(tmp_path / "out"), str(tmp_path / "ck")).collect())


def late(stream, seq=1):
    return (stream, seq, "text", "later", None, None, None, None, None, None, None)


def test_fold_of_a_table(spark):
    check(S.folded(timed(spark, ROWS), "at").collect())
    got = {r["stream"]: (r["text"], r["input_tokens"]) for r in S.batch_fold(spark.createDataFrame(ROWS, DELTA)).collect()}
    assert got == {"a": ("hello", 10), "b": ("open", None)}
    assert S.folded(timed(spark, ROWS).limit(0), "at").count() == 0
    far = timed(spark, ROWS).unionByName(timed(spark, [late("c")], 180))
    assert {r["stream"]: (r["text"], r["stop_reason"]) for r in S.folded(far, "at").collect()} == {"a": ("hello", "stop"), "b": ("open", "abandoned")}


def test_fold_of_a_stream(spark, tmp_path):
    """Over growing input: the end comes in another run, rows that come again after it give nothing."""
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    folder = str(tmp_path / "in")
    more(spark, folder, ROWS[:4])
    assert drain(spark, tmp_path) == []
    more(spark, folder, ROWS[3:], 3)
    check(drain(spark, tmp_path))
    more(spark, folder, ROWS[:4] + ROWS[5:6], 10)
    check(drain(spark, tmp_path))
    check(drain(spark, tmp_path))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == was


def test_an_abandoned_stream_is_let_go(spark, tmp_path):
    folder = str(tmp_path / "in")
    more(spark, folder, ROWS)
    check(drain(spark, tmp_path))
    more(spark, folder, [late("c")], 180)
    got = drain(spark, tmp_path)
    assert [(r["stream"], r["text"], r["stop_reason"]) for r in got] == [("a", "hello", "stop"), ("b", "open", "abandoned")]
    more(spark, folder, [late("d")], 400)
    assert [r["stream"] for r in drain(spark, tmp_path)] == ["a", "b", "c"]
    assert sorted(S.folded(spark.read.schema(TIMED).parquet(folder), "at").collect()) == drain(spark, tmp_path)


def test_streams_share_a_bucket(spark, tmp_path):
    """One call and one timer for many streams: each ends, is let go and begins anew by itself."""
    folder = str(tmp_path / "in")

    def drain():
        src = spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).parquet(folder)
        got = S.drained_fold(src, "at", str(tmp_path / "out"), str(tmp_path / "ck"), buckets=1).collect()
        return sorted((r["stream"], r["text"], r["stop_reason"]) for r in got)

    more(spark, folder, [r for r in ROWS if r[2] != "end"] + [late("c"), late("d")])
    assert drain() == []
    more(spark, folder, [ROWS[5], late("c", 2), late("e")], 20)
    ended = [("a", "hello", "stop")]
    assert drain() == ended
    more(spark, folder, [late("f")], 180)
    gone = sorted([*ended, ("b", "open", "abandoned"), ("c", "laterlater", "abandoned"), ("d", "later", "abandoned"), ("e", "later", "abandoned")])
    assert drain() == gone
    more(spark, folder, [late("a"), late("b"), late("f", 2)], 185)
    more(spark, folder, [late("g")], 400)
    assert drain() == sorted([*gone, ("a", "later", "abandoned"), ("b", "later", "abandoned"), ("f", "laterlater", "abandoned")])


def test_dedup_and_order(spark):
    e = spark.createDataFrame([("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 00:00:01"), ("l", "2024-01-01 00:00:00")], "k string, ts string")
    assert S.deduplicated(e, ["k"], "ts", "1 hour").count() == 2
    done = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x")], "r string, n int, result string")
    assert S.in_order(done, "r", "n").collect()[0]["results"] == ["x", "y"]


def test_each_key_is_drained_once(spark, tmp_path):
    """Over growing input, nothing new, and a batch whose commit was lost after it had written."""
    folder, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    kinds = "k string, n int"

    def more(rows):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(folder)

    def drain():
        got = S.drained_once(spark.readStream.schema(kinds).parquet(folder), ["k"], ["n"], out, ck)
        return sorted(((r["k"], r["n"], r["batch"]) for r in got.collect()), key=str)

    more([("a", 2), ("a", 1), (None, 7), ("b", 5)])
    first = [("a", 1, 0), ("b", 5, 0), (None, 7, 0)]
    assert drain() == first and drain() == first
    more([("a", 0), ("c", 3), (None, 1), ("c", 2)])
    second = [("a", 1, 0), ("b", 5, 0), ("c", 2, 1), (None, 7, 0)]
    assert drain() == second
    for name in ("1", ".1.crc"):
        (tmp_path / "ck" / "commits" / name).unlink(missing_ok=True)
    assert drain() == second
    more([("b", 1), ("d", 1)])
    assert drain() == sorted([*second, ("d", 1, 2)], key=str)
