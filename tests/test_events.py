import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from quern.operators import events as E


def journal(spark, payloads, name="j"):
    new = spark.createDataFrame([(name, i, "note", 5 + i, json.dumps(p)) for i, p in enumerate(payloads)], "journal string, n int, event_type string, timestamp_ns long, payload string")
    new = new.withColumns({"trace_id": F.lit("t"), "tool_call_id": F.lit(None).cast("string"), "idempotency_key": F.lit("")})
    heads = spark.createDataFrame([], "journal string, sequence long, event_hash string")
    return E.appended(new, heads)


def as_lines(rows, terminated=True):
    return [(r["journal"], r["line_no"], r["line"], True) for r in rows[:-1]] + [(rows[-1]["journal"], rows[-1]["line_no"], rows[-1]["line"], terminated)]


LINES = "journal string, line_no long, line string, terminated boolean"


def test_append_verify_replay(spark):
    rows = journal(spark, [{"n": 1}, {"n": 2, "text": "é ü"}]).orderBy("line_no").collect()
    first, second = (json.loads(r["line"]) for r in rows)
    assert [first["sequence"], second["sequence"]] == [1, 2] and second["prev_hash"] == first["event_hash"] and first["prev_hash"] == ""
    lines = spark.createDataFrame(as_lines(rows), LINES)
    events = E.intact(lines)
    total = E.reduced(events, "journal", "sequence", lambda s, r: s + json.loads(r["payload"])["n"], 0, "total long").collect()
    assert total[0]["total"] == 3
    more = spark.createDataFrame([("j", 0, "note", 9, "{}", "", "", "")], "journal string, n int, event_type string, timestamp_ns long, payload string, trace_id string, tool_call_id string, idempotency_key string")
    third = json.loads(E.appended(more, E.heads(events)).collect()[0]["line"])
    assert third["sequence"] == 3 and third["prev_hash"] == second["event_hash"]


def test_tampering_shows(spark):
    rows = journal(spark, [{"n": 1}, {"n": 2}, {"n": 3}]).orderBy("line_no").collect()
    lines = as_lines(rows)
    cases = {
        "event hash mismatch": [(j, k, t.replace('"n":2', '"n":7'), e) for j, k, t, e in lines], "invalid sequence": [lines[0], lines[2]],
        "invalid event": [lines[0], ("j", 2, lines[1][2][:-9], True), lines[2]], "broken hash chain": [(j, k, t.replace('"prev_hash":"', '"prev_hash":"0'), e) if k == 2 else (j, k, t, e) for j, k, t, e in lines],
    }
    for fault, bad in cases.items():
        with pytest.raises(E.IntegrityError, match=fault):
            E.intact(spark.createDataFrame([(j, i + 1, t, e) for i, (j, _, t, e) in enumerate(bad)], LINES))


def test_crash_tail(spark, tmp_path):
    rows = journal(spark, [{"n": 1}, {"n": 2}]).orderBy("line_no").collect()
    text = [r["line"] for r in rows]
    (tmp_path / "half.jsonl").write_text(text[0] + "\n" + text[1][:20])
    (tmp_path / "whole.jsonl").write_text(text[0] + "\n" + text[1])
    (tmp_path / "bad.jsonl").write_text(text[0][:20] + "\n" + text[1] + "\n")
    kept = E.repaired(E.read_lines(spark, str(tmp_path)))
    assert {r["journal"]: r["n"] for r in kept.groupBy("journal").agg(F.count("*").alias("n")).collect()} == {"half.jsonl": 1, "whole.jsonl": 2, "bad.jsonl": 2}
    assert E.intact(kept.where("journal = 'half.jsonl'")).count() == 1
    with pytest.raises(E.IntegrityError):
        E.intact(kept.where("journal = 'bad.jsonl'"))


def test_checkpoints(spark):
    rows = journal(spark, [{"n": 1}]).collect()
    events = E.intact(spark.createDataFrame(as_lines(rows), LINES))
    head = events.collect()[0]
    good = E.checkpoint({"cursor": 7}, {"sequence": 1, "event_hash": head["event_hash"]}, 1)
    cases = [good, {**good, "state": {"cursor": 8}}, {**good, "event_hash": "x"}, {**good, "sequence": 0}, {**good, "state": [1]}]
    df = spark.createDataFrame([(i, "j", c["sequence"], c["event_hash"], json.dumps(c["state"]), c["state_hash"]) for i, c in enumerate(cases)], "i int, journal string, sequence long, event_hash string, state string, state_hash string")
    got = [r["fault"] for r in E.checked(df, events).orderBy("i").collect()]
    assert got == [None, "checkpoint state hash mismatch", "checkpoint does not match the journal history", "empty checkpoint has an event hash", "checkpoint state must be an object"]


def test_large_outputs_become_blobs(spark):
    rows = [("tool_succeeded", json.dumps({"output": "0123456789é", "x": "1"})), ("tool_succeeded", json.dumps({"output": "0123456789é"})), ("tool_succeeded", json.dumps({"output": "short"})), ("note", json.dumps({"output": "0123456789é"}))]
    small, blobs = E.externalized(spark.createDataFrame([(i, t, p, "k" + str(i)) for i, (t, p) in enumerate(rows)], "sequence long, event_type string, payload string, idempotency_key string"), 8)
    digest = hashlib.sha256("0123456789é".encode()).hexdigest()
    assert [(b["sha256"], b["text"]) for b in blobs.collect()] == [(digest, "0123456789é")]
    got = E.resolved(E.committed(small.withColumn("j", F.lit("j")), ["j"], "sequence"), blobs).orderBy("sequence").collect()
    assert [r["output"] for r in got] == ["0123456789é", "0123456789é", "short"] and all(r["fault"] is None for r in got)
    blob = json.loads(json.loads(got[0]["payload"])["output_blob"])
    assert blob == {"sha256": digest, "chars": 11, "bytes": 12} and "output" not in json.loads(got[0]["payload"])
    faults = {r["fault"] for r in E.resolved(small.where("sequence < 2"), blobs.withColumn("text", F.lit("other"))).collect()} | {r["fault"] for r in E.resolved(small.where("sequence < 2"), blobs.limit(0)).collect()}
    assert faults == {"blob hash mismatch", "missing blob"}


def test_effectively_once(spark):
    req = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("", 4), ("", 5)], "key string, n int")
    got = E.effectively_once(req, spark.createDataFrame([("b",)], "key string"), "key", "n").orderBy("n").collect()
    assert [r["outcome"] for r in got] == ["run", "deduplicated", "deduplicated", "run", "run"]


def test_canonical_form_ignores_key_order(spark):
    rng = random.Random(1)
    d = {c: rng.choice([1, 2.5, None, "é", [1, {"z": 1, "a": 2}]]) for c in "zyxab"}
    texts = [json.dumps(dict(sorted(d.items(), key=lambda kv: rng.random()))) for _ in range(4)] + ["{", None]
    got = [r["c"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.canonical_json("t").alias("c")).collect()]
    assert len(set(got[:4])) == 1 and got[4:] == [None, None]


@pytest.mark.parametrize("size", [211, 1 << 27])
def test_lines_over_ranges(spark, tmp_path, size):
    """Files read in many ranges give the lines, places and faults of files read in one."""
    rows = journal(spark, [{"n": i, "text": "é" * (i * 7 % 90)} for i in range(24)]).orderBy("line_no").collect()
    text = [r["line"] for r in rows]
    text[15] = text[15].replace('"n":15', '"n":71')
    files = {
        "half.jsonl": "\n".join(text) + "\n" + text[0][:20], "open.jsonl": "\n".join(text), "whole.jsonl": "\n".join(text) + "\n", "returns.jsonl": "\r\n".join(text[:12]) + "\r\n",
        "blank.jsonl": "\n\n\nx\n\n", "one.jsonl": "y", "empty.jsonl": "", "odd.jsonl": "a\udcff\nb",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content.encode("utf-8", "surrogateescape"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        lines = E.read_lines(spark, str(tmp_path))
        got = {}
        for r in lines.collect():
            got.setdefault(r["journal"], []).append((r["line_no"], r["line"], r["terminated"]))
        faults = {(r["journal"], r["line_no"], r["fault"]) for r in E.verified(E.repaired(lines)).where("fault is not null and journal not in ('blank.jsonl', 'one.jsonl', 'odd.jsonl')").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    want = {}
    for name, content in files.items():
        parts = content.replace("\r", "").replace("\udcff", "\ufffd").split("\n")
        whole = [(i + 1, x, True) for i, x in enumerate(parts[:-1])]
        want[name] = whole + ([(len(parts), parts[-1], False)] if parts[-1] else [])
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert faults == {(name, 16, "event hash mismatch") for name in ("half.jsonl", "open.jsonl", "whole.jsonl")}


def test_journals_share_files(spark, tmp_path):
    """As many files as tasks, however many journals; lines keep their journal and place; a torn last line goes."""
    rows = [(j, n, f'{{"n":{n}}}') for j in range(200) for n in range(1, 1 + j % 5)]
    E.packed(spark.createDataFrame(rows, "journal long, line_no long, line string"), "journal").write.text(str(tmp_path / "logs"))
    files = list((tmp_path / "logs").glob("part-*"))
    assert 1 <= len(files) <= 8
    (tmp_path / "logs" / f".{files[0].name}.crc").unlink()
    with files[0].open("a") as f:
        f.write('7\t{"n":')
    read = E.repaired(E.unpacked(E.read_lines(spark, str(tmp_path / "logs"))))
    assert sorted((int(r["journal"]), r["line_no"], r["line"]) for r in read.collect()) == rows
