"""The jobs over growing copies of input, and as queries against their SQL."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from jobs import event_usage, issue_scan, queries
from pyspark.sql import functions as F

from tests.conftest import ROOT, SF
from tests.test_catalog import rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert len(got) > 0 and sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def usage(spark, out):
    return sorted(map(tuple, spark.read.schema(event_usage.USAGE).parquet(f"{out}/usage").collect()), key=str)


def test_only_new_events_are_taken(spark, tmp_path):
    """Two runs over a growing folder give what one run over all of it does; late and repeated events count once."""
    config = queries.settings("event_usage") | {"files_per_batch": 1}
    events = spark.read.parquet(f"{SF}/events.parquet")
    parts = [events.where("event_id < 600 and event_id % 50 <> 0"), events.where("event_id >= 600 or event_id % 50 = 0"), events.where("event_id between 100 and 300")]
    folder, out, whole = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "whole")
    parts[0].coalesce(1).write.mode("append").parquet(folder)
    first = event_usage.run(spark, folder, out, str(tmp_path / "ck"), config)
    assert (first["batches"], first["events"]) == (1, parts[0].count())
    assert event_usage.run(spark, folder, out, str(tmp_path / "ck"), config) == {"batches": 0, "events": 0, "days": 0}
    for part in parts[1:]:
        part.coalesce(1).write.mode("append").parquet(folder)
    second = event_usage.run(spark, folder, out, str(tmp_path / "ck"), config)
    assert (second["batches"], second["events"]) == (2, parts[1].count() + parts[2].count())
    once = event_usage.run(spark, f"{SF}/events.parquet", whole, str(tmp_path / "ck2"), config)
    assert once["batches"] == 1 and usage(spark, out) == usage(spark, whole)


def test_a_batch_that_ran_half_is_run_again(spark, tmp_path, monkeypatch):
    config, out, ck = queries.settings("event_usage"), str(tmp_path / "out"), str(tmp_path / "ck")

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(event_usage, "usage", fails)
        with pytest.raises(Exception, match="lost"):
            event_usage.run(spark, f"{SF}/events.parquet", out, ck, config)
    assert Path(out, "ledger").is_dir() and not Path(out, "usage").exists()
    n = event_usage.run(spark, f"{SF}/events.parquet", out, ck, config)["events"]
    assert n == sum(r[1] for r in usage(spark, out)) == spark.read.parquet(f"{out}/ledger").count()


def test_odd_events(spark, tmp_path):
    odd = [(1, None, 5, "error", None, None), (2, None, 5, None, 1.0, "{"), (3, None, None, "error", 2.0, '{"k": "x"}'), (None, None, None, None, None, None)]
    spark.createDataFrame(odd, event_usage.EVENT).write.parquet(str(tmp_path / "in"))
    event_usage.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), queries.settings("event_usage"))
    got = {r[0]: r[1:] for r in usage(spark, str(tmp_path / "out"))}
    assert got == {5: (2, 0, 2, 0, 100, 1, False, None), None: (2, 0, 3, 0, 200, 1, False, None)}


def test_scan_of_growing_texts_is_overwritten(spark, tmp_path):
    docs = [(1, "a", "en", 'x\ntoken = "0123456789abcdef" mail a.b@c.de\nLicensed under X'), (2, "a", None, "Licensed under X\nLicensed under X"), (3, None, "de", None), (None, None, "de", "+49 (030) 555-1234 +49 (030) 555-9999")]
    make = lambda d: spark.createDataFrame(d, "doc_id long, source string, lang string, text string").write.mode("overwrite").parquet(str(tmp_path / "in"))
    run = lambda: issue_scan.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), queries.settings("issue_scan"))
    names = lambda t: [c.split()[0] for c in getattr(issue_scan, t.upper()).split(", ")]
    read = lambda t: sorted(map(tuple, spark.read.schema(getattr(issue_scan, t.upper())).parquet(f"{tmp_path}/out/{t}").select(names(t)).collect()), key=str)
    make(docs[:2])
    assert run() == {"documents": 2, "findings": 5, "issues": 3, "projects": 3}
    make(docs)
    assert run() == run() == {"documents": 4, "findings": 6, "issues": 4, "projects": 4}
    assert ("low", "license", "Licensed under X", 2, 3, 1, 3) in read("issues")
    assert read("projects") == [("a", "high", "secret", 1, 1, 1, 2, 50.0), ("a", "low", "license", 2, 3, 3, 2, 100.0), ("a", "medium", "mail_address", 1, 1, 1, 2, 50.0), (None, "medium", "phone_number", 1, 1, 2, 2, 50.0)]
    assert len(read("findings")) == 6
    with pytest.raises(ValueError):
        issue_scan.rules_of({"rules": [{"name": "a", "pattern": "x"}, {"name": "a", "pattern": "y"}]})


@pytest.mark.parametrize("job", ["issue_scan", "event_usage"])
def test_command_line(spark, tmp_path, job):
    table = {"issue_scan": "documents", "event_usage": "events"}[job]
    shutil.copy(f"{SF}/{table}.parquet", tmp_path / "in.parquet")
    more = ["--checkpoint", str(tmp_path / "ck")] if job == "event_usage" else []
    args = ["--config", f"{ROOT}/jobs/{job}.json", f"--{table}", str(tmp_path / "in.parquet"), "--output", str(tmp_path / "out"), *more]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args], cwd=ROOT, capture_output=True, text=True, timeout=300, env=None)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr and "read" in done.stderr
    json.loads(Path(ROOT, "jobs", f"{job}.json").read_text())
    assert spark.read.parquet(str(tmp_path / "out" / ("usage" if more else "findings"))).select(F.count("*")).first()[0] > 0
