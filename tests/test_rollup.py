import random

import json

from pyspark.sql import functions as F
from quern.operators import rollup as R
from quern.sources import records, sinks


def write(tmp_path, name, **result):
    (tmp_path / name).mkdir()
    (tmp_path / name / "result.json").write_text(json.dumps(result))
    return str(tmp_path / name / "result.json")


def runs(spark, tmp_path):
    issue = {"issue_type": "x", "message": "m", "risk": "medium", "location": {"file": "a.py", "line": 1}}
    change = {"rule_id": "r", "location": {"file": "a.py", "line": 2}}
    a = write(tmp_path, "rules", status="needs-review", succeeded=False, project_root="/x/case", changes=[change] * 5, issues=[issue] * 5, validations=[{"passed": False, "duration_seconds": 1.5}])
    b = write(tmp_path, "hybrid", status="completed", succeeded=True, project_root="/x/case", scanned_files=3, changes=[change] * 9, issues=[issue], validations=[{"passed": True, "duration_seconds": 2.0}], metrics={"detected_migration_targets": 10, "automatically_cleared_targets": 9, "estimated_cost_usd": 0.0018, "deterministic_changes": 9})
    df = records.results(spark, [a, b])
    name = F.regexp_extract("result_path", r"([^/]+)/result.json$", 1)
    return R.derive_runs(df.withColumns({"variant": name, "case": F.lit("")}))


def test_runs_of_results(spark, tmp_path):
    got = {r["variant"]: r for r in runs(spark, tmp_path).collect()}
    a, b = got["rules"], got["hybrid"]
    assert (a["case"], a["metrics_source"], a["open_issues"], a["detected_targets"], a["cleared_targets"], a["succeeded"], a["validation_passed"], a["duration_seconds"], a["changed_files"]) == ("case", "legacy-derived", 5, 10, 5, False, 0, 1.5, 1)
    assert (b["metrics_source"], b["open_issues"], b["cleared_targets"], b["succeeded"], b["automatic_clearance_percent"], b["estimated_cost_usd"], b["semantic_changes"], b["scanned_files"]) == ("native", 1, 9, True, 90.0, 0.0018, 0, 3)


def test_summary_and_comparison(spark, tmp_path):
    r = runs(spark, tmp_path)
    s = R.variant_summary(r)
    by = {x["variant"]: x for x in s.collect()}
    assert by["hybrid"]["success_rate_percent"] == 100.0 and by["rules"]["success_rate_percent"] == 0.0 and by["rules"]["estimated_cost_usd"] is None
    c = R.compare(s, "rules").collect()
    assert [(x["variant"], x["success_rate_delta_points"], x["open_issue_reduction_percent"], x["high_risk_issue_reduction_percent"]) for x in c] == [("hybrid", 100.0, 80.0, None)]
    assert R.compare(s, "none").collect() == []
    text = sinks.summary(r, s, R.compare(s, "rules"), str(tmp_path / "out"), "Comparison")
    assert text.startswith("# Comparison") and json.loads((tmp_path / "out/summary.json").read_text())["variants"]["rules"]["open_issues"] == 5
    assert spark.read.option("header", True).csv(str(tmp_path / "out/runs.csv")).count() == 2


def test_metrics(spark):
    df = spark.createDataFrame([("a", 10, 4, 1200, 300), ("b", 2, 5, 0, 0), ("c", 0, 0, 0, 0)], "k string, b int, a int, i long, o long")
    got = {r["k"]: (r["resolved"], r["resolved_percent"], r["estimated_cost_usd"]) for r in R.metrics(df, ["k"], F.col("b"), F.col("a"), F.col("i"), F.col("o"), 1.0, 2.0).collect()}
    assert got == {"a": (6, 60.0, 0.0018), "b": (0, 0.0, 0.0), "c": (0, 100.0, 0.0)}


def test_tokens_and_teams(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 1, 10), ("b", 0, 7)], "k string, i int, c int")
    got = {r["k"]: r["current_tokens"] for r in R.anchored_tokens(df, ["k"], "i", F.col("c"), F.when(F.col("k") == "a", 100).otherwise(0), F.lit(1)).collect()}
    assert got == {"a": 102, "b": 2}
    assert spark.range(1).select(R.anchor_baseline(F.lit(5), F.lit(2), F.lit(None).cast("int"), F.lit(1)).alias("x"), R.uncached_input(F.lit(3), F.lit(9)).alias("y")).collect()[0] == (8, 0)
    team = spark.createDataFrame([("a", False), ("a", None), ("b", False)], "t string, x boolean")
    assert {r["t"]: (r["all_idle"], r["n_active"]) for r in R.idle_teams(team, "t", "x").collect()} == {"a": (False, 1), "b": (True, 0)}


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"runs": [{"variant": "v", "case": "c", "path": "r/result.json"}, {"variant": "w", "case": "c", "path": "/abs/result.json"}]}))
    (tmp_path / "l.json").write_text(json.dumps([{"variant": "x", "case": "c", "path": "q.json"}]))
    got = [(r["variant"], r["path"].removeprefix("file:")) for r in records.manifest(spark, str(tmp_path / "m.json")).collect()]
    assert got[1] == ("w", "/abs/result.json") and got[0][1].endswith(f"{tmp_path}/r/result.json")
    assert records.manifest(spark, str(tmp_path / "l.json")).collect()[0]["variant"] == "x"


def test_median_by_rounds(spark):
    """Against sorting, with so few values at an end that rounds are needed: ties, NaN, nulls, huge and tiny values."""
    rng = random.Random(3)
    cases = {
        "spread": [rng.random() * 10 ** rng.randint(-200, 200) for _ in range(3001)], "two": [1.0] * 1000 + [2.0] * 1000, "one": [5.0] * 1500,
        "mixed": [float(rng.randint(0, 9)) for _ in range(2000)] + [float("nan")] * 900 + [None] * 50, "nans": [float("nan")] * 600 + [1.0] * 100, "short": [3.0, 1.0], "none": [None, None],
    }
    for name, values in cases.items():
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
        known = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
        n = len(known)
        want = None if not n else known[n // 2] if n % 2 else (known[n // 2 - 1] + known[n // 2]) / 2
        got = R.median(df, "x", 20)
        assert got == want or got != got and want != want, name
    df = spark.createDataFrame([(v,) for v in cases["spread"]], "x double")
    assert [R.ranked(df, "x", r, 20) for r in (0, 17, 3000, 3001, -1)] == [*(sorted(cases["spread"])[r] for r in (0, 17, 3000)), None, None]
