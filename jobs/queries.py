"""The jobs as queries: each runs its function twice on the whole tables into one new folder of the shared folder, and
gives all of the output as it then stands."""

from __future__ import annotations

import json
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import event_usage, issue_scan
from quern.operators.staging import shared


def settings(name: str) -> dict:
    return json.loads((Path(__file__).parent / f"{name}.json").read_text())


def job1_issue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared(spark)}/issue-scan-{uuid.uuid4().hex}"
    for _ in range(2):
        issue_scan.run(spark, f"{sf_dir}/documents.parquet", out, settings("issue_scan"))
    parts = {t: spark.read.schema(getattr(issue_scan, t.upper())).parquet(f"{out}/{t}") for t in ("findings", "issues", "projects")}
    kinds = {c: k for t in parts.values() for c, k in t.dtypes}

    def whole(name: str, t: DataFrame) -> DataFrame:
        """A table with the others' columns: no numbers are 0, no texts are null."""
        absent = [F.lit(None if k == "string" else 0).cast(k).alias(c) for c, k in kinds.items() if c not in t.columns]
        return t.select(F.lit(name).alias("kind"), "*", *absent)

    return reduce(DataFrame.unionByName, [whole(name, t) for name, t in parts.items()])


def job2_event_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared(spark)}/event-usage-{uuid.uuid4().hex}"
    for _ in range(2):
        event_usage.run(spark, f"{sf_dir}/events.parquet", f"{out}/output", f"{out}/checkpoint", settings("event_usage"))
    return spark.read.schema(event_usage.USAGE).parquet(f"{out}/output/usage").withColumn("day", F.col("day").cast("string"))


def _rules() -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({text(r['name'])}, {text(r['risk'])}, {text(r['pattern'])})" for r in settings("issue_scan")["rules"])


QUERIES = {"job1_issue_scan": job1_issue_scan, "job2_event_usage": job2_event_usage}
ORACLES = {
    "job1_issue_scan": f"""
        WITH r(rule, risk, pattern) AS (VALUES {_rules()}),
        s AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS x FROM documents),
        l AS (SELECT doc_id, source, lang, unnest(x) AS line, generate_subscripts(x, 1) AS line_no FROM s),
        f AS (SELECT doc_id, source, lang, CAST(line_no AS BIGINT) AS line_no, line, CAST(len(regexp_extract_all(line, pattern)) AS INTEGER) AS hits, risk, rule FROM l, r WHERE regexp_matches(line, pattern)),
        i AS (SELECT risk, rule, line, count(DISTINCT doc_id) AS n_files, count(*) AS n_lines, min(doc_id) AS first_doc FROM f GROUP BY 1, 2, 3),
        p AS (SELECT source, risk, rule, count(DISTINCT doc_id) AS n_files, count(*) AS n_lines, CAST(sum(hits) AS BIGINT) AS n_hits FROM f GROUP BY 1, 2, 3),
        d AS (SELECT source, count(*) AS project_files FROM documents GROUP BY 1)
        SELECT 'findings' AS kind, doc_id, source, lang, line_no, line, hits, risk, rule, 0 AS n_files, 0 AS n_lines, 0 AS first_doc, 0 AS first_line, 0 AS n_hits, 0 AS project_files, 0.0::DOUBLE AS files_percent FROM f
        UNION ALL SELECT 'issues', 0, NULL, NULL, 0, line, 0, risk, rule, n_files, n_lines, first_doc, (SELECT min(line_no) FROM f WHERE f.rule = i.rule AND f.risk = i.risk AND f.line = i.line AND f.doc_id = i.first_doc), 0, 0, 0.0 FROM i
        UNION ALL SELECT 'projects', 0, p.source, NULL, 0, NULL, 0, risk, rule, n_files, n_lines, 0, 0, n_hits, project_files, round(n_files * 100.0::DOUBLE / project_files, 2) FROM p JOIN d ON p.source IS NOT DISTINCT FROM d.source""",
    "job2_event_usage": """
        WITH e AS (SELECT CAST(ts AS DATE) AS day, user_id, event_id, event_type, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(CAST(round(value * 100) AS BIGINT), 0) AS c,
            sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY event_id) AS run FROM events),
        f AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY day, user_id, run) AS n FROM e)
        SELECT CAST(day AS VARCHAR) AS day, user_id, count(*) AS events, count(*) FILTER (event_type IN ('click', 'purchase')) AS tool_calls, max(event_id) AS last_event, CAST(sum(k) AS BIGINT) AS input_tokens, CAST(sum(c) AS BIGINT) AS cents,
            CAST(max(n) AS BIGINT) AS longest_failure, max(n) >= 3 AS breaker_opened FROM f GROUP BY day, user_id""",
}
