"""Scan of project texts for issues, by rules: every finding, each project's counts and each distinct issue.

    python -m jobs.issue_scan --config jobs/issue_scan.json --documents PATH --output PATH

A project is a `source`, a file is a document. A rule is a name, a risk and a pattern (of the dialect that Spark's
rlike and RE2 share), searched in each line. Three tables are written:

  findings  one row for each line and rule that meet, partitioned by risk and rule
  issues    each distinct line of a rule once: its first place, in how many files and lines it stands
  projects  per project and rule: files and lines found, files of the project, their share in percent

Texts are read once; the other two tables come from the findings as written. All are overwritten, so a rerun gives
the same result whatever became of the run before. Null texts have no lines; null projects are one of their own.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import rollup as R

LOG = logging.getLogger("quern.jobs.issue_scan")
FINDINGS = "doc_id long, source string, lang string, line_no long, line string, hits int, risk string, rule string"
ISSUES = "risk string, rule string, line string, n_files long, n_lines long, first_doc long, first_line long"
PROJECTS = "source string, risk string, rule string, n_files long, n_lines long, n_hits long, project_files long, files_percent double"


def rules_of(config: dict) -> list[dict]:
    rules = config["rules"]
    if not rules or len({r["name"] for r in rules}) < len(rules) or any(not r["pattern"] for r in rules):
        raise ValueError("rules need different names, and patterns")
    return rules


def found(docs: DataFrame, rules: list[dict]) -> DataFrame:
    """Findings: one pass over the lines that any rule meets, then the rules of each."""
    lines = T.grep(docs, ["doc_id", "source", "lang"], "text", "|".join(f"(?:{r['pattern']})" for r in rules))
    hit = [F.struct(F.regexp_count("line", F.lit(r["pattern"])).alias("hits"), F.lit(r["risk"]).alias("risk"), F.lit(r["name"]).alias("rule")) for r in rules]
    return lines.select("*", F.inline(F.filter(F.array(*hit), lambda h: h["hits"] > 0)))


def issues_of(findings: DataFrame) -> DataFrame:
    """Files are counted by first adding up each file's lines, so both steps combine before their shuffle."""
    files = findings.groupBy("risk", "rule", "line", "doc_id").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no"))
    out = files.groupBy("risk", "rule", "line").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_lines"), first.alias("at"))
    return out.select("risk", "rule", "line", "n_files", "n_lines", F.col("at.doc_id").alias("first_doc"), F.col("at.line_no").alias("first_line"))


def projects_of(findings: DataFrame, docs: DataFrame) -> DataFrame:
    files = findings.groupBy("source", "risk", "rule", "doc_id").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"))
    per = files.groupBy("source", "risk", "rule").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_lines"), F.sum("hits").alias("n_hits"))
    sizes = docs.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("project_files"))
    out = per.join(sizes, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return out.withColumn("files_percent", R.percent(F.col("n_files"), F.col("project_files"), 0.0))


def run(spark: SparkSession, documents: str, output: str, config: dict) -> dict[str, int]:
    """Rows read and written, by table."""
    rules = rules_of(config)
    read, counts = Observation("read"), {}
    docs = spark.read.parquet(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    written = {name: Observation(name) for name in ("findings", "issues", "projects")}
    rows = found(docs.observe(read, F.count("*").alias("rows")), rules).observe(written["findings"], F.count("*").alias("rows"))
    # partitions of a common rule are split, those of rare ones joined
    rows.hint("rebalance", "risk", "rule").write.mode("overwrite").partitionBy("risk", "rule").parquet(f"{output}/findings")
    counts["documents"], counts["findings"] = read.get["rows"], written["findings"].get["rows"]
    LOG.info("read %d documents from %s with %d rules", counts["documents"], documents, len(rules))
    LOG.info("wrote %d findings to %s/findings", counts["findings"], output)
    findings = spark.read.schema(FINDINGS).parquet(f"{output}/findings")
    for name, table in (("issues", issues_of(findings)), ("projects", projects_of(findings, docs))):
        table.observe(written[name], F.count("*").alias("rows")).write.mode("overwrite").partitionBy("risk").parquet(f"{output}/{name}")
        counts[name] = written[name].get["rows"]
        LOG.info("wrote %d %s to %s/%s", counts[name], name, output, name)
    return counts


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("config", "documents", "output"):
        parser.add_argument(f"--{name}", required=True)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("issue_scan").getOrCreate()
    try:
        config = json.loads(spark.read.text(args.config, wholetext=True).first()["value"])
        run(spark, args.documents, args.output, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
