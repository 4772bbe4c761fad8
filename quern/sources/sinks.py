"""Writers: summaries, artefacts, appended records, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.events import canonical


def _put(spark, path: str, text: str) -> None:
    """A small text file by way of Hadoop's file systems: written beside, then renamed."""
    jvm = spark.sparkContext._jvm
    to, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(to, False)
    if not fs.rename(beside, to):
        raise OSError(f"could not write {path}")


def summary(runs: DataFrame, variants: DataFrame, comparisons: DataFrame, folder: str, title: str) -> str:
    """runs.csv (one folder of parts), summary.json and report.md; the report's text. Variants are few."""
    spark = runs.sparkSession
    runs.write.mode("overwrite").option("header", True).csv(f"{folder}/runs.csv")
    v, c = [r.asDict() for r in variants.orderBy("variant").collect()], [r.asDict() for r in comparisons.orderBy("variant").collect()]
    _put(spark, f"{folder}/summary.json", canonical({"variants": {r["variant"]: r for r in v}, "comparisons": {r["variant"]: r for r in c}}))
    text = report(title, v, c)
    _put(spark, f"{folder}/report.md", text)
    return text


def report(title: str, variants: list[dict], comparisons: list[dict]) -> str:
    out = [f"# {title}"]
    for rows in (variants, comparisons):
        if rows:
            cols = list(rows[0])
            out += ["", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
            out += ["| " + " | ".join("-" if r[c] is None else str(r[c]) for c in cols) + " |" for r in rows]
    return "\n".join(out) + "\n"


def artefacts(results: DataFrame, issues: DataFrame, folder: str) -> None:
    """result and semantic-tasks (medium and high issues only) as JSON lines."""
    results.write.mode("overwrite").json(f"{folder}/result.json")
    issues.where(F.col("risk").isin("medium", "high")).write.mode("overwrite").json(f"{folder}/semantic-tasks.json")


def migration_report(changes: DataFrame, issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lines of a report: risks counted over changes and issues, then nodes that are models or have edges."""
    risk = changes.select("risk").unionByName(issues.select("risk")).groupBy("risk").count()
    lines = risk.select(F.lit(0).alias("part"), F.col("risk").alias("key"), F.concat(F.lit("- "), "risk", F.lit(": "), F.col("count").cast("string")).alias("line"))
    shown = nodes.where((F.col("kind") == "model") | (F.size("depends_on") > 0) | (F.size("referenced_by") > 0))
    return lines.unionByName(shown.select(F.lit(1).alias("part"), F.col("node_id").alias("key"), F.concat(F.lit("- "), "node_id", F.lit(" -> "), F.array_join("depends_on", ", ")).alias("line"))).orderBy("part", "key")


def append_records(df: DataFrame, path: str) -> None:
    """JSON lines added to those that are there (session, transcript and replacement records)."""
    df.write.mode("append").json(path)


def session_title(messages: DataFrame, by: str, order: str, role: str, text: str, most: int = 50) -> DataFrame:
    """title (start of the first user text) and message_count per session."""
    first = F.min_by(F.when(F.col(role) == "user", F.substring(F.col(text), 1, most)), F.when(F.col(role) == "user", F.col(order)))
    return messages.groupBy(by).agg(F.coalesce(first, F.lit("")).alias("title"), F.count("*").alias("message_count"))


def write_checkpoint(spark, path: str, checkpoint: dict) -> None:
    """Readers see the old or the new checkpoint, never half of one."""
    _put(spark, path, canonical(checkpoint))


def semantic_payload(issues: DataFrame, graph: DataFrame, runs: DataFrame, tail: int = 12_000) -> DataFrame:
    """payload: pending issues, graph nodes of their files and the ends of the last run's output, as JSON."""
    pending = issues.where(F.col("risk").isin("medium", "high"))
    touched = pending.select(F.explode(F.array_union(F.array("file"), F.coalesce("affected_files", F.array().cast("array<string>")))).alias("file")).distinct()
    near = graph.join(touched, "file", "left_semi")
    last = runs.agg(F.max_by(F.struct(ending(F.col("stdout"), tail).alias("stdout"), ending(F.col("stderr"), tail).alias("stderr")), "n").alias("run"))
    some = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
    return some(pending, "issues").crossJoin(some(near, "graph")).crossJoin(last).select(F.to_json(F.struct("issues", "graph", "run")).alias("payload"))


def ending(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.substring(text, -n, n)).otherwise(text)
