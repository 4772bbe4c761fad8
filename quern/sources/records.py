"""Scans of JSON, JSON-lines, Markdown, YAML and source files. Schemas are given, never inferred."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.keyed import last_wins, precedence
from quern.sources import schemas

SKIPPED = (".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__", "node_modules", "build", "dist", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "site-packages")
MEMORY_TYPES = ("user", "feedback", "project", "reference")
MANIFESTS = ("pyproject.toml", "setup.cfg", "setup.py")
LOCKS = ("Pipfile", "poetry.lock", "uv.lock")


def results(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Result files, one object each, with result_path. A file that isn't an object is an error."""
    return spark.read.schema(schemas.RESULT).option("multiLine", True).option("mode", "FAILFAST").json(paths).withColumn("result_path", F.col("_metadata.file_path"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """variant, case and path of the runs that a manifest lists, as an array or as {runs: []}; relative paths
    start at the manifest."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("at"))
    kind = "array<struct<variant: string, case: string, path: string>>"
    runs = F.coalesce(F.from_json("value", f"struct<runs: {kind}>")["runs"], F.from_json("value", kind))
    folder = F.regexp_replace("at", r"/[^/]*$", "")
    listed = raw.select(folder.alias("folder"), F.explode(runs).alias("r")).select("folder", "r.*")
    absolute = F.rlike("path", F.lit(r"^(/|[a-z][a-z0-9+.-]*:/)"))
    return listed.withColumn("path", F.when(absolute, F.col("path")).otherwise(F.concat("folder", F.lit("/"), "path"))).drop("folder")


def listing(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """uri, path (relative to root) and mtime of files below root, by the file system's own listing: Spark's file
    sources leave out empty files and names that start with an underscore, such as packages' __init__ files.

    A listing is metadata of one project or folder, which the driver holds as the file sources' index does."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toUri().getPath().rstrip("/") + "/"
    rows, it = [], fs.listFiles(top, True)
    while it.hasNext():
        f = it.next()
        uri, path = f.getPath().toString(), f.getPath().toUri().getPath().removeprefix(base)
        if fnmatch.fnmatchcase(path.rsplit("/", 1)[-1], pattern) and not f.isSymlink():
            rows.append((uri, path, f.getModificationTime()))
    out = spark.createDataFrame(rows, "uri string, path string, ms long")
    return out.select("uri", "path", F.timestamp_millis("ms").alias("mtime"))


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri[5:].lstrip("/"))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path (relative to root), mtime and content of files below root; tasks read what the driver listed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = []
            for uri in batch["uri"].to_pylist():
                with _open(uri) as f:
                    content.append(f.read().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch["path"], batch["mtime"], pa.array(content, pa.string())], ["path", "mtime", "content"])

    return listing(spark, root, pattern).mapInArrow(read, "path string, mtime timestamp, content string")


def python_files(spark: SparkSession, root: str, skipped: Sequence[str] = SKIPPED) -> DataFrame:
    """Python sources by path, without skipped folders and without folders that hold a virtual environment."""
    out = files(spark, root, "*.py")
    parts = F.split(F.col("path"), "/")
    out = out.where(~F.arrays_overlap(F.slice(parts, 1, F.size(parts)), F.array(*[F.lit(s) for s in skipped])))
    homes = listing(spark, root, "pyvenv.cfg").select(F.regexp_replace("path", r"/?pyvenv\.cfg$", "").alias("home"))
    folders = out.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("home"))
    return out.join(folders.join(homes, "home").select("path").distinct(), "path", "left_anti").orderBy("path")


def manifests(listing: DataFrame) -> DataFrame:
    """Dependency manifests of a listing (path), in a fixed order: projects, requirements by name, locks."""
    order = F.when(F.col("path").isin(*MANIFESTS), F.array_position(F.array(*[F.lit(m) for m in MANIFESTS]), F.col("path"))).when(F.rlike("path", F.lit(r"^requirements[^/]*\.txt$")), 10).when(F.col("path").isin(*LOCKS), F.array_position(F.array(*[F.lit(m) for m in LOCKS]), F.col("path")) + 20)
    return listing.withColumn("_o", order).where("_o is not null").orderBy("_o", "path").drop("_o")


def session_records(spark: SparkSession, path: str) -> DataFrame:
    """session, line_no, type, content (JSON text), timestamp, tool_use_id and is_error; lines that aren't such
    records drop out."""
    from quern.operators.events import read_lines

    g = lambda k: F.get_json_object("line", f"$.{k}")
    rows = read_lines(spark, path).where(F.try_parse_json("line").isNotNull() & F.startswith(T.strip(F.col("line")), F.lit("{")))
    out = rows.select(F.regexp_replace("journal", r"\.jsonl$", "").alias("session"), "line_no", g("type").alias("type"), g("content").alias("content"), F.try_to_timestamp(g("timestamp")).alias("timestamp"), g("tool_use_id").alias("tool_use_id"), F.coalesce(g("is_error").try_cast("boolean"), F.lit(False)).alias("is_error"))
    return out.where("type is not null and timestamp is not null")


def session_metas(spark: SparkSession, path: str) -> DataFrame:
    """Newest first."""
    return spark.read.schema(schemas.SESSION_META).option("multiLine", True).json(path).where("id is not null").orderBy(F.desc("last_active"), "id")


def memories(spark: SparkSession, root: str, scope: str, head: int = 30, most: int = 200) -> DataFrame:
    """The newest `most` Markdown memories but the index: filename, scope, mtime_ms and frontmatter of the first
    `head` lines."""
    rows = files(spark, root, "*.md").where(~F.rlike("path", F.lit(r"(^|/)MEMORY\.md$")))
    f = T.frontmatter(F.array_join(F.slice(F.split("content", "\n"), 1, head), "\n"), MEMORY_TYPES)
    out = rows.select(F.col("path").alias("filename"), F.lit(scope).alias("scope"), F.unix_millis("mtime").alias("mtime_ms"), f.alias("f"))
    return out.select("filename", "scope", "mtime_ms", "f.description", "f.type").orderBy(F.desc("mtime_ms"), "filename").limit(most)


def memory_folders(spark: SparkSession, user: str, project: str) -> DataFrame:
    """Memories directly in both folders, the user's first, each by name."""
    one = lambda root, scope, rank: files(spark, root, "*.md").where(~F.contains("path", F.lit("/")) & (F.col("path") != "MEMORY.md")).withColumn("scope", F.lit(scope)).withColumn("rank", F.lit(rank))
    return one(user, "user", 0).unionByName(one(project, "project", 1)).orderBy("rank", "path")


def unseen_memories(user: DataFrame, project: DataFrame, surfaced: DataFrame) -> DataFrame:
    """Both scans without what was shown before."""
    return user.unionByName(project).join(surfaced, "filename", "left_anti")


def replacements(spark: SparkSession, path: str) -> DataFrame:
    """Replacement records; the kind defaults to tool-result; records without an id drop out."""
    out = spark.read.schema("kind string, tool_use_id string, replacement string").json(path)
    return out.withColumn("kind", F.coalesce("kind", F.lit("tool-result"))).where("tool_use_id is not null")


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of inbox files, one JSON array each; a corrupt file counts as empty."""
    return spark.read.schema(schemas.MESSAGE).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).where("id is not null").withColumn("inbox", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))


def task_board(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TASK).option("multiLine", True).json(path).where("id is not null")


def rule_file(spark: SparkSession, path: str, tier: int) -> DataFrame:
    """Rules (tier, pos, tool, pattern, effect) of a YAML list of {rule, effect}; other entries drop out. Read as
    lines, so no YAML library is needed: each entry has a rule and an effect line."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"(?m)^\s*-\s+")).alias("pos", "e"))
    value = lambda k: F.regexp_replace(T.strip(F.regexp_extract("e", rf"(?m)^\s*{k}:[ \t]*(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2")
    rows = raw.select("pos", value("rule").alias("rule"), value("effect").alias("effect"))
    rule = r"(?s)^(\w+)\((.*)\)$"
    return rows.where(F.col("effect").isin("allow", "deny", "ask") & F.rlike("rule", F.lit(rule))).select(F.lit(tier).alias("tier"), "pos", F.regexp_extract("rule", rule, 1).alias("tool"), F.regexp_extract("rule", rule, 2).alias("pattern"), "effect")


def layered(layers: Sequence[DataFrame], key: str = "name") -> DataFrame:
    """Skill or agent definitions of folders, the first layer that has a name wins."""
    return precedence(layers, [key], [key])


def commands(spark: SparkSession, root: str) -> DataFrame:
    """User commands of Markdown files: the name is the path with colons; the description, where the
    frontmatter has none, is the first line that is no header."""
    rows = files(spark, root, "*.md")
    name = F.replace(F.lower(F.replace(F.regexp_replace("path", r"\.md$", ""), F.lit("/"), F.lit(":"))), F.lit(" "), F.lit("-"))
    body = T.strip(F.regexp_replace("content", r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(\r?\n|\z)", ""))
    first = F.try_element_at(F.filter(F.transform(F.split(body, "\n"), lambda x: T.strip(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#"))), F.lit(1))
    described = F.coalesce(F.nullif(T.frontmatter(F.col("content"), ())["description"], F.lit("")), first, F.concat(F.lit("Custom command: "), name))
    return rows.select(name.alias("name"), described.alias("description"), body.alias("body"), "path")


def user_commands(user: DataFrame, project: DataFrame) -> DataFrame:
    """Commands of both folders: a project's replaces a user's in its place."""
    rank = lambda df, r: df.withColumn("rank", F.lit(r)).withColumn("place", F.concat(F.lit(str(r)), F.col("path")))
    return last_wins(rank(user, 0).unionByName(rank(project, 1)), ["name"], "rank", "place").drop("rank", "place")


def transcript(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TURN).json(path)


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def providers(raw: str, required: Sequence[str] = ("name", "protocol", "model")) -> list[dict]:
    """A configuration's providers, or an error that names what is missing."""
    found = json.loads(raw)
    if not isinstance(found, list) or not found:
        raise ValueError("providers must be a list with entries")
    for i, p in enumerate(found):
        if not isinstance(p, dict):
            raise ValueError(f"provider {i} must be an object")
        if missing := [k for k in required if not p.get(k)]:
            raise ValueError(f"provider {i} lacks {', '.join(missing)}")
    return found


def servers(raw: str) -> list[dict]:
    """A configuration's outside servers: each has a name and either a command or an address."""
    found = json.loads(raw)
    for i, s in enumerate(found):
        if not s.get("name"):
            raise ValueError(f"server {i} lacks a name")
        if bool(s.get("command")) == bool(s.get("url")):
            raise ValueError(f"server {i} needs a command or a url, not both")
    return found


def glob(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files below root whose relative path the shell pattern matches (** also over folders), newest first."""
    from quern.operators.rules import glob_regex

    found = listing(spark, root, "*").where(F.rlike("path", F.lit(glob_regex(pattern.replace("**/", "*")))))
    return found.select("path", "mtime").orderBy(F.desc("mtime"), "path")
