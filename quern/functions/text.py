"""Text, regular expression, date and number functions on columns."""

from __future__ import annotations

import difflib
import html
import shlex
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A diagnostic line (file, line, column, level, message) and a traceback line.
DIAGNOSTIC = r"^([^:\n]+\.py):(\d+)(?::(\d+))?:\s*(?:(error|warning):\s*)?(.+)$"
TRACEBACK = r"^([^:\n]+\.py):(\d+):\s+in\s+"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end; trim() takes spaces only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def grep(df: DataFrame, keys: Sequence[str], text: str, pattern: str) -> DataFrame:
    """keys, line_no (from 1) and line of matching lines."""
    out = df.where(F.rlike(F.col(text), F.lit(f"(?m){pattern}"))) if not any(x in pattern for x in ("^", "$", "(?", "\\A", "\\z", "\\s", "\\n", "[^", "\\W", "\\D", ".")) else df
    return out.select(*keys, F.posexplode(lines(F.col(text))).alias("_p", "line")).where(F.rlike("line", F.lit(pattern))).select(*keys, (F.col("_p") + 1).cast("long").alias("line_no"), "line")


def paged(df: DataFrame, keys: Sequence[str], text: str, offset: int = 0, limit: int = 2000) -> DataFrame:
    """Numbered lines offset + 1 to offset + limit."""
    out = df.select(*keys, F.posexplode(lines(F.col(text))).alias("_p", "_l")).where((F.col("_p") >= offset) & (F.col("_p") < offset + limit))
    return out.select(*keys, F.concat((F.col("_p") + 1).cast("string"), F.lit("\t"), F.col("_l")).alias("numbered"))


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def strip_tags(document: Column) -> Column:
    """Without scripts and styles; other tags become spaces; runs of blanks become one."""
    out = F.regexp_replace(document, r"(?is)<(script|style).*?>.*?</\1>", "")
    return F.regexp_replace(out, r"(?s)<[^>]+>", " ")


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\n\s*\n+", "\n\n"), r"[ \t]+", " "), r"^\s+", ""), r"\s+$", "")


def html_text(document: Column) -> Column:
    return collapse(unescape(strip_tags(document)))


def diagnostics(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Issues of tool output: validation_error per diagnostic line (the first per file, line and message) and
    test_failure per traceback line (the first per file and line)."""
    rows = df.select(*keys, F.posexplode(lines(F.col(text))).alias("_at", "_l"))
    part = lambda p, k: F.regexp_extract("_l", p, k)
    found = rows.where(F.rlike("_l", F.lit(DIAGNOSTIC))).select(*keys, "_at", F.lit("validation_error").alias("issue_type"), part(DIAGNOSTIC, 1).alias("file"), part(DIAGNOSTIC, 2).cast("long").alias("line"), F.coalesce(part(DIAGNOSTIC, 3).try_cast("long"), F.lit(0)).alias("column"), F.regexp_replace(part(DIAGNOSTIC, 5), r"^\s+|\s+$", "").alias("message"), F.when(part(DIAGNOSTIC, 4) == "error", "high").otherwise("medium").alias("risk"))
    tests = rows.where(F.rlike("_l", F.lit(TRACEBACK))).select(*keys, "_at", F.lit("test_failure").alias("issue_type"), part(TRACEBACK, 1).alias("file"), part(TRACEBACK, 2).cast("long").alias("line"), F.lit(0).cast("long").alias("column"), F.lit("traceback points to this location").alias("message"), F.lit("high").alias("risk"))
    every = found.unionByName(tests)
    same = [*keys, "issue_type", "file", "line", "message"]
    return every.groupBy(*same).agg(F.min_by(F.struct("column", "risk"), "_at").alias("_first")).select(*same, "_first.column", "_first.risk")


def frontmatter(content: Column, types: Sequence[str]) -> Column:
    """Struct of name, description and type from the block between --- lines at the start; the last of a key
    counts; a type that isn't listed is empty."""
    block = F.regexp_extract(content, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)

    def value(key: str) -> Column:
        hits = F.filter(F.split(block, "\n"), lambda x: strip(F.substring_index(x, ":", 1)) == F.lit(key))
        hits = F.filter(hits, lambda x: F.contains(x, F.lit(":")))
        raw = F.transform(hits, lambda x: strip(F.regexp_replace(x, r"^[^:]*:", "")))
        bare = F.transform(raw, lambda x: F.regexp_replace(x, r"""^(["'])(.*)\1\s*$""", "$2"))
        if key == "type":
            bare = F.filter(bare, lambda x: x.isin(*types))
        return F.coalesce(F.try_element_at(bare, F.lit(-1)), F.lit("")).alias(key)

    return F.struct(value("name"), value("description"), value("type"))


def safe_id(value: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9_.-]+", "-"), r"^-+|-+$", ""), 1, 100)


def file_id(value: Column) -> Column:
    """Letters and digits of any script, - and _."""
    return F.regexp_replace(value, r"[^\p{L}\p{N}_-]", "")


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def major(version: Column) -> Column:
    return F.regexp_extract(version, r"(\d+)", 1).try_cast("int")


def age_days(mtime_ms: Column, now_ms: Column) -> Column:
    return F.greatest(F.floor((now_ms - mtime_ms) / 86_400_000), F.lit(0)).cast("long")


def age_text(days: Column) -> Column:
    return F.when(days == 0, "today").when(days == 1, "yesterday").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def freshness(days: Column) -> Column:
    return F.when(days <= 1, "").otherwise(F.concat(F.lit("This memory is "), days.cast("string"), F.lit(" days old. Check it against the current state before use.")))


def scaled(n: Column) -> Column:
    """1.2M, 3.4k or the number."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1_000, F.format_string("%.1fk", n / 1_000)).otherwise(n.cast("string"))


def elapsed(start: Column, end: Column) -> Column:
    s = F.floor(end - start).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).otherwise(F.format_string("%dm%ds", F.floor(s / 60).cast("long"), s % 60))


def cut_tokens(text: Column, tokens: int, marker: str = "\n… (truncated)") -> Column:
    chars = int(tokens * 3.5)
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(marker))).otherwise(text)


def filled_lines(text: Column, trimmed: Callable[[Column], Column] = strip) -> Column:
    """Lines that `trimmed` leaves something of, so trimmed."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: trimmed(x)), lambda x: x != "")


def first_line(text: Column, trimmed: Callable[[Column], Column] = strip, missing: str | None = "") -> Column:
    """The first line that isn't blank; `missing` where there is none."""
    return F.coalesce(F.try_element_at(filled_lines(text, trimmed), F.lit(1)), F.lit(missing))


def tag_text(text: Column, tag: str = "summary") -> Column:
    """What the tag holds, trimmed; the whole text where the tag is missing."""
    a, b = F.instr(text, f"<{tag}>"), F.instr(text, f"</{tag}>")
    start = a + len(tag) + 2
    return F.when((a > 0) & (b > a), strip(F.substr(text, start, b - start))).otherwise(strip(text))


def json_object(text: Column) -> Column:
    """From the first { to the last } of a text, if that is JSON."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def cut_lines(text: Column, most: int = 200, chars: int = 25_000) -> Column:
    """At most so many lines; beyond `chars` bytes cut after that many characters."""
    kept = F.array_join(F.slice(F.split(text, "\n", -1), 1, most), "\n")
    return F.when(F.octet_length(kept) > chars, F.substring(kept, 1, chars)).otherwise(kept)


def expanded(template: Column, values: dict[str, Column]) -> Column:
    """$NAME replaced by values, longest names first."""
    return reduce(lambda t, k: F.replace(t, F.lit("$" + k), F.coalesce(values[k].cast("string"), F.lit(""))), sorted(values, key=len, reverse=True), template)


def placeholder(body: Column, args: Column, mark: str = "$ARGUMENTS") -> Column:
    """The mark replaced by args; args appended where there is no mark; without args the body alone."""
    has = F.contains(body, F.lit(mark))
    return F.when(has, F.replace(body, F.lit(mark), F.coalesce(args, F.lit("")))).when(F.coalesce(args, F.lit("")) == "", body).otherwise(F.concat(body, F.lit("\n\n"), args))


def with_env(value: Column, env: dict[str, str]) -> Column:
    """${NAME} replaced where env has the name, left where not; what comes in isn't looked at again."""
    if not env:
        return value
    known = F.create_map(*[F.lit(x) for kv in env.items() for x in kv])
    parts = F.split(value, r"(?=\$\{)|(?<=\})", -1)
    one = lambda p: F.coalesce(F.try_element_at(known, F.regexp_extract(p, r"^\$\{(.*)\}$", 1)), p)
    return F.array_join(F.transform(parts, one), "")


def replaced_once(text: Column, old: Column, new: Column) -> Column:
    """Struct of text and error: replaces a part that occurs exactly once."""
    n = F.when(old == "", 0).otherwise(F.floor((F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)))
    return F.struct(F.when(n == 1, F.replace(text, old, new)).otherwise(text).alias("text"), F.when(n == 0, "not found").when(n > 1, "not unique").alias("error"), n.cast("long").alias("n_found"))


def slash_command(text: Column) -> Column:
    t = strip(text)
    return F.struct(F.lower(F.regexp_extract(t, r"^/(\S+)", 1)).alias("name"), strip(F.regexp_extract(t, r"(?s)^/\S+\s+(.*)$", 1)).alias("args"))


def path_refs(text: Column) -> Column:
    """Distinct paths after @ in a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|\s)@([\w./\\-]+)"), F.lit(1)))


def preview(text: Column, path: Column, chars: int = 2000) -> Column:
    return F.concat(F.lit("<persisted-output>\noutput of "), F.floor(F.octet_length(text) / 1024).cast("string"), F.lit(" KB kept in\n"), path, F.lit("\n\n"), F.substring(text, 1, chars), F.lit("\n</persisted-output>"))


def output_tier(text: Column, persist: int = 50_000, cut: int = 10_000) -> Column:
    return F.when(F.length(text) > persist, "persisted").when(F.length(text) > cut, "truncated").otherwise("whole")


def tiered_output(text: Column, path: Column, persist: int = 50_000, cut: int = 10_000) -> Column:
    return F.when(F.length(text) > persist, preview(text, path)).when(F.length(text) > cut, F.concat(F.substring(text, 1, cut), F.lit("\n… (output truncated)"))).otherwise(text)


def relevance(df: DataFrame, query: str, name: str, description: str, order: str, n: int = 5) -> DataFrame:
    """The n rows of the highest score (ties: first by order): the query in the name 10, in the description 5;
    each of its words 3 and 1; rows without a score drop out."""
    q, a, b = query.lower(), F.lower(F.col(name)), F.lower(F.coalesce(F.col(description), F.lit("")))
    hit = lambda c, what, points: F.when(F.contains(c, F.lit(what)), points).otherwise(0)
    terms = [hit(a, q, 10), hit(b, q, 5)] + [t for w in q.split() for t in (hit(a, w, 3), hit(b, w, 1))]
    return df.withColumn("score", reduce(lambda x, y: x + y, terms).cast("long")).where("score > 0").orderBy(F.desc("score"), order).limit(n)


#: What exit code 1 of a command means where it is no error.
EXIT_ONE = {"grep": "no matches", "egrep": "no matches", "fgrep": "no matches", "rg": "no matches", "find": "some folders were not accessible", "diff": "files differ", "test": "condition is false", "[": "condition is false"}


@F.pandas_udf(StringType())
def last_command(command: pd.Series) -> pd.Series:
    """Name of the last command of a pipeline."""

    def one(c):
        try:
            words = shlex.split((c or "").split("|")[-1])
        except ValueError:
            words = (c or "").split("|")[-1].split()
        words = [w for w in words if "=" not in w or w.startswith("-")]
        return words[0].rsplit("/", 1)[-1] if words else ""

    return command.map(one)


def exit_meaning(command: Column, code: Column) -> Column:
    """Null if the code means an error, else what it means."""
    name = last_command(command)
    table = F.create_map(*[F.lit(x) for kv in EXIT_ONE.items() for x in kv])
    return F.when(code == 0, "ok").when(code == 1, F.try_element_at(table, name))


#: Where str.splitlines ends a line.
_LINE_END = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which the value is worked out once."""
    return F.transform(F.array(value), use)[0]


def split_lines(text: Column) -> Column:
    """As str.splitlines: an end after the last line begins no other; null and empty texts have no lines."""
    parts = F.split(F.coalesce(text, F.lit("")), _LINE_END)
    return _once(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def _alike(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common at their start."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(a))


def line_diff(old: Column | str, new: Column | str) -> Column:
    """Lines added and removed between the common start and end, and them with three lines around, 200 at most.

    In Spark's expressions, so no Python worker holds a batch of texts and their lines."""
    old, new = (F.col(c) if isinstance(c, str) else c for c in (old, new))

    def ends(x: Column) -> Column:
        rest = lambda c: F.reverse(F.slice(x[c], x["head"] + 1, F.size(x[c]) - x["head"]))
        return F.struct(*[x[c].alias(c) for c in ("a", "b", "head")], _alike(rest("a"), rest("b")).alias("tail"))

    def changed(x: Column) -> Column:
        a, head, tail = x["a"], x["head"], x["tail"]
        gone, come = (F.slice(x[c], head + 1, F.size(x[c]) - head - tail) for c in ("a", "b"))
        near = F.slice(a, F.greatest(head - 3, F.lit(0)) + 1, F.least(head, F.lit(3))), F.slice(a, F.size(a) - tail + 1, F.least(tail, F.lit(3)))
        led = lambda mark, lines: F.transform(lines, lambda t: F.concat(F.lit(mark), t))
        shown = F.slice(F.concat(led("  ", near[0]), led("- ", gone), led("+ ", come), led("  ", near[1])), 1, 200)
        n = lambda c: F.size(x[c]) - head - tail
        diff = F.when(n("a") + n("b") > 0, F.array_join(shown, "\n")).otherwise("")
        return F.struct(n("b").alias("additions"), n("a").alias("removals"), diff.alias("diff"))

    lines = F.struct(split_lines(old).alias("a"), split_lines(new).alias("b"))
    lines = _once(lines, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), _alike(x["a"], x["b"]).alias("head")))
    return _once(_once(lines, ends), changed)


@F.pandas_udf(StringType())
def unified_diff(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    def one(p, a, b):
        made = difflib.unified_diff((a or "").splitlines(keepends=True), (b or "").splitlines(keepends=True), f"a/{p}", f"b/{p}")
        return "".join(x if x.endswith("\n") else x + "\n" for x in made)

    return pd.Series([one(*x) for x in zip(path, before, after)])


def patch(files: DataFrame) -> DataFrame:
    """One patch of files (path, before, after) that differ, ordered by path."""
    each = files.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("d", unified_diff("path", "before", "after"))
    return each.agg(F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "d"))), lambda x: x["d"]), ""), F.lit("")).alias("patch"))


def ordered_text(df: DataFrame, by: Sequence[str], order: Sequence[str], text: str, glue: str = "\n\n") -> DataFrame:
    """Non-blank texts of a group joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, text)))
    return df.where(strip(F.col(text)) != "").groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p[text]), glue).alias("joined"))


def memory_blocks(df: DataFrame, keys: Sequence[str], text: str, types: Sequence[str], default: str) -> DataFrame:
    """name, description, type and content of blocks between --- lines; blocks without a name drop out."""
    rows = df.select(*keys, F.posexplode(F.split(F.col(text), r"(?m)^---\s*$")).alias("block_no", "_b"))
    part = lambda k: strip(F.regexp_extract("_b", rf"(?m)^{k}:[ \t]*(.*)$", 1))
    content = strip(F.regexp_extract("_b", r"(?s)content:[ \t]*(.*)$", 1))
    out = rows.select(*keys, "block_no", part("name").alias("name"), part("description").alias("description"), part("type").alias("_t"), content.alias("content")).where("name <> ''")
    return out.withColumn("type", F.when(F.col("_t").isin(*types), F.col("_t")).otherwise(default)).drop("_t")


def manifest_line(kind: Column, filename: Column, mtime_ms: Column, description: Column) -> Column:
    stamp = F.date_format(F.timestamp_millis(mtime_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    head = F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit("["), kind, F.lit("] "))).otherwise("")
    tail = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(": "), description)).otherwise("")
    return F.concat(F.lit("- "), head, filename, F.lit(" ("), stamp, F.lit(")"), tail)


def notification(ident: Column, status: Column, output: Column, seconds: Column, most: int = 5000) -> Column:
    body = F.when(F.length(output) > most, F.concat(F.substring(output, 1, most), F.lit("\n… (truncated)"))).otherwise(F.coalesce(output, F.lit("")))
    return F.concat_ws("\n", F.concat(F.lit("task "), ident, F.lit(" "), status, F.lit(" after "), elapsed(F.lit(0), seconds)), body)


def board(tasks: DataFrame) -> DataFrame:
    """A task board's lines, in order of id."""
    icon = F.try_element_at(F.create_map(*[F.lit(x) for x in ("pending", "[ ]", "in_progress", "[~]", "completed", "[x]")]), F.col("status"))
    line = F.concat_ws(" ", F.coalesce(icon, F.lit("[?]")), F.concat(F.lit("#"), F.col("id")), F.col("title"), F.when(F.coalesce("assignee", F.lit("")) != "", F.concat(F.lit("@"), F.col("assignee"))))
    return tasks.select("id", line.alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("board"))


def change_count(status: Column, trimmed: Callable[[Column], Column] = strip) -> Column:
    """Non-blank lines; null for null."""
    return F.array_size(filled_lines(status, trimmed))
