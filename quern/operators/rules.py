"""Predicates, ordered rules and decision cascades, compiled to Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.functions.text import strip

#: Comparison operators of a condition, in the order in which they are looked for.
OPERATORS = ("==", "!=", "=~", "~=")

#: Patterns of dangerous commands, first match counts, and a short reason each.
DANGEROUS = (
    (r"rm\s+-[a-z]*r[a-z]*f[a-z]*\s+/\s*$", "removes the root folder"),
    (r"mkfs\.", "formats a disk"),
    (r"dd\s+if=.*of=/dev/", "writes to a disk device"),
    (r"chmod\s+-R\s+777\s+/", "opens the root folder's permissions"),
    (r":\(\)\{\s*:\|:&\s*\};:", "fork bomb"),
    (r"curl\s+.*\|\s*(ba)?sh", "runs a remote script"),
    (r"wget\s+.*\|\s*(ba)?sh", "runs a remote script"),
    (r">\s*/dev/sd", "overwrites a disk device"),
)

#: Commands that only read.
SAFE = (
    "ls", "dir", "pwd", "echo", "cat", "head", "tail", "wc", "find", "which", "whereis", "whoami", "hostname", "uname", "date", "cal", "uptime", "df", "du", "free", "env", "printenv",
    "file", "stat", "readlink", "realpath", "basename", "dirname", "sort", "uniq", "tr", "cut", "awk", "sed", "grep", "egrep", "fgrep", "diff", "comm", "tee", "xargs", "true", "false", "test",
    "git status", "git log", "git diff", "git show", "git branch", "git tag", "git remote", "git rev-parse", "git ls-files", "git blame", "git stash list", "go version", "go env",
    "node -v", "npm -v", "npx", "python --version", "pip list", "cargo --version", "rustc --version", "java -version", "java --version",
)

#: What a mode decides per category where nothing else did.
MODES = {
    "default": {"read": "allow", "write": "ask", "command": "ask"},
    "acceptEdits": {"read": "allow", "write": "allow", "command": "ask"},
    "plan": {"read": "allow", "write": "ask", "command": "ask"},
    "bypassPermissions": {"read": "allow", "write": "allow", "command": "allow"},
}


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a shell pattern; * and ? also match slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + (pattern[i : i + 1] in ("!", "]")) + (pattern[i : i + 2] == "!]"))) > 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&\\&")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end + 1
        else:
            out.append(re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", c))
    return "(?s)^" + "".join(out) + r"\z"


@F.pandas_udf(StringType())
def glob_column(pattern: pd.Series) -> pd.Series:
    """The same for patterns in a column of a rule table."""
    return pattern.map(lambda p: None if p is None else glob_regex(p))


def valid_regex(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


class ConditionError(ValueError):
    pass


def condition(text: str | None, field: Callable[[str], Column]) -> Column:
    """Column of a condition such as `tool == "Bash" && args.command =~ /rm/`. An empty one holds.

    field gives the column of a field name; what it has no value for counts as an empty text."""
    if not text or not text.strip():
        return F.lit(True)
    if "&&" in text and "||" in text:
        raise ConditionError("&& and || can't be mixed")
    glue = "||" if "||" in text else "&&"
    parts = [_comparison(p.strip(), field) for p in text.strip().split(glue)]
    return reduce((lambda a, b: a | b) if glue == "||" else (lambda a, b: a & b), parts)


def _comparison(text: str, field: Callable[[str], Column]) -> Column:
    for op in OPERATORS:  # in this order, wherever it stands
        left, found, right = text.partition(op)
        if not found:
            continue
        value = right.strip()
        if value.startswith('"') and value.endswith('"'):
            value = value[1:-1]
        c = F.coalesce(field(left.strip()).cast("string"), F.lit(""))
        if op == "==":
            return c == value
        if op == "!=":
            return c != value
        if op == "~=":
            return F.rlike(c, F.lit(glob_regex(value)))
        pattern = value[1:-1] if value.startswith("/") and value.endswith("/") else value
        return F.rlike(c, F.lit(pattern)) if valid_regex(pattern) else F.lit(False)
    raise ConditionError(f"no operator in {text!r}")


def event_field(name: str) -> Column:
    """Fields of a row with event, tool and args (a map): tool, event, args.*; any other is empty."""
    if name in ("tool", "event"):
        return F.col(name)
    return F.try_element_at(F.col("args"), F.lit(name[5:])) if name.startswith("args.") else F.lit("")


def matching_hooks(events: DataFrame, hooks: Sequence[dict], order: str) -> DataFrame:
    """Events with the hooks that they set off, in one scan. hooks: ident, event, condition, once; a hook with once
    fires on its first event only."""
    if not hooks:
        return events.limit(0).withColumn("hook", F.lit(None).cast("string"))
    hit = lambda h: F.when((F.col("event") == h["event"]) & condition(h.get("condition"), event_field), F.lit(h["ident"]))
    found = events.withColumn("hook", F.explode(F.array_compact(F.array(*map(hit, hooks)))))
    once = [h["ident"] for h in hooks if h.get("once")]
    if not once:
        return found
    first = found.where(F.col("hook").isin(*once)).groupBy(F.col("hook").alias("_hook")).agg(F.min(order).alias("_first"))
    out = found.join(F.broadcast(first), F.col("hook") == F.col("_hook"), "left")  # a row per hook
    return out.where(F.col("_first").isNull() | (F.col(order) == F.col("_first"))).drop("_hook", "_first")


def first_match(text: Column, patterns: Sequence[tuple[str, str]] = DANGEROUS) -> Column:
    """Reason of the first pattern found, else null."""
    return F.coalesce(*[F.when(F.rlike(text, F.lit(p)), F.lit(r)) for p, r in patterns])


def is_safe(command: Column, safe: Sequence[str] = SAFE) -> Column:
    """A command without shell syntax that is a safe one or starts with it and a space."""
    c = strip(command)
    plain = ~F.rlike(c, F.lit(r"[|;>`]|&&|\$\("))
    listed = c.isin(*safe) | F.rlike(c, F.lit("^(" + "|".join(map(re.escape, safe)).replace("\\ ", " ") + ") "))
    return F.coalesce((c != "") & plain & listed, F.lit(False))


def rule_effect(df: DataFrame, rules: Sequence[tuple[int, str, str, str]], tool: str, content: str) -> DataFrame:
    """effect: of the first tier (0 before 1 before 2) with a matching rule, its last matching rule's effect.

    rules: tier, tool, pattern, effect, in order within a tier; a policy, so small and given on the driver."""
    ordered = sorted(range(len(rules)), key=lambda i: (rules[i][0], -i))
    tests = [F.when((F.col(tool) == rules[i][1]) & F.rlike(F.coalesce(F.col(content), F.lit("")), F.lit(glob_regex(rules[i][2]))), F.lit(rules[i][3])) for i in ordered]
    return df.withColumn("effect", F.coalesce(*tests) if tests else F.lit(None).cast("string"))


def rule_effect_joined(df: DataFrame, rules: DataFrame, keys: Sequence[str], tool: str, content: str) -> DataFrame:
    """The same with rules as a table (tier, pos, tool, pattern, effect): an equi-join on the tool."""
    r = rules.select(F.col("tier").alias("_tier"), F.col("pos").alias("_pos"), F.col("tool").alias("_tool"), glob_column(F.col("pattern")).alias("_re"), F.col("effect").alias("_effect"))
    hit = df.join(r, (F.col(tool) == F.col("_tool")) & F.expr(f"rlike(coalesce(`{content}`, ''), _re)"))
    best = hit.groupBy(*keys).agg(F.min_by("_effect", F.struct("_tier", -F.col("_pos"))).alias("effect"))
    return df.join(best, list(keys), "left")


def session_allowed(tool: Column, content: Column, allowed: Sequence[str]) -> Column:
    """tool:content is allowed, or starts with an allowed prefix that ends in *."""
    key = F.concat(tool, F.lit(":"), F.coalesce(content, F.lit("")))
    tests = [F.startswith(key, F.lit(a[:-1])) for a in allowed if a.endswith("*")]
    return reduce(lambda a, b: a | b, tests, key.isin(*allowed) if allowed else F.lit(False))


def inside(path: Column, roots: Sequence[str], denied: Sequence[str] = ()) -> Column:
    """Path is in a root (or is one) and in none of the denied folders."""
    under = lambda some: reduce(lambda a, b: a | b, [(path == r.rstrip("/")) | F.startswith(path, F.lit(r.rstrip("/") + "/")) for r in some], F.lit(False))
    return under(roots) & ~under(denied)


def decide(mode: str, tool: Column, category: Column, content: Column, effect: Column, in_sandbox: Column, allowed: Sequence[str] = (), plan_tools: Sequence[str] = (), plan_file: Column | None = None, os_sandbox: bool = False, sub_effects: Column | None = None) -> Column:
    """Struct of decision and layer. Layers in order: plan exceptions, safe commands, dangerous commands, the
    operating system's sandbox, the path sandbox, rules (allow and deny only), the session, the mode.

    sub_effects: the rules' effects on a compound command's parts, for the sandbox layer."""
    say = lambda d, layer: F.struct(F.lit(d).alias("decision"), F.lit(layer).alias("layer"))
    c = F.coalesce(content, F.lit(""))
    steps: list[tuple[Column, Column]] = []
    if mode == "plan":
        steps += [(tool.isin(*plan_tools), say("allow", "plan"))] if plan_tools else []
        steps += [(tool.isin("WriteFile", "EditFile") & (c != "") & plan_file, say("allow", "plan"))] if plan_file is not None else []
    command = category == "command"
    steps += [(command & is_safe(c), say("allow", "safe")), (command & first_match(c).isNotNull(), say("deny", "dangerous"))]
    if os_sandbox:
        subs = sub_effects if sub_effects is not None else F.array(effect)
        steps += [(command & F.exists(subs, lambda e: e == "deny"), say("deny", "rule")), (command & F.exists(subs, lambda e: e == "ask"), say("ask", "rule")), (command, say("allow", "os sandbox"))]
    if mode != "bypassPermissions":
        steps.append((category.isin("read", "write") & (c != "") & ~in_sandbox, say("ask", "path")))
    steps += [(effect == "allow", say("allow", "rule")), (effect == "deny", say("deny", "rule")), (session_allowed(tool, content, allowed), say("allow", "session"))]
    steps += [(category == k, say(d, "mode")) for k, d in MODES[mode].items()]
    return reduce(lambda acc, s: acc.when(F.coalesce(s[0], F.lit(False)), s[1]), steps[1:], F.when(F.coalesce(steps[0][0], F.lit(False)), steps[0][1])).otherwise(say("ask", "mode"))


def subcommands(command: Column) -> Column:
    """Parts of a compound command; the command itself where it has none."""
    parts = F.filter(F.transform(F.split(command, r"\s*(?:&&|\|\||[;|])\s*"), lambda s: strip(s)), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(command))


def run_status(dry_run: Column, failed: Column, open_high: Column) -> Column:
    return F.when(dry_run, "dry-run").when(failed, "validation-failed").when(open_high > 0, "needs-review").otherwise("completed")


def access(name: Column, category: Column, path: Column, concurrent: Column, root: str = ".") -> Column:
    """Struct of reads, writes (arrays of path, recursive), exclusive and side_effect of a tool call."""
    ref = lambda p, rec: F.array(F.struct(p.alias("path"), F.lit(rec).alias("recursive")))
    none = F.array().cast("array<struct<path:string,recursive:boolean>>")
    p = F.when(path != "", path)
    has = p.isNotNull()

    def of(reads: Column = none, writes: Column = none, exclusive: bool = False, effect: str = "none") -> Column:
        return F.struct(reads.alias("reads"), writes.alias("writes"), F.lit(exclusive).alias("exclusive"), F.lit(effect).alias("side_effect"))

    return (
        F.when(name.isNull(), of(exclusive=True, effect="unknown"))
        .when(name.isin("Glob", "Grep"), of(reads=ref(F.coalesce(p, F.lit(root)), True)))
        .when((name == "ReadFile") & has, of(reads=ref(p, False)))
        .when((category == "write") & has & (name == "EditFile"), of(reads=ref(p, False), writes=ref(p, False), effect="filesystem"))
        .when((category == "write") & has, of(writes=ref(p, False), effect="filesystem"))
        .when((category == "command") & ~concurrent, of(exclusive=True, effect="process"))
        .when(category == "command", of(effect="declared_safe"))
        .when(~concurrent, of(exclusive=True, effect="unknown"))
        .when(has, of(reads=ref(p, False)))
        .otherwise(of())
    )


def allowed_tools(tools: DataFrame, globally_denied: Sequence[str], source_denied: Sequence[str], background: Sequence[str] | None, denied: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Tools that an agent may use: those of outside servers always; of the others what no list forbids and
    the background list (where given) and the agent's own (where not empty) name."""
    name = F.col("name")
    keep = ~name.isin(*globally_denied, *source_denied, *denied, "")
    if background is not None:
        keep = keep & name.isin(*background, "")
    if allowed:
        keep = keep & name.isin(*allowed)
    return tools.where(F.startswith(name, F.lit("mcp__")) | keep)


def coordinator_tools(tools: DataFrame, mode: bool, names: Sequence[str]) -> DataFrame:
    return tools.where(F.col("name").isin(*names)) if mode else tools


def teammate_tools(tools: DataFrame, base: Sequence[str], extra: DataFrame) -> DataFrame:
    """The base tools and the team's own, a name once."""
    kept = tools.where(F.col("name").isin(*base))
    return kept.unionByName(extra.join(kept, "name", "left_anti"))


def visible(tools: DataFrame, disabled: DataFrame, discovered: DataFrame, key: str, deferred: str) -> DataFrame:
    """Enabled tools that aren't deferred or have been discovered."""
    return tools.join(disabled, key, "left_anti").where(~F.col(deferred)).unionByName(tools.join(disabled, key, "left_anti").where(F.col(deferred)).join(discovered, key, "left_semi"))


def deferred_names(tools: DataFrame, disabled: DataFrame, discovered: DataFrame, key: str, deferred: str) -> DataFrame:
    return tools.where(F.col(deferred)).join(disabled, key, "left_anti").join(discovered, key, "left_anti").select(key)


def select_deferred(tools: DataFrame, asked: Column, key: str, deferred: str) -> DataFrame:
    """Deferred tools of the asked names in the order asked for; a disabled one too."""
    want = tools.sparkSession.range(1).select(F.posexplode(asked).alias("asked_at", "_name"))
    return tools.where(F.col(deferred)).join(F.broadcast(want), F.col(key) == F.col("_name")).drop("_name")


def open_issues(issues: DataFrame, passed: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Issues still open: medium and high ones, without validation issues if the last batch passed (one row,
    passed) and without lockfile issues whose lockfile changed."""
    out = issues.where(F.col("risk").isin("medium", "high")).crossJoin(F.broadcast(passed.select("passed").limit(1)))
    out = out.where(~(F.col("passed") & F.col("issue_type").isin("validation_error", "test_failure"))).drop("passed")
    locks = changed_files.select(F.col("file").alias("_f")).distinct()
    lock = F.col("issue_type") == "lockfile_stale"
    return out.join(locks, lock & (F.col("file") == F.col("_f")), "left_anti")


def retained(df: DataFrame, at: str, as_of: Column, days: int = 30) -> DataFrame:
    return df.where(F.col(at) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def stale_names(df: DataFrame, name: str, at: str, patterns: Sequence[str], cutoff: Column) -> DataFrame:
    return df.where(F.rlike(F.col(name), F.lit("|".join(f"(?:{p})" for p in patterns))) & (F.col(at) <= cutoff))


def tasks(df: DataFrame, status: str = "", assignee: str = "") -> DataFrame:
    """An empty argument doesn't filter."""
    out = df.where(F.col("status") == status) if status else df
    return out.where(F.col("assignee") == assignee) if assignee else out


def unread(inbox: DataFrame, acks: DataFrame, key: str = "id") -> DataFrame:
    """Messages not read and not acknowledged."""
    return inbox.where(~F.coalesce("read", F.lit(False))).join(acks, key, "left_anti")


def broadcast_messages(messages: DataFrame, members: DataFrame) -> DataFrame:
    """Each message once per team member other than its sender; members per team join by the team."""
    return messages.join(members, "team").where(F.col("member") != F.col("sender"))


def completions(commands: DataFrame, prefix: str, n: int = 8) -> DataFrame:
    hit = F.startswith(F.col("name"), F.lit(prefix)) | F.exists("aliases", lambda a: F.startswith(a, F.lit(prefix)))
    return commands.where(hit).orderBy("name").limit(n)


def file_completions(files: DataFrame, prefix: str, n: int = 10) -> DataFrame:
    name = F.col("name")
    return files.where(F.startswith(F.lower(name), F.lit(prefix.lower())) & ~F.startswith(name, F.lit("."))).orderBy("name").limit(n)
