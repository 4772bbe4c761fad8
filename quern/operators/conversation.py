"""Conversation rows: protocol forms, forks, mail and notification folding, boundaries, session selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ordered import islands

INTERRUPTED = "interrupted"


#: What a summary of an earlier part of a conversation begins with.
RESUMED = "This conversation goes on from an earlier one, which was compacted. Its summary:\n\n"
KEPT = "array<struct<role:string,content:string>>"


def merged_results(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Messages (first_at, part, role, content, tool_results) of session records (type, content, tool_use_id).

    Results in a row become one user message; any other record ends the row of results, also a system record, of
    which nothing else is left. A compression record becomes a user message of its summary. So does a compaction
    boundary (as boundary() gives it), and the messages that it keeps, JSON with role and content, follow as its
    parts 1 on. A row of results is collected into one message; the longest is bounded by a turn's calls."""
    kind, result = F.col("type"), F.col("type") == "tool_result"
    runs = islands(rows, by, [order], kind, result).where(~kind.eqNullSafe("system"))
    parts = F.array_sort(F.collect_list(F.struct(order, "tool_use_id", "content")))
    out = runs.groupBy(*by, "island", "type").agg(F.min(order).alias("first_at"), F.transform(parts, lambda p: F.struct(p["tool_use_id"].alias("tool_use_id"), p["content"].alias("content"))).alias("parts"))
    text = F.col("parts")[0]["content"]
    bounds = parsed_boundary(text)
    kept = F.transform(bounds["keep"], lambda k: F.from_json(k, "role string, content string"))
    said = lambda role, content: F.array(F.struct(role.alias("role"), content.alias("content"))).cast(KEPT)
    summary = lambda c: said(F.lit("user"), F.concat(F.lit(RESUMED), F.coalesce(c, F.lit(""))))
    messages = (
        F.when(result, said(F.lit("user"), F.lit(""))).when(kind == "compression", summary(text))
        .when(kind == "compact_boundary", F.concat(summary(bounds["summary"]), F.coalesce(kept, F.array().cast(KEPT))))
        .otherwise(said(kind, F.coalesce(text, F.lit(""))))
    )
    out = out.select(*by, "first_at", F.when(result, F.col("parts")).alias("tool_results"), F.posexplode(messages).alias("part", "message"))
    return out.select(*by, "first_at", "part", "message.role", "message.content", "tool_results")


def joined_users(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """User rows that stand next to each other and are nothing but text as one, lines joined, at the first one's place:
    the first protocol of wire() wants them so."""
    some = [F.size(F.coalesce(F.col(c), F.array())) > 0 for c in ("tool_uses", "tool_results", "thinking") if c in rows.columns]
    plain = (F.col("role") == "user") & ~F.greatest(*some, F.lit(False))
    runs = islands(rows, by, [order], F.lit(1), F.coalesce(plain, F.lit(False)))
    rest = [c for c in rows.columns if c not in (*by, "content")]
    texts = F.array_sort(F.collect_list(F.struct(order, F.coalesce("content", F.lit("")).alias("content"))))
    first = F.min_by(F.struct(*rest), order).alias("first")
    out = runs.groupBy(*by, "island").agg(first, F.array_join(F.transform(texts, lambda t: t["content"]), "\n").alias("content"))
    return out.select(*by, "first.*", "content").select(*rows.columns)


def _object(*fields: Column) -> Column:
    """JSON text of an object, nulls kept."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def wire(rows: DataFrame, protocol: str) -> DataFrame:
    """part (from 0) and message, JSON text: the messages of each row (role, content, tool_uses, tool_results, and
    thinking, an array of thinking and signature, where there is such a column) in one of three protocols. Rows that
    give none are left out.

    "anthropic" has one message a row, of blocks where there are any. "openai" has an item for each thought, text, call
    and result; "openai-compat" a message for each result, calls and joined thoughts within the assistant's. A row with
    results and calls gives the results first. Arguments that aren't JSON count as {}; a null text as empty."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    text, q = F.coalesce("content", F.lit("")), F.lit
    uses, results = F.coalesce("tool_uses", F.array()), F.coalesce("tool_results", F.array())
    thoughts = F.coalesce("thinking", F.array()) if "thinking" in rows.columns else none("struct<thinking:string,signature:string>")
    given = lambda u: F.when(F.try_parse_json(u["arguments"]).isNotNull(), u["arguments"]).otherwise("{}")
    named = lambda name, value: (q(value) if isinstance(value, str) else value).alias(name)
    calls, said = F.size(uses) > 0, _object(named("role", F.col("role")), named("content", text))
    only_results = (F.size(results) > 0) & ~calls
    when = lambda test, *items: F.when(test, F.array(*items)).otherwise(none("string"))
    if protocol == "anthropic":
        thought = F.transform(thoughts, lambda t: _object(named("type", "thinking"), t["thinking"].alias("thinking"), t["signature"].alias("signature")))
        written = when(text != "", _object(named("type", "text"), named("text", text)))
        use = F.transform(uses, lambda u: F.concat(q('{"type":"tool_use",'), F.substring(_object(u["tool_use_id"].alias("id"), u["tool_name"].alias("name")), 2, 1 << 30)))
        use = F.zip_with(use, uses, lambda head, u: F.concat(F.regexp_replace(head, r"\}\z", ""), q(',"input":'), given(u), q("}")))
        back = F.transform(results, lambda r: _object(named("type", "tool_result"), r["tool_use_id"].alias("tool_use_id"), r["content"].alias("content"), r["is_error"].alias("is_error")))
        blocks = lambda role, parts: F.concat(q(f'{{"role":"{role}","content":['), F.array_join(parts, ","), q("]}"))
        own = calls | (F.size(thoughts) > 0)
        messages = F.concat(
            when(F.size(results) > 0, blocks("user", back)), when(own, blocks("assistant", F.concat(thought, written, use))), when(~own & ~only_results, said)
        )
    elif protocol == "openai":
        summary = lambda t: F.array(F.struct(named("type", "summary_text"), t["thinking"].alias("text")))
        thought = F.transform(thoughts, lambda t: _object(named("type", "reasoning"), t["signature"].alias("id"), summary(t).alias("summary")))
        use = F.transform(uses, lambda u: _object(named("type", "function_call"), u["tool_name"].alias("name"), u["tool_use_id"].alias("call_id"), given(u).alias("arguments")))
        back = F.transform(results, lambda r: _object(named("type", "function_call_output"), r["tool_use_id"].alias("call_id"), r["content"].alias("output")))
        spoken = _object(named("role", "assistant"), named("content", text))
        kept = F.when(only_results, none("string")).otherwise(thought)
        messages = F.concat(back, kept, when(calls & (text != ""), spoken), use, when(~calls & ~only_results, said))
    elif protocol == "openai-compat":
        whole = F.array_join(F.transform(thoughts, lambda t: t["thinking"]), "")
        named_call = lambda u: F.struct(u["tool_name"].alias("name"), given(u).alias("arguments"))
        call = F.transform(uses, lambda u: F.struct(u["tool_use_id"].alias("id"), named("type", "function"), named_call(u).alias("function")))
        back = F.transform(results, lambda r: _object(named("role", "tool"), r["tool_use_id"].alias("tool_call_id"), r["content"].alias("content")))
        asks = [named("role", "assistant"), F.nullif(text, q("")).alias("content"), call.alias("tool_calls")]
        plain = [named("role", F.col("role")), named("content", text)]
        either = lambda fields: F.when(whole != "", _object(*fields, whole.alias("reasoning_content"))).otherwise(_object(*fields))
        messages = F.concat(back, when(calls, either(asks)), when(~calls & ~only_results, either(plain)))
    else:
        raise ValueError(f"unknown protocol {protocol}")
    return rows.select("*", F.posexplode(messages).alias("part", "message"))


def forked(rows: DataFrame, by: Sequence[str], order: str, mark: str) -> DataFrame:
    """Rows (role, content, tool_uses, tool_results) with a user row of interrupted results for the last assistant
    row's uses that have none. A conversation that holds the fork's mark can't be forked again."""
    if rows.where(F.contains("content", F.lit(mark))).limit(1).count():
        raise ValueError("a fork can't be forked")
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))).where((F.col("_r") == 1) & (F.col("role") == "assistant")).drop("_r")
    done = F.transform(F.coalesce("tool_results", F.array().cast("array<struct<tool_use_id:string,content:string,is_error:boolean>>")), lambda r: r["tool_use_id"])
    open_uses = F.filter("tool_uses", lambda u: ~F.array_contains(done, u["tool_use_id"]))
    given = F.transform(open_uses, lambda u: F.struct(u["tool_use_id"].alias("tool_use_id"), F.lit(INTERRUPTED).alias("content"), F.lit(False).alias("is_error")))
    extra = last.where(F.size(open_uses) > 0).select(*[c for c in (*by,)], (F.col(order) + 1).alias(order), F.lit("user").alias("role"), F.lit("").alias("content"), F.lit(None).cast(dict(rows.dtypes)["tool_uses"]).alias("tool_uses"), given.alias("tool_results"))
    return rows.select(*extra.columns).unionByName(extra)


def next_prompt(mail: DataFrame, by: Sequence[str], order: str, is_shutdown: Column) -> DataFrame:
    """prompt and shutdown per batch: one shutdown request empties the whole batch, else messages are joined."""
    line = F.concat(F.lit("From "), F.col("from_agent"), F.lit(": "), F.col("content"))
    parts = F.array_sort(F.collect_list(F.struct(order, line.alias("line"))))
    out = mail.groupBy(*by).agg(F.bool_or(is_shutdown).alias("shutdown"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("prompt"))
    return out.withColumn("prompt", F.when(F.col("shutdown"), "").otherwise(F.col("prompt")))


def notifications(mail: DataFrame, team: str, order: str, text: str) -> DataFrame:
    """One text per team, in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return mail.groupBy(team).agg(F.array_join(F.transform(parts, lambda p: p[text]), "\n\n").alias("notice"), F.count("*").alias("n_messages"))


def boundary(summary: Column, keep: Column, tokens: Column) -> Column:
    return F.to_json(F.struct(F.lit("compact_boundary").alias("kind"), summary.alias("summary"), keep.alias("keep"), tokens.alias("tokens")))


def parsed_boundary(text: Column) -> Column:
    """Struct of summary, keep and tokens; null for what isn't a boundary."""
    got = F.from_json(text, "kind string, summary string, keep array<string>, tokens long")
    return F.when(got["kind"] == "compact_boundary", F.struct(F.coalesce(got["summary"], F.lit("")).alias("summary"), F.coalesce(got["keep"], F.array().cast("array<string>")).alias("keep"), F.coalesce(got["tokens"], F.lit(0)).alias("tokens")))


def since(rows: DataFrame, at: str, offset: int) -> DataFrame:
    """Rows not seen before: those from a place on."""
    return rows.where(F.col(at) >= offset)


def changed_since(sessions: DataFrame, at: str, since_ms: int) -> DataFrame:
    return sessions.where(F.unix_millis(F.col(at).cast("timestamp")) > since_ms)


def due(sessions: DataFrame, at: str, last_run_ms: int, last_try_ms: int, now_ms: int, hours: int = 24, least: int = 5, throttle_min: int = 10) -> DataFrame:
    """One row, due: a run is `hours` back, the last try `throttle_min` minutes, and enough sessions are new."""
    late = now_ms - last_run_ms >= hours * 3_600_000 and now_ms - last_try_ms >= throttle_min * 60_000
    return changed_since(sessions, at, last_run_ms).agg((F.lit(late) & (F.count("*") >= least)).alias("due"))


def snapshot(fields: Sequence[str]) -> Column:
    return F.to_json(F.struct(*fields))


def restored(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)
