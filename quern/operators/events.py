"""Hash-chained event logs: verification, repair, append, replay, commits, checkpoints."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Types of results that an idempotency key commits.
COMMITTED = ("tool_succeeded", "tool_failed")
EVENT = "sequence long, event_type string, timestamp_ns long, trace_id string, tool_call_id string, idempotency_key string, payload string, prev_hash string, event_hash string, version int"


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces and characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def hash_of(raw: dict) -> str:
    return hashlib.sha256(canonical(raw).encode()).hexdigest()


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Canonical form of JSON texts; null for what isn't JSON."""

    def one(t):
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return None

    return text.map(one)


@F.pandas_udf(StringType())
def own_hash(line: pd.Series) -> pd.Series:
    """The hash that a log line should carry: of all its fields but event_hash. Null for what isn't an object."""

    def one(t):
        try:
            raw = json.loads(t)
            raw.pop("event_hash", None)
            return hash_of(raw)
        except (ValueError, AttributeError, TypeError):
            return None

    return line.map(one)


def repaired(lines: DataFrame, journal: str = "journal") -> DataFrame:
    """Without a last line that has no line end and isn't JSON. lines: journal, line_no, line, terminated; only a
    journal's last line can be one that isn't terminated, so no journal is gathered to find it."""
    return lines.where(F.col("terminated") | F.try_parse_json("line").isNotNull())


def parsed(lines: DataFrame, journal: str = "journal") -> DataFrame:
    """Events of log lines, with absent fields as defaults."""
    g = lambda k: F.get_json_object("line", f"$.{k}")
    text = lambda k: F.coalesce(g(k), F.lit("")).alias(k)
    return lines.select(journal, "line_no", "line", g("sequence").try_cast("long").alias("sequence"), g("event_type").alias("event_type"), g("timestamp_ns").try_cast("long").alias("timestamp_ns"), text("trace_id"), text("tool_call_id"), text("idempotency_key"), F.coalesce(g("payload"), F.lit("{}")).alias("payload"), text("prev_hash"), text("event_hash"), F.coalesce(g("version").try_cast("int"), F.lit(1)).alias("version"))


def verified(lines: DataFrame, journal: str = "journal") -> DataFrame:
    """Events with `fault`: null, or what is wrong first: invalid event, invalid sequence, broken hash chain or
    event hash mismatch. A line is tested against the line before it, which may be in another block, so a journal
    of any length is tested in parallel."""
    from quern.operators.scan import Scan

    rows = Scan(parsed(lines, journal).withColumn("_own", own_hash("line")).drop("line"), [journal], ["line_no"])
    rows = rows.sum(F.lit(1), "_n").lag(F.col("event_hash"), "_before", "").rows()
    fault = (
        F.when(F.col("_own").isNull(), "invalid event").when(F.coalesce(F.col("sequence") != F.col("_n"), F.lit(True)), "invalid sequence")
        .when(F.col("prev_hash") != F.col("_before"), "broken hash chain").when((F.col("event_hash") == "") | (F.col("event_hash") != F.col("_own")), "event hash mismatch")
    )
    return rows.withColumn("fault", fault).drop("_n", "_before", "_own")


class IntegrityError(ValueError):
    pass


def intact(lines: DataFrame, journal: str = "journal") -> DataFrame:
    """The events, or an error that names the first fault."""
    events = verified(lines, journal)
    if bad := events.where("fault is not null").orderBy(journal, "line_no").limit(1).collect():
        raise IntegrityError(f"{bad[0]['fault']} at line {bad[0]['line_no']} of {bad[0][journal]}")
    return events.drop("fault")


def links(events: DataFrame, by: str, order: str, digest: Column) -> DataFrame:
    """Each event's digest beside that of the one before ('' for the first)."""
    w = Window.partitionBy(by).orderBy(order)
    return events.withColumn("event_hash", digest).withColumn("prev_hash", F.lag("event_hash", 1, "").over(w)).withColumn("sequence", F.row_number().over(w))


def externalized(events: DataFrame, limit: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(events, blobs): outputs of results over `limit` characters make way for sha256, chars and bytes; blobs
    have each such text once."""
    out = F.get_json_object("payload", "$.output")
    large = F.col("event_type").isin(*COMMITTED) & (F.coalesce(F.length(out), F.lit(0)) > limit)
    rows = events.withColumn("_out", F.when(large, out))
    blob = F.struct(F.sha2("_out", 256).alias("sha256"), F.length("_out").alias("chars"), F.octet_length("_out").alias("bytes"))
    kept = F.map_filter(F.from_json("payload", "map<string,string>"), lambda k, v: k != "output")
    small = F.when(F.col("_out").isNull(), F.col("payload")).otherwise(F.to_json(F.map_concat(kept, F.create_map(F.lit("output_blob"), F.to_json(blob)))))
    blobs = rows.where("_out is not null").select(F.sha2("_out", 256).alias("sha256"), F.col("_out").alias("text")).groupBy("sha256").agg(F.first("text").alias("text"))
    return rows.withColumn("payload", small).drop("_out"), blobs


def appended(new: DataFrame, heads: DataFrame, journal: str = "journal", order: str = "n") -> DataFrame:
    """Log lines of new events after each journal's head (journal, sequence, event_hash): numbered, linked and
    hashed. A hash needs the one before, so a journal is one group and its events come in order."""

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        seq = int(pdf["_seq"].iloc[0]) if pd.notna(pdf["_seq"].iloc[0]) else 0
        prev = pdf["_hash"].iloc[0] if isinstance(pdf["_hash"].iloc[0], str) else ""
        lines = []
        for r in pdf.itertuples(index=False):
            seq += 1
            text = lambda v: v if isinstance(v, str) else ""
            raw = {"sequence": seq, "event_type": r.event_type, "timestamp_ns": int(r.timestamp_ns), "trace_id": text(r.trace_id), "tool_call_id": text(r.tool_call_id), "idempotency_key": text(r.idempotency_key), "payload": json.loads(text(r.payload) or "{}"), "prev_hash": prev, "version": 1}
            prev = raw["event_hash"] = hash_of(raw)
            lines.append((key[0], seq, canonical(raw)))
        return pd.DataFrame(lines, columns=[journal, "line_no", "line"])

    h = heads.select(F.col(journal).alias("_j"), F.col("sequence").alias("_seq"), F.col("event_hash").alias("_hash"))
    kind = dict(new.dtypes)[journal]
    rows = new.join(h, F.col(journal) == F.col("_j"), "left").drop("_j").withColumnsRenamed({"_seq": "_seq", "_hash": "_hash"})
    # names that start with an underscore don't survive itertuples, so only others are read there
    return rows.groupBy(journal).applyInPandas(chain, f"{journal} {kind}, line_no long, line string")


def heads(events: DataFrame, journal: str = "journal") -> DataFrame:
    return events.groupBy(journal).agg(F.max("sequence").alias("sequence"), F.max_by("event_hash", "sequence").alias("event_hash"))


def replayed(events: DataFrame, by: str, order: str, zero: Column, step: Callable[[Column, Column], Column], fields: list[str], name: str = "state") -> DataFrame:
    """Per group the fold of its events in order; `step` is an expression, so no Python runs."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    return events.groupBy(by).agg(F.aggregate(rows, zero, step).alias(name))


def reduced(events: DataFrame, by: str, order: str, reducer: Callable, initial: object, schema: str) -> DataFrame:
    """Per group the fold by a Python reducer(state, row) -> state; `schema` names the state's column."""
    column = schema.split()[0]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state = initial
        for row in pdf.sort_values(order).to_dict("records"):
            state = reducer(state, row)
        return pd.DataFrame({by: [key[0]], column: [state]})

    return events.groupBy(by).applyInPandas(run, f"{by} {dict(events.dtypes)[by]}, {schema}")


def committed(events: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last result per idempotency key that isn't empty."""
    hit = events.where(F.col("event_type").isin(*COMMITTED) & (F.col("idempotency_key") != ""))
    return hit.groupBy(*by, "idempotency_key").agg(F.max_by("payload", order).alias("payload"), F.max(order).alias(order), F.max_by("event_type", order).alias("event_type"))


def resolved(results: DataFrame, blobs: DataFrame) -> DataFrame:
    """Results with output: inline, or their blob's text; a missing or altered blob shows as fault."""
    digest = F.get_json_object(F.get_json_object("payload", "$.output_blob"), "$.sha256")
    b = blobs.select(F.col("sha256").alias("_sha"), F.col("text").alias("_text"))
    out = results.withColumn("_want", digest).join(b, F.col("_want") == F.col("_sha"), "left")
    fault = F.when(F.col("_want").isNotNull() & F.col("_sha").isNull(), "missing blob").when(F.col("_want") != F.sha2("_text", 256), "blob hash mismatch")
    return out.withColumn("output", F.coalesce("_text", F.get_json_object("payload", "$.output"))).withColumn("fault", fault).drop("_want", "_sha", "_text")


def effectively_once(requests: DataFrame, done: DataFrame, key: str, order: str) -> DataFrame:
    """outcome per request: deduplicated if its key was done before or came earlier in the batch, else run."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    d = done.select(F.col(key).alias("_k")).distinct()
    out = requests.withColumn("_first", first | (F.coalesce(F.col(key), F.lit("")) == "")).join(d, F.col(key) == F.col("_k"), "left")
    return out.withColumn("outcome", F.when(F.col("_k").isNull() & F.col("_first"), "run").otherwise("deduplicated")).drop("_first", "_k")


def checkpoint(state: dict, head: dict, now_ns: int | None = None) -> dict:
    return {"version": 1, "sequence": head.get("sequence", 0), "event_hash": head.get("event_hash", ""), "created_at_ns": now_ns if now_ns is not None else time.time_ns(), "state": state, "state_hash": hash_of(state)}


def checked(checkpoints: DataFrame, events: DataFrame, journal: str = "journal") -> DataFrame:
    """fault per checkpoint (journal, sequence, event_hash, state, state_hash): null if it fits its journal and
    its own hash."""
    e = events.select(F.col(journal).alias("_j"), F.col("sequence").alias("_s"), F.col("event_hash").alias("_h"))
    out = checkpoints.join(e, (F.col(journal) == F.col("_j")) & (F.col("sequence") == F.col("_s")), "left")
    fault = (
        F.when((F.col("sequence") == 0) & (F.coalesce("event_hash", F.lit("")) != ""), "empty checkpoint has an event hash")
        .when((F.col("sequence") != 0) & ~F.coalesce(F.col("_h") == F.col("event_hash"), F.lit(False)), "checkpoint does not match the journal history")
        .when(F.schema_of_variant(F.try_parse_json("state")).isNull() | ~F.startswith(F.ltrim("state"), F.lit("{")), "checkpoint state must be an object")
        .when(F.sha2(canonical_json("state"), 256) != F.col("state_hash"), "checkpoint state hash mismatch")
    )
    return out.withColumn("fault", fault).drop("_j", "_s", "_h")


def read_lines(spark, path: str, journal: Column | None = None) -> DataFrame:
    """journal (by default the file's name), line_no, line and terminated of log files; a line ends at a line feed, a
    carriage return before it goes; bytes that are no UTF-8 become the replacement character.

    Spark reads a file in as many ranges as it plans, and a line belongs to the range in which it starts. Here a line's
    place is counted within its range, and one row a range, of a path and some numbers, says how many lines come before.
    Only a file's last line can lack its end; it does if its lines with all their ends would be one byte too long."""
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        (F.col("_metadata.file_name") if journal is None else journal).alias("journal"), meta["file_path"].alias("_path"), meta["file_block_start"].alias("_from"),
        meta["file_size"].alias("_size"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_id"),
    )
    length = F.octet_length("line").cast("long") + 1
    ranges = lines.groupBy("_path", "_from").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.sum(length).alias("_bytes"), F.max("_size").alias("_size"))
    file = Window.partitionBy("_path")
    before = F.coalesce(F.sum("_n").over(file.orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    half = F.sum("_bytes").over(file) > F.col("_size")
    ranges = ranges.select("_path", "_from", "_first", before.alias("_before"), F.when(half, F.sum("_n").over(file)).alias("_half"))
    line_no = F.col("_id") - F.col("_first") + F.col("_before") + 1
    out = lines.drop("_size").join(ranges, ["_path", "_from"])
    return out.select("journal", line_no.alias("line_no"), F.regexp_replace(F.make_valid_utf8("line"), r"\r\z", "").alias("line"), (~line_no.eqNullSafe(F.col("_half"))).alias("terminated"))


def packed(lines: DataFrame, journal: str = "journal") -> DataFrame:
    """Lines (journal, line_no, line) as `value`, for text files that hold many journals each: as many files as tasks,
    not as journals. A journal's name, without tabs or line ends, and a tab lead each of its lines; a journal is in one
    file and in order."""
    rows = lines.repartition(journal).sortWithinPartitions(journal, "line_no")
    return rows.select(F.concat(F.col(journal).cast("string"), F.lit("\t"), "line").alias("value"))


def unpacked(lines: DataFrame) -> DataFrame:
    """read_lines() of such files: each line with the journal that leads it and its place there."""
    parts = F.split("line", "\t", 2)
    rows = lines.select(parts[0].alias("journal"), "line_no", F.try_element_at(parts, F.lit(2)).alias("line"), "terminated")
    starts = rows.groupBy("journal").agg(F.min("line_no").alias("_first"))
    return rows.join(starts, "journal").select("journal", (F.col("line_no") - F.col("_first") + 1).alias("line_no"), "line", "terminated")
