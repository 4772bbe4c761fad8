"""Structured Streaming forms: folds of deltas, deduplication, completion drains."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FOLD = "stream string, text string, calls string, stop_reason string, input_tokens long, output_tokens long"
#: What is held of a row until its stream ends.
PIECE = (
    "seq long, kind string, text string, call_index int, call_id string, call_name string, arguments string, "
    "stop_reason string, input_tokens long, output_tokens long"
)
_NAMES = [c.split()[0] for c in PIECE.split(", ")]
ABANDONED = "abandoned"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(stream: str | None, rows: list[tuple]) -> tuple | None:
    """The row of FOLD for a stream's PIECE rows in order of seq, or None without any. Of rows with one seq the first
    counts, and none after the first end. Text is joined; calls are put together by index: the last id and name that
    aren't empty, arguments joined, {} where they aren't a JSON object. Without an end it is an abandoned one."""
    text, calls, seen = [], {}, set()
    for seq, kind, said, index, ident, name, arguments, stop, tokens_in, tokens_out in sorted(rows, key=lambda r: r[0]):
        if seq in seen:
            continue
        seen.add(seq)
        if kind == "text":
            text.append(said or "")
        elif kind == "call":
            call = calls.setdefault(int(index or 0), {"id": "", "name": "", "arguments": []})
            call["id"], call["name"] = ident or call["id"], name or call["name"]
            call["arguments"].append(arguments or "")
        elif kind == "end":
            return _result(stream, text, calls, stop, tokens_in, tokens_out)
    return _result(stream, text, calls, ABANDONED, 0, 0) if seen else None


def _result(stream: str | None, text: list, calls: dict, stop: str | None, tokens_in, tokens_out) -> tuple:
    whole = [{**calls[k], "arguments": _object("".join(calls[k]["arguments"]))} for k in sorted(calls)]
    return stream, "".join(text), json.dumps(whole, sort_keys=True), stop, int(tokens_in or 0), int(tokens_out or 0)


def _object(text: str) -> dict:
    try:
        got = json.loads(text or "{}")
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def _pieces(pdf: pd.DataFrame) -> dict[str | None, list[tuple]]:
    """PIECE rows by stream."""
    columns = []
    for c in ("stream", *_NAMES):
        values = pdf[c].astype(object)
        columns.append([int(v) if isinstance(v, float) else v for v in values.where(values.notna(), None).tolist()])
    out: dict[str | None, list[tuple]] = {}
    for stream, *row in zip(*columns):
        out.setdefault(stream, []).append(tuple(row))
    return out


def _frame(results: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(results, columns=[c.split()[0] for c in FOLD.split(", ")])


class Deltas(StatefulProcessor):
    """Holds the pieces of a bucket's streams, each until it ends or has had no row for `idle_ms` of event time.

    A bucket is a key of the state, as a call for each stream and some for its state take longer than the fold. Pieces
    are added to and not rewritten, but when more than half of them are of streams that ended. An ended stream leaves a
    mark until it would have been abandoned, so rows that come twice don't begin it anew. Event time and not the clock
    decides (as a state's TTL would), so a rerun gives the same result."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "stream string, " + PIECE)
        # of each stream: when it is due, whether it ended, and how many pieces the list has of it
        self.marks = handle.getValueState("marks", "timer long, streams array<string>, due array<long>, ended array<boolean>, held array<long>")

    def _marks(self) -> tuple[int | None, dict[str | None, tuple[int, bool, int]]]:
        got = self.marks.get() if self.marks.exists() else None
        return (got[0], dict(zip(got[1], zip(*got[2:])))) if got else (None, {})

    def _held(self) -> dict[str | None, list[tuple]]:
        out: dict[str | None, list[tuple]] = {}
        for stream, *row in self.pieces.get():
            out.setdefault(stream, []).append(tuple(row))
        return out

    def _keep(self, was: int | None, marks: dict, held: dict | None, new: list[tuple], fired: bool = False) -> None:
        """The marks, the held pieces anew where given, then new ones; a timer for the stream that is due first."""
        if held is not None:
            live = [(s, *r) for s, rows in held.items() for r in rows] + new
            self.pieces.put(live) if live else self.pieces.clear()
        elif new:
            self.pieces.appendList(new)
        timer = min((due for due, *_ in marks.values()), default=None)
        if timer != was:
            if was is not None and not fired:
                self.handle.deleteTimer(was)
            if timer is not None:
                self.handle.registerTimer(timer)
        if marks:
            self.marks.update((timer, list(marks), *map(list, zip(*marks.values()))))
        else:
            self.marks.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh, last = {}, {}
        for pdf in rows:
            for stream, some in _pieces(pdf).items():
                fresh.setdefault(stream, []).extend(some)
            for stream, at in zip(pdf["stream"].tolist(), pdf["at_ms"].tolist()):
                last[stream] = max(at, last.get(stream, at))
        was, marks = self._marks()
        held, new, results = None, [], []
        for stream, some in fresh.items():
            due, ended, n = marks.get(stream, (0, False, 0))
            if not ended and any(r[1] == "end" for r in some):
                if n and held is None:
                    held = self._held()
                results.append(fold(stream, (held[stream] if n else []) + some))
                ended = True
            elif not ended:
                new += [(stream, *r) for r in some]
                n += len(some)
            marks[stream] = max(int(last[stream]) + self.idle_ms, due), ended, n
        dead = sum(n for _, ended, n in marks.values() if ended)
        if dead and dead * 2 > sum(n for *_, n in marks.values()):
            held = {s: r for s, r in (held if held is not None else self._held()).items() if not marks[s][1]}
            marks = {s: (due, ended, 0 if ended else n) for s, (due, ended, n) in marks.items()}
        else:
            held = None
        self._keep(was, marks, held, new)
        if results:
            yield _frame(results)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, mark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        was, marks = self._marks()
        gone = {s: m for s, m in marks.items() if m[0] <= at or m[0] < mark}
        # pieces go with their stream's mark, so one that begins anew doesn't meet them
        held = self._held() if any(n for *_, n in gone.values()) else None
        results = [fold(s, held[s]) for s, (_, ended, n) in gone.items() if n and not ended]
        marks = {s: m for s, m in marks.items() if s not in gone}
        self._keep(was, marks, None if held is None else {s: r for s, r in held.items() if s in marks}, [], was == at)
        if results:
            yield _frame(results)

    def close(self) -> None:
        pass


def folded(deltas: DataFrame, at: str, idle_ms: int = 3_600_000, delay_ms: int = 600_000, buckets: int = 1 << 10) -> DataFrame:
    """One row per stream that ended, or was abandoned: without an end, and `idle_ms` behind the watermark, which is
    `delay_ms` behind the last row of all. `deltas`: stream, PIECE and `at`, a timestamp; a table or a stream (which
    needs the RocksDB state store, see drained_fold). Both give the same rows if no stream pauses for longer than
    idle_ms + delay_ms and no row is later than delay_ms. Rows without seq or `at` are left out. Python takes the
    streams of a bucket at once; a checkpoint holds for the number of buckets that it began with."""
    rows = deltas.where(F.col("seq").isNotNull() & F.col(at).isNotNull())
    rows = rows.select("stream", *_NAMES, F.col(at).cast("timestamp").alias("at"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("stream"), F.lit(buckets)).cast("int"))
    if deltas.isStreaming:
        timed = rows.withWatermark("at", f"{delay_ms} milliseconds").withColumn("at_ms", F.unix_millis("at"))
        return timed.groupBy("bucket").transformWithStateInPandas(Deltas(idle_ms), FOLD, "append", "eventTime")

    def batch(pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame([fold(s, some) for s, some in _pieces(pdf).items()])

    rows = rows.withColumn("at_ms", F.unix_millis("at"))
    passed = rows.agg((F.max("at_ms") - delay_ms).alias("_mark"))
    ends = rows.groupBy(F.col("stream").alias("_of")).agg(F.max("at_ms").alias("_last"), F.bool_or(F.col("kind") == "end").alias("_ended"))
    done = ends.crossJoin(F.broadcast(passed)).where(F.coalesce("_ended", F.lit(False)) | (F.col("_last") + idle_ms < F.col("_mark")))
    return rows.join(done, F.col("stream").eqNullSafe(F.col("_of")), "left_semi").groupBy("bucket").applyInPandas(batch, FOLD)


def drained_fold(stream: DataFrame, at: str, output: str, checkpoint: str, idle_ms: int = 3_600_000, delay_ms: int = 600_000, buckets: int = 1 << 10) -> DataFrame:
    """folded() of everything that is there now, added to files, and all rows of these. State goes on with the next
    call. The session's state store is set for this query alone."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        writer = folded(stream, at, idle_ms, delay_ms, buckets).writeStream.format("parquet").option("path", output)
        q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, was)
    return spark.read.schema(FOLD).parquet(output)


def batch_fold(deltas: DataFrame) -> DataFrame:
    """The same for tables in expressions alone: text joined in order, calls in order of seq, the last usage."""
    rows = F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("seq", "text"))))
    ends = F.col("kind") == "end"
    return deltas.groupBy("stream").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("text"), F.max_by(F.when(ends, F.col("input_tokens")), F.when(ends, F.col("seq"))).alias("input_tokens"), F.max_by(F.when(ends, F.col("output_tokens")), F.when(ends, F.col("seq"))).alias("output_tokens"))


def deduplicated(events: DataFrame, key: list[str], at: str, horizon: str) -> DataFrame:
    """First event of each key within a horizon of event time; a batch is deduplicated whole."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp"))
    return stamped.withWatermark(at, horizon).dropDuplicatesWithinWatermark(key) if events.isStreaming else stamped.dropDuplicates(key)


def drained(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now into an in-memory table, then stop."""
    q = stream.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def drained_once(stream: DataFrame, keys: list[str], order: list[str], output: str, checkpoint: str) -> DataFrame:
    """Everything that is there now, each key once and for ever, into files by batch; gives all that they hold.

    Of a batch's rows of one key the first by `order` counts, and none if an earlier batch has the key. A batch
    overwrites its own partition and looks at those before it only. So one that is run again, as its commit was
    lost, neither repeats nor loses a key, whatever its first run had written. What is joined are the keys of all
    earlier batches, by a shuffle; null keys are keys. `stream` has no column `batch`."""
    from quern.operators.keyed import keep_first

    schema = stream.schema.add("batch", "long")
    every = lambda spark: spark.read.schema(schema).parquet(output)

    def take(rows: DataFrame, number: int) -> None:
        new = keep_first(rows, keys, order)
        if number:
            done = every(rows.sparkSession).where(F.col("batch") < number).select(*[F.col(k).alias(f"_done_{k}") for k in keys])
            same = [F.col(k).eqNullSafe(F.col(f"_done_{k}")) for k in keys]
            new = new.join(done, reduce(lambda a, b: a & b, same), "left_anti")
        new.write.mode("overwrite").parquet(f"{output}/batch={number}")

    q = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return every(stream.sparkSession)


def in_order(done: DataFrame, by: str, submitted: str) -> DataFrame:
    """Results in order of submission, whatever order they ended in."""
    return done.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(submitted, "result"))), lambda r: r["result"]).alias("results"))
