"""Daily usage of agents from a growing folder of event files, as a stream that takes only what is new.

    python -m jobs.event_usage --config jobs/event_usage.json --events PATH --output PATH --checkpoint PATH

Each run takes the event files that its checkpoint hasn't seen, in batches of `files_per_batch` files, and ends.

  ledger  the events as they came, in partitions of day and batch
  usage   one row for each day and user, in partitions of day: events, calls, tokens, amount, the longest row
          of failures and whether it opened the circuit breaker

A batch overwrites its own partitions of the ledger, then the days that it has events of, each computed from all of the
ledger's events of that day. So late events and events delivered twice count rightly (an event is known by day and
id; the least in order of time and content counts), and a batch that ran half is run again with the same result.
Events without a time have the day null.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.operators import keyed as K
from quern.operators import ordered as O
from quern.operators import rollup as R
from quern.operators.staging import drop_staged

LOG = logging.getLogger("quern.jobs.event_usage")
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LEDGER = EVENT + ", day date, batch long"
#: Name of the partition of rows without a day, as Spark writes it.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
USAGE = "user_id long, events long, tool_calls long, last_event long, input_tokens long, cents long, longest_failure long, breaker_opened boolean, day date"


def usage(events: DataFrame, config: dict) -> DataFrame:
    """day, user_id and what the user's events of the day come to. events: each once."""
    failed = F.coalesce(F.col("event_type").isin(*config["failed_types"]), F.lit(False))
    rows = events.select(
        "day", "user_id", "event_id", failed.alias("failed"), F.struct("day", "user_id").alias("run"), F.coalesce(F.col("event_type").isin(*config["call_types"]), F.lit(False)).alias("call"),
        F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0)).alias("k"), F.coalesce(F.round(F.col("value") * 100).cast("long"), F.lit(0)).alias("cents"),
    )
    sums = R.usage(rows, "run", "event_id", F.col("call"), "k", "cents").withColumnsRenamed({"turns": "last_event", "output_tokens": "cents"})
    # a user with most of a day's events spreads over blocks
    breaker = O.breaker(rows.select("run", "event_id", "failed"), ["run"], ["event_id"], ~F.col("failed"), config["opens_at"])
    streaks = breaker.groupBy("run").agg(F.count("*").alias("events"), F.max("failures").alias("longest_failure"), F.bool_or("is_open").alias("breaker_opened"))
    return sums.join(streaks, "run").select("run.user_id", "events", "tool_calls", "last_event", "input_tokens", "cents", "longest_failure", "breaker_opened", "run.day")


def run(spark: SparkSession, events: str, output: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Batches, events and days that this run took. `events` is a folder of Parquet files, or one such file."""
    counts = {"batches": 0, "events": 0, "days": 0}

    def take(batch: DataFrame, number: int) -> None:
        session, read, ledger = batch.sparkSession, Observation("read"), f"{output}/ledger"
        rows = batch.withColumn("day", F.to_date("ts")).withColumn("batch", F.lit(number)).observe(read, F.count("*").alias("rows"), F.collect_set(F.coalesce(F.col("day").cast("string"), F.lit(NO_DAY))).alias("days"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(ledger)
        n, days = read.get["rows"], read.get["days"]
        LOG.info("batch %d: read %d events from %s, wrote them to %s", number, n, events, ledger)
        counts["batches"], counts["events"] = counts["batches"] + 1, counts["events"] + n
        if not n:
            return
        # the calendar days of one batch are few; their folders alone are listed, read and overwritten
        held = session.read.schema(LEDGER).option("basePath", ledger).parquet(*[f"{ledger}/day={d}" for d in sorted(days)])
        once = K.keep_first(held.drop("batch"), ["day", "event_id"], [F.col("ts"), "user_id", "event_type", "value", "props"])
        wrote = Observation("wrote")
        rows = usage(once, config).observe(wrote, F.count("*").alias("rows"))
        rows.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{output}/usage")
        drop_staged(rows)
        counts["days"] += len(days)
        LOG.info("batch %d: wrote %d rows of %d days to %s/usage", number, wrote.get["rows"], len(days), output)

    # as a pattern that only this path meets, since a file stream takes one file by a pattern only
    path = events.rstrip("/")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(f"{path[:-1]}[{path[-1]}]")
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("took %(batches)d batches, %(events)d events, %(days)d days", counts)
    return counts


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("config", "events", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("event_usage").getOrCreate()
    try:
        config = json.loads(spark.read.text(args.config, wholetext=True).first()["value"])
        run(spark, args.events, args.output, args.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
