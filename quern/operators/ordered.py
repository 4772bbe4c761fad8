"""Operators over ordered rows. Each takes the partition columns `by` and a unique ordering `order`."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Names = Sequence[str]


def _w(by: Names, order: Sequence) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def _desc(order: Names) -> list[Column]:
    return [F.col(c).desc() for c in order]


def upto_here(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before_here(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def keep_tail(df: DataFrame, by: Names, order: Names, cost: Column, min_cost: int = 10_000, min_rows: int = 5, max_cost: int = 40_000) -> DataFrame:
    """The last rows: from the end, until the cost reaches min_cost or the rows min_rows, whichever is first,
    and never beyond max_cost but for the very last row."""
    back = _w(by, _desc(order))
    out = df.withColumn("_cost", cost).withColumn("_r", F.row_number().over(back)).withColumn("_c", F.sum("_cost").over(upto_here(back)))
    keep = (F.col("_r") == 1) | ((F.col("_c") - F.col("_cost") < min_cost) & (F.col("_r") <= min_rows) & (F.col("_c") <= max_cost))
    return out.where(keep).drop("_cost", "_r", "_c")


def turn_groups(df: DataFrame, by: Names, order: Names, closes: Column) -> DataFrame:
    """group_no: how many closing rows come before."""
    return df.withColumn("group_no", F.coalesce(F.sum(closes.cast("long")).over(before_here(_w(by, order))), F.lit(0)).cast("long"))


def drop_oldest(df: DataFrame, by: Names) -> DataFrame:
    """Without the oldest fifth of the turn groups, one at least. Needs group_no."""
    n = F.max("group_no").over(Window.partitionBy(*by)) + 1
    return df.withColumn("_n", n).where(F.col("group_no") >= F.greatest(F.lit(1), F.floor(F.col("_n") / 5))).drop("_n")


def islands(df: DataFrame, by: Names, order: Names, key: Column, joins: Column) -> DataFrame:
    """island: number, from 1, of the run of rows with equal key that join; other rows stand alone."""
    w = _w(by, order)
    out = df.withColumn("_k", key).withColumn("_j", joins)
    goes_on = F.col("_j") & F.lag("_j", 1, False).over(w) & F.col("_k").eqNullSafe(F.lag("_k").over(w))
    out = out.withColumn("_new", F.when(goes_on, 0).otherwise(1))
    return out.withColumn("island", F.sum("_new").over(upto_here(w)).cast("long")).drop("_k", "_j", "_new")


def merge_runs(df: DataFrame, by: Names, order: Names, key: str, text: str, joins: Column | None = None, glue: str = "\n") -> DataFrame:
    """One row per run of equal key: first place, key, number of rows, and the texts joined in order."""
    runs = islands(df, by, order, F.col(key), joins if joins is not None else F.lit(True))
    parts = F.array_sort(F.collect_list(F.struct(*order, text)))
    return runs.groupBy(*by, "island", key).agg(F.min(order[0]).alias("first_at"), F.count("*").alias("n_rows"), F.array_join(F.transform(parts, lambda p: p[text]), glue).alias("merged"))


def from_last(df: DataFrame, by: Names, order: Names, boundary: Column) -> DataFrame:
    """Rows from the last boundary row on; all rows where there is none."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(_w(by, order))
    out = df.withColumn("_at", place).withColumn("_b", boundary)
    return out.withColumn("_last", F.max(F.when(F.col("_b"), F.col("_at"))).over(w)).where(F.col("_last").isNull() | (F.col("_at") >= F.col("_last"))).drop("_at", "_b", "_last")


def valid_prefix(df: DataFrame, by: Names, order: Names, use_ids: str, result_id: str) -> DataFrame:
    """Per group, n_valid: rows up to the last one after which no use is without its result.

    use_ids is an array of ids that a row opens, result_id the id that it closes; both may be null. A result
    before its use closes nothing and an id that is open can't be opened again, so per id a row changes the
    number of open ids only where it differs from what the id's last row did."""
    w = _w(by, order)
    rows = df.withColumn("_at", F.row_number().over(w))
    opened = rows.select(*by, "_at", F.explode(F.array_distinct(F.filter(use_ids, lambda x: x.isNotNull() & (x != "")))).alias("_id"), F.lit(0).alias("_k"), F.lit(True).alias("_use"))
    closed = rows.where(F.col(result_id).isNotNull() & (F.col(result_id) != "")).select(*by, "_at", F.col(result_id).alias("_id"), F.lit(1).alias("_k"), F.lit(False).alias("_use"))
    of_id = Window.partitionBy(*by, "_id").orderBy("_at", "_k")
    steps = opened.unionByName(closed).withColumn("_d", F.col("_use").cast("int") - F.lag("_use", 1, False).over(of_id).cast("int"))
    per_row = steps.groupBy(*by, "_at").agg(F.sum("_d").alias("_d"))
    joined = rows.select(*by, "_at").join(per_row, [*by, "_at"], "left")
    pending = F.sum(F.coalesce("_d", F.lit(0))).over(upto_here(Window.partitionBy(*by).orderBy("_at")))
    return joined.withColumn("_p", pending).groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("_p") == 0, F.col("_at"))), F.lit(0)).cast("long").alias("n_valid"))


def spill_budget(
    df: DataFrame, by: Names, ident: str, text: str, one: int = 50_000, total: int = 200_000,
    preview: Column | None = None, exempt: Column | None = None, fixed: Column | None = None,
) -> DataFrame:
    """spilled: whether a row's text makes way for its preview, whose length `preview` gives.

    Texts of over `one` characters do. If what is left in the group still is over `total`, the longest of the
    others follow, one after the other (ties by `ident`, which is unique in its group), until it isn't. `exempt`
    rows never do; `fixed` rows were decided before: they count, with their text, but aren't looked at. Only
    lengths are dealt and sorted, in blocks; texts stay where they are."""
    from quern.operators.scan import Scan

    length, no = F.length(text).cast("long"), F.lit(False)
    out = df.select(
        *by, ident, length.alias("_len"), (preview if preview is not None else F.least(length, F.lit(2000))).cast("long").alias("_pre"),
        (F.coalesce(exempt, no) if exempt is not None else no).alias("_exempt"), (F.coalesce(fixed, no) if fixed is not None else no).alias("_fixed"),
    )
    big = (F.col("_len") > one) & ~F.col("_fixed")
    first, can = big & ~F.col("_exempt"), ~big & ~F.col("_exempt") & ~F.col("_fixed")
    out = out.select(*by, ident, "_len", F.coalesce(first, no).alias("_first"), F.coalesce(can, no).alias("_can"), F.when(first, F.col("_pre")).otherwise(F.col("_len")).alias("_now"), F.when(can, F.col("_len") - F.col("_pre")).otherwise(0).alias("_save"))
    scan = Scan(out, by, [F.col("_can").desc(), F.col("_len").desc(), F.col(ident)])
    # a preview can be longer than its text, so what has been saved may fall; once under, it stays so
    scan = scan.sum(F.col("_now"), "_upto", total="_sum").sum(F.col("_save"), "_saved", before=True).max(F.col("_saved"), "_best")
    later = F.col("_can") & (F.col("_sum") - F.greatest("_best", F.lit(0)) > total)
    decided = scan.rows().select(*[F.col(c).alias(f"_of_{c}") for c in (*by, ident)], (F.col("_first") | later).alias("spilled"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*by, ident)]
    return df.join(decided, reduce(lambda x, y: x & y, same)).drop(*[f"_of_{c}" for c in (*by, ident)])


def sticky(df: DataFrame, decided: DataFrame, ident: str, text: str) -> DataFrame:
    """Rows whose id was decided before get the replacement of then (null: none); `known` tells them apart."""
    d = decided.select(F.col(ident).alias("_id"), F.col("replacement").alias("_r"), F.lit(True).alias("_known"))
    out = df.join(d, F.col(ident) == F.col("_id"), "left")
    return out.withColumn(text, F.coalesce("_r", text)).withColumn("known", F.coalesce("_known", F.lit(False))).drop("_id", "_r", "_known")


def prefix_budget(df: DataFrame, by: Names, order: Sequence, cost: Column, budget: int) -> DataFrame:
    """The first rows as long as their summed (positive) costs stay within the budget. All columns are dealt into
    blocks once; pass those that are needed."""
    from quern.operators.scan import Scan

    return Scan(df, by, order).sum(cost, "used").rows().where(F.col("used") <= budget)


def latest(df: DataFrame, by: Names, order: Names, n: int) -> DataFrame:
    """The last n rows of each group, with rank 1 for the last."""
    return df.withColumn("rank", F.row_number().over(_w(by, _desc(order)))).where(F.col("rank") <= n)


def latest_per_key(df: DataFrame, by: Names, key: str, order: Names, n: int) -> DataFrame:
    """The last row of each key, and of those the last n of a group."""
    last = latest(df, [*by, key], order, 1).drop("rank")
    return latest(last, by, order, n)


def versions(df: DataFrame, by: Names, order: Names) -> DataFrame:
    """version: the n-th row of its group."""
    return df.withColumn("version", F.row_number().over(_w(by, order)))


def breaker(df: DataFrame, by: Names, order: Names, success: Column, opens_at: int = 3) -> DataFrame:
    """failures: how many in a row end here; is_open: whether they are opens_at or more. The failures so far, less
    those that there were at the last success. All columns are dealt into blocks once; pass those that are needed."""
    from quern.operators.scan import Scan

    out = df.withColumn("_ok", F.coalesce(success, F.lit(False)))
    scan = Scan(out, by, order).sum((~F.col("_ok")).cast("long"), "_all").max(F.when(F.col("_ok"), F.col("_all")), "_before")
    out = scan.rows().withColumn("failures", F.col("_all") - F.coalesce("_before", F.lit(0)))
    return out.withColumn("is_open", F.col("failures") >= opens_at).drop("_ok", "_all", "_before")


def compaction_gate(tokens: Column, window: Column, failures: Column, opens_at: int = 3, reserve: int = 20_000, soft: int = 13_000, hard: int = 3_000) -> Column:
    """Whether to compact: from the hard threshold on always, from the soft one unless the breaker is open."""
    room = window - reserve
    return F.when(tokens >= room - hard, F.lit(True)).when(failures >= opens_at, F.lit(False)).otherwise(tokens >= room - soft)


def accepted_intervals(df: DataFrame, by: Names, start: str, stop: str) -> DataFrame:
    """accepted: in order of (start, stop), whether an interval starts no earlier than the last accepted one ends.

    What is accepted depends on what was before, so a group's intervals are folded as one sorted array; a
    group is one file's edits."""
    sorted_spans = F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(stop).alias("e"))))
    zero = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<struct<s:bigint,e:bigint,ok:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s, e = x["s"].cast("long"), x["e"].cast("long")
        ok = s >= acc["end"]
        return F.struct(F.when(ok, e).otherwise(acc["end"]).alias("end"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), ok.alias("ok")))).alias("out"))

    grouped = df.groupBy(*by).agg(F.aggregate(sorted_spans, zero, step)["out"].alias("o"))
    return grouped.select(*by, F.inline("o")).toDF(*by, start, stop, "accepted")


def aligned_start(df: DataFrame, by: Names, order: Names, start: Column, role: str, has_results: Column, has_uses: Column) -> DataFrame:
    """start_at per group, moved back while it is a user row with results that follows an assistant row with
    uses; `start` is the 0-based place where keeping would begin."""
    w = _w(by, order)
    rows = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_start", start)
    answer = (F.col(role) == "user") & has_results
    rows = rows.withColumn("_asks", (F.col(role) == "assistant") & has_uses)
    rows = rows.withColumn("_moves", answer & F.lag("_asks", 1, False).over(w) & (F.col("_at") > 0))
    hit = F.max(F.when((F.col("_at") == F.col("_start")) & F.col("_moves"), 1).otherwise(0))
    # the row before is an assistant's, so the start moves once at most
    return rows.groupBy(*by).agg((F.max("_start") - hit).cast("long").alias("start_at"))


def mark_last(df: DataFrame, by: Names, order: Names, which: Column) -> DataFrame:
    """is_last: the last row of each group for which `which` holds."""
    w = Window.partitionBy(*by, "_which").orderBy(*_desc(order))
    out = df.withColumn("_which", F.coalesce(which, F.lit(False)))
    return out.withColumn("is_last", F.col("_which") & (F.row_number().over(w) == 1)).drop("_which")
