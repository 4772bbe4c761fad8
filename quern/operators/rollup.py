"""Run derivation, grouped roll-ups and comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ("successful_projects", "scanned_files", "deterministic_changes", "semantic_changes", "changed_files", "open_issues", "high_risk_issues", "detected_targets", "cleared_targets", "validation_runs", "validation_passed", "input_tokens", "output_tokens")


def percent(part: Column, whole: Column, empty: float) -> Column:
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), 2), F.lit(empty))


def derive_runs(results: DataFrame) -> DataFrame:
    """Benchmark runs of migration results: what the metrics say, else what changes, issues and validations
    give. results: RESULT of quern.sources.schemas, with case, variant and result_path."""
    m, changes, issues, checks = F.col("metrics"), F.coalesce("changes", F.array()), F.coalesce("issues", F.array()), F.coalesce("validations", F.array())
    risk = lambda name: F.size(F.filter(issues, lambda i: F.coalesce(i["risk"], F.lit("medium")) == name)).cast("long")
    out = results.withColumn("deterministic_changes", F.coalesce(m["deterministic_changes"].cast("long"), F.size(F.filter(changes, lambda c: F.coalesce(c["deterministic"], F.lit(True)))).cast("long")))
    out = out.withColumn("semantic_changes", F.coalesce(m["semantic_changes"].cast("long"), F.greatest(F.size(changes) - F.col("deterministic_changes"), F.lit(0)).cast("long")))
    out = out.withColumn("validation_passed", F.coalesce(m["validation_passed"].cast("long"), F.size(F.filter(checks, lambda v: v["passed"].eqNullSafe(F.lit(True)))).cast("long")))
    out = out.withColumn("validation_runs", F.coalesce(m["validation_runs"].cast("long"), F.size(checks).cast("long")))
    out = out.withColumn("detected_targets", F.coalesce(m["detected_migration_targets"].cast("long"), F.col("deterministic_changes") + F.size(issues)))
    out = out.withColumn("cleared_targets", F.coalesce(m["automatically_cleared_targets"].cast("long"), F.col("deterministic_changes")))
    out = out.withColumn("high_risk_issues", risk("high")).withColumn("medium_risk_issues", risk("medium"))
    sound = (F.coalesce("status", F.lit("unknown")) == "completed") & (F.col("high_risk_issues") == 0) & ((F.size(checks) == 0) | (F.col("validation_passed") == F.col("validation_runs")))
    seconds = F.aggregate(checks, F.lit(0.0), lambda acc, v: acc + F.coalesce(v["duration_seconds"], F.lit(0.0)))
    files = F.size(F.array_distinct(F.transform(changes, lambda c: F.coalesce(c["location"]["file"], F.lit("")))))
    name = F.regexp_extract(F.coalesce("project_root", F.lit("project")), r"([^/]*)/*$", 1)
    some = lambda c, other: F.coalesce(F.when(c != "", c), other)
    return out.select(
        some(F.col("case"), some(name, F.lit("project"))).alias("case"), some(F.col("variant"), F.lit("unknown")).alias("variant"), "result_path",
        F.when(m.isNotNull(), "native").otherwise("legacy-derived").alias("metrics_source"), F.coalesce("status", F.lit("unknown")).alias("status"), (F.coalesce("succeeded", F.lit(True)) & sound).alias("succeeded"),
        F.coalesce(F.col("scanned_files").cast("long"), F.lit(0)).alias("scanned_files"), "deterministic_changes", "semantic_changes", F.coalesce(m["changed_files"].cast("long"), files.cast("long")).alias("changed_files"),
        F.size(issues).cast("long").alias("open_issues"), "high_risk_issues", "medium_risk_issues", "detected_targets", "cleared_targets",
        F.coalesce(m["automatic_clearance_percent"], F.try_divide(F.col("cleared_targets") * 100.0, F.col("detected_targets")), F.lit(100.0)).alias("automatic_clearance_percent"), "validation_runs", "validation_passed",
        F.coalesce(m["validation_pass_rate_percent"], F.try_divide(F.col("validation_passed") * 100.0, F.col("validation_runs")), F.lit(0.0)).alias("validation_pass_rate_percent"),
        F.coalesce(m["duration_seconds"], seconds).alias("duration_seconds"), F.coalesce(m["agent_iterations"].cast("long"), F.lit(0)).alias("agent_iterations"),
        F.coalesce(m["agent_input_tokens"].cast("long"), F.lit(0)).alias("input_tokens"), F.coalesce(m["agent_output_tokens"].cast("long"), F.lit(0)).alias("output_tokens"), m["estimated_cost_usd"].alias("estimated_cost_usd"),
    )


def variant_summary(runs: DataFrame) -> DataFrame:
    """Runs by variant: counts, sums, ratios of sums in percent, and the cost, null if no run has one."""
    runs = runs.withColumn("successful_projects", F.col("succeeded").cast("long"))
    out = runs.groupBy("variant").agg(F.count("*").alias("projects"), *[F.sum(c).cast("long").alias(c) for c in SUMS], F.round(F.sum("duration_seconds"), 3).alias("duration_seconds"), F.round(F.sum("estimated_cost_usd"), 6).alias("estimated_cost_usd"))
    return out.select(
        "variant", "projects", "successful_projects", percent(F.col("successful_projects"), F.col("projects"), 0.0).alias("success_rate_percent"), *SUMS[1:9],
        percent(F.col("cleared_targets"), F.col("detected_targets"), 100.0).alias("automatic_clearance_percent"), "validation_runs", "validation_passed",
        percent(F.col("validation_passed"), F.col("validation_runs"), 0.0).alias("validation_pass_rate_percent"), "duration_seconds", "input_tokens", "output_tokens", "estimated_cost_usd",
    )


def percent_change(now: Column, base: Column, reduction: bool = False) -> Column:
    delta = F.try_divide((now - base) * 100.0, base)
    return F.round(-delta if reduction else delta, 2)


def compare(summary: DataFrame, baseline: str) -> DataFrame:
    """Every other variant against the baseline; nothing where there is no baseline. One row is broadcast."""
    cols = ["success_rate_percent", "automatic_clearance_percent", "open_issues", "high_risk_issues", "validation_pass_rate_percent", "duration_seconds"]
    base = F.broadcast(summary.where(F.col("variant") == baseline).select(*[F.col(c).alias(f"_{c}") for c in cols]).limit(1))
    out = summary.where(F.col("variant") != baseline).crossJoin(base)
    points = lambda c: F.round(F.col(c) - F.col(f"_{c}"), 2)
    change = lambda c, reduction=False: percent_change(F.col(c), F.col(f"_{c}"), reduction)
    return out.select(
        "variant", points("success_rate_percent").alias("success_rate_delta_points"), points("automatic_clearance_percent").alias("automatic_clearance_delta_points"), change("open_issues", True).alias("open_issue_reduction_percent"),
        change("high_risk_issues", True).alias("high_risk_issue_reduction_percent"), points("validation_pass_rate_percent").alias("validation_pass_rate_delta_points"), change("duration_seconds").alias("duration_change_percent"),
    )


def metrics(df: DataFrame, by: list[str], before: Column, after: Column, tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> DataFrame:
    """Targets before, resolved (never below 0), their share, and the cost of the tokens."""
    out = df.groupBy(*by).agg(F.sum(before).alias("detected"), F.sum(after).alias("remaining"), F.sum(tokens_in).alias("input_tokens"), F.sum(tokens_out).alias("output_tokens"))
    out = out.withColumn("resolved", F.greatest(F.col("detected") - F.col("remaining"), F.lit(0)))
    cost = (F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / 1e6
    return out.withColumn("resolved_percent", percent(F.col("resolved"), F.col("detected"), 100.0)).withColumn("estimated_cost_usd", F.round(cost, 6))


def risk_counts(*parts: DataFrame) -> DataFrame:
    """Rows per risk over all parts."""
    union = parts[0].select("risk")
    for p in parts[1:]:
        union = union.unionByName(p.select("risk"))
    return union.groupBy("risk").agg(F.count("*").alias("n"))


def trace_totals(df: DataFrame, by: str, tokens_in: Column, tokens_out: Column) -> DataFrame:
    return df.groupBy(by).agg(F.sum(tokens_in).alias("input_tokens"), F.sum(tokens_out).alias("output_tokens"), F.count("*").alias("n_nodes"))


def tokens(chars: Column) -> Column:
    """Estimated tokens of so many characters: 3.5 each, cut off."""
    return F.floor(chars / 3.5).cast("long")


def anchored_tokens(df: DataFrame, by: list[str], at: str, chars: Column, baseline: Column, anchor: Column) -> DataFrame:
    """Baseline plus the estimate of the rows from the anchor on; of all rows where the baseline isn't positive."""
    out = df.withColumn("_c", chars).withColumn("_b", baseline).withColumn("_a", anchor)
    out = out.groupBy(*by).agg(F.max("_b").alias("_b"), F.sum("_c").alias("_all"), F.sum(F.when(F.col(at) >= F.col("_a"), F.col("_c")).otherwise(0)).alias("_tail"))
    return out.select(*by, F.when(F.col("_b") > 0, F.col("_b") + tokens(F.col("_tail"))).otherwise(tokens(F.col("_all"))).alias("current_tokens"))


def anchor_baseline(input_tokens: Column, output_tokens: Column, cache_read: Column, cache_creation: Column) -> Column:
    return sum((F.coalesce(c, F.lit(0)) for c in (output_tokens, cache_read, cache_creation)), F.coalesce(input_tokens, F.lit(0)))


def uncached_input(prompt: Column, cached: Column) -> Column:
    return F.greatest(prompt - F.coalesce(cached, F.lit(0)), F.lit(0))


def idle_teams(df: DataFrame, team: str, active: str) -> DataFrame:
    """all_idle: no member but those whose flag is false; a null flag counts as active."""
    idle = F.col(active).eqNullSafe(F.lit(False))
    return df.groupBy(team).agg(F.bool_and(idle).alias("all_idle"), F.count_if(~idle).alias("n_active"))


def scheduler_stats(schedule: DataFrame, turn: str) -> DataFrame:
    """submitted, dependency_edges, conflicted_calls and max_parallelism (the most calls of one wave) of each turn of
    graph.scheduled(). Waves are added up first, so a turn is combined before its shuffle."""
    n = F.size("waits_for")
    per = schedule.groupBy(turn, "wave").agg(F.count("*").alias("calls"), F.sum(n).alias("edges"), F.count_if(n > 0).alias("held"))
    return per.groupBy(turn).agg(F.sum("calls").alias("submitted"), F.sum("edges").alias("dependency_edges"), F.sum("held").alias("conflicted_calls"), F.max("calls").alias("max_parallelism"))


def usage(df: DataFrame, run: str, turn: str, is_call: Column, tokens_in: str, tokens_out: str) -> DataFrame:
    return df.groupBy(run).agg(F.count_if(is_call).alias("tool_calls"), F.max(turn).alias("turns"), F.sum(tokens_in).alias("input_tokens"), F.sum(tokens_out).alias("output_tokens"))


def ranked(df: DataFrame, value: str, rank: int, few: int = 65_536, accuracy: int = 10_000) -> float | None:
    """The value of a rank (from 0) among those that aren't null, as a double, NaN last; None past the end.

    Each round takes two borders from a mergeable sketch, counts exactly what is below, at and between them, and goes on
    with what lies strictly between, some 4 / accuracy of the round before; borders come from the data, so many
    equal values end it. No task holds more than the sketch or `few` values. A round reads the column twice."""
    v = F.col(value).cast("double")
    rows = df.select(v.alias("v")).where("v is not null")
    n = rows.count()
    if not 0 <= rank < n:
        return None
    while n > few:
        share = [min(max((rank + k * 2 * n / accuracy) / n, 0.0), 1.0) for k in (-1, 1)]
        low, high = rows.agg(F.percentile_approx("v", share, accuracy).alias("p")).first()["p"]
        at, here = F.col("v"), F.lit
        below, equal, between, top = rows.agg(
            F.count_if(at < here(low)), F.count_if(at == here(low)), F.count_if((at > here(low)) & (at < here(high))), F.count_if((at == here(high)) & (at > here(low)))
        ).first()
        if rank < below:
            rows, n = rows.where(at < here(low)), below
        elif rank < below + equal:
            return low
        elif rank < below + equal + between:
            rows, rank, n = rows.where((at > here(low)) & (at < here(high))), rank - below - equal, between
        elif rank < below + equal + between + top:
            return high
        else:
            past = below + equal + between + top
            rows, rank, n = rows.where(at > here(high)), rank - past, n - past
    return rows.orderBy("v").offset(rank).limit(1).first()["v"]


def median(df: DataFrame, value: str, few: int = 65_536) -> float | None:
    """The exact median: the middle value, or the mean of both; None without values."""
    n = df.agg(F.count(value)).first()[0]
    low = ranked(df, value, (n - 1) // 2, few) if n else None
    return low if low is None or n % 2 else (low + ranked(df, value, n // 2, few)) / 2


def median_speedup(df: DataFrame, slow: str, fast: str) -> DataFrame:
    """One row of two exact medians and their ratio (null where the second is 0 or missing)."""
    found = [F.lit(median(df, c)).cast("double") for c in (slow, fast)]
    out = df.sparkSession.range(1).select(found[0].alias("sequential_ms"), found[1].alias("scheduled_ms"))
    return out.withColumn("speedup", F.round(F.try_divide("sequential_ms", "scheduled_ms"), 2))
