"""Distinct, precedence and lookup operators. Orders are explicit and unique; dropDuplicates keeps any row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def _kept(df: DataFrame, keys: Names, order: Sequence, pick) -> DataFrame:
    """One row per key: an aggregate that combines before its shuffle, which a window would not, of all columns
    but the keys, which are not carried twice."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(1).alias("_one"))
    out = df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("_row"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def keep_first(df: DataFrame, keys: Names, order: Sequence) -> DataFrame:
    """The first row of each key."""
    return _kept(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Names, order: Sequence) -> DataFrame:
    """The last row of each key."""
    return _kept(df, keys, order, F.max_by)


def precedence(layers: Sequence[DataFrame], keys: Names, order: Names) -> DataFrame:
    """Union of layers, the first one that has a key wins; `layer` is its number from 0."""
    ranked = [df.withColumn("layer", F.lit(i)) for i, df in enumerate(layers)]
    return keep_first(reduce(DataFrame.unionByName, ranked), keys, ["layer", *order])


def last_wins(df: DataFrame, keys: Names, rank: str, place: str) -> DataFrame:
    """The row of the highest rank per key, at the first place that the key ever had (first_place)."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(rank, place)).alias("_row"), F.min(place).alias("first_place"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns], "first_place")


def duplicate_keys(df: DataFrame, keys: Names) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def guard_unique(df: DataFrame, keys: Names) -> DataFrame:
    """df, or an error that names a repeated key."""
    if bad := duplicate_keys(df, keys).limit(1).collect():
        raise ValueError(f"duplicate key {bad[0].asDict()}")
    return df


def overlay(base: DataFrame, override: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Rows of both by key; a column of the override counts where it isn't the default."""
    o = override.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in override.columns if c != key])
    joined = base.join(o, F.col(key) == F.col("_k"), "full_outer")
    cols = [F.coalesce(F.when(~F.col(f"_o_{c}").eqNullSafe(F.lit(defaults.get(c))), F.col(f"_o_{c}")), F.col(c), F.col(f"_o_{c}")).alias(c) for c in base.columns if c != key]
    return joined.select(F.coalesce(key, "_k").alias(key), *cols)


def context_window(explicit: Column, fetched: Column, model: Column, table: Sequence[tuple[str, int]], fallback: int) -> Column:
    """First of: explicit, fetched, the first table entry that the model's name contains, fallback."""
    found = reduce(lambda acc, e: acc.when(F.contains(F.lower(model), F.lit(e[0].lower())), e[1]), table[1:], F.when(F.contains(F.lower(model), F.lit(table[0][0].lower())), table[0][1])) if table else F.lit(None)
    positive = lambda c: F.when(c > 0, c)
    return F.coalesce(positive(explicit), positive(fetched), found, F.lit(fallback))


def add_absent(old: Column, new: Column) -> Column:
    """Items of new that old lacks, appended in order."""
    return F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))


def inherited(candidates: DataFrame, records: DataFrame, parent: DataFrame, key: str, order: str) -> DataFrame:
    """Of candidate keys, the last own record, or, where there is none, the parent's."""
    own = keep_last(records, [key], [order]).select(F.col(key).alias("_ok"), F.col("replacement").alias("_own"))
    up = parent.select(F.col(key).alias("_pk"), F.col("replacement").alias("_up"))
    out = candidates.select(key).distinct().join(own, F.col(key) == F.col("_ok"), "left").join(up, F.col(key) == F.col("_pk"), "left")
    return out.select(key, F.coalesce("_own", "_up").alias("replacement"), F.when(F.col("_own").isNotNull(), "own").when(F.col("_up").isNotNull(), "inherited").otherwise("none").alias("origin"))


def resolve_name(df: DataFrame, ask: str, names: DataFrame) -> DataFrame:
    """ident of what is asked for, by name first, else by id. names: name, ident."""
    by_name = names.select(F.col("name").alias("_n"), F.col("ident").alias("_i1"))
    by_id = names.select(F.col("ident").alias("_i2")).distinct()
    return df.join(by_name, F.col(ask) == F.col("_n"), "left").join(by_id, F.col(ask) == F.col("_i2"), "left").withColumn("ident", F.coalesce("_i1", "_i2")).drop("_n", "_i1", "_i2")


def as_of(versions: DataFrame, key: str, at: str, version: str, moment) -> DataFrame:
    """Of each key the highest version up to a moment."""
    return keep_last(versions.where(F.col(at) <= moment), [key], [at, version])


def restored(current: DataFrame, backups: DataFrame, key: str, content: str) -> DataFrame:
    """What a restore does per backed-up key: write (bytes differ or nothing is there), delete (the backup is
    missing, the file isn't) or none."""
    b = backups.select(F.col(key).alias("_k"), F.col(content).alias("_b"))
    out = b.join(current.select(key, content), F.col(key) == F.col("_k"), "left")
    action = F.when(F.col("_b").isNull(), F.when(F.col(key).isNotNull(), "delete").otherwise("none"))
    return out.select(F.col("_k").alias(key), action.when(F.coalesce(F.col(content), F.lit("")) != F.col("_b"), "write").otherwise("none").alias("action"))


def changes(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """change: created, deleted, changed or same, per key of either side."""
    b, a = before.select(F.col(key).alias("_b"), F.col(content).alias("_bc")), after.select(F.col(key).alias("_a"), F.col(content).alias("_ac"))
    kind = F.when(F.col("_b").isNull(), "created").when(F.col("_a").isNull(), "deleted").when(F.col("_bc").eqNullSafe(F.col("_ac")), "same").otherwise("changed")
    return b.join(a, F.col("_b") == F.col("_a"), "full_outer").select(F.coalesce("_b", "_a").alias(key), kind.alias("change"))


def selected(backups: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Backups of the wanted keys; a wanted key without one is an error."""
    if missing := wanted.join(backups, key, "left_anti").limit(1).collect():
        raise ValueError(f"no backup of {missing[0][key]}")
    return backups.join(wanted, key, "left_semi")


def stale_reads(reads: DataFrame, files: DataFrame, key: str, mtime: str) -> DataFrame:
    """state per file: unread, modified since it was read, or fresh."""
    r = reads.groupBy(F.col(key).alias("_k")).agg(F.max(mtime).alias("_m"))
    state = F.when(F.col("_k").isNull(), "unread").when(F.col("_m") != F.col(mtime), "modified").otherwise("fresh")
    return files.join(r, F.col(key) == F.col("_k"), "left").select(key, state.alias("state"))


def needs_reload(recorded: DataFrame, current: DataFrame, key: str, mtime: str) -> DataFrame:
    """Keys whose times differ, an absent one being 0, and keys that are there but were not recorded, whatever their time."""
    a, b = recorded.select(F.col(key).alias("_a"), F.col(mtime).alias("_x")), current.select(F.col(key).alias("_b"), F.col(mtime).alias("_y"))
    out = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    new = F.col("_a").isNull() & F.col("_b").isNotNull()
    return out.where(new | (F.coalesce("_x", F.lit(0)) != F.coalesce("_y", F.lit(0)))).select(F.coalesce("_a", "_b").alias(key))


def unique_names(df: DataFrame, ident: str, name: str, aliases: str) -> DataFrame:
    """Names and aliases that more than one row claims."""
    claims = df.select(ident, F.col(name).alias("claim")).union(df.select(ident, F.explode(aliases).alias("claim")))
    return claims.groupBy("claim").agg(F.count("*").alias("n")).where("n > 1")


def suffixed(df: DataFrame, name: str, order: Names) -> DataFrame:
    """unique_name: the name, then name-2, name-3 … in order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat_ws("-", F.col(name), k.cast("string"))))


def chosen(memories: DataFrame, names: DataFrame, surfaced: DataFrame) -> DataFrame:
    """Memories that a selection names, by path or by file name, once each and without those shown before."""
    want = names.select(F.col("name").alias("_w")).distinct()
    last = F.regexp_extract("filename", r"([^/]+)$", 1)
    by_path = memories.join(want, F.col("filename") == F.col("_w"), "left_semi").select("filename")
    by_name = memories.join(want, last == F.col("_w"), "left_semi").select("filename")
    hit = memories.join(by_path.union(by_name).distinct(), "filename", "left_semi")
    return hit.join(surfaced, "filename", "left_anti")


def team_of(members: DataFrame, asked: DataFrame) -> DataFrame:
    """Team of each asked agent id. members: team, member_ids."""
    return asked.join(members.select("team", F.explode("member_ids").alias("agent_id")), "agent_id", "left")


def models_first(files: DataFrame, model_files: DataFrame, path: str = "path") -> DataFrame:
    """Files in order: those with models, then the others, by path."""
    m = model_files.select(F.col(path).alias("_m")).distinct()
    return files.join(m, F.col(path) == F.col("_m"), "left").orderBy(F.col("_m").isNull(), path).drop("_m")


def sorted_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))
