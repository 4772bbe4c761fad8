"""Conflicts, dependency frontiers, adjacency and closure."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ROUNDS = 200


def ancestors(path: Column) -> Column:
    """A path's proper ancestor folders."""
    parts = F.split(path, "/")
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.filter(F.transform(every, lambda p: F.when(p == "", "/").otherwise(p)), lambda p: p != path)


def conflicts(calls: DataFrame, turn: str | None = None) -> DataFrame:
    """(earlier, later) pairs of calls that conflict. calls: seq, reads, writes (arrays of path, recursive),
    exclusive, as access() gives them. Where a column names the turn, only calls of one turn meet, and it leads.

    Only equi-joins meet resources: a path with itself, and a recursive one with the ancestors that every
    path lists. Exclusive calls conflict with all; each is joined by a range (of its turn)."""
    on = [turn] if turn else []
    refs = calls.select(*on, "seq", F.explode("reads").alias("r"), F.lit(False).alias("w")).unionByName(calls.select(*on, "seq", F.explode("writes").alias("r"), F.lit(True).alias("w")))
    refs = refs.select(*on, "seq", "r.path", "r.recursive", "w").distinct()
    at = refs.select(*on, "seq", "w", F.col("path").alias("key"), F.lit("self").alias("by")).unionByName(refs.select(*on, "seq", "w", F.explode(ancestors(F.col("path"))).alias("key"), F.lit("up").alias("by")))
    tops = refs.where("recursive").select(*on, "seq", "w", F.col("path").alias("key"), F.lit("tree").alias("by"))
    both = at.where("by = 'self'")
    pair = lambda a, b: a.select(*on, F.col("seq").alias("x"), F.col("w").alias("wx"), "key").join(b.select(*on, F.col("seq").alias("y"), F.col("w").alias("wy"), "key"), [*on, "key"]).where("x <> y and (wx or wy)")
    met = pair(both, both).unionByName(pair(tops, at.where("by = 'up'")))
    met = met.select(*on, F.least("x", "y").alias("earlier"), F.greatest("x", "y").alias("later"))
    alone = calls.where("exclusive").select(*on, F.col("seq").alias("x"))
    every = calls.select(*on, F.col("seq").alias("y"))
    ranged = alone.join(every, on or None)
    before = ranged.where("y < x").select(*on, F.col("y").alias("earlier"), F.col("x").alias("later"))
    after = ranged.where("y > x").select(*on, F.col("x").alias("earlier"), F.col("y").alias("later"))
    return met.unionByName(before).unionByName(after).distinct()


def closure(edges: DataFrame, a: str, b: str, within: str | None = None) -> DataFrame:
    """All (from, to) with a path, by doubling: rounds grow with the logarithm of the longest path. Cycles end.
    Where a column is given, paths stay within one value of it, and it leads."""
    from quern.operators.staging import staged

    on = [within] if within else []
    reach = staged(edges.select(*on, F.col(a).alias("f"), F.col(b).alias("t")).where("f <> t").distinct())
    n = reach.count()
    for _ in range(MAX_ROUNDS):
        hop = reach.withColumnRenamed("t", "_m").join(reach.withColumnRenamed("f", "_m"), [*on, "_m"]).select(*on, "f", "t").where("f <> t")
        reach = staged(reach.union(hop).distinct())
        n, was = reach.count(), n
        if n == was:
            return reach.toDF(*on, "from", "to")
    raise RuntimeError("no fixpoint")


def frontier(edges: DataFrame, turn: str | None = None) -> DataFrame:
    """Transitive reduction of (earlier, later), within each turn where a column names it: a pair stays unless
    another way, whose last step is a pair, leads from one to the other."""
    on = [turn] if turn else []
    ways = closure(edges, "earlier", "later", turn).select(*on, F.col("from").alias("earlier"), F.col("to").alias("_m"))
    longer = ways.join(edges.withColumnRenamed("earlier", "_m"), [*on, "_m"]).select(*on, "earlier", "later").distinct()
    return edges.join(longer, [*on, "earlier", "later"], "left_anti")


SCHEDULED = "seq long, wave int, waits_for array<long>"


def _above(path: str):
    while (at := path.rfind("/")) >= 0 and path != "/":
        path = path[:at] or "/"
        yield path


class Turn:
    """The calls of one turn so far. Sets of calls are bits of one number: those that read and write at a path, below
    it, and at all of it (recursively), those that exclude all others, and the calls above each call."""

    def __init__(self):
        self.seqs, self.waves, self.above, self.exclusive = [], [], [], 0
        self.at, self.below, self.tree = ({}, {}), ({}, {}), ({}, {})

    def add(self, seq: int, reads, writes, exclusive: bool) -> tuple[int, list[int]]:
        """(wave, calls to wait for): the conflicting calls that no other conflicting call waits for. The latest
        of those left is always one of them, and takes all above it away."""
        n = len(self.seqs)
        met = (1 << n) - 1 if exclusive else self.exclusive
        refs = [(r, 0) for r in reads or ()] + [(r, 1) for r in writes or ()]
        for ref, write in refs:
            path = ref["path"]
            for side in (0, 1) if write else (1,):
                met |= self.at[side].get(path, 0) | self.tree[side].get(path, 0)
                if ref["recursive"]:
                    met |= self.below[side].get(path, 0)
                for up in _above(path):
                    met |= self.tree[side].get(up, 0)
        waits, above = [], 0
        while met:
            last = met.bit_length() - 1
            waits.append(last)
            above |= self.above[last] | 1 << last
            met &= ~above
        wave = 1 + max((self.waves[k] for k in waits), default=0)
        self.seqs.append(seq)
        self.waves.append(wave)
        self.above.append(above)
        mine = 1 << n
        self.exclusive |= mine if exclusive else 0
        for ref, write in refs:
            path = ref["path"]
            self.at[write][path] = self.at[write].get(path, 0) | mine
            if ref["recursive"]:
                self.tree[write][path] = self.tree[write].get(path, 0) | mine
            for up in _above(path):
                self.below[write][up] = self.below[write].get(up, 0) | mine
        return wave, [self.seqs[k] for k in reversed(waits)]


def scheduled(calls: DataFrame, turn: str | None = None) -> DataFrame:
    """seq, wave (1 on) and waits_for of each call, led by the turn where a column names it: the frontier of conflicts()
    without its pairs. calls as there. A turn's calls stream through one task in order of seq; what it holds are some
    bits for each two calls of the turn."""
    by = F.col(turn) if turn else F.lit(0)
    rows = calls.select(by.cast("string").alias("_turn"), *([F.col(turn)] if turn else []), F.col("seq").cast("long").alias("seq"), "reads", "writes", F.coalesce("exclusive", F.lit(False)).alias("exclusive"))
    kind = f"`{turn}` {dict(calls.dtypes)[turn]}, " if turn else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, None
        for batch in batches:
            names, found = batch["_turn"].to_pylist(), []
            for name, r in zip(names, batch.select(["seq", "reads", "writes", "exclusive"]).to_pylist()):
                if now is None or name != key:
                    now, key = Turn(), name
                found.append(now.add(r["seq"], r["reads"], r["writes"], r["exclusive"]))
            cols = [batch["seq"], pa.array([w for w, _ in found], pa.int32()), pa.array([x for _, x in found], pa.list_(pa.int64()))]
            lead = [batch[turn]] if turn else []
            yield pa.RecordBatch.from_arrays(lead + cols, ([turn] if turn else []) + ["seq", "wave", "waits_for"])

    return rows.repartition("_turn").sortWithinPartitions("_turn", "seq").mapInArrow(run, kind + SCHEDULED)


def waiting(schedule: DataFrame, turn: str | None = None) -> DataFrame:
    """(earlier, later) pairs of scheduled()."""
    return schedule.select(*([turn] if turn else []), F.explode("waits_for").alias("earlier"), F.col("seq").alias("later"))


def write_chain(writes: DataFrame, resource: str, order: str) -> DataFrame:
    """Each write with the one before it on the resource: the frontier where writes are all that conflicts."""
    w = Window.partitionBy(resource).orderBy(order)
    return writes.select(F.lag(order).over(w).alias("earlier"), F.col(order).alias("later")).where("earlier is not null")


def inverted(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Per target the sorted distinct sources, without itself."""
    return edges.where(F.col(source) != F.col(target)).groupBy(target).agg(F.array_sort(F.collect_set(source)).alias("referenced_by"))


def owners(imports: DataFrame, definitions: DataFrame, name: str, order: str) -> DataFrame:
    """Imports with the node that defines the name; of several definitions the last one owns it."""
    owner = definitions.groupBy(name).agg(F.max_by("node", order).alias("owner"))
    return imports.join(owner, name)


def affected(issues: DataFrame, consumers: DataFrame, file: str, existing: str | None = None) -> DataFrame:
    """affected_files: the file's consumers and those named before, without itself, sorted."""
    c = consumers.groupBy(F.col("file").alias("_f")).agg(F.collect_set("consumer").alias("_c"))
    none = F.array().cast("array<string>")
    union = F.array_union(F.coalesce("_c", none), F.coalesce(F.col(existing), none) if existing else none)
    return issues.join(c, F.col(file) == F.col("_f"), "left").withColumn("affected_files", F.array_sort(F.array_remove(union, F.col(file)))).drop("_f", "_c")


def model_classes(classes: DataFrame, roots: list[str], file: str, name: str, bases: str) -> DataFrame:
    """(file, name) of classes that have a root, or another such class of the same file, among their bases, to
    the fixpoint. Cycles end."""
    from quern.operators.staging import staged

    links = classes.select(file, name, F.explode(bases).alias("_base"))
    found = staged(links.where(F.col("_base").isin(*roots)).select(file, name).distinct())
    n = found.count()
    for _ in range(MAX_ROUNDS):
        more = links.join(found.withColumnRenamed(name, "_base"), [file, "_base"]).select(file, name)
        found = staged(found.union(more).distinct())
        n, was = found.count(), n
        if n == was:
            return found
    raise RuntimeError("no fixpoint")


def tree(nodes: DataFrame, ident: str, parent: str) -> DataFrame:
    """depth and path (ids from the root) of each node, once for each of its ways; a missing parent makes a root.
    Level by level, each staged, until one is empty, so neither rows nor levels have a limit. A way doesn't meet
    a node twice, so cycles end."""
    from quern.operators.staging import staged

    nodes = nodes.select(F.col(ident).alias("id"), F.col(parent).alias("up"))
    known = nodes.select(F.col("id").alias("up"), F.lit(True).alias("known")).distinct()
    placed = staged(nodes.join(known, "up", "left").select("id", F.when(F.col("known"), F.col("up")).alias("up")))
    name = F.col("id").cast("string")
    level = staged(placed.where("up is null").select("id", F.lit(0).alias("depth"), name.alias("path"), F.array("id").alias("met")))
    levels = []
    while not level.isEmpty():
        levels += level.inputFiles()
        above = level.select(F.col("id").alias("up"), "depth", "path", "met")
        below = placed.join(above, "up").where(~F.coalesce(F.array_contains("met", F.col("id")), F.lit(False)))
        level = staged(below.select("id", F.col("depth") + 1, F.concat("path", F.lit("/"), name), F.array_append("met", F.col("id"))).toDF(*level.columns))
    found = nodes.sparkSession.read.schema(level.schema).parquet(*levels) if levels else level
    return found.select(F.col("id").alias("node"), "depth", "path")


def includes(edges: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    """(root, file, depth) of files reached over include edges (file, target), at most so deep, each once."""
    from quern.operators.staging import staged

    level = staged(start.select(F.col("file").alias("root"), "file", F.lit(0).alias("depth")))
    seen = level
    for d in range(1, depth + 1):
        level = staged(level.join(edges, "file").select("root", F.col("target").alias("file"), F.lit(d).alias("depth")).distinct().join(seen, ["root", "file"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def cascade(nodes: DataFrame, parent_id: str) -> DataFrame:
    """Running children of a node become completed."""
    return nodes.withColumn("status", F.when((F.col("parent_id") == parent_id) & (F.col("status") == "running"), "completed").otherwise(F.col("status")))


def task_edges(tasks: DataFrame) -> DataFrame:
    """(before, after) of a task board, from either side, each once."""
    out = tasks.select(F.col("id").alias("before"), F.explode("blocks").alias("after"))
    return out.union(tasks.select(F.explode("blocked_by").alias("before"), F.col("id").alias("after"))).distinct()
