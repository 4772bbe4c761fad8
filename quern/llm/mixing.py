"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Each source's documents, in a seeded order, form one stream of words, cut into blocks of `block` words.
The mix has as many seats as its target words fill blocks; seats go to sources by the highest quotients
target / (2 k + 1), and a source's seats to its shards (equal runs of blocks) by the same rule, which gives
an integer quota per shard. A shard whose quota is q takes each of its n blocks q div n times and a seeded
choice of q mod n blocks once more, so a block is taken at most `ceiling` times and a document at most
`ceiling` times its size.

Sizes, stream positions and block overlaps are DataFrame expressions. Positions come in two levels (a bucket
of the seeded order, then a window within it), so a source with a third of all rows is still spread over
`buckets` tasks. Only one row per source reaches the driver; more than MAX_SOURCES sources is an error.

Defined cases: a null or empty text has size 0 and takes 0; null is a source of its own, ordered last; a row
without an id is ordered by its text; rows alike in all that is ordered by (id and size) may swap places, which changes no result; an empty table
gives an empty mix; other columns are carried only if asked for.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

MAX_SOURCES = 1_000_000
BUCKETS, SHARDS, BLOCK, ROWS = 4096, 64, 32, 4096


def cycle_weight(rank: int) -> float:
    return rank % 3 + 1.0


def targets(sizes: list[int], weights: list[float], ceiling: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none above ceiling times its size; what is cut off goes to the others."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free, left = list(range(len(sizes))), total
    while free:
        w = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / w > ceiling * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = ceiling * sizes[i]
        left = total - sum(out[i] for i in range(len(out)) if out[i] and i not in set(free) - set(full))
        free = [i for i in free if i not in set(full)]
    return out


def apportion(votes: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1), none above its cap; ties go to the lower index.

    Starts from each party's rounded share and then adds the highest or takes back the lowest quotients,
    so the work grows with the number of parties, not of seats."""
    caps = caps if caps is not None else [seats] * len(votes)
    total = sum(votes)
    if not total or seats <= 0:
        return [0] * len(votes)
    got = [min(c, math.floor(seats * v / total + 0.5)) for v, c in zip(votes, caps)]
    over = sum(got) - seats
    if over > 0:
        heap = [(v / (2 * g - 1), -i) for i, (v, g) in enumerate(zip(votes, got)) if g]
        heapq.heapify(heap)
        for _ in range(over):
            i = -heapq.heappop(heap)[1]
            got[i] -= 1
            if got[i]:
                heapq.heappush(heap, (votes[i] / (2 * got[i] - 1), -i))
    else:
        heap = [(-v / (2 * g + 1), i) for i, (v, g, c) in enumerate(zip(votes, got, caps)) if g < c and v > 0]
        heapq.heapify(heap)
        for _ in range(-over):
            if not heap:
                break
            i = heapq.heappop(heap)[1]
            got[i] += 1
            if got[i] < caps[i]:
                heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def coprime(n: int) -> int:
    """A step near the golden section of n that visits all of 0..n-1."""
    a = max(1, round(n * 0.6180339887))
    while math.gcd(a, n) != 1:
        a += 1
    return a


def plan(sources: list[tuple[str | None, int]], block: int, ceiling: int, shards: int, seed: int, weight=cycle_weight) -> list[tuple]:
    """One row per source: source, source_size, target, blocks, per_shard, quotas, steps, offsets."""
    sources = sorted(sources, key=lambda s: (s[0] is None, s[0] or ""))
    sizes = [n for _, n in sources]
    goal = targets(sizes, [weight(i) for i in range(len(sources))], ceiling)
    blocks = [-(-n // block) for n in sizes]
    seats = apportion(goal, (sum(sizes) + block // 2) // block, [ceiling * b for b in blocks])
    rows = []
    for at, ((name, size), t, b, q) in enumerate(zip(sources, goal, blocks, seats)):
        per = max(1, -(-b // shards))
        runs = [min(per, b - s) for s in range(0, b, per)]
        quotas = apportion([float(n) for n in runs], q, [ceiling * n for n in runs])
        rows.append((name, size, float(t), b, per, quotas, [coprime(n) for n in runs], [(seed * 7919 + at * 104729 + s * 1299709) % n for s, n in enumerate(runs)]))
    return rows


PLAN = "key string, source_size long, target double, blocks long, per_shard long, quotas array<long>, steps array<long>, offsets array<long>"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _mixed(docs: DataFrame, seed: int = 1, block: int = BLOCK, ceiling: int = 3, shards: int = SHARDS, buckets: int = BUCKETS, carry: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each row; where `carry` is given, it and what deals
    rows into windows."""
    spark = docs.sparkSession
    named = F.coalesce(docs["doc_id"].cast("string"), F.md5(F.coalesce(docs["text"], F.lit(""))))
    order = F.md5(F.concat(F.lit(f"{seed}:"), named))
    # a key that is never null: null-safe equality would have the rows, texts and all, dealt once more for each join
    key = F.when(docs["source"].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), docs["source"].cast("string")))
    fine = F.floor(F.conv(F.substring(order, 1, 6), 16, 10).cast("long") * buckets / (1 << 24))
    recs = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), key.alias("key"), words(docs["text"]).alias("size"), order.alias("ord"), fine.alias("bucket"), *([carry.alias("carry")] if carry is not None else []))
    cells = recs.groupBy("key", "bucket").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    found = [(r["key"], r["n"], r["rows"]) for r in cells.groupBy("key").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).limit(MAX_SOURCES + 1).toLocalIterator()]
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    named = lambda k: k[1:] if k else None
    per_source = spark.createDataFrame([("" if r[0] is None else "=" + r[0], *r[1:]) for r in plan([(named(k), n) for k, n, _ in found], block, ceiling, shards, seed)], PLAN)
    # a source's buckets are put together until they hold some ROWS rows, so a small source is one window
    merged = spark.createDataFrame([(k, min(buckets, 1 << max(0, -(-rows // ROWS) - 1).bit_length())) for k, _, rows in found], "key string, dealt long")
    if len(found) <= 10_000:  # then at most some 20 MB
        per_source, merged = F.broadcast(per_source), F.broadcast(merged)
    cell = F.floor(F.col("bucket") * F.col("dealt") / buckets).alias("cell")
    before = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.join(merged, "key").groupBy("key", cell).agg(F.sum("n").alias("n")).select("key", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("key", "cell").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = recs.join(merged, "key").withColumn("cell", cell).drop("bucket", "dealt").withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(starts, ["key", "cell"]).withColumn("at", F.col("base") + F.col("local")).join(per_source, "key")
    begin, end = F.col("at"), F.col("at") + F.col("size")

    def taken_of(j: Column) -> Column:
        s = F.expr("0").cast("long") + F.floor(j / F.col("per_shard"))
        run = F.least(F.col("per_shard"), F.col("blocks") - s * F.col("per_shard"))
        k = s.cast("int") + 1
        q = F.element_at("quotas", k)
        chosen = (F.element_at("steps", k) * (j - s * F.col("per_shard")) + F.element_at("offsets", k)) % run < q % run
        times = F.floor(q / run) + F.when(chosen, 1).otherwise(0)
        return times * (F.least(end, (j + 1) * block) - F.greatest(begin, j * block))

    span = F.sequence(F.floor(begin / block), F.floor((end - 1) / block))
    taken = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.aggregate(span, F.lit(0).cast("long"), lambda acc, j: acc + taken_of(j)))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["carry", "key", "cell", "ord"] if carry is not None else []))


def mix(docs: DataFrame, seed: int = 1, **how) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each row."""
    return _mixed(docs, seed, **how)


def mixed_documents(docs: DataFrame, seed: int = 1, **how) -> DataFrame:
    """The documents of the mix, with the columns of docs: a row comes taken / size times. Fractions are rounded
    along each window's rows from the largest on, as differences of whole parts of running sums, so a window's words
    are off by less than its largest document's, and a source of ROWS rows or less is one window. Rows without words, which
    no share in words can weigh, come once."""
    carried = _mixed(docs, seed, carry=F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]), **how)
    one = 1 << 20
    part = F.when(F.col("size") == 0, 0).otherwise(F.floor(F.col("taken") * one / F.greatest(F.col("size"), F.lit(1)))).cast("long")
    along = Window.partitionBy("key", "cell").orderBy(F.desc("size"), "ord").rowsBetween(Window.unboundedPreceding, 0)
    summed = carried.withColumn("part", part).withColumn("upto", F.sum("part").over(along) + one // 2)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("upto") / one) - F.floor((F.col("upto") - F.col("part")) / one)).cast("int")
    taken = summed.select(copies.alias("copies"), F.col("carry").alias("row")).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")
