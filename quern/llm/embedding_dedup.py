"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

Unit vectors are turned by a random rotation and cut into BLOCKS blocks; each block has CODES random unit
directions, and every choice of one direction per block is a filter direction, so that CODES ** BLOCKS
filters need CODES * BLOCKS stored ones. There are ROTATIONS such codes. A vector belongs to all filters whose
cap it lies in: the cap's height is HEIGHT deviations of a random vector's product, or less where fewer than
LEAST filters of a code would be exceeded. They are list-decoded: sums over two halves of the blocks are
sorted and joined by bisection, so only what is listed is visited. Vectors of equal label that share a filter
are compared, in double precision.

Equal vectors of a label form one class with a number of copies, so a vector that is repeated without end is
compared once. A filter's bucket of over CELL classes is dealt into groups, and pairs of groups are compared
in separate tasks. A pair is counted in its lowest common filter only. No pair leaves a task: a task adds up
each class's links and gives one edge per class to the root of its component there; those edges are few, and
connected_components() joins them.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers, and those with a null
label, link with nothing; vectors of unequal length don't link; repeated rows are vectors of their own that
link with each other; a null vec_id links and counts, but no component is named after it; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop_staged, lists, runs, staged

ROTATIONS, BLOCKS, CODES, HEIGHT, LEAST, CELL = 3, 4, 12, 3.6, 12, 1024


@functools.lru_cache(maxsize=8)
def product_codes(dim: int, seed: int = 5) -> list[tuple[np.ndarray, list[slice], list[np.ndarray]]]:
    """Per rotation: the rotation, the blocks, and each block's directions."""
    edges = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
    parts = [slice(a, b) for a, b in zip(edges, edges[1:])]
    made = []
    for k in range(ROTATIONS):
        rng = np.random.default_rng((seed, dim, k))
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        codes = [c / np.linalg.norm(c, axis=1, keepdims=True) for c in (rng.standard_normal((CODES, p.stop - p.start)) for p in parts)]
        made.append((turn, parts, codes))
    return made


def filters(units: np.ndarray) -> list[np.ndarray]:
    """The filters of each unit vector, rising."""
    n, dim = units.shape
    found: list[list[np.ndarray]] = [[] for _ in range(n)]
    for base, (turn, parts, codes) in enumerate(product_codes(dim)):
        turned = units @ turn
        tables = [turned[:, p] @ c.T / np.sqrt(len(parts)) for p, c in zip(parts, codes)]
        tables += [np.zeros((n, 1))] * (2 - len(tables))
        left, right = _sums(tables[: len(tables) // 2]), _sums(tables[len(tables) // 2 :])
        order = np.argsort(right, axis=1)
        ranked, width = np.take_along_axis(right, order, axis=1), right.shape[1]
        # the best LEAST sums are among those of either half's best LEAST
        best = (np.sort(left, axis=1)[:, -LEAST:, None] + ranked[:, None, -LEAST:]).reshape(n, -1)
        height = np.minimum(np.sort(best, axis=1)[:, -min(LEAST, best.shape[1])], HEIGHT / np.sqrt(dim)) - 1e-12
        for k in range(n):
            first = np.searchsorted(ranked[k], height[k] - left[k])
            for i in np.flatnonzero(first < width):
                found[k].append(base * (CODES**BLOCKS) + i * width + order[k, first[i] :])
    return [np.sort(np.concatenate(f)) for f in found]


def _sums(tables: list[np.ndarray]) -> np.ndarray:
    out = tables[0]
    for t in tables[1:]:
        out = (out[:, :, None] + t[:, None, :]).reshape(len(out), -1)
    return out


def matches(units: np.ndarray, times: np.ndarray, earlier: list[np.ndarray], groups: np.ndarray, apart: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Within a bucket (one cell of it): links added to each row, and each row's root.

    earlier: each row's filters below the bucket's own; a pair with one in common was counted there. groups:
    if `apart`, only pairs of different groups are compared."""
    m = len(units)
    near = units @ units.T >= least
    np.fill_diagonal(near, False)
    if apart:
        near &= groups[:, None] != groups[None, :]
    root = np.arange(m)
    if not near.any():
        return np.zeros(m, np.int64), root
    keys, inverse = np.unique(np.concatenate(earlier), return_inverse=True)
    counted = near
    if len(keys):
        member = np.zeros((m, len(keys)), np.float32)
        member[np.repeat(np.arange(m), [len(e) for e in earlier]), inverse] = 1
        member = member[:, member.sum(axis=0) > 1]
        counted = near & ~(member @ member.T > 0)
    while True:
        low = np.minimum(root, np.where(near, root[None, :], m).min(axis=1))
        low = low[low]
        if (low == root).all():
            return (counted * times[None, :]).sum(axis=1), root
        root = low


def unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norms
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = lists(batch["embedding"])
        found: list = [None] * len(vectors)
        for dim in {len(v) for v in vectors}:
            at = [k for k, v in enumerate(vectors) if len(v) == dim]
            for a in range(0, len(at), 512):
                some = at[a : a + 512]
                for k, f in zip(some, filters(unit([vectors[i] for i in some]))):
                    found[k] = f.tolist()
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("rep", "label", "dim", "times", "embedding")), pa.array(found, pa.list_(pa.int32()))], ["rep", "label", "dim", "times", "embedding", "filters"])


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, f, ci, cj), rows in runs(batches, ("label", "dim", "f", "ci", "cj")):
            if len(rows) < 2:
                continue
            rep = rows["rep"].to_numpy()
            earlier = [e[e < f] for e in lists(rows["filters"])]
            links, root = matches(unit(lists(rows["embedding"])), rows["times"].to_numpy(), earlier, rows["g"].to_numpy(), ci != cj, least)
            on = (links > 0) | (root != np.arange(len(root)))
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(rep[on]), pa.array(links[on], pa.int64()), pa.array(rep[root][on])], ["rep", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    e = vectors["embedding"]
    sound = F.coalesce(vectors["label"].isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].alias("label"), F.when(sound, e).alias("embedding"))
    rows = rows.withColumn("h1", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(17), "embedding")))
    key = ["label", "h1", "h2"]
    classes = rows.where("h1 is not null").groupBy(*key).agg(F.count("*").alias("times"), F.min("vec_id").alias("name"), F.first("embedding").alias("embedding"))
    # a class's own number, as its vec_ids may all be null; it is settled once it is written
    classes = staged(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    coded = classes.select("rep", "label", F.size("embedding").alias("dim"), "times", "embedding")
    kinds = dict(coded.dtypes)
    coded = staged(coded.mapInArrow(_decode, ", ".join(f"{c} {kinds[c]}" for c in coded.columns) + ", filters array<int>"), "coded")
    posted = coded.select("rep", "label", "dim", F.explode("filters").alias("f"))
    # written, so that the join below can be split where a filter is hot
    sizes = staged(posted.groupBy("label", "dim", "f").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    full = coded.withColumn("f", F.explode("filters")).join(sizes, ["label", "dim", "f"])
    cells = F.ceil(F.col("n") / CELL).cast("int")
    full = full.withColumn("g", F.pmod(F.xxhash64("rep"), cells).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cells - 1)))
    full = full.withColumn("ci", F.least("g", "other")).withColumn("cj", F.greatest("g", "other"))
    order = ["label", "dim", "f", "ci", "cj"]
    found = full.select(*order, "g", "rep", "times", "embedding", "filters").repartition(*order).sortWithinPartitions(*order)
    found = staged(found.mapInArrow(_compare(least), "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vectors")
    placed = classes.select(*key, "times", "rep", "name").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    placed = staged(placed.select(*key, (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "name", F.coalesce("component", "rep").alias("component")), "placed")
    names = placed.groupBy("component").agg(F.min("name").alias("component_id"))
    named = staged(placed.join(names, "component").select(*key, "n_links", "component_id"), "named")
    drop_staged(classes, coded, sizes, found, roots, placed)
    out = rows.join(named, key, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
