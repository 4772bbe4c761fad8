"""Shared folder, staged tables, remote files and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset (local tests) a temporary folder takes its place.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Set while a table is staged: shuffle files go when its write ends (else they wait until the driver's JVM collects
#: garbage, which a large heap puts off), and what a Python worker is sent at once is bounded, as a row may be a long text.
STAGING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with these settings; afterwards with its own again."""
    was = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends in files that survive lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    with settings(spark, STAGING):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Removes the files of staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remote(uri: str):
    """(pyarrow file system, path) of a URI; a plain path is local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_once(fs, path: str, write) -> None:
    """write(stream) under a name of this attempt, then a rename: readers never see half a file,
    and a retried or speculative task replaces the same bytes."""
    part = f"{path}.{os.getpid()}-{uuid.uuid4().hex[:8]}.tmp"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, path)


def frugal(run):
    """A task's function that gives back memory at its end: Arrow's and the C library's pools keep what was freed,
    and workers live on."""

    @functools.wraps(run)
    def wrapped(*args):
        yield from run(*args)
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def among(rows: DataFrame, keys: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """Rows whose `key` may be among the keys: all that are, and few others. What is sent is a bitmap of `bits` bits
    in pieces of 4 KB, whatever the number of keys."""
    return _mapped(rows, keys, bits, "inner").where("may").drop("may")


def without(rows: DataFrame, keys: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """Rows whose `key` is not among the keys. Only those that may be, by the bitmap of among(), are shuffled."""
    marked = _mapped(rows, keys, bits, "left")
    doubtful = marked.where("may").join(keys.select("key").hint("merge"), "key", "left_anti")
    return marked.where("not may").drop("may").unionByName(doubtful.drop("may"))


def _mapped(rows: DataFrame, keys: DataFrame, bits: int, how: str) -> DataFrame:
    """Rows and whether their `key` may be among the keys."""
    place = lambda df: df.withColumn("at", F.pmod(F.xxhash64("key"), F.lit(bits)) + 1).withColumn("piece", F.expr("bitmap_bucket_number(at)")).withColumn("bit", F.expr("bitmap_bit_position(at)"))
    maps = place(keys.select("key")).groupBy("piece").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    byte = "cast(conv(hex(substring(bits, cast(shiftright(bit, 3) + 1 as int), 1)), 16, 10) as int)"
    may = F.expr(f"coalesce(shiftright({byte}, cast(bit & 7 as int)) & 1 = 1, false)")
    return place(rows).join(F.broadcast(maps), "piece", how).withColumn("may", may).drop("at", "piece", "bit", "bits")


def stars(a, b):
    """The edges that join the same nodes as the edges (a, b), each from a node to its component's smallest."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if (root == before).all():
            break
    on = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[on], nodes[root[on]]


def _contracted(edges: DataFrame, chunk: int) -> DataFrame:
    """Edges that join the same nodes as staged edges (a, b): the stars of every `chunk` edges or so. A task holds no
    more than a chunk; there are as few tasks as chunks, so few edges are joined at once."""

    def run(batches):
        import pyarrow as pa

        def made(held):
            a, b = stars(*(pa.chunked_array([x[c] for x in held]).to_numpy() for c in ("a", "b")))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= chunk:
                yield made(held)
                held, n = [], 0
        if n:
            yield made(held)

    return edges.coalesce(max(1, -(-edges.count() // chunk))).mapInArrow(frugal(run), "a long, b long")


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60, chunk: int = 1 << 18) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b): component is the smallest node
    reachable. Nodes without an edge to another node are left out; null ends are ignored.

    Edges are joined within chunks first, which leaves each chunk a star per component. Then alternating large-star
    and small-star steps: each is an aggregation, which combines before its shuffle, and an equi-join with its written
    result, whose exchanges adaptive execution can split where a node is a hub. The rounds grow with the logarithm of the graph's diameter; they end when every node has one edge, to a node
    that has none. Every round is written to the shared folder, so lineage stays short and lost executors cost no
    more than the round at hand.
    """
    given = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), name)
    e = staged(_contracted(given, chunk).distinct(), name)
    drop_staged(given)
    for _ in range(max_rounds):
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("out")).union(e.select("b", F.lit(0)))
        if ends.groupBy("n").agg(F.sum("out").alias("out"), F.min("out").alias("low")).where("out > 1 or out = 1 and low = 0").isEmpty():
            return e.toDF("node", "component")
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        step = staged(large, name)
        drop_staged(low)
        low = staged(step.groupBy("a").agg(F.min("b").alias("m")), name)
        small = step.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        following = staged(small, name)
        drop_staged(e, step, low)
        e = following
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def runs(batches, keys: tuple[str, ...]):
    """(key, table) for each run of rows with equal keys in a stream of record batches sorted by them.

    A run is held whole; callers bound its size by how they deal rows into keys."""
    import numpy as np
    import pyarrow as pa

    held, open_key = [], None
    for batch in batches:
        if not len(batch):
            continue
        changed = np.zeros(len(batch), bool)
        for c in keys:
            col = batch[c].dictionary_encode().indices.to_numpy(zero_copy_only=False)
            changed[1:] |= col[1:] != col[:-1]
        starts = [0, *np.flatnonzero(changed).tolist(), len(batch)]
        for a, b in zip(starts, starts[1:]):
            key = tuple(batch[c][a].as_py() for c in keys)
            if held and key != open_key:
                yield open_key, pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            open_key = key
    if held:
        yield open_key, pa.Table.from_batches(held).combine_chunks()


def lists(column) -> list:
    """The lists of an Arrow column as numpy arrays."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    return [flat[a:b] for a, b in zip(ends - ends[0], ends[1:] - ends[0])]
