"""Running values per key that no task computes for a whole key.

A window over a key puts all its rows into one task. Here rows are dealt into blocks by ranges of (key, order), so a
large key spreads over blocks. Each block gives one value per key; running values over those few rows, one for each
key and block, give what comes before a block; windows within (key, block) do the rest.

Which rows are in a block depends on sampled borders, so the dealt rows are written once to the shared folder and
read back by every step: a lost executor can't move a border. Callers narrow the rows to what they need first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.staging import staged

KEY, BLOCK = "_key", "_block"


class Scan:
    """Rows with running values by the columns `by` in the order `order` (names or sort columns over the rows,
    unique per key). Null keys are keys of their own. Each step returns a new scan; `rows()` ends it."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence, _dealt: bool = False):
        self.by, self.order = list(by), list(order)
        if not _dealt:
            dealt = df.repartitionByRange(*self.by, *self.order).withColumn(BLOCK, F.spark_partition_id())
            df = staged(dealt).withColumn(KEY, F.struct(*self.by) if self.by else F.struct(F.lit(1).alias("all")))
        self.df = df

    def _next(self, df: DataFrame) -> Scan:
        return Scan(df, self.by, self.order, True)

    def _here(self):
        w = Window.partitionBy(KEY, BLOCK).orderBy(*self.order)
        return w, w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def _met(self, blocks: DataFrame) -> DataFrame:
        return self.df.join(blocks, [KEY, BLOCK], "left")

    @staticmethod
    def _blocks():
        w = Window.partitionBy(KEY).orderBy(BLOCK)
        return w, w.rowsBetween(Window.unboundedPreceding, -1)

    def sum(self, value: Column, name: str, before: bool = False, total: str | None = None) -> Scan:
        """Running sum, null until there is a value; without the row itself where `before` (then 0 at first).
        `total` names the sum of the whole key."""
        blocks = self.df.groupBy(KEY, BLOCK).agg(F.sum(value).alias("_in"))
        if total:
            blocks = blocks.withColumn(total, F.sum("_in").over(Window.partitionBy(KEY)))
        blocks = blocks.withColumn("_off", F.sum("_in").over(self._blocks()[1])).drop("_in")
        zero = F.lit(0)
        local = F.sum(value).over(self._here()[1])
        here = F.when(F.col("_off").isNotNull() | local.isNotNull(), F.coalesce("_off", zero) + F.coalesce(local, zero))
        if before:
            here = F.coalesce(here, zero) - F.coalesce(value, zero)
        return self._next(self._met(blocks).withColumn(name, here).drop("_off"))

    def max(self, value: Column, name: str) -> Scan:
        """Running maximum, null until there is a value."""
        blocks = self.df.groupBy(KEY, BLOCK).agg(F.max(value).alias("_in"))
        blocks = blocks.withColumn("_off", F.max("_in").over(self._blocks()[1])).drop("_in")
        return self._next(self._met(blocks).withColumn(name, F.greatest("_off", F.max(value).over(self._here()[1]))).drop("_off"))

    def lag(self, value: Column, name: str, default: object) -> Scan:
        """The value of the row before; the default for the first row. `order` must be names, ascending."""
        last = F.max_by(F.struct(value.alias("v")), F.struct(*self.order))
        blocks = self.df.groupBy(KEY, BLOCK).agg(last.alias("_in"))
        blocks = blocks.withColumn("_off", F.lag("_in").over(self._blocks()[0])).drop("_in")
        w = self._here()[0]
        near = F.lag(F.struct(value.alias("v"))).over(w)
        got = F.coalesce(near, F.col("_off"))
        return self._next(self._met(blocks).withColumn(name, F.when(got.isNull(), F.lit(default)).otherwise(got["v"])).drop("_off"))

    def rows(self) -> DataFrame:
        return self.df.drop(KEY, BLOCK)
