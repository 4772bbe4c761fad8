"""Session helpers."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def importable(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with this library on the Python path of the session's workers, whatever folder they start in."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        env = spark.sparkContext.environment
        if ROOT not in (path := env.get("PYTHONPATH", "")).split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (path, ROOT) if x)
        return query(spark, sf_dir)

    return run
