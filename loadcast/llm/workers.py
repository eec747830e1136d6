"""Running this package's functions in Spark's Python workers."""

from __future__ import annotations

import ctypes
import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

ROOT = str(Path(__file__).resolve().parents[2])


#: Bounds of what a worker is handed at once; long texts make batches of few rows.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}


def give_back() -> None:
    """Return memory that this process has freed: workers are kept, and the next stage's need it beside them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(function):
    """``function`` of a task's batches; what it has freed goes back at the task's end."""
    def task(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return task


def map_arrow(frame: DataFrame, function, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches of bounded size, with workers that find this package where the driver did.

    On a cluster the package is installed or shipped with the job; the path
    added here then simply does not exist on the executors. The batch bounds
    are set in the session, for they are read when the plan runs.
    """
    spark = frame.sparkSession
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return frame.mapInArrow(lean(function), schema)
