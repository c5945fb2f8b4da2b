"""Python functions on executors.

Workers must be able to import this package, wherever the driver found it, so
it is added to the context once as a zip file.
"""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="lexigrid-")) / "lexigrid_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the workers, which give back what a task took."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what the former task's function held
        try:
            yield from f(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Hand memory that is free to the system: a worker waits for its next task beside an executor that may need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def extended(schema: T.StructType, more: str) -> T.StructType:
    """``schema`` and further fields, given as DDL."""
    return T.StructType([*schema.fields, *T._parse_datatype_string(more).fields])
