"""Tables in the folder that every executor shares.

Long plans are cut by writing a table and reading it again: the files outlive
any executor, and their statistics let Catalyst choose joins by real sizes.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task sorts or groups, where there are many.
TASK_ROWS = 500_000
_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; a temporary one where that is unset (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lexigrid-")
    return _own[app]


def materialise(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._lexigrid_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_lexigrid_path", None)
        if path:
            _delete(t.sparkSession, path)


def tasks(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int | None:
    """Tasks that so many rows need, if more than the session's usual number, which follows no table's size."""
    n = -(-rows // each)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over as many tasks as ``rows`` need; as it is where the usual number does."""
    n = tasks(df.sparkSession, rows)
    return df.repartition(n, *keys) if n else df


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone already at interpreter exit
            return
