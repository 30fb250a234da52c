"""Tables written to the folder that the driver and all executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_scratch: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is not set a temporary folder, in local mode only, where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own_dirs.get(app) or _own_dirs.setdefault(app, tempfile.mkdtemp(prefix="spark-shared-"))
    return found


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again. Inside ``scratch`` the table goes when the block ends, unless it is to be kept."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    level = len(_scratch) - 1 - keep
    if level >= 0:
        _scratch[level].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """A path and all below it, in whatever store it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables that were written inside when their work is done."""
    _scratch.append([])
    try:
        yield
    finally:
        for spark, path in _scratch.pop():
            delete(spark, path)
