"""Tables in the folder that driver and executors share, and who removes them."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Open scratch() blocks, the innermost last: the paths that each removes.
_owners: list[list[str]] = []


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Lower the rows of an Arrow batch in this session to that many at most, as texts of any length stand in them.

    Entry points call it; operators work with any setting and change none.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "stowage-checkpoints")
    return found


def materialise(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and survives lost executors.

    The files go with the innermost scratch() block (with keep, the one around it), by release(), or when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stowage-{uuid.uuid4().hex}"
    owners = _owners[:-1] if keep else _owners
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stowage_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jvm_path, True)
    fs.cancelDeleteOnExit(jvm_path)


def release(*tables: DataFrame) -> None:
    """Remove the files of what materialise() returned. Nothing that reads them may run afterwards."""
    for df in tables:
        if path := getattr(df, "_stowage_path", None):
            _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Own what materialise() writes inside: it is removed at the end. What leaves the block must be kept or written before."""
    paths: list[str] = []
    _owners.append(paths)
    try:
        yield
    finally:
        _owners.pop()
        for path in paths:
            _delete(spark, path)
