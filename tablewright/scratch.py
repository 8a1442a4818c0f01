"""Tables written to the cluster's shared folder and read again: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where that is unset and all of Spark is on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed at the end of this process."""
    path = f"{root(spark)}/tablewright/{uuid.uuid4().hex}-{label}"
    _written.append((spark, path))
    return path


def write(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written once and read back: lineage ends here, and lost executors take nothing with them."""
    path = folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, fs = file_system(spark, path)
    fs.delete(where, True)


@atexit.register
def clear() -> None:
    while _written:
        try:
            delete(*_written.pop())
        except Exception:  # the JVM may have ended before us
            return
