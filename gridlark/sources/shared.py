"""What more than one job of a plan needs: Parquet tables in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Of each application, the places it was given and hasn't cleared.
_PATHS: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. On a local master one of our own serves where it is unset; on a cluster, where
    each machine would have another, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="gridlark-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that nothing else has, and that goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"
    folder, where = _folder(spark, path)
    folder.deleteOnExit(where)
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def cleared(spark: SparkSession) -> int:
    """Deletes all tables that this application has written to the shared folder so far, and says how many there were. For
    sessions that run long, between their jobs: DataFrames that read one of these tables can't be used any more."""
    paths = _PATHS.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        folder, where = _folder(spark, path)
        folder.delete(where, True)
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts its lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
