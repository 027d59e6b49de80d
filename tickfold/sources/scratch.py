"""Tables that are written once and read again, in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. What was written there
survives the loss of any executor, and cuts the lineage of what reads it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, on one machine only, a temporary folder that is removed at exit."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors share; {master} has several machines")
        path = tempfile.mkdtemp(prefix="tickfold-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which drop_scratch removes."""
    _made.append(f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df once to the shared folder and return the table that was written."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove what this process has written under scratch_path; results that still read it must have been written elsewhere."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
