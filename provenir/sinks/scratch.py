"""Where a query may write a table it reads back."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="provenir-")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path for this application below the folder every executor can reach.

    A cluster names that folder in ``spark.checkpoint.dir``. Only a local session
    without it gets a temporary folder of its own.
    """
    shared = spark.conf.get(SETTING, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        shared = _own_folder()
    return "/".join([shared.rstrip("/"), spark.sparkContext.applicationId, *parts])


def new_scratch_path(spark: SparkSession, *parts: str) -> str:
    """Such a path that no other call gets, so that no later write takes a table away."""
    return scratch_path(spark, *parts, uuid.uuid4().hex)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to such a path and read back, for what is used more than once.

    Later steps read the table instead of computing it again, also after losing an executor.
    """
    path = new_scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever Spark can write."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_scratch(spark: SparkSession, *parts: str) -> None:
    """Remove what this application wrote below ``parts``, or all of it."""
    drop_folder(spark, scratch_path(spark, *parts))
