"""Tables written in the middle of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _of_this_process() -> str:
    return tempfile.mkdtemp(prefix="narravane-")


def folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Where that is unset, a master in this process (``local``) uses a folder of its own; a cluster has no folder that
    its executors are known to share, so the setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _of_this_process()
    path = f"{base.rstrip('/')}/narravane-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


#: The tables that this process has written below a shared folder.
_MADE: list[str] = []


def remove_all(spark: SparkSession) -> int:
    """Deletes the tables that this process wrote, for the end of a job; gives their number.  Frames that read them are of no use then."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    n = len(_MADE)
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(hadoop).delete(path, True)
    return n


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a table on shared storage: it cuts the lineage and outlives any executor."""
    path = path or folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
