"""Tables that are written on the way: into the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; in one of our own only where it is unset and the driver is the only
    machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
        folder = _own[context.applicationId]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write df into the shared folder and read it back. With `by`, in as many buckets of these columns as a shuffle has
    partitions, which later joins and groupings by them use as they are; such a table has a name in the session's catalog."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if not by:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), os.path.basename(path).replace("-", "_")
    # no exchange where df is partitioned like this already; else it gives one file a bucket
    df.repartition(n, *by).write.format("parquet").bucketBy(n, *by).option("path", path).saveAsTable(table)
    return spark.table(table)
