"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from hindcast.session import shared_folder


@functools.cache
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="hindcast-")


def kept(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing.

    The folder is the session's ``spark.checkpoint.dir``; only a session in one
    process (``local[n]``) without that setting gets a folder of its own.
    """
    path = f"{folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    alone = spark.sparkContext.master.partition("[")[0] == "local"
    return shared_folder(spark, _test_folder() if alone else None).rstrip("/")
