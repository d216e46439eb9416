"""Session settings every operator relies on."""

from __future__ import annotations

import functools
import os
import tempfile

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # History is stored as UTC wall-clock time; all interval arithmetic is UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Windows over compact rows are heavy per byte: merge partitions less eagerly.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, app: str = "hindcast", **conf: str) -> SparkSession:
    """Local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("HINDCAST_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession, default: str | None = None) -> str:
    """The folder for checkpoints: the cluster names it in ``spark.checkpoint.dir``.

    ``default`` is used only where the setting is absent (tests on one machine).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or default
    if not folder:
        raise ValueError("spark.checkpoint.dir is not set and no default folder was given")
    return folder


def ensure_checkpoint_dir(spark: SparkSession, default: str | None = None) -> None:
    """Make ``DataFrame.checkpoint`` usable, keeping a folder the cluster already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, default))


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder; one-process sessions without ``spark.checkpoint.dir`` get a folder of their own."""
    alone = spark.sparkContext.master.partition("[")[0] == "local"
    return shared_folder(spark, _own_folder() if alone else None).rstrip("/")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="hindcast-")


def stored(df):
    """Write a table that several later steps read to the shared folder, once.

    A reliable checkpoint: it outlives lost executors, unlike cached blocks.
    """
    ensure_checkpoint_dir(df.sparkSession, scratch_folder(df.sparkSession))
    return df.checkpoint()
