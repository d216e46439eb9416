"""Python workers need this package: send it to them once per Spark context."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import hindcast

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every Python worker the package, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = os.path.dirname(os.path.abspath(hindcast.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="hindcast-"), "hindcast.zip")
    with zipfile.ZipFile(path, "w") as z:
        for place, folders, names in os.walk(root):
            folders.sort()
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(place, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _sent.add(context.applicationId)
