"""Send the package to Python workers, which may start in any folder."""
from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session once; Spark serves them to every executor."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="waymesh-"), "waymesh_sources.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(home)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
