"""Makes the package importable in Python workers that don't share the driver's import path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: Rows of an Arrow batch, of texts of any length: Spark's 10,000 would be tens of megabytes a batch, on both sides.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once a context, and keeps Arrow batches small where their size wasn't chosen."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")
    context = spark.sparkContext
    if getattr(context, "_quarry_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-"), "quarry.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._quarry_shipped = True
