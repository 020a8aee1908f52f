"""What jobs of these operators need on executors: the package's source, and batches of a bounded size."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import linkloom

#: Texts come to Python in batches of this size, so that workers stay small next to the executor's heap.
BATCH_BYTES = 4 << 20

_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def lean_workers(spark: SparkSession) -> None:
    """Have the Python workers of later jobs give freed arrays of a megabyte and more back to the system at once."""
    for name in ("MALLOC_MMAP_THRESHOLD_", "MALLOC_TRIM_THRESHOLD_"):
        spark.sparkContext.environment.setdefault(name, str(1 << 20))


def ship(spark: SparkSession) -> None:
    """Send the package along with the jobs of this application, once, and bound the batches of this session."""
    context = spark.sparkContext
    if spark.conf.get(_BATCHES, None) != str(BATCH_BYTES):
        spark.conf.set(_BATCHES, str(BATCH_BYTES))
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(linkloom.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="linkloom-"), "linkloom.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    place = os.path.join(folder, name)
                    archive.write(place, os.path.relpath(place, os.path.dirname(root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
