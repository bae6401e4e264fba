"""Sends this package to the executors' Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()
#: Bytes of rows that go to a Python worker at once, where the session does not say.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def ship(spark: SparkSession) -> None:
    """Once an application: a zip of the package through Spark's own file distribution; and batches of bounded bytes."""
    if spark.conf.get(BATCH, "1") == "1":
        spark.conf.set(BATCH, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="screenlake-code-")
    target = os.path.join(folder, "screenlake.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent).as_posix())
    context.addPyFile(target)
    _SENT.add(context.applicationId)
