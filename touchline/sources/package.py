"""Sending this package to the executors, whose Python workers need it for grouped operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's code to the session, once."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="touchline-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(archive := f"{folder}/touchline_code.zip", "w") as z:
        for d, _, names in os.walk(f"{root}/touchline"):
            for n in names:
                if n.endswith(".py"):
                    z.write(f"{d}/{n}", os.path.relpath(f"{d}/{n}", root))
    sc.addPyFile(archive)
