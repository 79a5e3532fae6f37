"""Gives executors this package: a driver may have it on a path that they do not have."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's source to the application once; every Python worker can then import it."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="phylospan-src-"), "phylospan_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"phylospan/{p.relative_to(root)}")
    context.addPyFile(path)
    _done.add(context.applicationId)
