"""The package on the executors: sent along with the session where they could not import it themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package once per application, unless PYTHONPATH already names its folder.

    The archive is made on the driver and served by it; nothing is read from executors' own folders.
    """
    root = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    if context.applicationId in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="corpusflow-")) / "corpusflow.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted((root / "corpusflow").rglob("*.py")):
            archive.write(file, file.relative_to(root))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
