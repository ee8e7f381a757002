"""Makes this package importable on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / "recollect_sources.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted((top / "recollect").rglob("*.py")):
            z.write(path, path.relative_to(top))
    context.addPyFile(str(target))
    _sent.add(context.applicationId)
