"""Making this library importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once per application, unless their PYTHONPATH or folder has it."""
    app = spark.sparkContext.applicationId
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if app in _shipped or ROOT.parent in known:
        return
    path = Path(tempfile.mkdtemp(prefix="stemmata-")) / f"{ROOT.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(ROOT.rglob("*.py")):
            out.write(source, source.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
