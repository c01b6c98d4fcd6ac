"""Getting this package to the Python workers where they could not import it."""

from __future__ import annotations

import os
import site
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

NAME = "sparkward.zip"
ROOT = Path(__file__).resolve().parent.parent


def importable() -> bool:
    """Whether workers find the package by themselves: in the working folder, on PYTHONPATH, or installed."""
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
    return any(p and Path(p).resolve() == ROOT for p in places)


def ensure_workers(spark: SparkSession) -> None:
    """Send the package's source to all workers once, by Spark's own file server, unless they have it anyway."""
    context = spark.sparkContext
    if importable() or NAME in context._python_includes:
        return
    path = Path(tempfile.mkdtemp()) / NAME  # the driver serves this file; executors fetch it
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted((ROOT / "sparkward").rglob("*.py")):
            z.write(source, source.relative_to(ROOT))
    context.addPyFile(str(path))
