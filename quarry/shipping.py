"""Give executors this package's code, for sessions that were not started with it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per context: the package as an archive that Spark sends to every executor."""
    if getattr(spark.sparkContext, "_quarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    held = tempfile.mkdtemp(prefix="quarry-code-")
    shutil.copytree(root, Path(held) / "code" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{held}/quarry", "zip", f"{held}/code"))
    spark.sparkContext._quarry_shipped = True
