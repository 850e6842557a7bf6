"""Takes the package to the workers where they would not find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files once, unless PYTHONPATH already leads the workers to it."""
    app = spark.sparkContext.applicationId
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _sent or ROOT in paths:
        return
    path = Path(tempfile.mkdtemp(prefix="spacemill-")) / "spacemill.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "spacemill").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
        for f in ROOT.glob("corpus_pipeline.py"):
            z.write(f, f.name)
    spark.sparkContext.addPyFile(str(path))
    _sent.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = getattr(query, "__name__", "query"), query.__doc__
    return run
