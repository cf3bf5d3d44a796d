"""Session defaults, and the package itself for Python workers that do not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: For local runs; a cluster brings its own.
DEFAULTS = {
    "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]")
    for key, value in {**DEFAULTS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the workers of this context, once."""
    context = spark.sparkContext
    if not getattr(context, "_quillspark_shipped", False):
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="quillspark-src-")) / "quillspark.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(target))
        context._quillspark_shipped = True
    return spark
