"""Hand this package to the executors, as `--py-files` would, where it isn't installed on them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).parent


def ship(spark: SparkSession) -> None:
    """Once per Spark context; cheap after that."""
    context = spark.sparkContext
    if getattr(context, "_chronofact_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="chronofact-ship-")) / "chronofact_package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(_ROOT.rglob("*.py")):
            out.write(source, f"chronofact/{source.relative_to(_ROOT)}")
    context.addPyFile(str(path))
    context._chronofact_shipped = True
