"""Makes the package importable in the Python workers of executors that don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's sources, some tens of KB, to the files of the application, once."""
    sc = spark.sparkContext
    if not getattr(sc, "_saxframe_shipped", False):
        here = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="saxframe-")) / "saxframe.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(str(to))
        sc._saxframe_shipped = True
    return spark
