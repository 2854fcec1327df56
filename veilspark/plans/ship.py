"""The library's own files, brought to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session once, so that Python workers find it wherever they run."""
    sc = spark.sparkContext
    if not getattr(sc, "_veilspark_shipped", False):
        path = Path(tempfile.mkdtemp(prefix="veil-")) / "veilspark.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(ROOT.glob("veilspark/**/*.py")):
                z.write(p, p.relative_to(ROOT))
        sc.addPyFile(str(path))
        sc._veilspark_shipped = True
    return spark
