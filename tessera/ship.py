"""Makes the package importable in Python workers that were started elsewhere."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, unless their PYTHONPATH has them already."""
    sc = spark.sparkContext
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.applicationId in _shipped or ROOT in known:
        return
    to = Path(tempfile.mkdtemp(prefix="tessera-src-")) / "tessera.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((ROOT / "tessera").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)
    if str(to) in sys.path:  # the driver goes on with the sources themselves
        sys.path.remove(str(to))
