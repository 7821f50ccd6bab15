"""Getting this package to Python workers that cannot import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]


def ensure_importable(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once, unless workers find it by PYTHONPATH or, where they run on
    this machine, by the driver's folder."""
    paths = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)] if os.environ.get("PYTHONPATH") else []
    context = spark.sparkContext
    here = [Path.cwd()] if context.master.startswith("local") else []
    if ROOT in [*paths, *here] or getattr(context, "_geoloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="geoloom-")) / "geoloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted((ROOT / "geoloom").rglob("*.py")):
            z.write(source, source.relative_to(ROOT))
    context.addPyFile(str(archive))
    context._geoloom_shipped = True
