"""Let Python workers import this package where the driver alone can."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """The driver serves a zip of the package to all executors. Where everything runs in one process nothing has to be done if PYTHONPATH or the working folder names the repository."""
    if getattr(spark.sparkContext, "_graphloom_shipped", False):
        return
    places = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) and (ROOT in places or Path.cwd() == ROOT):
        return
    out = Path(tempfile.mkdtemp(prefix="graphloom-code-")) / "graphloom_code.zip"  # on the driver; executors fetch it from there
    with zipfile.ZipFile(out, "w") as z:
        for p in (ROOT / "graphloom").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(out))
    spark.sparkContext._graphloom_shipped = True
