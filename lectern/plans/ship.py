"""Getting the package to Python workers that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def workers_find_it() -> bool:
    """Whether workers started by this process inherit a path to the package."""
    here = str(PACKAGE.parent)
    return here in map(os.path.abspath, os.environ.get("PYTHONPATH", "").split(os.pathsep)) or os.getcwd() == here


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers of a session, once, unless they find it anyway."""
    app = spark.sparkContext.applicationId
    if app in _sent or workers_find_it():
        return
    archive = Path(tempfile.mkdtemp(prefix="lectern-")) / "lectern.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(archive))
    _sent.add(app)
