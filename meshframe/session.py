"""Sessions and what executors need of this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(name: str = "meshframe", **conf: str) -> SparkSession:
    """A session with the settings that the operators are tested with: UTC and adaptive plans."""
    builder = SparkSession.builder.appName(name)
    for k, v in ({"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, wherever the driver imported it from."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    at = os.path.join(os.path.realpath(tempfile.mkdtemp()), "meshframe.zip")
    with zipfile.ZipFile(at, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)
