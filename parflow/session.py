"""Sessions, and how the package reaches the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH, DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
_shipped: dict[str, str] = {}


def session(app: str = "parflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` keys may write dots as double underscores."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application, so that their Python workers can import it. Batches for Python are
    made shorter than Spark's default, as rows may be long texts; a setting of one's own stays."""
    app = spark.sparkContext.applicationId
    if spark.conf.get(BATCH, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(BATCH, "2000")
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        at = os.path.join(tempfile.mkdtemp(prefix="parflow-"), "parflow.zip")
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name) / p.relative_to(root))
        spark.sparkContext.addPyFile(at)
        _shipped[app] = at
    return spark
