"""Makes this package importable on the executors, wherever the session came from, and keeps their Arrow batches small."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the application's Python workers, once (SparkContext.addPyFile).

    Spark's default of 10,000 rows in an Arrow batch is lowered to 2,000, because texts
    can be long; any other setting stays.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "2000")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        with tempfile.TemporaryDirectory() as staging:
            shutil.copytree(package, f"{staging}/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
            served = tempfile.mkdtemp()  # executors fetch it from here as long as the driver lives
            atexit.register(shutil.rmtree, served, ignore_errors=True)
            archive = shutil.make_archive(f"{served}/{package.name}", "zip", staging)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
