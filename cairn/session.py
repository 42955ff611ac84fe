"""Session settings, and shipping this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session as tests and bench.py use it; on a cluster the submitter's settings hold."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("cairn")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("CAIRN_DRIVER_MEMORY", "8g"),
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        # the driver serves the file as long as it runs
        d = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        with zipfile.ZipFile(f"{d}/cairn.zip", "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(f"{d}/cairn.zip")
        _shipped.add(app)
    return spark
