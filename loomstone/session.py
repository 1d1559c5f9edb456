"""A session with the settings the engine is tested with; on a cluster, pass the cluster's own session instead."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "loomstone", cpus: str | int | None = None, partitions: int = 8) -> SparkSession:
    cpus = cpus or os.environ.get("LOOMSTONE_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LOOMSTONE_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.warehouse.dir", "/tmp/loomstone-warehouse")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context: they needn't have it on their path, whatever folder the driver runs in.

    The archive is served by the driver, as any file given to addPyFile, from the folder that PySpark removes at its end.
    """
    sc = spark.sparkContext
    if getattr(sc, "_loomstone_sent", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(sc._temp_dir, "loomstone.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._loomstone_sent = True
