"""A session with the settings the engine expects."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[*]", shuffle_partitions: int = 8, driver_memory: str = "4g", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("spanloom").config("spark.driver.memory", driver_memory)
    for k, v in {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver found it; once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parents[1]
    paths = [str(root), context.environment.get("PYTHONPATH", "")]
    context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, paths))
    if not context.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="spanloom-code-")
        atexit.register(shutil.rmtree, folder, True)
        context.addPyFile(shutil.make_archive(f"{folder}/spanloom", "zip", root, "spanloom"))
