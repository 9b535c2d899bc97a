"""The engine's Spark session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the engine's defaults; on a cluster give no master, spark-submit names it."""
    b = SparkSession.builder.appName("millrace")
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **(conf or {})}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once a session.

    Nothing is sent where they find it already: in PYTHONPATH or, in local mode,
    in the working folder.
    """
    package = os.path.dirname(os.path.realpath(__file__))
    root, sc = os.path.dirname(package), spark.sparkContext
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    if getattr(sc, "_millrace_shipped", False) or any(os.path.realpath(p) == root for p in known):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._millrace_shipped = True
