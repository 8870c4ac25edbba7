"""Session builder with the settings that the engine expects."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def settings(cpus: int | None = None, shuffle_partitions: int | None = None) -> dict[str, str]:
    """What a session gets where nothing else is set; the master, the number of partitions and the memory only fit one
    machine."""
    n = cpus or os.cpu_count() or 4
    return {
        "spark.master": os.environ.get("SPARK_MASTER", f"local[{n}]"), "spark.sql.shuffle.partitions": str(shuffle_partitions or n), "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "12g"),
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }


_LOCAL_ONLY = ("spark.sql.shuffle.partitions", "spark.driver.memory")


def build_session(app: str = "querylume", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session. Under spark-submit every setting of the submitter wins, and what only fits one machine is left alone if
    the master is a cluster; else it is a local session for tests and benchmarks. The package is sent to the executors."""
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # under spark-submit, whose JVM has what was submitted
        SparkContext._ensure_initialized()
    conf, wanted = SparkConf(), settings(cpus, shuffle_partitions)
    master = conf.get("spark.master", wanted["spark.master"])
    for key, value in wanted.items():
        if not conf.contains(key) and (key not in _LOCAL_ONLY or master.startswith("local")):
            conf.set(key, value)
    spark = SparkSession.builder.config(conf=conf).appName(app).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, wherever the session was started."""
    if not any(f.endswith(f"/{PACKAGE.name}.zip") for f in spark.sparkContext.listFiles):
        folder = tempfile.mkdtemp(prefix="package-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{PACKAGE.name}", "zip", PACKAGE.parent, PACKAGE.name))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file as long as it runs
