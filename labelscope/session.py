"""Session defaults and the shared folder that intermediate tables go to."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. On a cluster use the session it gives you."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("labelscope")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, for functions that run in their Python workers.

    Spark's own file distribution carries a zip of it, once per application, so nothing has
    to be installed on the workers or be on their path.
    """
    context = spark.sparkContext
    if any(path.endswith("/labelscope.zip") for path in context.listFiles):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="labelscope-"), "labelscope")
    context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here)))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    `spark.checkpoint.dir` is read from the session. Only on one machine does a temporary
    folder stand in for it where it is unset; on a cluster each executor would write to a disk
    of its own and the read-back would miss rows, so that raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="labelscope-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
