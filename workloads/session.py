"""Local session for tests, checks and the benchmark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(name: str, cpus: int | None = None, **conf: str) -> SparkSession:
    """``conf``: more settings, with ``__`` for each dot in their names.

    Without a shared folder among them, intermediates go to one that the process removes.
    """
    cpus = cpus or os.cpu_count() or 8
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    if "spark.checkpoint.dir" not in conf:
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="riskfold-")
        atexit.register(shutil.rmtree, conf["spark.checkpoint.dir"], True)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.scheduler.mode", "FAIR")
        .config(map=conf)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
