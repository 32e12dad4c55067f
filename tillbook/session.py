"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "tillbook", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every report relies on.

    On a cluster leave ``master`` unset: resources, shuffle partitions and
    ``spark.checkpoint.dir`` come from the cluster's own configuration.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # lists are collected in hash maps up to so many keys of a task before they are sorted
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
        # checkpoints of an iterative job go when its DataFrames do
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """Local session for tests and the benchmark."""
    return build_session(
        "tillbook-local",
        f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": str(cores if cores != "*" else os.cpu_count()),
            "spark.driver.memory": memory,
            "spark.ui.enabled": "false",
            "spark.sql.files.openCostInBytes": "262144",
            **conf,
        },
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Every executor must be able to reach it, so a machine-local folder is made
    only when the session itself is local and nothing is configured; it goes
    when the process ends.
    """
    folder = spark.conf.get(_CHECKPOINT_KEY, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder every executor can reach")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="tillbook-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: an iterative job survives lost executors and keeps its plan short."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
