"""Session helpers: where intermediate results go and how lineage is cut."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from the session. Only a session on one machine, as in tests, may name
    none; a temporary folder takes its place there.
    """
    sc = spark.sparkContext
    path = sc.getConf().get(CHECKPOINT_KEY) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-gridloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from the written copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context (as --py-files would)."""
    sc = spark.sparkContext
    if not getattr(sc, "_gridloom_shipped", False):
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="spark-gridloom-")
        stage = os.path.join(folder, "stage")
        shutil.copytree(root, os.path.join(stage, root.name), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "gridloom_package"), "zip", stage))
        sc._gridloom_shipped = True


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
