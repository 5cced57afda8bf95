"""Session settings the jobs rely on."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on; leave sizing to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    _ship_package(spark)
    return spark


def _ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers of the application, once."""
    context = spark.sparkContext
    if getattr(context, "_glossaflow_shipped", False):
        return
    package = Path(__file__).parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}", "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    context._glossaflow_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's checkpoint folder.

    Every executor can reach that folder.  Only where it is unset, as in local tests, is a folder
    of this machine used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    run = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
    return f"{root.rstrip('/')}/{name}-{run}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, however often it is used.

    Its size is known from its files, so Spark's own check decides about broadcasts, and what was
    computed survives a lost executor.
    """
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
