"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossaflow.session import configure, shared_folder

SPACE_CLASS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows handed to Python at once.  Texts may be long, so a batch is small.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of the library, and small batches for Python."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a written table in the folder that all executors share.

    What was computed survives a lost executor, is computed once however often it is used, and
    has a known size, so that Spark's own size check decides about broadcasts.
    """
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def numbered(frame: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with a number from 0 in the given order, without sorting them in one task.

    Rows are dealt into ranges and sorted there; the driver adds up one count for each range.
    """
    ranged = (
        frame.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    kept = cut(ranged, "numbered")
    part = F.shiftright("_place", 33)
    counts = kept.groupBy(part.alias("part")).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return (
        kept.withColumn("_part", part)
        .join(F.broadcast(starts), F.col("_part") == F.col("part"))
        .withColumn(name, F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_place", "_part", "part", "_start")
    )
