"""Tables written in order, so that a page is found by counting, not by sorting what comes before.

Rows lie in ranges of the order, each range sorted in its own files.  A page opens the ranges that
its places fall in; where these are follows from the ranges' numbers of rows, which are kept, or,
under a filter, counted from the filter's columns alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RANGE = "_range"


def write_ranked(rows: DataFrame, path: str, order: list[Column], ranges: int | None = None) -> None:
    """Write the rows by ranges of ``order``, which should tell all rows apart.

    Without a number of ranges, Spark makes them of the size it aims at for partitions.
    """
    ranged = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    ranged.withColumn(_RANGE, F.spark_partition_id()).write.partitionBy(_RANGE).parquet(f"{path}/rows")
    stored = rows.sparkSession.read.schema(f"{_RANGE} int").parquet(f"{path}/rows")
    stored.groupBy(_RANGE).agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/counts")


def read_ranked(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop(_RANGE)


def read_page(
    spark: SparkSession, path: str, order: list[Column], limit: int, offset: int = 0, where: Column | None = None
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order, with their ``rank`` from 0 and the ``total``.

    The driver reads a number for each range.  Only the page's ranges are read for their rows, each
    ranked on its own.
    """
    rows = spark.read.parquet(f"{path}/rows")
    if where is None:
        counts = spark.read.parquet(f"{path}/counts")
    else:
        rows = rows.where(where)
        counts = rows.groupBy(_RANGE).agg(F.count("*").alias("n"))
    starts, total = {}, 0
    for row in counts.orderBy(_RANGE).collect():
        starts[row[_RANGE]], total = (total, total + row["n"]), total + row["n"]
    opened = {k: begin for k, (begin, end) in starts.items() if end > offset and begin < offset + limit}
    start = F.lit(0).cast("bigint")
    for k, begin in opened.items():
        start = F.when(F.col(_RANGE) == k, F.lit(begin)).otherwise(start)
    within = Window.partitionBy(_RANGE).orderBy(*order)
    return (
        rows.where(F.col(_RANGE).isin(*opened))
        .withColumn("rank", start + F.row_number().over(within) - 1)
        .where((F.col("rank") >= offset) & (F.col("rank") < offset + limit))
        .drop(_RANGE)
        .withColumn("total", F.lit(total).cast("bigint"))
    )
