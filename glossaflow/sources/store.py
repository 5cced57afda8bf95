"""The tables of the translation store as partitioned parquet, and assembled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def job_bucket(job: Column) -> Column:
    return F.pmod(F.xxhash64(job), F.lit(BUCKETS)).cast("int")


def hash_prefix(source_hash: Column) -> Column:
    return F.substring(source_hash, 1, 2)


# Tables that are read by key carry a derived partition column, so that a lookup reads one part.
PARTITIONS = {
    "chunks": ("job_bucket", lambda: job_bucket(F.col("job_id"))),
    "tm": ("hash_prefix", lambda: hash_prefix(F.col("source_hash"))),
}


def write_table(rows: DataFrame, root: str, name: str, mode: str = "errorifexists") -> None:
    """Write a table; rows of a partition meet before the write, so it makes few files.

    A large partition is split by adaptive execution, so one hot job does not end in one task.
    """
    if name in PARTITIONS:
        column, derive = PARTITIONS[name]
        bucketed = rows.withColumn(column, derive()).hint("rebalance", column)
        bucketed.write.mode(mode).partitionBy(column).option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(f"{root}/{name}")
    else:
        rows.write.mode(mode).parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{root}/{name}")
    return rows.drop(PARTITIONS[name][0]) if name in PARTITIONS else rows


def read_job_chunks(spark: SparkSession, root: str, job_id: str) -> DataFrame:
    """Chunks of one job, read from its partition alone."""
    rows = spark.read.parquet(f"{root}/chunks")
    return rows.where(F.col("job_bucket") == job_bucket(F.lit(job_id))).where(
        F.col("job_id") == job_id
    ).drop("job_bucket")


def assembled_blocks(rendered: DataFrame, key: str) -> DataFrame:
    """Output blocks in reading order over all documents, chunk numbers as numbers.

    Range partitioning on the full order lets a large document span several partitions.
    """
    order = [key, "chunk_index", "block_pos"]
    return (
        rendered.select(*order, "type", "output_level", "output_text")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )


def assembled_texts(rendered: DataFrame, key: str) -> DataFrame:
    """One text a document; a document is bounded by the size limit of source files."""
    entries = F.array_sort(F.collect_list(F.struct("chunk_index", "block_pos", "output_text")))
    return rendered.groupBy(key).agg(
        F.array_join(F.transform(entries, lambda e: e["output_text"]), "\n\n").alias("text")
    )


def held_back(rendered: DataFrame, complete: DataFrame, key: str = "job_id") -> DataFrame:
    """The blocks of the jobs that can be assembled; ``complete`` is a completeness report."""
    ready = complete.where("reason IS NULL").select(key)
    return rendered.join(ready, key, "left_semi")


def write_assembled(
    rendered: DataFrame,
    path: str,
    key: str = "job_id",
    complete: DataFrame | None = None,
    incomplete_too: bool = False,
) -> None:
    """Write output blocks in order, of jobs without a reason against it in the completeness report.

    Jobs are held back unless ``incomplete_too`` says that what is there is wanted; without a report
    nothing can be told to be complete, so it must be given.
    """
    if complete is None and not incomplete_too:
        raise ValueError("give the completeness report, or ask for incomplete jobs too")
    ready = rendered if incomplete_too else held_back(rendered, complete, key)
    assembled_blocks(ready, key).write.parquet(path)
