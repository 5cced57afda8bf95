"""Streaming versions of the status and memory tables.

Late rows: those older than the newest event time by more than ``delay`` are left out of windowed
counts.  Each windowed stream writes per micro-batch below a folder, under the batch number, so a
batch that runs again replaces itself.

Tables of the newest state of a key hold no state in the stream: each micro-batch is reduced and
merged into a store on disk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.operators.memory import build_tm, upsert_tm
from glossaflow.sources.versions import VersionedTable


def read_stream(spark: SparkSession, folder: str, schema, file_filter: str | None = None) -> DataFrame:
    """A stream of the parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    if file_filter:
        reader = reader.option("pathGlobFilter", file_filter)
    return reader.parquet(folder)


def with_event_time(rows: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need an instant; a local timestamp is read as UTC, the session's time zone."""
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def drain(
    rows: DataFrame, folder: str, mode: str = "update", prepare: Callable | None = None
) -> DataFrame:
    """Run a stream over what is there now and return what it wrote, with the batch number."""
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        out = prepare(batch) if prepare else batch
        out.write.mode("overwrite").parquet(f"{folder}/data/batch={number}")

    query = (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/data")


def newest(written: DataFrame, keys: list[str]) -> DataFrame:
    """The last emitted row of each key."""
    values = [c for c in written.columns if c not in [*keys, "batch"]]
    return written.groupBy(*keys).agg(
        *[F.max_by(c, "batch").alias(c) for c in values]
    )


def latest_status(events: DataFrame, job: str, chunk: str) -> DataFrame:
    """Status of each chunk: completed is final, otherwise the newest event counts.

    An aggregate over an ordering that does not depend on arrival: late and repeated results leave
    a completed chunk as it is.  Works on a stream and on a table alike.
    """
    rank = F.struct((F.col("status") == "completed").alias("final"), "ts", "event_id")
    return events.groupBy(job, chunk).agg(
        F.max_by("status", rank).alias("status"), F.max("ts").alias("updated_at")
    )


def merge_stream(
    rows: DataFrame,
    folder: str,
    keys: list[str],
    prepare: Callable[[DataFrame], DataFrame],
    combine: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """Run a stream over what is there now into a table of one row a key, and return its rows.

    A micro-batch is reduced by ``prepare`` and merged by ``combine`` (old, new) with the groups of
    files that hold its keys, no others; groups split as the table grows.  The table remembers the
    number of the last batch, so a batch that runs again counts nothing twice.
    """
    table = VersionedTable(rows.sparkSession, f"{folder}/data", keys)

    def write(batch: DataFrame, number: int) -> None:
        table.upsert(prepare(batch), combine, change=number)
        table.expire()

    query = (
        rows.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return table.read()


def stream_latest_status(events: DataFrame, job: str, chunk: str, folder: str) -> DataFrame:
    """Status of each chunk, as ``latest_status`` has it, from a stream with repeated and late rows.

    The reduced rows keep what decides, so merging them is the same reduction again.
    """
    keys = [job, chunk]
    rank = F.struct("final", "ts", "event_id")

    def prepare(batch: DataFrame) -> DataFrame:
        ranked = batch.select(*keys, "status", "ts", "event_id", F.col("ts").alias("updated_at"))
        return reduce_(ranked.withColumn("final", F.col("status") == "completed"))

    def reduce_(rows: DataFrame) -> DataFrame:
        kept = F.max_by(F.struct("status", "final", "ts", "event_id"), rank)
        return rows.groupBy(*keys).agg(kept.alias("k"), F.max("updated_at").alias("updated_at")).select(
            *keys, "k.*", "updated_at"
        )

    found = merge_stream(events, folder, keys, prepare, lambda old, new: reduce_(old.unionByName(new)))
    return found.select(*keys, "status", "updated_at")


def windowed_progress(events: DataFrame, job: str, width: str, delay: str) -> DataFrame:
    """Finished and failed results per job and tumbling window, and finished ones an hour."""
    hours = (
        F.unix_micros(F.col("window.end")) - F.unix_micros(F.col("window.start"))
    ) / F.lit(3.6e9)
    return (
        events.withWatermark("ts", delay)
        .groupBy(job, F.window("ts", width))
        .agg(
            F.count_if(F.col("status") == "completed").alias("completed"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
        .select(
            job,
            F.col("window.start").alias("window_start"),
            "completed",
            "failed",
            (F.col("completed") / hours).alias("completed_per_hour"),
        )
    )


def stream_progress(
    events: DataFrame, job: str, folder: str, width: str = "1 day", delay: str = "1 day"
) -> DataFrame:
    written = drain(windowed_progress(events, job, width, delay), folder)
    return newest(written, [job, "window_start"])


def windowed_errors(errors: DataFrame, width: str, delay: str) -> DataFrame:
    return (
        errors.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "error_type", "severity")
        .agg(F.count("*").alias("errors"))
        .select(
            F.col("window.start").alias("window_start"), "error_type", "severity", "errors"
        )
    )


def stream_errors(
    errors: DataFrame, folder: str, width: str = "1 day", delay: str = "1 day"
) -> DataFrame:
    """Errors by type and severity per window."""
    written = drain(windowed_errors(errors, width, delay), folder)
    return newest(written, ["window_start", "error_type", "severity"])


def stream_dedup_results(results: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Each result once, the one that arrived first; of one micro-batch, the earliest.

    What came before is in the store, not in the stream's state, so repeats may come at any time.
    """
    columns = results.columns

    def once(rows: DataFrame) -> DataFrame:
        first = F.min_by(F.struct(*columns), F.struct("_new", "ts"))
        return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first.alias("k")).select("k.*")

    return merge_stream(
        results,
        folder,
        keys,
        lambda batch: once(batch.withColumn("_new", F.lit(1))),
        lambda old, new: once(
            old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        ),
    )


def stream_tm_upsert(pairs: DataFrame, order: list[str], folder: str, language: str = "ar") -> DataFrame:
    """Memory kept from a stream of pairs: texts are written once, counts are merged by their hashes.

    An entry's texts never change, so they stay in the folder of the batch that brought them; what a
    batch rewrites is narrow.  A batch whose number the counts hold already does nothing.
    """
    spark, keys = pairs.sparkSession, ["source_hash", "target_language"]
    counts = VersionedTable(spark, f"{folder}/data", keys)
    texts = ["source_text", "target_text"]

    def write(batch: DataFrame, number: int) -> None:
        version = counts.current()
        if number <= version.change:
            return
        entries = build_tm(batch, [F.col(c) for c in order], language)
        if version.schema is None:
            fresh = entries.withColumn("known", F.lit(False))
        else:
            # The entries lie by their hashes already: what is shuffled for this is the known hashes.
            known = counts.read().select(*keys, F.lit(True).alias("known"))
            fresh = entries.join(known, keys, "left").withColumn("known", F.col("known").isNotNull())
        path = f"{folder}/texts/batch={number}"
        kept = {c: F.when(~F.col("known"), F.col(c)) for c in texts}
        fresh.withColumns(kept).write.mode("overwrite").parquet(path)
        counts.upsert(spark.read.schema(fresh.schema).parquet(path).drop("known", *texts), upsert_tm, change=number)
        counts.expire()

    query = (
        pairs.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    said = spark.read.parquet(f"{folder}/texts").where(~F.col("known")).select(*keys, *texts)
    return counts.read().select(*keys, "use_count").join(said, keys).select(*keys, *texts, "use_count")
