"""Streams with state of their own: status by key with expiry, results once, seconds left.

Unlike the merges of ``status``, these keep what they need in the stream's state store, and let go
of it when the watermark says that nothing more can come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from glossaflow.operators.jobs import eta_seconds
from glossaflow.sources.versions import VersionedTable
from glossaflow.streaming.status import drain

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks(spark: SparkSession) -> None:
    """State on the executors' disks rather than in their heaps, with changelogs in the checkpoint."""
    spark.conf.set(_PROVIDER, _ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def status_changes(events: DataFrame, job: str, chunk: str, delay: str, keep_hours: float) -> DataFrame:
    """A stream of the status that counts of each chunk; ``events`` has status, ts and event_id.

    An aggregate by the chunk and by spans of the time at which an event's state may go, ``keep_hours``
    after it, so a chunk has a row of state for each span it has events in, and state goes when the
    watermark has passed its span.  A row comes out where a batch touches it.  Rows that are later than
    the watermark by ``keep_hours`` and the rest of their span are dropped.
    """
    use_rocks(events.sparkSession)
    keep = int(keep_hours * 3_600_000)
    rows = events.select(
        job, chunk, "status",
        F.col("status").eqNullSafe("completed").alias("final"),
        F.unix_micros("ts").alias("micros"),
        F.col("event_id").cast("long").alias("event_id"),
        F.timestamp_micros(F.unix_micros("ts") + F.lit(keep * 1000)).alias("until"),
    )
    # The watermark is that of ``ts`` by ``delay``.
    late = rows.withWatermark("until", f"{delay} {keep} milliseconds")
    spans = late.groupBy(job, chunk, F.window("until", f"{keep} milliseconds"))
    return _newest(spans, "micros").select(job, chunk, "k.*", "updated")


def _newest(groups: GroupedData, time: str) -> DataFrame:
    """Completed is final, otherwise the newest event counts."""
    kept = F.max_by(F.struct("status", "final", "micros", "event_id"), F.struct("final", "micros", "event_id"))
    return groups.agg(kept.alias("k"), F.max(time).alias("updated"))


def stream_status_with_state(
    events: DataFrame, job: str, chunk: str, folder: str, delay: str = "1 day", keep_hours: float = 24 * 14
) -> DataFrame:
    """Status of each chunk from a stream; what a batch changes is merged into the table of all chunks.

    A chunk whose state has gone is still in the table, and completed stays final there.
    """
    table = VersionedTable(events.sparkSession, f"{folder}/table", [job, chunk])

    def newer(old: DataFrame, new: DataFrame) -> DataFrame:
        return _newest(old.unionByName(new).groupBy(job, chunk), "updated").select(job, chunk, "k.*", "updated")

    def merge(batch: DataFrame, number: int) -> None:
        # The batch is used once: each use would run the state's step again.
        table.upsert(batch, newer, change=number)
        table.expire()

    query = (
        status_changes(events, job, chunk, delay, keep_hours)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(merge)
        .start()
    )
    query.awaitTermination()
    return table.read().select(job, chunk, "status", F.timestamp_micros("updated").alias("updated_at"))


def once_within(results: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Each result once among those that come within the delay of each other; state goes after it."""
    use_rocks(results.sparkSession)
    return results.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def stream_once_within(results: DataFrame, keys: list[str], folder: str, delay: str = "1 day") -> DataFrame:
    return drain(once_within(results, keys, delay), folder, mode="append").drop("batch")


def left_by_job(
    events: DataFrame, totals: DataFrame, job: str, width: str, period: str, delay: str
) -> DataFrame:
    """Per job and period: finished and failed chunks, and seconds left at the period's rate.

    Results are counted by window, and the windows by job: two stateful operators in one stream, so
    the second keeps one row a job and period, however many events there are.  ``totals`` is a table
    of (job, total_chunks).  A period is final, and given out, when the watermark has passed it.
    """
    use_rocks(events.sparkSession)
    counted = (
        events.withWatermark("ts", delay)
        .groupBy(job, F.window("ts", width))
        .agg(
            F.count_if(F.col("status") == "completed").alias("completed"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
    )
    spans = counted.withColumns({"first": F.col("window.start"), "last": F.col("window.end")})
    by_job = spans.groupBy(job, F.window(F.window_time("window"), period)).agg(
        F.sum("completed").alias("completed"),
        F.sum("failed").alias("failed"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    elapsed = (F.unix_micros("last") - F.unix_micros("first")) / F.lit(1e6)
    left = eta_seconds(F.col("total_chunks"), F.col("completed"), F.col("failed"), elapsed)
    return by_job.join(totals, job).select(
        job, F.col("window.start").alias("period_start"), "completed", "failed", left.alias("seconds_left")
    )


def stream_seconds_left(
    events: DataFrame, totals: DataFrame, job: str, folder: str,
    width: str = "1 day", period: str = "30 days", delay: str = "1 day",
) -> DataFrame:
    return drain(left_by_job(events, totals, job, width, period, delay), folder, mode="append").drop("batch")
