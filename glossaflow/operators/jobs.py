"""Jobs and their chunks: progress, dashboards, listings, state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaflow.functions.text import preview
from glossaflow.operators.terms import page_of
from glossaflow.schema import ACTIVE_STATUSES, RESUMABLE_STATUSES

# Page sizes and the number of finished chunks an estimate needs.
RECENT = 8
RECENT_ERRORS = 10
CLAIM_LIMIT = 4
ETA_MINIMUM = 3
OPEN_STATUSES = ("pending", "failed", "translating")
#: What a chunk has before it is first translated.
FRESH = {"translation": None, "attempts": 0, "prompt_tokens_used": 0, "completion_tokens_used": 0}
# What a parked job says.
INTERRUPTED = "The run was cut off; resume the job to go on."
PAUSED = "The job is on hold; resume it to go on."


def progress_percentage(done: Column, total: Column) -> Column:
    share = done.cast("double") / total * 100
    return F.when(total > 0, F.bround(share, 1)).otherwise(F.lit(0.0))


def eta_seconds(total: Column, completed: Column, failed: Column, elapsed: Column) -> Column:
    """Seconds left at the rate so far; null below three finished chunks."""
    rate = completed / F.greatest(F.lit(1.0), elapsed.cast("double"))
    left = (total - completed - failed) / F.greatest(rate, F.lit(1e-6))
    return F.when(completed >= ETA_MINIMUM, F.bround(left, 0))


def job_progress(chunks: DataFrame, job: str = "job_id", time: str | None = None) -> DataFrame:
    """Counts, percentage and current chunk of each job; with ``time`` also the seconds left.

    ``chunks`` has job, chunk_index, status, chapter, section.
    """
    status = F.col("status")
    current = F.min_by(
        F.struct("chunk_index", "chapter", "section"),
        F.when(status == "translating", F.col("chunk_index")),
    )
    counts = [
        F.count("*").alias("total_chunks"),
        F.count_if(status == "completed").alias("completed_chunks"),
        F.count_if(status == "failed").alias("failed_chunks"),
        current.alias("_current"),
    ]
    if time:
        elapsed = F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))
        counts.append((elapsed / F.lit(1e6)).alias("elapsed_seconds"))
    total, done, failed = (
        F.col(c) for c in ("total_chunks", "completed_chunks", "failed_chunks")
    )
    progress = chunks.groupBy(job).agg(*counts).select(
        "*",
        F.col("_current.chunk_index").alias("current_chunk_index"),
        F.col("_current.chapter").alias("current_chapter"),
        F.col("_current.section").alias("current_section"),
        progress_percentage(done + failed, total).alias("progress_percentage"),
    )
    if time:
        progress = progress.withColumn(
            "eta_seconds", eta_seconds(total, done, failed, F.col("elapsed_seconds"))
        )
    return progress.drop("_current")


def dashboard_counts(
    jobs: DataFrame, documents: DataFrame, terms: DataFrame, tm: DataFrame
) -> DataFrame:
    """The figures of the start page: one pass over the jobs, counts as scalar subqueries."""
    status = F.col("status")
    return jobs.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(status == "completed").alias("completed_jobs"),
        F.count_if(status.isin(*ACTIVE_STATUSES)).alias("active_jobs"),
        F.count_if(status == "failed").alias("failed_jobs"),
        F.count_if(status == "paused").alias("paused_jobs"),
    ).withColumns(
        {
            "total_documents": documents.agg(F.count("*")).scalar(),
            "total_terms": terms.agg(F.count("*")).scalar(),
            "total_memory_entries": tm.agg(F.count("*")).scalar(),
        }
    )


def job_totals(jobs: DataFrame, *by: Column | str, nested: bool = False) -> DataFrame:
    """Counts of jobs by several columns, with all totals, in one aggregate.

    Totals are over every choice of the columns (cube), or with ``nested`` over the leading ones
    (rollup).  ``level`` tells which: a bit for each column that is added up, the first the highest,
    so that a total is told from a group of nulls.
    """
    status = F.col("status")
    grouped = jobs.rollup(*by) if nested else jobs.cube(*by)
    return grouped.agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("jobs"),
        F.count_if(status == "completed").alias("completed_jobs"),
        F.count_if(status.isin(*ACTIVE_STATUSES)).alias("active_jobs"),
        F.count_if(status == "failed").alias("failed_jobs"),
        F.count_if(status == "paused").alias("paused_jobs"),
    )


def recent(rows: DataFrame, time: str, tie: str, k: int = RECENT) -> DataFrame:
    return rows.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(k)


def recent_errors(errors: DataFrame, job: str = "job_id", k: int = RECENT_ERRORS) -> DataFrame:
    """The newest errors of each job."""
    order = Window.partitionBy(job).orderBy(F.col("id").desc())
    return errors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def list_chunks(
    chunks: DataFrame, job_id, status: str | None = None, limit: int = 100, offset: int = 0
) -> DataFrame:
    """A page of one job's chunks in order, with short previews."""
    found = chunks.where(F.col("job_id") == job_id)
    if status:
        found = found.where(F.col("status") == status)
    return (
        found.orderBy("chunk_index")
        .offset(offset)
        .limit(limit)
        .withColumn("source_preview", preview(F.col("source_text")))
        .withColumn("translation_preview", preview(F.col("translation")))
        .drop("source_text", "translation", "source_blocks")
    )


def claim_batch(chunks: DataFrame, jobs: DataFrame, limit: int = CLAIM_LIMIT) -> DataFrame:
    """The next pending chunks of translating jobs: oldest job first, then chunk order."""
    working = jobs.where("status = 'translating'").select(
        F.col("id").alias("job_id"), "updated_at"
    )
    return (
        chunks.where("status = 'pending'")
        .join(working, "job_id")
        .orderBy("updated_at", "job_id", "chunk_index")
        .limit(limit)
    )


def open_work(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Translating jobs, and their chunks that are not finished."""
    working = jobs.where("status = 'translating'").select(F.col("id").alias("job_id"))
    open_chunks = chunks.where(F.col("status").isin(*OPEN_STATUSES)).join(
        working, "job_id", "left_semi"
    )
    return working.agg(F.count("*").alias("jobs_translating")).withColumn(
        "chunks_open", open_chunks.agg(F.count("*")).scalar()
    )


def transition(
    jobs: DataFrame,
    chunks: DataFrame,
    action: str,
    job_ids: DataFrame | None = None,
    now: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Jobs and chunks after an action on all jobs, or on those of ``job_ids`` (column ``id``).

    recover and pause park active jobs; resume queues parked or failed ones and puts back their
    chunks under way; retry_failed does so with failed chunks too; cancel ends jobs that have not
    ended, as of ``now``; retranslate puts all chunks back as if they were new: what they had of
    translations, attempts, tokens and messages is cleared.
    """
    if job_ids is None:
        picked = jobs.withColumn("_picked", F.lit(True))
    else:
        marks = job_ids.select("id").distinct().withColumn("_picked", F.lit(True))
        picked = jobs.join(marks, "id", "left").withColumn(
            "_picked", F.coalesce("_picked", F.lit(False))
        )
    status = F.col("status")
    affected, to, note = {
        "recover": (status.isin(*ACTIVE_STATUSES), "paused", INTERRUPTED),
        "pause": (status.isin(*ACTIVE_STATUSES), "paused", PAUSED),
        "resume": (status.isin(*RESUMABLE_STATUSES), "queued", None),
        "retry_failed": (status.isin(*RESUMABLE_STATUSES), "queued", None),
        "cancel": (~status.isin("completed", "cancelled"), "cancelled", None),
        "retranslate": (F.lit(True), "queued", None),
    }[action]
    hit = F.col("_picked") & affected
    message = F.col("error_message") if action == "cancel" else F.lit(note).cast("string")
    new_jobs = picked.withColumn("_hit", hit).withColumns(
        {
            "status": F.when(F.col("_hit"), to).otherwise(status),
            "error_message": F.when(F.col("_hit"), message).otherwise(F.col("error_message")),
        }
    )
    if action == "cancel" and "completed_at" in jobs.columns:
        end = (now if now is not None else F.current_timestamp()).cast(
            jobs.schema["completed_at"].dataType
        )
        new_jobs = new_jobs.withColumn(
            "completed_at", F.when(F.col("_hit"), end).otherwise(F.col("completed_at"))
        )
    put_back = {
        "resume": ("translating",),
        "retry_failed": ("translating", "failed"),
        "retranslate": ("pending", "translating", "failed", "completed", "skipped"),
    }.get(action)
    if put_back:
        # Failed chunks of every picked job are put back, those under way only where a job resumes.
        reach = F.col("_picked") if action == "retry_failed" else F.col("_hit")
        ids = new_jobs.where(reach).select(
            F.col("id").alias("job_id"), F.col("_hit").alias("_resumed")
        )
        reset = F.col("_resumed").isNotNull() & F.when(
            status == "failed", F.lit("failed" in put_back)
        ).otherwise(status.isin(*put_back) & F.col("_resumed"))
        new_chunks = (
            chunks.join(ids, "job_id", "left")
            .withColumn("_reset", reset)
            .withColumns(
                {
                    c: F.when(F.col("_reset"), F.lit(fresh).cast(chunks.schema[c].dataType)).otherwise(F.col(c))
                    for c, fresh in FRESH.items()
                    if action == "retranslate" and c in chunks.columns
                }
            )
            .withColumns(
                {
                    "error_message": F.when(
                        F.col("_reset") & ((status != "translating") | F.lit(action == "retranslate")),
                        F.lit(None).cast("string"),
                    ).otherwise(F.col("error_message")),
                    "status": F.when(F.col("_reset"), "pending").otherwise(status),
                }
            )
            .drop("_reset", "_resumed")
        )
    else:
        new_chunks = chunks
    return new_jobs.drop("_picked", "_hit"), new_chunks


def latest_completed(jobs: DataFrame, document: str = "document_id") -> DataFrame:
    """The newest finished job of each document."""
    return (
        jobs.where("status = 'completed'")
        .groupBy(document)
        .agg(F.max_by("id", F.struct("completed_at", "id")).alias("job_id"))
    )


def pending_work(chunks: DataFrame) -> DataFrame:
    """What is left to do, in order; finished chunks are not done again."""
    return chunks.where("status <> 'completed'").orderBy("job_id", "chunk_index")


def unfinished(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks without a completed result, after a restart."""
    done = results.where("status = 'completed'").select("job_id", "chunk_index")
    return chunks.join(done, ["job_id", "chunk_index"], "left_anti")


def list_documents(documents: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    order = [F.col("created_at").desc(), F.col("id").desc()]
    return page_of(documents, order, limit, offset)


def document_structure(documents: DataFrame, *keys: str, limit: int | None = None) -> DataFrame:
    """The blocks of each document, all or the first ones, with their number."""
    return documents.select(
        *keys,
        F.size("blocks").alias("total_blocks"),
        F.inline(F.col("blocks") if limit is None else F.slice("blocks", 1, limit)),
    )


def jobs_with_documents(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Every job with the name of its document, null if the document is gone."""
    names = documents.select(
        F.col("id").alias("document_id"), F.col("original_filename").alias("document_name")
    )
    return jobs.join(names, "document_id", "left")


def list_jobs(
    jobs: DataFrame, documents: DataFrame, document_id=None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """A page of jobs, newest change first.  Names are joined to the page, not to all jobs."""
    found = jobs if document_id is None else jobs.where(F.col("document_id") == document_id)
    order = [F.col("updated_at").desc(), F.col("id").desc()]
    return jobs_with_documents(page_of(found, order, limit, offset), documents)


def admit_jobs(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """For each requested document its open job, or a new one with a null id."""
    open_jobs = (
        jobs.where(F.col("status").isin(*ACTIVE_STATUSES, "paused"))
        .groupBy("document_id")
        .agg(F.min("id").alias("job_id"))
    )
    wanted = requests.select("document_id").distinct()
    return wanted.join(open_jobs, "document_id", "left").withColumn(
        "created_new", F.col("job_id").isNull()
    )


def cascade_delete(
    document_ids: DataFrame, documents: DataFrame, jobs: DataFrame, chunks: DataFrame, tm: DataFrame
) -> dict[str, DataFrame]:
    """All tables after documents are deleted: their jobs and chunks go, memory forgets the link."""
    gone = document_ids.select("id").distinct()
    gone_documents = gone.withColumnRenamed("id", "document_id")
    linked = gone_documents.withColumn("_gone", F.lit(True))
    return {
        "documents": documents.join(gone, "id", "left_anti"),
        "jobs": jobs.join(gone_documents, "document_id", "left_anti"),
        "chunks": chunks.join(gone_documents, "document_id", "left_anti"),
        "tm": tm.join(linked, "document_id", "left")
        .withColumn("document_id", F.when(F.col("_gone").isNull(), F.col("document_id")))
        .drop("_gone"),
    }


def job_outcome(results: DataFrame, job: str = "job_id") -> DataFrame:
    """Status of each job after a run: a fatal error fails it, as do failed chunks."""
    return results.groupBy(job).agg(
        F.when(F.bool_or("fatal"), "failed")
        .when(F.count_if(F.col("status") != "completed") > 0, "failed")
        .otherwise("assembling")
        .alias("status"),
        F.max(F.when(F.col("fatal"), F.col("error_message"))).alias("error_message"),
    )
