"""Queries over jobs, chunks and assembled documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.functions import blocks as B
from glossaflow.functions.tables import CELL_SEPARATOR, number_table_rows
from glossaflow.functions.text import collapse_space, split_paragraphs, split_sentences
from glossaflow.operators import alignment, chunking, jobs, quality
from glossaflow.plans import views as V
from glossaflow.plans.structure_queries import chunk_state
from glossaflow.plans.text_queries import _NUMBERED_SQL, _SENTENCES
from glossaflow.plans.views import _WS, with_views
from glossaflow.session import shared_folder
from glossaflow.sources import store


def _progress(spark, folder):
    return jobs.job_progress(V.event_chunks(spark, folder)).drop("elapsed_seconds")


def _eta(spark, folder):
    return jobs.job_progress(V.event_chunks(spark, folder), time="updated_at").select(
        "job_id", "completed_chunks", "eta_seconds"
    )


def _dashboard(spark, folder):
    return jobs.dashboard_counts(
        V.jobs(spark, folder), V.job_documents(spark, folder), V.terms(spark, folder), V.memory(spark, folder)
    )


def _totals(nested):
    """Jobs by year, and by whether their document's number is even; some have neither."""

    def run(spark, folder):
        rows = V.jobs(spark, folder).withColumns(
            {
                "year": F.when(F.col("id") % 7 != 0, F.year("updated_at").cast("bigint")),
                "half": F.when(F.col("document_id") % 5 != 0, F.col("document_id") % 2),
            }
        )
        return jobs.job_totals(rows, "year", "half", nested=nested)

    return run


def _totals_sql(kind: str) -> str:
    return with_views(
        f"""t AS (SELECT *, CASE WHEN id % 7 <> 0 THEN year(updated_at) END AS year,
                         CASE WHEN document_id % 5 <> 0 THEN document_id % 2 END AS half FROM v_jobs)
        SELECT year, half, grouping_id(year, half) AS level, count(*) AS jobs,
               count(*) FILTER (WHERE status = 'completed') AS completed_jobs, count(*) FILTER (WHERE status IN ({_PARKED})) AS active_jobs,
               count(*) FILTER (WHERE status = 'failed') AS failed_jobs, count(*) FILTER (WHERE status = 'paused') AS paused_jobs
        FROM t GROUP BY {kind}""",
        "v_jobs",
    )


def _recent(spark, folder):
    newest = jobs.recent(V.jobs(spark, folder), "updated_at", "id")
    return jobs.jobs_with_documents(newest, V.job_documents(spark, folder)).select(
        "id", "document_name", "status", "updated_at"
    )


def _errors(spark, folder):
    errors = V.status_events(spark, folder).where("status = 'failed'")
    return jobs.recent_errors(
        errors.select("job_id", F.col("event_id").alias("id"), "chunk_index", "value")
    )


def _list_chunks(spark, folder):
    chunks = V.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("job_id"),
        F.col("turn").alias("chunk_index"),
        F.col("role").alias("status"),
        F.col("text").alias("source_text"),
        F.lit(None).cast("string").alias("translation"),
        F.array().cast("array<string>").alias("source_blocks"),
    )
    return jobs.list_chunks(chunks, 3, status="user", limit=100, offset=1)


def _claim(spark, folder):
    return jobs.claim_batch(
        V.order_chunks(spark, folder).drop("updated_at"), V.jobs(spark, folder), limit=25
    ).select("job_id", "chunk_index", "updated_at")


def _open(spark, folder):
    return jobs.open_work(V.order_chunks(spark, folder), V.jobs(spark, folder))


def _transition(action):
    def run(spark, folder):
        kept = ["job_id", "chunk_index", "status", "error_message"]
        new_jobs, new_chunks = jobs.transition(
            V.jobs(spark, folder), V.order_chunks(spark, folder).select(*kept), action
        )
        return new_jobs.select(
            F.col("id").alias("job_id"), F.lit(None).cast("int").alias("chunk_index"), "status", "error_message"
        ).unionByName(new_chunks.select(*kept))

    return run


def _latest(spark, folder):
    return jobs.latest_completed(V.jobs(spark, folder))


def _pending(spark, folder):
    return jobs.pending_work(V.event_chunks(spark, folder)).select("job_id", "chunk_index", "status")


def _unfinished(spark, folder):
    chunks = V.order_chunks(spark, folder).select("job_id", "chunk_index").distinct()
    return jobs.unfinished(chunks, V.order_chunks(spark, folder))


def _list_jobs(spark, folder):
    return jobs.list_jobs(V.jobs(spark, folder), V.job_documents(spark, folder), limit=500, offset=7).select(
        "id", "document_name", "total", "updated_at"
    )


def _admit(spark, folder):
    requests = V.job_documents(spark, folder).select(F.col("id").alias("document_id"))
    return jobs.admit_jobs(requests, V.jobs(spark, folder))


def _cascade(spark, folder):
    gone = V.table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("id")
    )
    all_jobs = V.jobs(spark, folder)
    chunks = V.order_chunks(spark, folder).join(
        all_jobs.select(F.col("id").alias("job_id"), "document_id"), "job_id"
    )
    tm = all_jobs.select("id", "document_id")
    left = jobs.cascade_delete(gone, V.job_documents(spark, folder), all_jobs, chunks, tm)
    return left["documents"].select(F.lit("document").alias("kind"), "id", F.col("id").alias("document_id")).unionByName(
        left["jobs"].select(F.lit("job").alias("kind"), "id", "document_id")
    ).unionByName(
        left["chunks"].select(F.lit("chunk").alias("kind"), F.col("job_id").alias("id"), "document_id")
    ).unionByName(left["tm"].select(F.lit("memory").alias("kind"), "id", "document_id"))


def _sentence_chunks(spark, folder) -> DataFrame:
    """Chunks of documents, each translated to one paragraph a sentence."""
    chunks = chunking.chunk_documents(V.document_blocks(spark, folder), "doc_id", maximum=1000000)
    return chunks.select(
        (F.col("doc_id") * 10000 + F.col("chunk_index")).alias("job_id"),
        "source_text",
        "source_blocks",
        F.array_join(F.transform(split_sentences(F.col("source_text")), collapse_space), "\n\n").alias("translation"),
    )


def _align(spark, folder):
    return alignment.align_chunks(_sentence_chunks(spark, folder), "job_id").select(
        "job_id", "block_pos", "translated"
    )


def _align_rows(spark, folder):
    """The same chunks with their blocks and paragraphs as rows."""
    chunks = _sentence_chunks(spark, folder)
    blocks = chunks.select("job_id", F.posexplode("source_blocks").alias("block_pos", "b")).select("job_id", "block_pos", "b.*")
    said = chunks.select("job_id", F.posexplode(split_paragraphs(F.col("translation"))).alias("pos", "text"))
    return alignment.align_rows(blocks, said, "job_id").select("job_id", "block_pos", "translated")


def _table_chunks(spark, folder) -> DataFrame:
    """A sentence and a table, translated to a sentence, the rows, and a note."""
    intro = B.make_block("paragraph", F.lit("Values follow."))
    table = intro.withField("type", F.lit("table")).withField("rows", F.col("rows"))
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, CELL_SEPARATOR)), "\n")
    return V.table_documents(spark, folder).select(
        F.col("doc_id").alias("job_id"),
        F.lit(0).alias("chunk_index"),
        F.lit("").alias("source_text"),
        B.with_seq(F.array(intro, table)).alias("source_blocks"),
        F.concat(F.lit("Intro\n\n"), number_table_rows(rows), F.lit("\n\nNote")).alias("translation"),
    )


def _render(spark, folder):
    aligned = alignment.align_chunks(_table_chunks(spark, folder), "job_id", "chunk_index")
    return alignment.render_output_blocks(aligned).select(
        "job_id", "block_pos", "type", "output_text", "output_level"
    )


def _assembled(spark, folder):
    """Chunks of all documents, translated to themselves and put together again."""
    chunks = chunking.chunk_documents(
        V.document_blocks(spark, folder), "doc_id", target=600, maximum=1000000
    ).withColumn("translation", F.col("source_text"))
    aligned = alignment.align_chunks(chunks, "doc_id", "chunk_index")
    return store.assembled_texts(alignment.render_output_blocks(aligned), "doc_id")


def _assembled_order(spark, folder):
    """The written form of the same, in order; every ninth document lacks a chunk and is held back."""
    chunks = chunking.chunk_documents(
        V.document_blocks(spark, folder), "doc_id", target=600, maximum=1000000
    ).withColumn("translation", F.col("source_text"))
    status = F.when((F.col("doc_id") % 9 == 0) & (F.col("chunk_index") == 0), "pending").otherwise("completed")
    complete = quality.completeness(chunks.withColumn("status", status), "doc_id")
    rendered = alignment.render_output_blocks(alignment.align_chunks(chunks, "doc_id", "chunk_index"))
    path = shared_folder(spark, "assembled")
    store.write_assembled(rendered, path, "doc_id", complete)
    return spark.read.parquet(path).select("doc_id", "type", "output_level", "output_text")


def _retranslated(spark, folder):
    """Chunks after a new start: nothing is left of what they had."""
    _, chunks = jobs.transition(V.jobs(spark, folder), V.order_chunks(spark, folder), "retranslate")
    return chunks.select(
        "job_id", "chunk_index", "status", "translation", "attempts", "prompt_tokens_used", "error_message"
    )


def _outcome(spark, folder):
    results = V.order_chunks(spark, folder).withColumn(
        "fatal", (F.col("status") == "failed") & (F.col("attempts") == 3)
    )
    return jobs.job_outcome(results)


_ALIGN_SQL = f"""
    {chunk_state("v_blocks", "doc_id", 4000)},
    cb AS (SELECT b.doc_id * 10000 + c AS doc_id, b.seq AS old, text,
                  row_number() OVER (PARTITION BY b.doc_id, c ORDER BY b.seq) - 1 AS seq
           FROM v_blocks b JOIN st USING (doc_id, seq)),
    ct AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY old) AS text FROM cb GROUP BY doc_id),
    p AS (SELECT doc_id, s, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n,
                 greatest(length(s), 1) AS len, contains(s, '|') AS pipe, k
          FROM (SELECT doc_id, trim(regexp_replace(s, '[{_WS}]+', ' ', 'g'), '{_WS}') AS s, k FROM ct, unnest({_SENTENCES}) WITH ORDINALITY AS u(s, k)
                WHERE trim(text, '{_WS}') <> '')
          WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
    b AS (SELECT doc_id, seq, greatest(length(text), 1) AS len, count(*) OVER (PARTITION BY doc_id) AS m FROM cb),
    o AS (SELECT p.doc_id, s, n, len, m, CASE WHEN n = m THEN i ELSE row_number() OVER (PARTITION BY p.doc_id ORDER BY pipe, i) - 1 END AS i
          FROM p JOIN (SELECT DISTINCT doc_id, m FROM b) USING (doc_id)),
    mid AS (SELECT *, (sum(len) OVER (PARTITION BY doc_id ORDER BY i) - len + len / 2.0::DOUBLE) / (sum(len) OVER (PARTITION BY doc_id)) AS mid FROM o),
    share AS (SELECT doc_id, seq, m, sum(len) OVER (PARTITION BY doc_id ORDER BY seq) / (sum(len) OVER (PARTITION BY doc_id))::DOUBLE AS e FROM b),
    slot AS (SELECT mid.doc_id, i, least(count(share.seq), any_value(mid.m) - 1) AS slot
             FROM mid LEFT JOIN share ON share.doc_id = mid.doc_id AND share.e <= mid.mid GROUP BY mid.doc_id, i),
    bound AS (SELECT b.doc_id, b.seq, b.m, count(slot.i) AS e FROM b LEFT JOIN slot ON slot.doc_id = b.doc_id AND slot.slot <= b.seq
              GROUP BY b.doc_id, b.seq, b.m),
    n AS (SELECT doc_id, max(n) AS n FROM o GROUP BY doc_id),
    stops AS (SELECT doc_id, seq, least(n, CASE WHEN n <= m THEN seq + 1 ELSE
                greatest(seq + 1, seq + max(e - seq) OVER (PARTITION BY doc_id ORDER BY seq)) END) AS stop
              FROM bound JOIN n USING (doc_id)),
    ranges AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY seq), 0) AS begin FROM stops)"""

_PARKED = "'queued', 'analyzing', 'extracting', 'ocr', 'chunking', 'translating', 'assembling'"


def _transition_sql(job_status: str, job_message: str, chunk_status: str, chunk_message: str) -> str:
    return with_views(
        f"""SELECT id AS job_id, NULL AS chunk_index, {job_status} AS status, {job_message} AS error_message FROM v_jobs j
            UNION ALL
            SELECT job_id, chunk_index, {chunk_status}, {chunk_message}
            FROM v_order_chunks c LEFT JOIN (SELECT id, status AS js FROM v_jobs) ON id = job_id""",
        "v_jobs",
        "v_order_chunks",
    )


_ALIGNED_SQL = with_views(
    f"""{_ALIGN_SQL}
    SELECT r.doc_id AS job_id, CAST(seq AS INTEGER) AS block_pos, string_agg(s, chr(10) || chr(10) ORDER BY i) AS translated
    FROM ranges r LEFT JOIN o ON o.doc_id = r.doc_id AND i >= begin AND i < stop GROUP BY r.doc_id, seq""",
    "v_blocks",
    recursive=True,
)

QUERIES = {
    "job_progress": (
        _progress,
        with_views(
            """c AS (SELECT job_id, count(*) AS total_chunks, count(*) FILTER (WHERE status = 'completed') AS completed_chunks,
                     count(*) FILTER (WHERE status = 'failed') AS failed_chunks,
                     min(chunk_index) FILTER (WHERE status = 'translating') AS current_chunk_index
                     FROM v_event_chunks GROUP BY job_id)
               SELECT job_id, total_chunks, completed_chunks, failed_chunks, current_chunk_index,
                      'Chapter ' || (current_chunk_index // 5) AS current_chapter, 'Section ' || current_chunk_index AS current_section,
                      round_even((completed_chunks + failed_chunks)::DOUBLE / total_chunks * 100, 1) AS progress_percentage FROM c""",
            "v_event_chunks",
        ),
    ),
    "eta_seconds": (
        _eta,
        with_views(
            """c AS (SELECT job_id, count(*) AS t, count(*) FILTER (WHERE status = 'completed') AS done,
                     count(*) FILTER (WHERE status = 'failed') AS failed,
                     greatest(1.0::DOUBLE, (epoch_us(max(updated_at)) - epoch_us(min(updated_at))) / 1e6::DOUBLE) AS s
                     FROM v_event_chunks GROUP BY job_id)
               SELECT job_id, done AS completed_chunks,
                      CASE WHEN done >= 3 THEN round_even((t - done - failed) / greatest(done / s, 1e-6::DOUBLE), 0) END AS eta_seconds FROM c""",
            "v_event_chunks",
        ),
    ),
    "dashboard_counts": (
        _dashboard,
        with_views(
            f"""SELECT count(*) AS total_jobs, count(*) FILTER (WHERE status = 'completed') AS completed_jobs,
                      count(*) FILTER (WHERE status IN ({_PARKED})) AS active_jobs,
                      count(*) FILTER (WHERE status = 'failed') AS failed_jobs, count(*) FILTER (WHERE status = 'paused') AS paused_jobs,
                      (SELECT count(*) FROM v_docs) AS total_documents, (SELECT count(*) FROM v_terms) AS total_terms,
                      (SELECT count(*) FROM v_tm) AS total_memory_entries FROM v_jobs""",
            "v_jobs", "v_docs", "v_terms", "v_tm",
        ),
    ),
    "dashboard_totals": (_totals(False), _totals_sql("GROUPING SETS ((year, half), (year), (half), ())")),
    "dashboard_totals_nested": (_totals(True), _totals_sql("ROLLUP (year, half)")),
    "recent_jobs": (
        _recent,
        with_views(
            """SELECT v_jobs.id, original_filename AS document_name, status, updated_at FROM v_jobs JOIN v_docs ON v_docs.id = document_id
               ORDER BY updated_at DESC, v_jobs.id DESC LIMIT 8""",
            "v_jobs", "v_docs",
        ),
    ),
    "recent_errors": (
        _errors,
        with_views(
            """SELECT * FROM (SELECT job_id, event_id AS id, chunk_index, value, row_number() OVER (PARTITION BY job_id ORDER BY event_id DESC) AS rank
               FROM v_status WHERE status = 'failed') WHERE rank <= 10""",
            "v_status",
        ),
    ),
    "list_chunks": (
        _list_chunks,
        """SELECT conv_id AS job_id, turn AS chunk_index, role AS status, left(text, 200) AS source_preview, '' AS translation_preview
           FROM conversations WHERE conv_id = 3 AND role = 'user' ORDER BY turn LIMIT 100 OFFSET 1""",
    ),
    "claim_batch": (
        _claim,
        with_views(
            """SELECT job_id, chunk_index, v_jobs.updated_at FROM v_order_chunks JOIN v_jobs ON id = job_id
               WHERE v_jobs.status = 'translating' AND v_order_chunks.status = 'pending'
               ORDER BY v_jobs.updated_at, job_id, chunk_index LIMIT 25""",
            "v_order_chunks", "v_jobs",
        ),
    ),
    "open_work": (
        _open,
        with_views(
            """SELECT (SELECT count(*) FROM v_jobs WHERE status = 'translating') AS jobs_translating,
                      (SELECT count(*) FROM v_order_chunks WHERE status IN ('pending', 'failed', 'translating')
                         AND job_id IN (SELECT id FROM v_jobs WHERE status = 'translating')) AS chunks_open""",
            "v_order_chunks", "v_jobs",
        ),
    ),
    "transition_recover": (
        _transition("recover"),
        _transition_sql(
            f"CASE WHEN status IN ({_PARKED}) THEN 'paused' ELSE status END",
            f"CASE WHEN status IN ({_PARKED}) THEN 'The run was cut off; resume the job to go on.' END",
            "status", "error_message",
        ),
    ),
    "transition_resume": (
        _transition("resume"),
        _transition_sql(
            "CASE WHEN status IN ('paused', 'failed', 'cancelled') THEN 'queued' ELSE status END", "NULL",
            "CASE WHEN js IN ('paused', 'failed', 'cancelled') AND status = 'translating' THEN 'pending' ELSE status END",
            "error_message",
        ),
    ),
    "transition_retry_failed": (
        _transition("retry_failed"),
        _transition_sql(
            "CASE WHEN status IN ('paused', 'failed', 'cancelled') THEN 'queued' ELSE status END", "NULL",
            """CASE WHEN js IS NOT NULL AND status = 'failed' THEN 'pending'
                    WHEN js IN ('paused', 'failed', 'cancelled') AND status = 'translating' THEN 'pending' ELSE status END""",
            "CASE WHEN js IS NOT NULL AND status = 'failed' THEN NULL ELSE error_message END",
        ),
    ),
    "transition_retranslate": (
        _transition("retranslate"),
        _transition_sql(
            "'queued'", "NULL", "CASE WHEN js IS NULL THEN status ELSE 'pending' END",
            "CASE WHEN js IS NULL THEN error_message END",
        ),
    ),
    "transition_cancel": (
        _transition("cancel"),
        _transition_sql(
            "CASE WHEN status NOT IN ('completed', 'cancelled') THEN 'cancelled' ELSE status END", "NULL", "status", "error_message"
        ),
    ),
    "latest_completed": (
        _latest,
        with_views(
            "SELECT document_id, arg_max(id, (updated_at, id)) AS job_id FROM v_jobs WHERE status = 'completed' GROUP BY document_id",
            "v_jobs",
        ),
    ),
    "pending_work": (
        _pending,
        with_views("SELECT job_id, chunk_index, status FROM v_event_chunks WHERE status <> 'completed'", "v_event_chunks"),
    ),
    "unfinished": (
        _unfinished,
        with_views(
            """SELECT job_id, chunk_index FROM v_order_chunks GROUP BY job_id, chunk_index
               HAVING count(*) FILTER (WHERE status = 'completed') = 0""",
            "v_order_chunks",
        ),
    ),
    "list_documents": (
        lambda s, f: jobs.list_documents(V.job_documents(s, f), limit=50, offset=10),
        with_views(
            "SELECT *, (SELECT count(*) FROM v_docs) AS total FROM v_docs ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10", "v_docs"
        ),
    ),
    "jobs_with_documents": (
        lambda s, f: jobs.jobs_with_documents(V.jobs(s, f), V.job_documents(s, f)).select("id", "document_id", "document_name", "status"),
        with_views(
            "SELECT v_jobs.id, document_id, original_filename AS document_name, status FROM v_jobs LEFT JOIN v_docs ON v_docs.id = document_id",
            "v_jobs", "v_docs",
        ),
    ),
    "list_jobs": (
        _list_jobs,
        with_views(
            """SELECT v_jobs.id, original_filename AS document_name, (SELECT count(*) FROM v_jobs) AS total, updated_at
               FROM v_jobs LEFT JOIN v_docs ON v_docs.id = document_id ORDER BY updated_at DESC, v_jobs.id DESC LIMIT 500 OFFSET 7""",
            "v_jobs", "v_docs",
        ),
    ),
    "admit_jobs": (
        _admit,
        with_views(
            f"""SELECT d.id AS document_id, min(j.id) AS job_id, min(j.id) IS NULL AS created_new
                FROM v_docs d LEFT JOIN v_jobs j ON j.document_id = d.id AND j.status IN ({_PARKED}, 'paused') GROUP BY d.id""",
            "v_jobs", "v_docs",
        ),
    ),
    "cascade_delete": (
        _cascade,
        with_views(
            """gone AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING')
               SELECT 'document' AS kind, id, id AS document_id FROM v_docs WHERE id NOT IN (SELECT id FROM gone)
               UNION ALL SELECT 'job', id, document_id FROM v_jobs WHERE document_id NOT IN (SELECT id FROM gone)
               UNION ALL SELECT 'chunk', job_id, document_id FROM v_order_chunks JOIN v_jobs ON id = job_id WHERE document_id NOT IN (SELECT id FROM gone)
               UNION ALL SELECT 'memory', id, CASE WHEN document_id NOT IN (SELECT id FROM gone) THEN document_id END FROM v_jobs""",
            "v_jobs", "v_docs", "v_order_chunks",
        ),
    ),
    "align_paragraphs": (_align, _ALIGNED_SQL),
    "align_rows": (_align_rows, _ALIGNED_SQL),
    "render_output_blocks": (
        _render,
        f"""WITH {_NUMBERED_SQL}
            SELECT DISTINCT doc_id AS job_id, 0 AS block_pos, 'paragraph' AS type, 'Intro' || chr(10) || chr(10) || 'Note' AS output_text, 0 AS output_level
            FROM lines WHERE is_row
            UNION ALL
            SELECT doc_id, 1, 'table', CASE WHEN count(*) = 1 THEN any_value(line) ELSE string_agg(fixed, chr(10) ORDER BY pos) END, 0
            FROM (SELECT doc_id, pos, line, array_to_string(
                    CASE WHEN len(c) > k THEN list_append(c[1:k - 1], array_to_string(c[k:], ' | '))
                         ELSE list_concat(c, list_transform(range(k - len(c)), lambda x: '')) END, ' | ') AS fixed
                  FROM (SELECT doc_id, pos, line, k, c2[(CASE WHEN c2[1] = '' THEN 2 ELSE 1 END):(CASE WHEN c2[-1] = '' THEN len(c2) - 1 ELSE len(c2) END)] AS c
                        FROM (SELECT *, list_transform(string_split(line, '|'), lambda c: trim(c, '{_WS}')) AS c2, len(string_split(line, ' | ')) AS k
                              FROM lines WHERE is_row)))
            GROUP BY doc_id""",
    ),
    "assembled_texts": (
        _assembled,
        with_views(
            "SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM v_blocks GROUP BY doc_id", "v_blocks"
        ),
    ),
    "write_assembled": (
        _assembled_order,
        with_views(
            """SELECT doc_id, type, CASE WHEN type = 'heading' THEN level ELSE 0 END AS output_level, text AS output_text
               FROM v_blocks WHERE doc_id % 9 <> 0""",
            "v_blocks",
        ),
    ),
    "retranslated_chunks": (
        _retranslated,
        with_views(
            """SELECT job_id, chunk_index, CASE WHEN j.id IS NULL THEN c.status ELSE 'pending' END AS status,
                      CASE WHEN j.id IS NULL THEN translation END AS translation,
                      CASE WHEN j.id IS NULL THEN attempts ELSE 0 END AS attempts,
                      CASE WHEN j.id IS NULL THEN prompt_tokens_used ELSE 0 END AS prompt_tokens_used,
                      CASE WHEN j.id IS NULL THEN error_message END AS error_message
               FROM v_order_chunks c LEFT JOIN v_jobs j ON j.id = job_id""",
            "v_order_chunks", "v_jobs",
        ),
    ),
    "job_outcome": (
        _outcome,
        with_views(
            """SELECT job_id, CASE WHEN count(*) FILTER (WHERE status <> 'completed') > 0 THEN 'failed' ELSE 'assembling' END AS status,
                      max(CASE WHEN status = 'failed' AND attempts = 3 THEN error_message END) AS error_message
               FROM v_order_chunks GROUP BY job_id""",
            "v_order_chunks",
        ),
    ),
}
