"""Queries that run as streams over the given tables, and over files made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.plans import views as V
from glossaflow.plans.views import _WS, with_views
from glossaflow.session import shared_folder
from glossaflow.operators import memory
from glossaflow.sources import files, ranked, search, store, terms_csv
from glossaflow.sources.versions import VersionedTable
from glossaflow.streaming import keyed as K
from glossaflow.streaming import status as S


#: Parts in which a table arrives, each at least one micro-batch.
PARTS = 4


def _fed(spark, rows: DataFrame, run) -> DataFrame:
    """What a stream has written after rows arrived by their ``_part``, one part after the other.

    ``run`` takes the stream and starts it anew from where it was.
    """
    path = shared_folder(spark, "arrivals")
    found = None
    for k in range(PARTS):
        rows.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(path)
        found = run(S.read_stream(spark, path, rows.drop("_part").schema))
    return found


def _arrivals(rows: DataFrame, key: str, late: bool = False, again: bool = False) -> DataFrame:
    """Rows with the part they arrive in: by key; every tenth a part late, every seventh once more."""
    most = rows.agg(F.max(key)).scalar()
    part = F.floor(F.col("_k") * PARTS / (F.col("_most") + 1)).cast("int")
    delayed = F.least(part + F.when(F.lit(late) & (F.col("_k") % 10 == 0), 1).otherwise(0), F.lit(PARTS - 1))
    repeated = F.when(F.lit(again) & (F.col("_k") % 7 == 0), F.lit(PARTS - 1))
    return (
        rows.withColumn("_k", F.col(key))
        .withColumn("_most", most)
        .withColumn("_part", F.explode(F.array_compact(F.array(delayed, repeated))))
        .drop("_k", "_most")
    )


def _events(spark, folder, again: bool = False) -> DataFrame:
    return _arrivals(V.table(spark, folder, "events"), "event_id", late=True, again=again)


def _local(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _latest(spark, folder):
    out = shared_folder(spark, "status")
    latest = _fed(
        spark,
        _events(spark, folder, again=True),
        lambda rows: S.stream_latest_status(V.as_status(rows), "job_id", "chunk_index", out),
    )
    return _local(latest, "updated_at")


def _progress(spark, folder):
    """A part spans about a week, so rows that come a part late are within the delay."""
    out = shared_folder(spark, "progress")
    run = lambda rows: S.stream_progress(V.as_status(rows), "job_id", out, delay="12 days")
    return _local(_fed(spark, _events(spark, folder), run), "window_start")


def _errors(spark, folder):
    out = shared_folder(spark, "errors")

    def run(rows):
        errors = V.as_status(rows).where("status = 'failed'").select(
            "ts",
            F.when(F.col("value") > 20, "api_error").otherwise("worker_error").alias("error_type"),
            F.when(F.col("value") > 10, "error").otherwise("warning").alias("severity"),
        )
        return S.stream_errors(errors, out, delay="12 days")

    return _local(_fed(spark, _events(spark, folder), run), "window_start")


def _dedup(spark, folder):
    out = shared_folder(spark, "results")
    keys = ["job_id", "chunk_index"]
    run = lambda rows: S.stream_dedup_results(V.as_status(rows).where("status = 'completed'"), keys, out)
    return _fed(spark, _events(spark, folder, again=True), run).select(*keys, "status")


def _upsert(spark, folder):
    out = shared_folder(spark, "memory")

    def run(rows):
        pairs = rows.select(
            "doc_id", F.col("text").alias("source_text"), F.concat("lang", F.lit(": "), "text").alias("translation")
        )
        return S.stream_tm_upsert(pairs, ["doc_id"], out)

    documents = _arrivals(V.table(spark, folder, "documents"), "doc_id")
    return _fed(spark, documents, run).select("source_hash", "target_text", "use_count")


def _keyed(spark, folder):
    """Parts are about a week apart, so rows a part late come in time, and those of weeks ago do not."""
    out = shared_folder(spark, "keyed")
    latest = _fed(
        spark,
        _events(spark, folder, again=True),
        lambda rows: K.stream_status_with_state(V.as_status(rows), "job_id", "chunk_index", out, delay="12 days"),
    )
    return _local(latest, "updated_at")


def _once(spark, folder):
    out = shared_folder(spark, "once")
    keys = ["job_id", "chunk_index"]

    def run(rows):
        done = S.with_event_time(V.as_status(rows)).where("status = 'completed'")
        return K.stream_once_within(done, keys, out, delay="60 days")

    return _fed(spark, _events(spark, folder, again=True), run).select(*keys, "status")


def _left(spark, folder):
    """A last event of an unknown job, long after the others, lets the last period end."""
    out = shared_folder(spark, "left")
    totals = V.order_chunks(spark, folder).groupBy("job_id").agg(F.count("*").alias("total_chunks"))
    totals = totals.withColumn("total_chunks", F.col("total_chunks") * 100)
    events = _events(spark, folder)
    beat = events.limit(1).withColumns(
        {
            "user_id": F.lit(-1).cast("bigint"),
            "ts": (F.timestamp_seconds(F.lit(4102444800))).cast("timestamp_ntz"),
            "_part": F.lit(PARTS - 1),
        }
    )
    run = lambda rows: K.stream_seconds_left(V.as_status(rows), totals, "job_id", out, delay="12 days")
    return _local(_fed(spark, events.unionByName(beat.select(*events.columns)), run), "period_start")


def _versions(spark, folder):
    """A memory in small groups: made from even documents, changed by all others, read by key."""
    table = VersionedTable(spark, shared_folder(spark, "versions"), ["source_hash", "target_language"], group_rows=100)
    pairs = V.memory_pairs(spark, folder)
    for rest in (0, 1):
        part = memory.build_tm(pairs.where(F.col("doc_id") % 2 == rest), [F.col("doc_id")])
        table.upsert(part.drop("first_seen"), memory.upsert_tm, change=rest)
    table.delete(table.read().where("use_count > 2"))
    return table.read().select("source_hash", "use_count")


def _search(needle: str, limit: int, offset: int):
    """A search in the stored memory by its posting lists."""

    def run(spark, folder):
        path = shared_folder(spark, "search")
        search.write_index(V.memory(spark, folder).select("id", "source_text", "target_text", "use_count"), path, 16, 4)
        return search.search_stored(spark, path, needle, limit, offset).select("id", "use_count", "total")

    return run


def _search_sql(pattern: str, limit: int, offset: int) -> str:
    hit = f"source_text ILIKE '{pattern}' OR target_text ILIKE '{pattern}'"
    return with_views(
        f"""SELECT id, use_count, (SELECT count(*) FROM v_tm WHERE {hit}) AS total
            FROM v_tm WHERE {hit} ORDER BY id DESC LIMIT {limit} OFFSET {offset}""",
        "v_tm",
    )


def _page(spark, folder):
    """A page of jobs in the middle of the table, and one of those of a status."""
    path, order = shared_folder(spark, "ranked"), [F.col("updated_at").desc(), F.col("id").desc()]
    ranked.write_ranked(V.jobs(spark, folder).select("id", "status", "updated_at"), path, order)
    whole = ranked.read_page(spark, path, order, limit=40, offset=700)
    some = ranked.read_page(spark, path, order, limit=40, offset=100, where=F.col("status") == "completed")
    pages = [p.select(F.lit(k).alias("page"), "id", "rank", "total") for k, p in enumerate((whole, some))]
    return pages[0].unionByName(pages[1])


def _text_files(spark, folder) -> str:
    """All texts as lines of files within the size limit, however the table is dealt, and none without a line."""
    path = shared_folder(spark, "texts")
    texts = V.documents(spark, folder).select("text")
    most = texts.agg(F.coalesce(F.max(F.octet_length("text")), F.lit(0)).alias("most")).first()["most"]
    lines = max(1, files.MAX_FILE_BYTES // (most + 1))
    texts.hint("rebalance").write.option("maxRecordsPerFile", lines).text(path)
    return path


def _read_texts(spark, folder):
    return files.read_text_documents(spark, _text_files(spark, folder)).agg(
        F.sum(F.length("text")).alias("characters"),
        F.sum(F.regexp_count("text", F.lit("\n"))).alias("lines"),
    )


def _inventory(spark, folder):
    return files.file_inventory(spark, _text_files(spark, folder)).groupBy(
        "extension", "found", "verdict"
    ).agg(F.sum("length").alias("bytes"))


def _stale(spark, folder):
    """Files of even documents, and later those of odd ones; the cutoff lies between."""
    path = shared_folder(spark, "ages")
    texts = V.documents(spark, folder)
    for name, rest in (("earlier", 0), ("later", 1)):
        texts.where(F.col("doc_id") % 2 == rest).select("text").write.text(f"{path}/{name}")
    later = files._files(spark, f"{path}/later").agg(F.min("modificationTime")).scalar()
    return files.stale_files(spark, path, 0, later).agg(F.sum("length").alias("bytes"))


def _csv(spark, folder, broken: bool = False) -> str:
    """A dictionary file; ``broken`` leaves out the translation of every seventh term."""
    path = shared_folder(spark, "terms")
    rows = V.terms(spark, folder)
    if broken:
        lost = F.length("english") % 7 == 0
        rows = rows.withColumn("preferred", F.when(lost, "").otherwise(F.col("preferred")))
    terms_csv.write_terms_csv(rows, path)
    return path


def _read_csv(spark, folder):
    accepted, _, _ = terms_csv.read_terms_csv(spark, _csv(spark, folder))
    return accepted.select("english", "preferred", "domain", F.array_join("alternatives", ";").alias("alternatives"))


def _import(spark, folder):
    """The file is read against a dictionary that has the terms of one domain."""
    known = V.terms(spark, folder).where("domain = 'General'")
    return terms_csv.import_report(
        *terms_csv.read_terms_csv(spark, _csv(spark, folder, broken=True), known)
    ).select("imported", "skipped_duplicates", "rejected", F.size("errors").alias("errors"))


def _write_csv(spark, folder):
    return terms_csv.terms_csv_rows(V.terms(spark, folder))


def _store(spark, folder):
    root = shared_folder(spark, "store")
    store.write_table(V.order_chunks(spark, folder), root, "chunks")
    return store.read_table(spark, root, "chunks").select("job_id", "chunk_index", "status", "attempts")


def _store_memory(spark, folder):
    root = shared_folder(spark, "store")
    store.write_table(V.memory(spark, folder), root, "tm")
    return store.read_table(spark, root, "tm").select("id", "source_hash", "use_count")


QUERIES = {
    "stream_latest_status": (
        _latest,
        with_views("SELECT job_id, chunk_index, status, updated_at FROM v_event_chunks", "v_event_chunks"),
    ),
    "stream_progress": (
        _progress,
        with_views(
            """SELECT job_id, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start,
                      count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
                      count(*) FILTER (WHERE status = 'completed') / 24.0::DOUBLE AS completed_per_hour
               FROM v_status GROUP BY ALL""",
            "v_status",
        ),
    ),
    "stream_errors": (
        _errors,
        with_views(
            """SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start,
                      CASE WHEN value > 20 THEN 'api_error' ELSE 'worker_error' END AS error_type,
                      CASE WHEN value > 10 THEN 'error' ELSE 'warning' END AS severity, count(*) AS errors
               FROM v_status WHERE status = 'failed' GROUP BY ALL""",
            "v_status",
        ),
    ),
    "stream_dedup_results": (
        _dedup,
        with_views("SELECT DISTINCT job_id, chunk_index, status FROM v_status WHERE status = 'completed'", "v_status"),
    ),
    "stream_status_with_state": (
        _keyed,
        with_views("SELECT job_id, chunk_index, status, updated_at FROM v_event_chunks", "v_event_chunks"),
    ),
    "stream_once_within": (
        _once,
        with_views("SELECT DISTINCT job_id, chunk_index, status FROM v_status WHERE status = 'completed'", "v_status"),
    ),
    "stream_seconds_left": (
        _left,
        with_views(
            """d AS (SELECT job_id, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS day,
                             count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed
                      FROM v_status GROUP BY ALL),
                p AS (SELECT job_id, time_bucket(INTERVAL '30 days', day, TIMESTAMP '1970-01-01') AS period_start,
                             CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(failed) AS BIGINT) AS failed,
                             epoch(max(day) - min(day)) + 86400 AS elapsed FROM d GROUP BY ALL),
                t AS (SELECT job_id, 100 * count(*) AS total FROM v_order_chunks GROUP BY job_id)
               SELECT job_id, period_start, completed, failed,
                      CASE WHEN completed >= 3 THEN round_even((total - completed - failed)
                                / greatest(completed / greatest(1.0, elapsed)::DOUBLE, 1e-6::DOUBLE), 0) END AS seconds_left
               FROM p JOIN t USING (job_id)""",
            "v_status",
            "v_order_chunks",
        ),
    ),
    "search_stored": (_search("TION", 15, 3), _search_sql("%tion%", 15, 3)),
    "search_stored_with_wildcards": (_search("der%die_", 50, 0), _search_sql("%der%die_%", 50, 0)),
    "search_stored_short": (_search("ü", 20, 2), _search_sql("%ü%", 20, 2)),
    "page_of_ranked": (
        _page,
        with_views(
            """SELECT 0 AS page, id, rank, total FROM (SELECT id, row_number() OVER (ORDER BY updated_at DESC, id DESC) - 1 AS rank,
                                                            count(*) OVER () AS total FROM v_jobs) WHERE rank >= 700 AND rank < 740
               UNION ALL
               SELECT 1, id, rank, total FROM (SELECT id, row_number() OVER (ORDER BY updated_at DESC, id DESC) - 1 AS rank,
                                                      count(*) OVER () AS total FROM v_jobs WHERE status = 'completed') WHERE rank >= 100 AND rank < 140""",
            "v_jobs",
        ),
    ),
    "store_versions": (
        _versions,
        with_views("SELECT source_hash, use_count FROM v_tm WHERE use_count <= 2", "v_tm"),
    ),
    "stream_tm_upsert": (
        _upsert,
        with_views("SELECT source_hash, target_text, use_count FROM v_tm", "v_tm"),
    ),
    "read_text_documents": (
        _read_texts,
        """SELECT CAST(sum(length(text) + 1) AS BIGINT) AS characters,
                  CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines FROM documents""",
    ),
    "file_inventory": (
        _inventory,
        "SELECT '.txt' AS extension, '.txt' AS found, 'ok' AS verdict, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents",
    ),
    "stale_files": (
        _stale,
        "SELECT CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents WHERE doc_id % 2 = 0",
    ),
    "read_terms_csv": (
        _read_csv,
        with_views("SELECT english, preferred, domain, alternative AS alternatives FROM v_terms", "v_terms"),
    ),
    "import_terms_csv": (
        _import,
        with_views(
            """SELECT count(*) FILTER (WHERE domain <> 'General' AND length(english) % 7 <> 0) AS imported,
                      count(*) FILTER (WHERE domain = 'General' AND length(english) % 7 <> 0) AS skipped_duplicates,
                      count(*) FILTER (WHERE length(english) % 7 = 0) AS rejected,
                      count(*) FILTER (WHERE length(english) % 7 = 0) AS errors FROM v_terms""",
            "v_terms",
        ),
    ),
    "write_terms_csv": (
        _write_csv,
        with_views(
            """SELECT english AS "English", preferred AS "Arabic", domain AS "Domain", '' AS "Definition", alternative AS "Alternatives"
               FROM v_terms""",
            "v_terms",
        ),
    ),
    "store_chunks": (
        _store,
        with_views("SELECT job_id, chunk_index, status, attempts FROM v_order_chunks", "v_order_chunks"),
    ),
    "store_memory": (_store_memory, with_views("SELECT id, source_hash, use_count FROM v_tm", "v_tm")),
}
