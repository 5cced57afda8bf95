"""How the given tables stand for documents, chunks, jobs, terms and memory.

Each view is a plain projection or aggregate of whole tables, written the same way in SQL below
under the same name, so that results can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.functions import blocks as B
from glossaflow.functions.text import WHITESPACE
from glossaflow.operators.structure import BLOCK_ELEMENTS, SKIPPED_ELEMENTS, html_to_blocks


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def document_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with blocks: each line is a paragraph."""
    return documents(spark, folder).select(
        "doc_id", B.text_blocks(F.col("text"), "\n").alias("blocks")
    )


def page_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with the blocks of their HTML."""
    return table(spark, folder, "pages").select(
        "page_id", "url", html_to_blocks(F.col("html")).alias("blocks")
    )


def table_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with cells as one table block each: a row for every line with cells."""
    rows = F.transform(
        F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit(" | "))),
        lambda x: F.split(x, r" \| "),
    )
    return (
        documents(spark, folder)
        .select("doc_id", rows.alias("rows"))
        .where(F.size("rows") > 0)
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Source and translation: a turn of the user and the answer that follows it."""
    turns = table(spark, folder, "conversations")
    source = turns.where("role = 'user'").select(
        F.col("conv_id").alias("job_id"),
        F.col("turn").alias("chunk_index"),
        F.col("text").alias("source_text"),
    )
    answer = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("job_id"),
        (F.col("turn") - 1).alias("chunk_index"),
        F.col("text").alias("translation"),
    )
    return source.join(answer, ["job_id", "chunk_index"])


def terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the benchmark is a term, numbered by where it is first seen."""
    words = table(spark, folder, "benchmark").select(
        "item_id",
        F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias(
            "pos", "english"
        ),
    )
    return words.groupBy("english").agg(
        F.min(F.col("item_id") * 100000 + F.col("pos")).alias("id")
    ).select(
        "id",
        "english",
        F.col("english").alias("preferred"),
        F.array(F.substring("english", 1, 4)).alias("alternatives"),
        F.when(F.length("english") % 2 == 0, "General").otherwise("Custom").alias("domain"),
        F.lit("").alias("definition"),
        F.lit("normal").alias("priority"),
        (F.length("english") % 5 != 0).alias("active"),
    )


def memory_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as sources, in order of their number."""
    return table(spark, folder, "documents").select(
        "doc_id",
        F.col("text").alias("source_text"),
        F.concat("lang", F.lit(": "), "text").alias("translation"),
    )


def memory(spark: SparkSession, folder: str) -> DataFrame:
    """The memory of all documents; the number of an entry is that of its first document."""
    from glossaflow.operators.memory import build_tm

    return build_tm(memory_pairs(spark, folder), [F.col("doc_id")]).select(
        F.col("first_seen.doc_id").alias("id"),
        "source_hash",
        "target_language",
        "source_text",
        "target_text",
        "use_count",
        F.lit(True).alias("approved"),
    )


_STATUS = {
    "view": "pending",
    "click": "translating",
    "purchase": "completed",
    "error": "failed",
    "signup": "skipped",
}


def as_status(events: DataFrame) -> DataFrame:
    """Events as status messages of chunks; works on the table and on a stream of it."""
    status = None
    for event, value in _STATUS.items():
        test = F.col("event_type") == event
        status = F.when(test, value) if status is None else status.when(test, value)
    return events.select(
        F.col("user_id").alias("job_id"),
        (F.col("event_id") % 20).alias("chunk_index"),
        status.alias("status"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        "event_type",
        "value",
    )


def status_events(spark: SparkSession, folder: str) -> DataFrame:
    return as_status(table(spark, folder, "events"))


def event_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Current state of the chunks that the events are about."""
    from glossaflow.streaming.status import latest_status

    return latest_status(status_events(spark, folder), "job_id", "chunk_index").select(
        "*",
        F.concat(F.lit("Chapter "), F.floor(F.col("chunk_index") / 5).cast("string")).alias("chapter"),
        F.concat(F.lit("Section "), F.col("chunk_index").cast("string")).alias("section"),
    )


def order_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as chunks of their order."""
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    status = (
        F.when(flag == "A", "failed")
        .when(flag == "R", "completed")
        .when(line == "O", "pending")
        .otherwise("translating")
    )
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        (F.col("l_linenumber") - 1).alias("chunk_index"),
        status.alias("status"),
        F.when(line == "F", F.col("l_partkey").cast("string")).otherwise(" ").alias("translation"),
        F.col("l_quantity").cast("long").alias("prompt_tokens_used"),
        (F.col("l_suppkey") % 50).alias("completion_tokens_used"),
        (F.col("l_partkey") % 3 + 1).alias("attempts"),
        F.when(flag == "A", "no answer").alias("error_message"),
        F.col("l_shipdate").alias("updated_at"),
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as jobs."""
    code, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    status = (
        F.when((code == "F") & (priority == "5-LOW"), "failed")
        .when(code == "F", "completed")
        .when(code == "O", "translating")
        .when(priority == "1-URGENT", "queued")
        .otherwise("paused")
    )
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("document_id"),
        status.alias("status"),
        F.col("o_orderdate").alias("updated_at"),
        F.when(status == "completed", F.col("o_orderdate")).alias("completed_at"),
        F.lit(None).cast("string").alias("error_message"),
    )


def job_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as the documents of jobs."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("original_filename"),
        F.col("c_acctbal").alias("created_at"),
    )


# The same views as SQL, as the body of a common table expression.
_WS = WHITESPACE.replace("'", "''")


def _shown(html: str) -> str:
    """Without comments and elements that show no text."""
    shown = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    for name in SKIPPED_ELEMENTS.split("|"):
        shown = f"regexp_replace({shown}, '(?is)<{name}\\b[^>]*>.*?</{name}\\s*>', '', 'g')"
    return shown


def _unescaped(text: str) -> str:
    for name, code in (("&nbsp;", 160), ("&lt;", 60), ("&gt;", 62), ("&quot;", 34), ("&#39;", 39), ("&copy;", 169), ("&middot;", 183), ("&amp;", 38)):
        text = f"replace({text}, '{name.replace(chr(39), chr(39) * 2)}', chr({code}))"
    return text


SQL = {
    "v_blocks": f"""
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS seq,
               CASE WHEN level IS NULL THEN 'paragraph' ELSE 'heading' END AS type,
               line AS text, coalesce(level, 0) AS level
        FROM (SELECT doc_id, pos, line,
                     CASE WHEN length(line) <= 100 AND NOT regexp_matches(line, '[.:؟]$') THEN
                       CASE WHEN regexp_matches(line, '^(?i:chapter|part)[{_WS}]+[0-9IVXLCivxlc]') THEN 1
                            WHEN upper(line) = line AND lower(line) <> line THEN 2 END END AS level
              FROM (SELECT doc_id, trim(u.line, '{_WS}') AS line, u.pos
                    FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, pos))
              WHERE line <> '')""",
    "v_page_blocks": f"""
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS seq,
               CASE WHEN regexp_matches(name, '^h[1-6]$') THEN 'heading' WHEN name = 'li' THEN 'list_item' ELSE 'paragraph' END AS type,
               text, CASE WHEN regexp_matches(name, '^h[1-6]$') THEN CAST(name[2:2] AS INTEGER) ELSE 0 END AS level
        FROM (SELECT page_id, pos, lower(regexp_extract(piece, '^<([A-Za-z0-9]+)', 1)) AS name,
                     trim(regexp_replace({_unescaped("regexp_replace(piece, '<[^>]*>', '', 'g')")}, '[{_WS}]+', ' ', 'g'), '{_WS}') AS text
              FROM (SELECT page_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS pos
                    FROM (SELECT page_id, string_split(regexp_replace({_shown("html")}, '(?i)</?({BLOCK_ELEMENTS})\\b[^>]*>', chr(1) || '\\0', 'g'), chr(1)) AS pieces
                          FROM pages)))
        WHERE text <> ''""",
    "v_pairs": """
        SELECT s.conv_id AS job_id, s.turn AS chunk_index, s.text AS source_text, a.text AS translation
        FROM conversations s JOIN conversations a ON a.conv_id = s.conv_id AND a.turn = s.turn + 1
        WHERE s.role = 'user' AND a.role = 'assistant'""",
    "v_terms": """
        SELECT min(item_id * 100000 + pos - 1) AS id, english, english AS preferred,
               left(english, 4) AS alternative,
               CASE WHEN length(english) % 2 = 0 THEN 'General' ELSE 'Custom' END AS domain,
               length(english) % 5 <> 0 AS active
        FROM benchmark, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) WITH ORDINALITY AS u(english, pos)
        GROUP BY english""",
    "v_hash": f"""
        SELECT doc_id, lang, text,
               sha256(lower(regexp_replace(trim(text, '{_WS}'), '[{_WS}]+', ' ', 'g'))) AS source_hash
        FROM documents""",
    "v_tm": f"""
        SELECT min(doc_id) AS id, source_hash, trim(arg_min(text, doc_id), '{_WS}') AS source_text,
               trim(arg_min(lang || ': ' || text, doc_id), '{_WS}') AS target_text, count(*) - 1 AS use_count
        FROM v_hash WHERE trim(text, '{_WS}') <> '' GROUP BY source_hash""",
    "v_status": """
        SELECT user_id AS job_id, event_id % 20 AS chunk_index, ts, event_id, event_type, value,
               CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'translating'
                    WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
                    WHEN 'signup' THEN 'skipped' END AS status
        FROM events""",
    "v_event_chunks": """
        SELECT job_id, chunk_index,
               coalesce(max(CASE WHEN status = 'completed' THEN status END),
                        arg_max(status, (ts, event_id))) AS status,
               max(ts) AS updated_at,
               'Chapter ' || CAST(chunk_index // 5 AS VARCHAR) AS chapter,
               'Section ' || CAST(chunk_index AS VARCHAR) AS section
        FROM v_status GROUP BY job_id, chunk_index""",
    "v_order_chunks": """
        SELECT l_orderkey AS job_id, l_linenumber - 1 AS chunk_index,
               CASE WHEN l_returnflag = 'A' THEN 'failed' WHEN l_returnflag = 'R' THEN 'completed'
                    WHEN l_linestatus = 'O' THEN 'pending' ELSE 'translating' END AS status,
               CASE WHEN l_linestatus = 'F' THEN CAST(l_partkey AS VARCHAR) ELSE ' ' END AS translation,
               CAST(l_quantity AS BIGINT) AS prompt_tokens_used, l_suppkey % 50 AS completion_tokens_used,
               l_partkey % 3 + 1 AS attempts,
               CASE WHEN l_returnflag = 'A' THEN 'no answer' END AS error_message,
               l_shipdate AS updated_at
        FROM lineitem""",
    "v_jobs": """
        SELECT o_orderkey AS id, o_custkey AS document_id,
               CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'failed'
                    WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'translating'
                    WHEN o_orderpriority = '1-URGENT' THEN 'queued' ELSE 'paused' END AS status,
               o_orderdate AS updated_at
        FROM orders""",
    "v_docs": "SELECT c_custkey AS id, c_name AS original_filename, c_acctbal AS created_at FROM customer",
}
NEEDS = {"v_tm": ["v_hash"], "v_event_chunks": ["v_status"]}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """A statement over the named views.  ``body`` may start with further expressions of its own."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in [*NEEDS.get(name, []), name] if n not in wanted]
    parts = [f"{n} AS ({SQL[n]})" for n in wanted]
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return head + ",\n".join(parts) + "\n" + body
    return head + ",\n".join([*parts, body])
