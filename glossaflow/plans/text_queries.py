"""Queries over the text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaflow.functions import blocks as B
from glossaflow.functions import markup, names, responses, tables, text
from glossaflow.functions.register import register_functions
from glossaflow.plans import views as V
from glossaflow.plans.views import _WS, with_views

# Latin letters stand for Arabic ones and digits for Arabic-Indic ones, to get such text at all.
LATIN, ARABIC = "aeinrst", "ابتثجحخ"
FENCE = "```"

_NORMAL = f"lower(regexp_replace(trim(text, '{_WS}'), '[{_WS}]+', ' ', 'g'))"
_SENTENCES = f"""
    string_split(regexp_replace(
      regexp_replace(trim(text, '{_WS}'), '([.!?؟])[{_WS}]+([A-Zء-ي0-9"''(\\[])', '\\1' || chr(65535) || '\\2', 'g'),
      '(^|' || chr(65535) || ')((?i:[a-z]{{1,3}}|prof|e\\.g|i\\.e)\\.)' || chr(65535), '\\1\\2 ', 'g'), chr(65535))"""


def _arabic_docs(spark, folder):
    return V.documents(spark, folder).withColumn("text", F.translate("text", LATIN, ARABIC))


def _normalize(spark, folder):
    return V.documents(spark, folder).select(
        "doc_id", text.normalize_text(F.col("text")).alias("normal")
    )


def _tokens(spark, folder):
    plain = V.documents(spark, folder).select("doc_id", F.lit("latin").alias("form"), "text")
    arabic = _arabic_docs(spark, folder).select("doc_id", F.lit("arabic").alias("form"), "text")
    return plain.unionByName(arabic).select(
        "doc_id", "form", text.estimate_tokens(F.col("text")).alias("tokens")
    )


def _mostly_arabic(spark, folder):
    return _arabic_docs(spark, folder).select(
        "doc_id",
        text.is_mostly_arabic(F.col("text")).alias("arabic"),
        text.arabic_count(F.col("text")).alias("arabic_letters"),
    )


def _sentences(spark, folder):
    return V.documents(spark, folder).select(
        "doc_id", F.posexplode(text.split_sentences(F.col("text"))).alias("pos", "sentence")
    )


def _fences(spark, folder):
    fenced = F.concat(F.lit(FENCE + "text\n"), "text", F.lit("\n" + FENCE + "\n"))
    return V.table(spark, folder, "conversations").select(
        "conv_id", "turn", responses.strip_code_fences(fenced).alias("clean")
    )


def _prefixes(spark, folder):
    label = F.get(
        F.array(*[F.lit(x) for x in responses.RESPONSE_LABELS]), (F.col("turn") % 5).cast("int")
    )
    return V.table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        responses.strip_response_prefix(F.concat(F.upper(label), F.lit(" – "), "text")).alias(
            "clean"
        ),
    )


def _json(spark, folder):
    changed = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}"))).otherwise(
        F.concat(F.lit(" "), "props")
    )
    return V.table(spark, folder, "events").select(
        "event_id",
        responses.looks_like_json_object(F.col("props")).alias("is_object"),
        responses.looks_like_json_object(changed).alias("changed_is_object"),
    )


def _model_output(spark, folder):
    kind = F.col("conv_id") % 8
    output = (
        F.when(kind == 1, "  ")
        .when(kind == 2, F.concat(F.lit('{"text": '), F.length("text").cast("string"), F.lit("}")))
        .when(kind == 3, F.concat(F.lit("Note: "), "text"))
        .when(kind == 4, F.concat(F.lit(responses.PROMPT_HEADINGS[0]), F.lit("\n"), "text"))
        .when(kind == 5, F.lit("Translation: "))
        .otherwise(F.col("text"))
    )
    finish = F.when(F.length("text") % 7 == 0, "length").otherwise("stop")
    return V.table(spark, folder, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn", responses.classify_model_output(output, finish).alias("reason")
    )


def _numbered(spark, folder):
    return V.documents(spark, folder).select(
        "doc_id", tables.number_table_rows(F.col("text")).alias("numbered")
    )


def _markers(spark, folder):
    return _numbered(spark, folder).select(
        "doc_id", F.posexplode(tables.extract_row_markers(F.col("numbered"))).alias("pos", "marker")
    )


def _strip_markers(spark, folder):
    return _numbered(spark, folder).select(
        "doc_id", tables.strip_row_markers(F.col("numbered")).alias("text")
    )


def _cells(spark, folder):
    return _numbered(spark, folder).select(
        "doc_id", F.explode(tables.row_cell_counts(F.col("numbered"))).alias("marker", "cells")
    )


def _digits(spark, folder):
    key = F.col("o_orderkey").cast("string")
    indic = F.translate(key, "0123456789", tables.ARABIC_DIGITS)
    return V.table(spark, folder, "orders").select(
        "o_orderkey", indic.alias("indic"), tables.normalize_arabic_digits(indic).alias("latin")
    )


def _reshape(spark, folder):
    """Rows get outer pipes and every second one loses its last cell; shape is that of the source.

    Pipes inside cells become slashes first.
    """
    line = lambda r, i: F.concat(
        F.lit("| "),
        F.array_join(
            F.when(i % 2 == 0, r).otherwise(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(1)))),
            " | ",
        ),
        F.lit(" |"),
    )
    clean = F.transform("rows", lambda r: F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("/"))))
    given = F.array_join(F.transform(clean, line), "\n")
    return V.table_documents(spark, folder).select(
        "doc_id",
        F.posexplode(tables.reshape_table_rows(given, F.col("rows"))).alias("row", "cells"),
    ).select("doc_id", "row", F.size("cells").alias("cells"), F.array_join("cells", "|").alias("line"))


def _runs(spark, folder):
    return V.documents(spark, folder).select(
        "doc_id", F.posexplode(markup.inline_runs(F.col("text"))).alias("pos", "run")
    ).select("doc_id", "pos", "run.*")


def _mark_runs(spark, folder):
    """Words as runs, every third bold and every fourth italic."""
    runs = F.transform(
        F.split("text", " "),
        lambda w, i: F.struct(w.alias("text"), (i % 3 == 0).alias("bold"), (i % 4 == 0).alias("italic")),
    )
    return V.table(spark, folder, "benchmark").select("item_id", markup.mark_runs(runs).alias("marked"))


def _filenames(spark, folder):
    return V.table(spark, folder, "pages").select(
        "page_id", names.sanitize_filename(F.col("url")).alias("name")
    )


def _output_names(spark, folder):
    title = B.title_of(F.col("blocks"), F.concat(F.lit("document "), F.col("doc_id").cast("string")))
    return V.document_blocks(spark, folder).select("doc_id", names.output_name(title).alias("name"))


def _usage(spark, folder):
    return V.documents(spark, folder).select(
        "doc_id",
        text.usage_estimate(F.col("text")).alias("u"),
        text.quick_usage(F.col("text")).alias("q"),
    ).select(
        "doc_id", "u.*", F.col("q.input_tokens").alias("quick_input"), F.col("q.total_tokens").alias("quick_total")
    )


def _sql_functions(spark, folder):
    register_functions(spark)
    return V.documents(spark, folder).selectExpr(
        "doc_id",
        "source_hash(text) AS source_hash",
        "length(normalize_text(text)) AS normal_chars",
        "estimate_tokens(text) AS tokens",
        "is_mostly_arabic(text) AS arabic",
        "size(split_sentences(text)) AS sentences",
        "length(number_table_rows(text)) AS numbered_chars",
        "size(extract_row_markers(number_table_rows(text))) AS markers",
        "strip_row_markers(number_table_rows(text)) = text AS restored",
        "normalize_arabic_digits(text) = text AS digits_kept",
    )


def _json_blocks(spark, folder):
    stored = V.document_blocks(spark, folder).select(
        "doc_id", B.blocks_to_json(F.col("blocks")).alias("json")
    )
    return stored.select("doc_id", F.inline(B.blocks_from_json(F.col("json")))).select(
        "doc_id", "seq", "type", "text", "level", "page", F.size("rows").alias("row_count")
    )


def _plain_text(spark, folder):
    block = lambda kind, content: F.struct(
        F.lit(kind).alias("type"), content.alias("text"), F.col("rows").alias("rows")
    )
    return V.table_documents(spark, folder).select(
        "doc_id",
        B.block_plain_text(block("table", F.lit(""))).alias("table_text"),
        B.block_plain_text(block("paragraph", F.col("rows")[0][0])).alias("cell_text"),
    )


_NUMBERED_SQL = """lines AS (
    SELECT doc_id, pos, line, contains(line, ' | ') AS is_row,
           sum(CASE WHEN contains(line, ' | ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS n
    FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, pos))"""

QUERIES = {
    "normalize_text": (_normalize, f"SELECT doc_id, {_NORMAL} AS normal FROM documents"),
    "source_hash": (
        lambda s, f: V.documents(s, f).select(
            "doc_id", text.source_hash(F.col("text")).alias("source_hash")
        ),
        f"SELECT doc_id, sha256({_NORMAL}) AS source_hash FROM documents",
    ),
    "estimate_tokens": (
        _tokens,
        f"""SELECT doc_id, form, greatest(1, CAST(floor((length(text) - a) / 4.0::DOUBLE + a / 3.0::DOUBLE) AS INTEGER)) AS tokens
            FROM (SELECT *, length(text) - length(regexp_replace(text, '[؀-ۿ]', '', 'g')) AS a
                  FROM (SELECT doc_id, 'latin' AS form, text FROM documents UNION ALL
                        SELECT doc_id, 'arabic', translate(text, '{LATIN}', '{ARABIC}') FROM documents))""",
    ),
    "is_mostly_arabic": (
        _mostly_arabic,
        f"""SELECT doc_id, a > 0 AND a >= length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS arabic,
                   a AS arabic_letters
            FROM (SELECT *, length(t) - length(regexp_replace(t, '[؀-ۿ]', '', 'g')) AS a
                  FROM (SELECT doc_id, translate(text, '{LATIN}', '{ARABIC}') AS t FROM documents))""",
    ),
    "split_sentences": (
        _sentences,
        f"""SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, sentence FROM documents,
            unnest({_SENTENCES}) WITH ORDINALITY AS u(sentence, pos) WHERE trim(text, '{_WS}') <> ''""",
    ),
    "strip_code_fences": (
        _fences,
        f"SELECT conv_id, turn, trim(text, '{_WS}') AS clean FROM conversations",
    ),
    "strip_response_prefix": (
        _prefixes,
        f"SELECT conv_id, turn, trim(text, '{_WS}') AS clean FROM conversations",
    ),
    "looks_like_json_object": (
        _json,
        """SELECT event_id, json_valid(props) AND trim(props) LIKE '{%}' AS is_object,
                  event_id % 3 <> 0 AND json_valid(props) AND trim(props) LIKE '{%}' AS changed_is_object
           FROM events""",
    ),
    "classify_model_output": (
        _model_output,
        """SELECT conv_id, turn, CASE WHEN length(text) % 7 = 0 THEN 'truncated'
             WHEN conv_id % 8 = 1 THEN 'empty' WHEN conv_id % 8 = 2 THEN 'json_object'
             WHEN conv_id % 8 = 4 THEN 'prompt_echo' WHEN conv_id % 8 = 3 THEN 'comment'
             WHEN conv_id % 8 = 5 THEN 'empty_after_cleaning' END AS reason
           FROM conversations WHERE role = 'assistant'""",
    ),
    "number_table_rows": (
        _numbered,
        f"""WITH {_NUMBERED_SQL} SELECT doc_id, string_agg(CASE WHEN is_row THEN '[' || n || '] ' ELSE '' END || line,
            chr(10) ORDER BY pos) AS numbered FROM lines GROUP BY doc_id""",
    ),
    "extract_row_markers": (
        _markers,
        f"WITH {_NUMBERED_SQL} SELECT doc_id, CAST(n - 1 AS INTEGER) AS pos, CAST(n AS INTEGER) AS marker FROM lines WHERE is_row",
    ),
    "strip_row_markers": (_strip_markers, "SELECT doc_id, text FROM documents"),
    "row_cell_counts": (
        _cells,
        f"""WITH {_NUMBERED_SQL} SELECT doc_id, CAST(n AS INTEGER) AS marker,
            CAST((length(line) - length(replace(line, ' | ', ''))) // 3 + 1 AS INTEGER) AS cells FROM lines WHERE is_row""",
    ),
    "normalize_arabic_digits": (
        _digits,
        f"""SELECT o_orderkey, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '{tables.ARABIC_DIGITS}') AS indic,
            CAST(o_orderkey AS VARCHAR) AS latin FROM orders""",
    ),
    "reshape_table_rows": (
        _reshape,
        f"""WITH {_NUMBERED_SQL}, cut AS (
            SELECT doc_id, n - 1 AS row, list_transform(string_split(line, ' | '), lambda c: trim(replace(c, '|', '/'), '{_WS}')) AS c
            FROM lines WHERE is_row)
            SELECT doc_id, CAST(row AS INTEGER) AS row, CAST(len(c) AS INTEGER) AS cells,
                   array_to_string(CASE WHEN row % 2 = 0 THEN c ELSE list_append(c[1:len(c) - 1], '') END, '|') AS line
            FROM cut""",
    ),
    "inline_runs": (
        _runs,
        """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INTEGER) AS pos,
             CASE WHEN three THEN part[4:len(part) - 3] WHEN two THEN part[3:len(part) - 2]
                  WHEN one THEN part[2:len(part) - 1] ELSE part END AS text,
             three OR two AS bold, three OR (one AND NOT two) AS italic
           FROM (SELECT doc_id, p, part, part LIKE '***%***' AND len(part) > 6 AS three,
                        part LIKE '**%**' AND len(part) > 4 AS two, part LIKE '*%*' AND len(part) > 2 AS one
                 FROM documents, unnest(string_split(regexp_replace(text,
                   '(\\*\\*\\*[^\\n]+?\\*\\*\\*|\\*\\*[^\\n]+?\\*\\*|\\*[^\\n]+?\\*)', chr(65535) || '\\1' || chr(65535), 'g'),
                   chr(65535))) WITH ORDINALITY AS u(part, p) WHERE part <> '')""",
    ),
    "mark_runs": (
        _mark_runs,
        f"""SELECT item_id, string_agg(CASE WHEN core = '' THEN w ELSE m || core || m || substr(w, length(core) + 1) END,
                   '' ORDER BY i) AS marked
            FROM (SELECT item_id, i, w, rtrim(w, '{_WS}') AS core,
                         CASE WHEN (i - 1) % 12 = 0 THEN '***' WHEN (i - 1) % 3 = 0 THEN '**' WHEN (i - 1) % 4 = 0 THEN '*' ELSE '' END AS m
                  FROM benchmark, unnest(string_split(text, ' ')) WITH ORDINALITY AS u(w, i))
            GROUP BY item_id""",
    ),
    "sanitize_filename": (
        _filenames,
        """SELECT page_id, nullif(trim(regexp_replace(string_split(url, '/')[-1], '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '. '), '') AS name
           FROM pages""",
    ),
    "output_name": (
        _output_names,
        with_views(
            f"""t AS (SELECT d.doc_id, coalesce(arg_min(b.text, seq) FILTER (WHERE type = 'heading'),
                          arg_min(b.text, seq) FILTER (WHERE length(b.text) <= 120), 'document ' || d.doc_id) AS title
                     FROM documents d LEFT JOIN v_blocks b USING (doc_id) GROUP BY d.doc_id)
            SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(title, '[^\\p{{L}}\\p{{N}} _-]', '_', 'g'),
                   '{_WS}'), 80), ''), 'document') || '_arabic.docx' AS name FROM t""",
            "v_blocks",
        ),
    ),
    "usage_estimate": (
        _usage,
        """SELECT doc_id, greatest(1, length(text) // 4) AS input_tokens, greatest(1, length(text) // 4) AS output_tokens,
                  length(text) AS characters, CAST(floor(length(text) / 4.0 + 0.5) AS BIGINT) AS quick_input,
                  CAST(floor(length(text) / 4.0 + 0.5) AS BIGINT) * 2 AS quick_total FROM documents""",
    ),
    "preview": (
        lambda s, f: V.documents(s, f).select("doc_id", text.preview(F.col("text")).alias("preview")),
        "SELECT doc_id, left(text, 200) AS preview FROM documents",
    ),
    "sql_functions": (
        _sql_functions,
        f"""WITH {_NUMBERED_SQL}, n AS (SELECT doc_id, count(*) FILTER (WHERE is_row) AS markers,
              coalesce(sum(length(CAST(n AS VARCHAR)) + 3) FILTER (WHERE is_row), 0) AS extra FROM lines GROUP BY doc_id)
            SELECT doc_id, sha256({_NORMAL}) AS source_hash, length({_NORMAL}) AS normal_chars,
                   greatest(1, length(text) // 4) AS tokens, false AS arabic,
                   CASE WHEN trim(text, '{_WS}') = '' THEN 0 ELSE len({_SENTENCES}) END AS sentences,
                   CAST(length(text) + extra AS BIGINT) AS numbered_chars, markers, true AS restored,
                   true AS digits_kept
            FROM documents JOIN n USING (doc_id)""",
    ),
    "blocks_json": (
        _json_blocks,
        with_views(
            "SELECT doc_id, seq, type, text, level, -1 AS page, 0 AS row_count FROM v_blocks", "v_blocks"
        ),
    ),
    "block_plain_text": (
        _plain_text,
        f"""WITH {_NUMBERED_SQL} SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS table_text,
            arg_min(string_split(line, ' | ')[1], pos) AS cell_text FROM lines WHERE is_row GROUP BY doc_id""",
    ),
}
