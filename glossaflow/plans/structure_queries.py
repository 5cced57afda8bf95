"""Queries over structure extraction and chunking, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaflow.functions import blocks as B
from glossaflow.functions.text import strip
from glossaflow.operators import chunking, layout, long_documents, structure
from glossaflow.plans import views as V
from glossaflow.plans.text_queries import _NUMBERED_SQL, _SENTENCES
from glossaflow.plans.views import _WS, with_views

SMALL = {"target": 600, "maximum": 900}


def _text_blocks(spark, folder):
    return structure.text_to_blocks(V.documents(spark, folder), separator="\n").select(
        "doc_id", "seq", "type", "text", "level"
    )


def _markdown_blocks(spark, folder):
    """Pages written out as marked-up text and read back."""
    line = lambda b: F.concat(
        F.when(b["type"] == "heading", F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "))).when(b["type"] == "list_item", "- ").otherwise(""),
        F.regexp_replace(b["text"], "\\s+", " "),
    )
    text = F.array_join(F.transform("blocks", line), "\n\n")
    return structure.text_to_blocks(
        V.page_blocks(spark, folder).select("page_id", text.alias("text")), "page_id"
    ).select("page_id", "seq", "type", "text", "level", "marker")


def _page_texts(spark, folder):
    """Turns of a conversation as its pages; lines are paragraphs."""
    return V.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).alias("page"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
    )


def _ocr_blocks(spark, folder):
    return structure.page_text_to_blocks(_page_texts(spark, folder)).select(
        "doc_id", "seq", "page", "type", "text", "level"
    )


def _spans(spark, folder):
    """Lines of documents as spans: forty to a page, short lines in larger type."""
    line = F.col("line")
    size = (
        F.when((F.upper(line) == line) & (F.lower(line) != line), 18.0)
        .when(F.length(line) < 40, 13.0)
        .otherwise(11.04)
    )
    return (
        V.documents(spark, folder)
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select(
            "doc_id",
            (F.floor(F.col("pos") / 40) + 1).cast("int").alias("page"),
            F.col("pos").alias("block"),
            F.lit(0).alias("line"),
            F.lit(0).alias("span"),
            size.alias("size"),
            F.col("line").alias("text"),
        )
    )


def _layout_blocks(spark, folder):
    return layout.classify_layout_spans(_spans(spark, folder)).select(
        "doc_id", "page", "seq", "type", "text", "level"
    )


def _paged(spark, folder):
    return (
        _spans(spark, folder)
        .groupBy("doc_id", "page")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]
                ),
                "\n",
            ).alias("text")
        )
        .withColumn("has_image", F.col("page") % 2 == 0)
    )


def _scanned(spark, folder):
    return layout.detect_scanned(_paged(spark, folder))


def _block_counts(spark, folder):
    return structure.block_counts(
        structure.explode_blocks(V.page_blocks(spark, folder), "page_id"), "page_id"
    )


def _titles(spark, folder):
    return structure.detect_title(
        structure.explode_blocks(V.document_blocks(spark, folder), "doc_id"),
        F.concat(F.lit("document "), F.col("doc_id").cast("string")),
    )


def _chapters(spark, folder):
    return structure.chapters(V.page_blocks(spark, folder), "page_id")


def _analyze(spark, folder):
    return structure.analyze_documents(
        V.document_blocks(spark, folder),
        "doc_id",
        fallback_title=F.concat(F.lit("document "), F.col("doc_id").cast("string")),
        target=SMALL["target"],
        maximum=1000000,
        scanned=_scanned(spark, folder),
    ).withColumn("chapters", F.array_join("chapters", "|"))


def _expand(spark, folder):
    """Documents without line feeds, as one long paragraph each."""
    whole = F.array(F.struct(F.lit(0).alias("seq"), *_one_block(F.replace("text", F.lit("\n"), F.lit(" ")))))
    return (
        V.documents(spark, folder)
        .select("doc_id", whole.alias("blocks"))
        .select(
            "doc_id",
            F.posexplode(chunking.expand_oversized(F.col("blocks"), 500, 700)).alias("pos", "b"),
        )
        .select("doc_id", "pos", F.col("b.text").alias("text"))
    )


def _one_block(text):
    made = B.make_block("paragraph", text)
    return [made[f].alias(f) for f in ("type", "text", "page", "level", "marker", "rows", "bold", "italic")]


def _split_table(spark, folder):
    table = F.array(
        F.struct(
            F.lit(0).alias("seq"),
            F.lit("table").alias("type"),
            F.lit("").alias("text"),
            F.lit(-1).alias("page"),
            F.lit(0).alias("level"),
            F.lit("").alias("marker"),
            F.col("rows"),
            F.lit(False).alias("bold"),
            F.lit(False).alias("italic"),
        )
    )
    groups = chunking.expand_oversized(table, 1000, 1500)
    return (
        V.table_documents(spark, folder)
        .select("doc_id", F.posexplode(groups).alias("group_no", "g"))
        .select("doc_id", "group_no", F.size("g.rows").alias("row_count"), F.col("g.plain").alias("text"))
    )


def _assign(spark, folder):
    return chunking.assign_chunks(
        V.document_blocks(spark, folder), "doc_id", target=600, maximum=1000000
    ).select("doc_id", "seq", "chunk_index")


def _carry(spark, folder):
    """Pages with every fifth item after the title as a section heading, in small chunks."""
    heading = lambda b: (b["seq"] % 5 == 0) & (b["type"] == "list_item")
    changed = F.transform(
        "blocks",
        lambda b: b.withField("type", F.when(heading(b), "heading").otherwise(b["type"])).withField(
            "level", F.when(heading(b), 2).otherwise(b["level"])
        ),
    )
    return chunking.chunk_documents(
        V.page_blocks(spark, folder).withColumn("blocks", changed), "page_id", target=400, maximum=1000000
    ).select("page_id", "chunk_index", "chapter", "section", "page_start", "page_end", "char_count")


def _chunks(spark, folder):
    return chunking.chunk_documents(V.document_blocks(spark, folder), "doc_id", maximum=1000000).select(
        "doc_id", "chunk_index", "chapter", "section", "source_text", "char_count", "token_estimate"
    )


def _chunks_of_rows(spark, folder):
    """The same chunks, from blocks as rows."""
    blocks = V.document_blocks(spark, folder).select("doc_id", F.inline("blocks"))
    return long_documents.chunk_block_rows(blocks, "doc_id", maximum=1000000).select(
        "doc_id", "chunk_index", "chapter", "section", "source_text", "char_count", "token_estimate"
    )


def _chunks_split(spark, folder):
    """The whole chunker, over-long lines included, at its usual sizes."""
    return chunking.chunk_documents(V.document_blocks(spark, folder), "doc_id").select(
        "doc_id", "chunk_index", "section", "source_text", "char_count"
    )



def structure_page(spark, folder):
    from glossaflow.operators.jobs import document_structure

    return document_structure(V.page_blocks(spark, folder), "page_id").select(
        "page_id", "total_blocks", "seq", "type", "text"
    )


def chunk_state(blocks: str, key: str, target: int) -> str:
    """Recursive expressions that give each block (key, seq, type, level, text) its chunk ``c``."""
    return f"""
    st AS (
      SELECT b.{key}, b.seq, length(b.text) + 2 AS chars, 1 AS n, b.type = 'heading' AS after, 0 AS c
      FROM {blocks} b WHERE b.seq = 0
      UNION ALL
      SELECT {key}, seq, CASE WHEN fresh THEN 0 ELSE chars END + len + 2, CASE WHEN fresh THEN 0 ELSE n END + 1,
             heading, CASE WHEN fresh THEN c + 1 ELSE c END
      FROM (SELECT b.{key}, b.seq, s.chars, s.n, s.c, length(b.text) AS len, b.type = 'heading' AS heading,
                   CASE WHEN b.type = 'heading' AND b.level = 1 THEN true
                        WHEN b.type = 'heading' THEN s.chars + length(b.text) >= {target}
                        WHEN s.after AND (s.chars < {target} * 0.8::DOUBLE OR s.n = 1) THEN false
                        ELSE s.chars + length(b.text) > {target} END AS fresh
            FROM st s JOIN {blocks} b ON b.{key} = s.{key} AND b.seq = s.seq + 1))"""


def packed_pieces(source: str, key: str, target: int) -> str:
    """Recursive expressions that cut texts (key, text) into ``pieces`` (key, p, piece)."""
    return f"""
    sentences AS (SELECT {key}, sp, s FROM {source}, unnest({_SENTENCES}) WITH ORDINALITY AS u(s, sp)),
    units AS (
      SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY sp, wp) - 1 AS i, w,
             CASE WHEN wp = 1 THEN length(s) ELSE length(w) END AS decide
      FROM sentences, unnest(CASE WHEN length(s) > {target} THEN string_split(s, ' ') ELSE [s] END) WITH ORDINALITY AS u(w, wp)),
    packed AS (
      SELECT {key}, i, length(w) + 1 AS used, 0 AS p FROM units WHERE i = 0
      UNION ALL
      SELECT u.{key}, u.i, CASE WHEN k.used + u.decide + 1 > {target} THEN 0 ELSE k.used END + length(u.w) + 1,
             CASE WHEN k.used + u.decide + 1 > {target} THEN k.p + 1 ELSE k.p END
      FROM packed k JOIN units u ON u.{key} = k.{key} AND u.i = k.i + 1),
    pieces AS (
      SELECT {key}, p, string_agg(w, ' ' ORDER BY i) AS piece
      FROM packed JOIN units USING ({key}, i) GROUP BY {key}, p)"""


_CHUNK_TEXT = """SELECT doc_id, c AS chunk_index, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS source_text,
       coalesce(arg_max(sec, seq), '') AS section, coalesce(arg_min(chap, seq), '') AS chapter
FROM (SELECT b.doc_id, b.seq, b.text, st.c,
             last_value(CASE WHEN b.level = 1 THEN b.text END IGNORE NULLS) OVER w AS chap,
             last_value(CASE WHEN b.level = 1 THEN '' WHEN b.type = 'heading' THEN b.text END IGNORE NULLS) OVER w AS sec
      FROM {blocks} b JOIN st USING (doc_id, seq) WINDOW w AS (PARTITION BY b.doc_id ORDER BY b.seq))
GROUP BY doc_id, c"""

_SPANS_SQL = """spans AS (
    SELECT doc_id, (pos - 1) // 40 + 1 AS page, pos - 1 AS block, line AS text,
           CASE WHEN upper(line) = line AND lower(line) <> line THEN 18.0
                WHEN length(line) < 40 THEN 13.0 ELSE 11.0 END AS size,
           CASE WHEN upper(line) = line AND lower(line) <> line THEN 18.0
                WHEN length(line) < 40 THEN 13.0 ELSE 11.04 END AS real_size
    FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, pos))"""

_CHUNKS_SQL = with_views(
    f"""{chunk_state("v_blocks", "doc_id", 4000)},
    chunked AS ({_CHUNK_TEXT.format(blocks="v_blocks")})
    SELECT doc_id, chunk_index, chapter, section, source_text, length(source_text) AS char_count,
           greatest(1, length(source_text) // 4) AS token_estimate FROM chunked""",
    "v_blocks",
    recursive=True,
)

QUERIES = {
    "chunk_documents": (_chunks, _CHUNKS_SQL),
    "chunk_block_rows": (_chunks_of_rows, _CHUNKS_SQL),
    "chunk_documents_with_long_blocks": (
        _chunks_split,
        with_views(
            f"""long AS (SELECT doc_id * 1000 + seq AS k, text FROM v_blocks WHERE length(text) > 6000),
            {packed_pieces("long", "k", 4000)},
            expanded AS (
              SELECT doc_id, seq AS old, coalesce(p, 0) AS p, type, level, coalesce(piece, text) AS text
              FROM v_blocks b LEFT JOIN pieces ON k = doc_id * 1000 + seq),
            e AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY old, p) - 1 AS INTEGER) AS seq,
                         type, level, text FROM expanded),
            {chunk_state("e", "doc_id", 4000)},
            chunked AS ({_CHUNK_TEXT.format(blocks="e")})
            SELECT doc_id, chunk_index, section, source_text, length(source_text) AS char_count FROM chunked""",
            "v_blocks",
            recursive=True,
        ),
    ),
    "text_to_blocks": (
        _text_blocks,
        with_views("SELECT doc_id, seq, type, text, level FROM v_blocks", "v_blocks"),
    ),
    "markdown_to_blocks": (
        _markdown_blocks,
        with_views(
            """SELECT page_id, seq, CASE WHEN caps THEN 'heading' ELSE type END AS type,
                      CASE WHEN caps THEN line ELSE text END AS text, CASE WHEN caps THEN 2 ELSE level END AS level,
                      CASE WHEN type = 'list_item' AND NOT caps THEN '•' ELSE '' END AS marker
               FROM (SELECT *, type <> 'heading' AND length(line) <= 100 AND upper(line) = line
                              AND lower(line) <> line AND NOT regexp_matches(line, '[.:؟]$') AS caps
                     FROM (SELECT page_id, seq, type, level, regexp_replace(text, '\\s+', ' ', 'g') AS text,
                                  CASE type WHEN 'list_item' THEN '- ' ELSE '' END || regexp_replace(text, '\\s+', ' ', 'g') AS line
                           FROM v_page_blocks))""",
            "v_page_blocks",
        ),
    ),
    "page_text_to_blocks": (
        _ocr_blocks,
        f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1 AS INTEGER) AS seq, page,
                   CASE WHEN caps THEN 'heading' ELSE 'paragraph' END AS type, text,
                   CASE WHEN caps THEN 2 ELSE 0 END AS level
            FROM (SELECT *, length(text) <= 100 AND upper(text) = text AND lower(text) <> text AS caps
                  FROM (SELECT conv_id AS doc_id, turn + 1 AS page, pos, trim(line, '{_WS}') AS text
                        FROM conversations, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, pos))
                  WHERE text <> '')""",
    ),
    "classify_layout_spans": (
        _layout_blocks,
        f"""WITH {_SPANS_SQL},
            sizes AS (
              SELECT doc_id, size, sum(length(trim(text, '{_WS}'))) AS w, min(block) AS f
              FROM spans WHERE trim(text, '{_WS}') <> '' GROUP BY doc_id, size),
            body AS (SELECT doc_id, arg_min(size, (-w, f)) AS body FROM sizes GROUP BY doc_id)
            SELECT doc_id, CAST(page AS INTEGER) AS page,
                   row_number() OVER (PARTITION BY doc_id ORDER BY page, block) - 1 AS seq,
                   CASE WHEN h THEN 'heading' ELSE 'paragraph' END AS type, text,
                   CASE WHEN NOT h THEN 0 WHEN r >= 1.7 THEN 1 WHEN r >= 1.4 THEN 2 WHEN r >= 1.15 THEN 3 ELSE 4 END AS level
            FROM (SELECT doc_id, page, block, trim(text, '{_WS}') AS text,
                         CAST(real_size AS DOUBLE) / CAST(coalesce(body, 11) AS DOUBLE) AS r,
                         length(trim(text, '{_WS}')) <= 150 AND real_size >= coalesce(body, 11) * 1.12::DOUBLE AS h
                  FROM spans LEFT JOIN body USING (doc_id) WHERE trim(text, '{_WS}') <> '')""",
    ),
    "detect_scanned": (
        _scanned,
        f"""WITH {_SPANS_SQL},
            pages AS (SELECT doc_id, page, length(trim(string_agg(text, chr(10) ORDER BY block), '{_WS}')) AS n
                      FROM spans GROUP BY doc_id, page)
            SELECT doc_id, count(*) AS page_count, round_even(sum(n) / count(*)::DOUBLE, 1) AS avg_chars_per_page,
                   count(*) FILTER (WHERE page % 2 = 0) AS pages_with_images, sum(n) / count(*) < 40 AS is_scanned
            FROM pages GROUP BY doc_id""",
    ),
    "html_to_blocks": (
        lambda s, f: structure.explode_blocks(V.page_blocks(s, f), "page_id").select(
            "page_id", "seq", "type", "text", "level"
        ),
        with_views("SELECT page_id, seq, type, text, level FROM v_page_blocks", "v_page_blocks"),
    ),
    "block_counts": (
        _block_counts,
        with_views(
            """SELECT page_id, count(*) FILTER (WHERE type = 'heading') AS headings,
                      count(*) FILTER (WHERE type = 'paragraph') AS paragraphs,
                      count(*) FILTER (WHERE type = 'list_item') AS list_items,
                      count(*) FILTER (WHERE type = 'table') AS tables
               FROM v_page_blocks GROUP BY page_id""",
            "v_page_blocks",
        ),
    ),
    "detect_title": (
        _titles,
        with_views(
            """SELECT doc_id, coalesce(arg_min(text, seq) FILTER (WHERE type = 'heading'),
                      arg_min(text, seq) FILTER (WHERE length(text) <= 120), 'document ' || doc_id) AS title
               FROM v_blocks GROUP BY doc_id""",
            "v_blocks",
        ),
    ),
    "chapters": (
        _chapters,
        with_views(
            """SELECT page_id, CAST(k - 1 AS INTEGER) AS chapter_index, text AS chapter
               FROM (SELECT page_id, text, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS k
                     FROM v_page_blocks WHERE type = 'heading' AND level = 1)""",
            "v_page_blocks",
        ),
    ),
    "analyze_documents": (
        _analyze,
        with_views(
            f"""{chunk_state("v_blocks", "doc_id", 600)},
            {_SPANS_SQL},
            pages AS (SELECT doc_id, page, length(trim(string_agg(text, chr(10) ORDER BY block), '{_WS}')) AS n
                      FROM spans GROUP BY doc_id, page),
            scans AS (SELECT doc_id, count(*) AS page_count, sum(n) / count(*) < 40 AS is_scanned FROM pages GROUP BY doc_id),
            a AS (SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS character_count,
                     count(*) FILTER (WHERE type = 'heading') AS heading_count,
                     count(*) FILTER (WHERE type = 'paragraph') AS paragraph_count,
                     coalesce(arg_min(text, seq) FILTER (WHERE type = 'heading'),
                       arg_min(text, seq) FILTER (WHERE length(text) <= 120), 'document ' || doc_id) AS title,
                     coalesce(string_agg(text, '|' ORDER BY seq) FILTER (WHERE level = 1), '') AS chapters
                  FROM v_blocks GROUP BY doc_id)
            SELECT d.doc_id, coalesce(character_count, 0) AS character_count, coalesce(heading_count, 0) AS heading_count,
                   coalesce(paragraph_count, 0) AS paragraph_count, 0 AS table_count, 0 AS list_item_count,
                   coalesce(max(c) + 1, 0) AS estimated_chunks, coalesce(chapters, '') AS chapters,
                   coalesce(title, 'document ' || d.doc_id) AS title,
                   coalesce(character_count, 0) > 0 AS has_extractable_text,
                   coalesce(heading_count, 0) + coalesce(paragraph_count, 0) AS estimated_translation_units,
                   page_count, coalesce(is_scanned, false) AS is_scanned
            FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN st USING (doc_id) LEFT JOIN scans USING (doc_id)
            GROUP BY ALL""",
            "v_blocks",
            recursive=True,
        ),
    ),
    "expand_oversized": (
        _expand,
        f"""WITH RECURSIVE one AS (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents
                                   WHERE length(trim(replace(text, chr(10), ' '), '{_WS}')) > 700),
            {packed_pieces("one", "doc_id", 500)}
            SELECT doc_id, p AS pos, piece AS text FROM pieces
            UNION ALL
            SELECT doc_id, 0, replace(text, chr(10), ' ') FROM documents
            WHERE length(trim(replace(text, chr(10), ' '), '{_WS}')) <= 700""",
    ),
    "split_table_rows": (
        _split_table,
        f"""WITH RECURSIVE {_NUMBERED_SQL},
            r AS (SELECT doc_id, n - 1 AS i, line, length(replace(line, ' | ', '')) + 3 * len(string_split(line, ' | ')) AS size,
                         sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1 AS whole FROM lines WHERE is_row),
            g AS (SELECT doc_id, i, size AS used, 0 AS g FROM r WHERE i = 0
                  UNION ALL
                  SELECT r.doc_id, r.i,
                         CASE WHEN whole > 1500 AND g.used + size > 1000 THEN 0 ELSE g.used END + size,
                         CASE WHEN whole > 1500 AND g.used + size > 1000 THEN g + 1 ELSE g END
                  FROM g JOIN r ON r.doc_id = g.doc_id AND r.i = g.i + 1)
            SELECT doc_id, g AS group_no, count(*) AS row_count, string_agg(line, chr(10) ORDER BY i) AS text
            FROM g JOIN r USING (doc_id, i) GROUP BY doc_id, g""",
    ),
    "assign_chunks": (
        _assign,
        with_views(
            f"""{chunk_state("v_blocks", "doc_id", 600)}
            SELECT doc_id, seq, c AS chunk_index FROM st""",
            "v_blocks",
            recursive=True,
        ),
    ),
    "carry_headings": (
        _carry,
        with_views(
            f"""b AS (SELECT page_id, seq, text,
                      CASE WHEN seq % 5 = 0 AND type = 'list_item' THEN 'heading' ELSE type END AS type,
                      CASE WHEN seq % 5 = 0 AND type = 'list_item' THEN 2 ELSE level END AS level FROM v_page_blocks),
            {chunk_state("b", "page_id", 400)},
            h AS (SELECT page_id, b.seq, text, c,
                    last_value(CASE WHEN level = 1 THEN text END IGNORE NULLS) OVER w AS chap,
                    last_value(CASE WHEN level = 1 THEN '' WHEN type = 'heading' THEN text END IGNORE NULLS) OVER w AS sec
                  FROM b JOIN st USING (page_id, seq) WINDOW w AS (PARTITION BY page_id ORDER BY b.seq))
            SELECT page_id, c AS chunk_index, coalesce(arg_min(chap, seq), '') AS chapter,
                   coalesce(arg_max(sec, seq), '') AS section, -1 AS page_start, -1 AS page_end,
                   CAST(sum(length(text) + 2) - 2 AS BIGINT) AS char_count
            FROM h GROUP BY page_id, c""",
            "v_page_blocks",
            recursive=True,
        ),
    ),
    "document_structure": (
        structure_page,
        with_views(
            """SELECT page_id, total_blocks, seq, type, text
               FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS total_blocks FROM v_page_blocks)""",
            "v_page_blocks",
        ),
    ),
}
