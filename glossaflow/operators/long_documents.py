"""Chunking of documents that are larger than a row: their blocks are rows.

The rules are those of ``chunking``; a chunk always starts at a chapter heading, so chapters are
chunked apart from each other, in as many tasks as there are.  Within a chapter the blocks stream by
in order, and only a few numbers are kept from one to the next, so no chapter is gathered; what is
gathered in the end is one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaflow.functions.text import estimate_tokens, strip
from glossaflow.operators.chunking import _FIELDS, MAX_CHARS, TARGET_CHARS, expand_oversized
from glossaflow.schema import HEADING
from glossaflow.session import written


def packed_blocks(blocks: DataFrame, *keys: str, target: int = TARGET_CHARS, maximum: int = MAX_CHARS) -> DataFrame:
    """Blocks as they are packed, over-long ones in pieces; in order of ``_seq`` and ``_piece``."""
    block = F.array(F.struct(*[F.col(f) for f in _FIELDS]))
    items = blocks.select(*keys, F.col("seq").alias("_seq"), F.posexplode(expand_oversized(block, target, maximum)).alias("_piece", "_i"))
    return items.select(*keys, "_seq", "_piece", "_i.*")


def _numbered_chapters(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with the number of chapter headings up to them."""
    upto = Window.partitionBy(*keys).orderBy("_seq", "_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_chapter", F.count_if(F.col("heading") & (F.col("level") == 1)).over(upto))


def _streamed(rows: DataFrame, keys: tuple[str, ...], target: int) -> DataFrame:
    """Each row with its chunk within its chapter, and the headings in force after it."""
    by = [*keys, "_chapter"]
    names = [*by, "_seq", "_piece"]
    schema = T.StructType(
        [rows.schema[n] for n in names]
        + T._parse_datatype_string("_chunk long, chapter string, section string").fields
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = None
        for batch in batches:
            chunks, chapters, sections = [], [], []
            place = batch[by].itertuples(index=False, name=None)
            columns = (batch[c].tolist() for c in ("heading", "level", "decide", "grow", "joined", "title"))
            for key, heading, level, decide, grow, joined, title in zip(place, *columns):
                first = key != current
                if first:
                    current, chunk, chars, count, after, chapter, section = key, -1, 0, 0, False, "", ""
                top = heading and level == 1
                full = chars + decide
                # A block after a heading stays with it while there is room.
                kept = after and (chars < target * 0.8 or count == 1)
                if first or top or (heading and full >= target) or (not heading and not joined and not kept and full > target):
                    chunk, chars, count = chunk + 1, 0, 0
                if top:
                    chapter, section = title, ""
                elif heading and level <= 3:
                    section = title
                chars, count, after = chars + grow, count + 1, heading
                chunks.append(chunk)
                chapters.append(chapter)
                sections.append(section)
            yield batch[names].assign(_chunk=chunks, chapter=chapters, section=sections)

    ordered = rows.repartition(*by).sortWithinPartitions(*by, "_seq", "_piece")
    return ordered.mapInPandas(fold, schema)


def assign_block_rows(
    blocks: DataFrame, *keys: str, target: int = TARGET_CHARS, maximum: int = MAX_CHARS
) -> DataFrame:
    """Packed blocks with ``chunk_index``, ``chapter`` and the ``section`` in force after each.

    ``blocks`` has the keys and a block's fields, a row a block, in order of ``seq``.
    """
    items = written(packed_blocks(blocks, *keys, target=target, maximum=maximum), "packed")
    heading = F.col("type") == HEADING
    narrow = items.select(
        *keys, "_seq", "_piece", heading.alias("heading"), "level", "decide", "grow", "joined",
        F.when(heading, strip(F.col("text"))).alias("title"),
    )
    # Used for the chapters' sizes and for the blocks' numbers; written, it is made once.
    placed = written(_streamed(_numbered_chapters(narrow, keys), keys, target), "placed")
    sizes = placed.groupBy(*keys, "_chapter").agg((F.max("_chunk") + 1).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chapter").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_chapter", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = placed.join(starts, [*keys, "_chapter"]).select(
        *keys, "_seq", "_piece", (F.col("_start") + F.col("_chunk")).cast("int").alias("chunk_index"), "chapter", "section"
    )
    # Both sides grow with the documents, so a long one is spread over tasks by its blocks.
    return items.join(numbered.hint("merge"), [*keys, "_seq", "_piece"]).drop("decide", "grow", "joined")


def chunk_block_rows(
    blocks: DataFrame, *keys: str, target: int = TARGET_CHARS, maximum: int = MAX_CHARS
) -> DataFrame:
    """As ``chunk_documents``, from blocks as rows: one row a chunk."""
    placed = assign_block_rows(blocks, *keys, target=target, maximum=maximum)
    item = F.struct("_seq", "_piece", "plain", "section", *_FIELDS)
    chunks = placed.groupBy(*keys, "chunk_index", "chapter").agg(F.sort_array(F.collect_list(item)).alias("items"))
    texts = F.filter(F.transform("items", lambda i: i["plain"]), lambda t: t != "")
    pages = F.transform("items", lambda i: i["page"])
    return chunks.select(
        *keys,
        "chunk_index",
        "chapter",
        F.element_at("items", -1)["section"].alias("section"),
        F.get(pages, F.lit(0)).alias("page_start"),
        F.array_max(pages).alias("page_end"),
        F.array_join(texts, "\n\n").alias("source_text"),
        F.transform("items", lambda i: F.struct(*[i[f].alias(f) for f in _FIELDS])).alias("source_blocks"),
    ).withColumn("char_count", F.length("source_text")).withColumn("token_estimate", estimate_tokens(F.col("source_text")))
