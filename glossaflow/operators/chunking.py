"""Structure-aware chunking of documents.

A document is one row with its blocks as an array, so all of this is expression work inside the
row: no shuffle, no grouping, and one long document costs its own task only its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.functions.blocks import block_plain_text
from glossaflow.functions.fold import greedy_starts, let, slices_at
from glossaflow.functions.tables import render_rows
from glossaflow.functions.text import estimate_tokens, split_sentences, strip
from glossaflow.schema import BLOCKS, HEADING, TABLE

# The sizes used unless a job names its own.
TARGET_CHARS = 4000
MAX_CHARS = 6000

_FIELDS = BLOCKS.elementType.fieldNames()


def split_long_text(text: Column, target: int = TARGET_CHARS) -> Column:
    """Pieces of about ``target`` characters, cut between sentences.

    A sentence longer than the target starts a piece of its own and is taken apart into its words,
    which then fill pieces like short sentences do.
    """
    unit = lambda text, decide: F.struct(text.alias("text"), decide.cast("int").alias("decide"))
    units = F.flatten(
        F.transform(
            split_sentences(text),
            lambda s: F.when(
                F.length(s) > target,
                F.transform(
                    F.split(s, " "),
                    lambda w, i: unit(w, F.when(i == 0, F.length(s)).otherwise(F.length(w))),
                ),
            ).otherwise(F.array(unit(s, F.length(s)))),
        )
    )

    def pack(found: Column) -> Column:
        starts = greedy_starts(
            found, lambda u: F.length(u["text"]) + 1, target, lambda u: u["decide"] + 1
        )
        return let(
            starts,
            lambda s: F.transform(
                slices_at(found, s),
                lambda part: F.array_join(F.transform(part, lambda u: u["text"]), " "),
            ),
        )

    return let(units, pack)


def split_table_rows(rows: Column, target: int = TARGET_CHARS) -> Column:
    """Groups of whole rows of about ``target`` characters."""
    return let(
        greedy_starts(rows, row_size, target), lambda starts: slices_at(rows, starts)
    )


def row_size(row: Column) -> Column:
    return F.aggregate(
        row, F.lit(0).cast("int"), lambda total, cell: total + F.length(cell) + F.lit(3)
    )


def _item(block: Column, plain: Column, decide: Column, grow: Column, joined: Column, **changed):
    """A block with what packing needs: its text, the size that decides, the size that is added."""
    fields = [changed.get(f, block[f]).alias(f) for f in _FIELDS]
    return F.struct(
        *fields,
        plain.alias("plain"),
        decide.cast("int").alias("decide"),
        grow.cast("int").alias("grow"),
        joined.alias("joined"),
    )


def expand_oversized(
    blocks: Column, target: int = TARGET_CHARS, maximum: int = MAX_CHARS
) -> Column:
    """Blocks ready for packing: too long texts in pieces, too long tables in row groups.

    The groups of one table are ``joined``: they never start a chunk, and the first of them decides
    with the length of the whole table.
    """
    no, yes = F.lit(False), F.lit(True)

    def whole(b: Column, plain: Column) -> Column:
        return F.array(_item(b, plain, F.length(plain), F.length(plain) + 2, no))

    def pieces(b: Column) -> Column:
        return F.transform(
            split_long_text(strip(b["text"]), target),
            lambda p: _item(
                b, p, F.length(p), F.length(p) + 2, no, text=p, rows=F.array().cast("array<array<string>>")
            ),
        )

    def groups(b: Column, plain: Column) -> Column:
        def group(rows: Column, k: Column) -> Column:
            size = F.aggregate(
                rows, F.lit(0).cast("int"), lambda total, row: total + row_size(row)
            )
            return _item(
                b,
                render_rows(rows),
                F.length(plain),
                size + 2,
                F.when(k > 0, yes).otherwise(no),
                text=F.lit(""),
                rows=rows,
            )

        return F.transform(split_table_rows(b["rows"], target), group)

    def expand(b: Column) -> Column:
        table = b["type"] == TABLE
        return let(
            block_plain_text(b),
            lambda plain: F.when(~table & (F.length(strip(b["text"])) > maximum), pieces(b))
            .when(table & (F.length(plain) > maximum), groups(b, plain))
            .otherwise(whole(b, plain)),
        )

    return F.flatten(F.transform(blocks, expand))


def chunk_marks(items: Column, target: int = TARGET_CHARS) -> Column:
    """Where chunks start, with the heading positions in force, as one ordered fold.

    The state holds only what the next decision needs; the result grows once a chunk, not once a
    block.  ``chapter`` is the position of the chapter heading at the start of the chunk, ``before``
    that of the section heading in force just before it.  The last mark closes the final chunk.
    """
    int_ = lambda v: F.lit(v).cast("int")
    mark = lambda at, chapter, before: F.struct(
        at.alias("at"), chapter.alias("chapter"), before.alias("before")
    )

    def step(s: Column, b: Column) -> Column:
        heading = b["type"] == HEADING
        chapter_heading = heading & (b["level"] == 1)
        full = s["chars"] + b["decide"]
        keep_with_heading = s["after_heading"] & (
            (s["chars"] < F.lit(target * 0.8)) | (s["count"] == 1)
        )
        fresh = (
            (s["at"] == 0)
            | chapter_heading
            | (heading & (full >= target))
            | (~heading & ~b["joined"] & ~keep_with_heading & (full > target))
        )
        chapter = F.when(chapter_heading, s["at"]).otherwise(s["chapter"])
        section = (
            F.when(chapter_heading, int_(-1))
            .when(heading & (b["level"] <= 3), s["at"])
            .otherwise(s["section"])
        )
        return F.struct(
            (s["at"] + 1).alias("at"),
            (F.when(fresh, int_(0)).otherwise(s["chars"]) + b["grow"]).alias("chars"),
            (F.when(fresh, int_(0)).otherwise(s["count"]) + 1).alias("count"),
            heading.alias("after_heading"),
            chapter.alias("chapter"),
            section.alias("section"),
            F.when(fresh, F.concat(s["marks"], F.array(mark(s["at"], chapter, s["section"]))))
            .otherwise(s["marks"])
            .alias("marks"),
        )

    start = F.struct(
        int_(0).alias("at"),
        int_(0).alias("chars"),
        int_(0).alias("count"),
        F.lit(False).alias("after_heading"),
        int_(-1).alias("chapter"),
        int_(-1).alias("section"),
        F.array().cast("array<struct<at:int,chapter:int,before:int>>").alias("marks"),
    )
    close = lambda s: F.when(
        s["at"] > 0, F.concat(s["marks"], F.array(mark(s["at"], s["chapter"], s["section"])))
    ).otherwise(s["marks"])
    return F.aggregate(items, start, step, close)


def _heading_name(items: Column, at: Column) -> Column:
    return F.when(at >= 0, strip(F.get(items, at)["text"])).otherwise("")


def _cut(items: Column, marks: Column) -> Column:
    def chunk(m: Column, k: Column) -> Column:
        following = F.get(marks, k + 1)
        return F.struct(
            k.alias("chunk_index"),
            _heading_name(items, m["chapter"]).alias("chapter"),
            _heading_name(items, following["before"]).alias("section"),
            F.slice(items, m["at"] + 1, following["at"] - m["at"]).alias("items"),
        )

    return F.transform(F.slice(marks, F.lit(1), F.greatest(F.size(marks) - 1, F.lit(0))), chunk)


def chunks_of(blocks: Column, target: int = TARGET_CHARS, maximum: int = MAX_CHARS) -> Column:
    """Chunks of a document's blocks, as an array."""
    return let(
        expand_oversized(blocks, target, maximum),
        lambda items: let(chunk_marks(items, target), lambda marks: _cut(items, marks)),
    )


def chunk_count(blocks: Column, target: int = TARGET_CHARS, maximum: int = MAX_CHARS) -> Column:
    marks = chunk_marks(expand_oversized(blocks, target, maximum), target)
    return F.greatest(F.size(marks) - 1, F.lit(0))


def assign_chunks(
    documents: DataFrame, *keys: str, target: int = TARGET_CHARS, maximum: int = MAX_CHARS
) -> DataFrame:
    """Chunk number of each packed block, one row a block."""
    return (
        documents.select(*keys, F.explode(chunks_of(F.col("blocks"), target, maximum)).alias("c"))
        .select(*keys, "c.chunk_index", "c.chapter", "c.section", F.inline("c.items"))
        .drop("decide", "grow", "joined")
    )


def chunk_documents(
    documents: DataFrame, *keys: str, target: int = TARGET_CHARS, maximum: int = MAX_CHARS
) -> DataFrame:
    """Documents with a ``blocks`` array to one row a chunk."""
    texts = F.filter(F.transform(F.col("c.items"), lambda i: i["plain"]), lambda t: t != "")
    pages = F.transform(F.col("c.items"), lambda i: i["page"])
    return (
        documents.select(*keys, F.explode(chunks_of(F.col("blocks"), target, maximum)).alias("c"))
        .select(
            *keys,
            "c.chunk_index",
            "c.chapter",
            "c.section",
            F.get(pages, F.lit(0)).alias("page_start"),
            F.array_max(pages).alias("page_end"),
            F.array_join(texts, "\n\n").alias("source_text"),
            F.transform(
                F.col("c.items"), lambda i: F.struct(*[i[f].alias(f) for f in _FIELDS])
            ).alias("source_blocks"),
        )
        .withColumn("char_count", F.length("source_text"))
        .withColumn("token_estimate", estimate_tokens(F.col("source_text")))
    )
