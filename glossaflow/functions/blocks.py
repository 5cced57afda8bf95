"""Expressions over one document's array of blocks.

A document is one row, its blocks one array in it.  A row holds at most one document, so these
expressions need no shuffle and no grouping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaflow.functions.fold import let
from glossaflow.functions.tables import render_rows
from glossaflow.functions.text import MAYBE_SPACES, SPACES, split_lines, split_paragraphs, strip
from glossaflow.schema import BLOCKS, HEADING, LIST_ITEM, PARAGRAPH, ROWS, TABLE

# The patterns that tell headings and list items from prose.
MARKDOWN_HEADING = rf"^(#{{1,4}}){SPACES}([^\n]+)$"
CHAPTER_HEADING = rf"(?i)^(?:chapter|part){SPACES}[\p{{Nd}}IVXLC]+"
BULLET_START = rf"^{MAYBE_SPACES}[-*•‣▪]{SPACES}"
NUMBERED_START = rf"^{MAYBE_SPACES}(\p{{Nd}}{{1,2}})[.)]{SPACES}"
HEADING_LIMIT = 100
BULLET = "•"


def make_block(
    kind: Column | str,
    text: Column,
    level: Column | int = 0,
    marker: Column | str = "",
    page: Column | int = -1,
) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_column(kind).alias("type"),
        text.alias("text"),
        as_column(page).cast("int").alias("page"),
        as_column(level).cast("int").alias("level"),
        as_column(marker).alias("marker"),
        F.array().cast(ROWS).alias("rows"),
        F.lit(False).alias("bold"),
        F.lit(False).alias("italic"),
    )


def is_all_caps(c: Column) -> Column:
    """At least one letter with case, and none in lower case."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def heading_level(line: Column) -> Column:
    """Level of a plain line that reads as a heading, else null."""
    level = F.when(line.rlike(CHAPTER_HEADING), 1).when(is_all_caps(line), 2)
    return F.when(F.length(line) <= HEADING_LIMIT, level)


def with_seq(blocks: Column) -> Column:
    """Number the blocks of an array from zero."""
    return F.transform(
        blocks,
        lambda b, i: F.struct(
            i.alias("seq"),
            *[b[f].alias(f) for f in BLOCKS.elementType.fieldNames() if f != "seq"],
        ),
    )


def _is_list(lines: Column) -> Column:
    return F.forall(
        lines,
        lambda x: (F.length(strip(x)) == 0) | x.rlike(BULLET_START) | x.rlike(NUMBERED_START),
    )


def _list_items(lines: Column) -> Column:
    def item(line: Column) -> Column:
        bullet = line.rlike(BULLET_START)
        text = F.regexp_replace(line, F.when(bullet, BULLET_START).otherwise(NUMBERED_START), "")
        number = F.concat(F.regexp_extract(line, NUMBERED_START, 1), F.lit("."))
        return make_block(
            LIST_ITEM, strip(text), marker=F.when(bullet, BULLET).otherwise(number)
        )

    return F.transform(F.filter(lines, lambda x: F.length(strip(x)) > 0), item)


def _paragraph_blocks(paragraph: Column) -> Column:
    """Blocks of one stripped paragraph.  The cheap tests come first: most lines are prose."""
    ends_open = paragraph.endswith(".") | paragraph.endswith(":") | paragraph.endswith("؟")
    level = F.when((F.length(paragraph) <= HEADING_LIMIT) & ~ends_open, heading_level(paragraph))

    def build(lines: Column) -> Column:
        one_line = F.size(lines) == 1
        hashes = F.regexp_extract(paragraph, MARKDOWN_HEADING, 1)
        markdown = make_block(
            HEADING,
            strip(F.regexp_extract(paragraph, MARKDOWN_HEADING, 2)),
            level=F.length(hashes),
        )
        prose = F.when(one_line, paragraph).otherwise(
            F.array_join(F.transform(lines, strip), " ")
        )
        return (
            F.when(
                one_line & paragraph.startswith("#") & paragraph.rlike(MARKDOWN_HEADING),
                F.array(markdown),
            )
            .when(one_line & level.isNotNull(), F.array(make_block(HEADING, paragraph, level=level)))
            .when(_is_list(lines), _list_items(lines))
            .otherwise(F.array(make_block(PARAGRAPH, prose)))
        )

    return let(split_lines(paragraph), build)


def text_blocks(text: Column, separator: str | None = None) -> Column:
    """Blocks of a plain text; paragraphs are set apart by blank lines unless told otherwise."""
    paragraphs = split_paragraphs(text, separator) if separator else split_paragraphs(text)
    return with_seq(F.flatten(F.transform(paragraphs, _paragraph_blocks)))


def page_blocks(text: Column, page: Column) -> Column:
    """Blocks of one page of recognised text: headings and paragraphs only."""

    def block(paragraph: Column) -> Column:
        lines = F.filter(F.transform(split_lines(paragraph), strip), lambda x: F.length(x) > 0)
        joined = F.array_join(lines, " ")
        level = F.when(F.size(lines) == 1, heading_level(joined))
        return make_block(
            F.when(level.isNotNull(), HEADING).otherwise(PARAGRAPH),
            joined,
            level=F.coalesce(level, F.lit(0)),
            page=page,
        )

    return F.transform(split_paragraphs(text), block)


def block_plain_text(block: Column) -> Column:
    """Text of a block as it is translated; a table becomes pipe rows."""
    return F.when(block["type"] == TABLE, render_rows(block["rows"])).otherwise(block["text"])


def blocks_to_json(blocks: Column) -> Column:
    return F.to_json(blocks)


def blocks_from_json(c: Column) -> Column:
    """Blocks from JSON: absent fields get their defaults, unknown ones are left out."""
    return F.transform(
        F.coalesce(F.from_json(c, BLOCKS), F.array().cast(BLOCKS)),
        lambda b, i: F.struct(
            F.coalesce(b["seq"], i).alias("seq"),
            F.coalesce(b["type"], F.lit(PARAGRAPH)).alias("type"),
            F.coalesce(b["text"], F.lit("")).alias("text"),
            F.coalesce(b["page"], F.lit(-1)).alias("page"),
            F.coalesce(b["level"], F.lit(0)).alias("level"),
            F.coalesce(b["marker"], F.lit("")).alias("marker"),
            F.coalesce(b["rows"], F.array().cast(ROWS)).alias("rows"),
            F.coalesce(b["bold"], F.lit(False)).alias("bold"),
            F.coalesce(b["italic"], F.lit(False)).alias("italic"),
        ),
    )


def first_text(blocks: Column, keep) -> Column:
    """Stripped text of the first block that ``keep`` accepts, null if there is none."""
    return F.get(F.transform(F.filter(blocks, keep), lambda b: strip(b["text"])), F.lit(0))


def title_of(blocks: Column, fallback: Column) -> Column:
    """First heading of level two or less, else the first short text, else the fallback."""
    filled = lambda b: F.length(strip(b["text"])) > 0
    heading = first_text(
        blocks, lambda b: (b["type"] == HEADING) & (b["level"] <= 2) & filled(b)
    )
    short = first_text(blocks, lambda b: filled(b) & (F.length(strip(b["text"])) <= 120))
    return F.coalesce(heading, short, fallback)


def chapters_of(blocks: Column, limit: int | None = None) -> Column:
    """The level-one headings, all of them or the first ones."""
    found = F.filter(
        blocks,
        lambda b: (b["type"] == HEADING) & (b["level"] == 1) & (F.length(strip(b["text"])) > 0),
    )
    kept = found if limit is None else F.slice(found, 1, limit)
    return F.transform(kept, lambda b: strip(b["text"]))


def count_of(blocks: Column, kind: str) -> Column:
    return F.size(F.filter(blocks, lambda b: b["type"] == kind))
