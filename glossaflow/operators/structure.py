"""Structure extraction: documents and pages to typed blocks, and per-document summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaflow.functions import blocks as B
from glossaflow.functions.text import CUT, collapse_space, strip
from glossaflow.operators.chunking import chunk_count
from glossaflow.schema import BLOCKS, HEADING, LIST_ITEM, PARAGRAPH, TABLE


def document_blocks(
    documents: DataFrame, text: str = "text", separator: str | None = None
) -> DataFrame:
    """Add the ``blocks`` array of each document.  No shuffle."""
    return documents.withColumn("blocks", B.text_blocks(F.col(text), separator))


def explode_blocks(documents: DataFrame, *keys: str) -> DataFrame:
    """One row a block from documents with a ``blocks`` array."""
    return documents.select(*keys, F.inline("blocks"))


def nest_blocks(blocks: DataFrame, *keys: str) -> DataFrame:
    """Documents with a ``blocks`` array from one row a block.

    The array of a document is as large as the document; ``MAX_FILE_BYTES`` of the file source
    bounds that.
    """
    entry = F.struct(*[F.col(f).cast(BLOCKS.elementType[f].dataType).alias(f)
                       for f in BLOCKS.elementType.fieldNames()])
    return blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("blocks"))


def text_to_blocks(
    documents: DataFrame, key: str = "doc_id", text: str = "text", separator: str | None = None
) -> DataFrame:
    return explode_blocks(document_blocks(documents.select(key, text), text, separator), key)


def page_text_to_blocks(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks of page texts (key, page, text).

    The running number over a document adds up the block counts of its earlier pages, so only one
    small row a page is ordered, not the blocks.
    """
    paged = pages.select(key, "page", B.page_blocks(F.col("text"), F.col("page")).alias("blocks"))
    earlier = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    offsets = paged.select(key, "page", F.size("blocks").alias("n")).select(
        key, "page", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")
    )
    return (
        paged.select(key, "page", F.posexplode("blocks").alias("pos", "block"))
        .join(offsets, [key, "page"])
        .select(
            key,
            (F.col("offset") + F.col("pos")).cast("int").alias("seq"),
            F.col("block.*"),
        )
    )


def block_counts(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks of each type per document, from one row a block."""
    count = lambda kind: F.count_if(F.col("type") == kind)
    return blocks.groupBy(key).agg(
        count(HEADING).alias("headings"),
        count(PARAGRAPH).alias("paragraphs"),
        count(LIST_ITEM).alias("list_items"),
        count(TABLE).alias("tables"),
    )


def detect_title(blocks: DataFrame, fallback: Column, key: str = "doc_id") -> DataFrame:
    """Title of each document, from one row a block."""
    text = strip(F.col("text"))
    heading = (F.col("type") == HEADING) & (F.col("level") <= 2) & (F.length(text) > 0)
    short = (F.length(text) > 0) & (F.length(text) <= 120)
    first = lambda keep: F.min_by(
        F.when(keep, text), F.when(keep, F.col("seq"))
    )
    return (
        blocks.groupBy(key)
        .agg(first(heading).alias("_heading"), first(short).alias("_short"))
        .select(key, F.coalesce("_heading", "_short", fallback).alias("title"))
    )


def chapters(documents: DataFrame, *keys: str, limit: int | None = None) -> DataFrame:
    """The chapters of documents with a ``blocks`` array, one row a chapter."""
    return documents.select(
        *keys, F.posexplode(B.chapters_of(F.col("blocks"), limit)).alias("chapter_index", "chapter")
    )


def analyze_documents(
    documents: DataFrame,
    *keys: str,
    fallback_title: Column,
    target: int = 4000,
    maximum: int = 6000,
    scanned: DataFrame | None = None,
) -> DataFrame:
    """Summary of each document with a ``blocks`` array.  No shuffle: all parts are in the row.

    ``scanned``, from ``detect_scanned``, adds the number of pages and whether they are scans; a
    document that it does not have has no pages and is none.
    """
    blocks = F.col("blocks")
    counted = documents.select(
        *keys,
        F.aggregate(
            blocks,
            F.lit(0).cast("long"),
            lambda total, b: total + F.length(b["text"]),
        ).alias("character_count"),
        B.count_of(blocks, HEADING).alias("heading_count"),
        B.count_of(blocks, PARAGRAPH).alias("paragraph_count"),
        B.count_of(blocks, TABLE).alias("table_count"),
        B.count_of(blocks, LIST_ITEM).alias("list_item_count"),
        chunk_count(blocks, target, maximum).alias("estimated_chunks"),
        B.chapters_of(blocks).alias("chapters"),
        B.title_of(blocks, fallback_title).alias("title"),
    )
    summary = counted.withColumn(
        "has_extractable_text", F.col("character_count") > 0
    ).withColumn(
        "estimated_translation_units",
        F.col("heading_count")
        + F.col("paragraph_count")
        + F.col("list_item_count")
        + F.col("table_count"),
    )
    if scanned is None:
        return summary
    pages = scanned.select(*keys, "page_count", "is_scanned")
    return summary.join(pages, list(keys), "left").withColumn(
        "is_scanned", F.coalesce("is_scanned", F.lit(False))
    )


# Elements whose content is no text, and those that end a block.
SKIPPED_ELEMENTS = "script|style|noscript|template|head"
BLOCK_ELEMENTS = (
    "h[1-6]|p|li|ul|ol|div|article|section|header|footer|main|aside|table|tr|td|th|br|hr|title|body|html"
)
# The code points of the named characters that texts mostly use.
ENTITIES = {
    "amp": 38, "lt": 60, "gt": 62, "quot": 34, "apos": 39, "nbsp": 160, "iexcl": 161, "cent": 162, "pound": 163,
    "yen": 165, "sect": 167, "copy": 169, "laquo": 171, "shy": 173, "reg": 174, "deg": 176, "plusmn": 177,
    "sup2": 178, "sup3": 179, "acute": 180, "micro": 181, "para": 182, "middot": 183, "raquo": 187, "frac14": 188,
    "frac12": 189, "frac34": 190, "iquest": 191, "Agrave": 192, "Aacute": 193, "Acirc": 194, "Atilde": 195, "Auml": 196,
    "Aring": 197, "AElig": 198, "Ccedil": 199, "Egrave": 200, "Eacute": 201, "Ecirc": 202, "Euml": 203, "Iacute": 205,
    "Ntilde": 209, "Oacute": 211, "Ouml": 214, "times": 215, "Oslash": 216, "Uacute": 218, "Uuml": 220, "szlig": 223,
    "agrave": 224, "aacute": 225, "acirc": 226, "atilde": 227, "auml": 228, "aring": 229, "aelig": 230, "ccedil": 231,
    "egrave": 232, "eacute": 233, "ecirc": 234, "euml": 235, "igrave": 236, "iacute": 237, "icirc": 238, "iuml": 239,
    "ntilde": 241, "ograve": 242, "oacute": 243, "ocirc": 244, "otilde": 245, "ouml": 246, "divide": 247, "oslash": 248,
    "ugrave": 249, "uacute": 250, "ucirc": 251, "uuml": 252, "yacute": 253, "yuml": 255, "ndash": 8211, "mdash": 8212,
    "lsquo": 8216, "rsquo": 8217, "sbquo": 8218, "ldquo": 8220, "rdquo": 8221, "bdquo": 8222, "bull": 8226,
    "hellip": 8230, "euro": 8364, "trade": 8482, "larr": 8592, "rarr": 8594, "minus": 8722, "zwnj": 8204, "zwj": 8205,
}


def decode_entities(text: Column) -> Column:
    """Text with its character references decoded once: by number, decimal or hexadecimal, and by name.

    The text is cut before each ``&``, so what a reference gives is not read as part of another.
    Unknown names and impossible numbers stay as they are.
    """
    known = F.create_map(*[F.lit(v) for pair in ENTITIES.items() for v in pair])

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^&(#[0-9]{1,8}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]+[0-9]{0,2});", 1)
        point = (
            F.when(F.startswith(name, F.lit("#x")) | F.startswith(name, F.lit("#X")), F.conv(F.substring(name, 3, 6), 16, 10))
            .when(F.startswith(name, F.lit("#")), F.substring(name, 2, 8))
            .otherwise(F.try_element_at(known, name).cast("string"))
            .cast("bigint")
        )
        valid = (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        rest = F.substr(piece, F.length(name) + 3)
        return F.when((name != "") & valid, F.concat(character, rest)).otherwise(piece)

    pieces = F.transform(F.split(text, "(?=&)"), decoded)
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def html_to_blocks(html: Column) -> Column:
    """Typed blocks of a page: all text that an element shows, whatever is nested in it.

    Scripts, styles, the head and comments show none, to the end of the page if they are not closed.  A block element ends the block before it;
    other elements only mark up text and leave no trace.  Headings and list items are told by their
    element, all else is a paragraph.  Runs of white space become one space.
    """
    shown = F.regexp_replace(html, "(?s)<!--.*?(?:-->|\\z)", "")
    shown = F.regexp_replace(shown, f"(?is)<({SKIPPED_ELEMENTS})\\b[^>]*>.*?(?:</\\1\\s*>|\\z)", "")
    # Each start or end of a block element begins a piece.
    pieces = F.split(F.regexp_replace(shown, f"(?i)</?({BLOCK_ELEMENTS})\\b[^>]*>", f"{CUT}$0"), CUT)

    def block(piece: Column) -> Column:
        text = decode_entities(F.regexp_replace(piece, "<[^>]*>", ""))
        name = F.lower(F.regexp_extract(piece, "^<([A-Za-z0-9]+)", 1))
        level = F.when(F.rlike(name, F.lit("^h[1-6]$")), F.substring(name, 2, 1).cast("int"))
        kind = F.when(level.isNotNull(), HEADING).when(name == "li", LIST_ITEM).otherwise(PARAGRAPH)
        return B.make_block(
            kind,
            strip(collapse_space(text)),
            level=F.coalesce(level, F.lit(0)),
            marker=F.when(name == "li", B.BULLET).otherwise(""),
        )

    return B.with_seq(F.filter(F.transform(pieces, block), lambda b: F.length(b["text"]) > 0))
