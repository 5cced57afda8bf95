"""Structure from page layout: text spans with font sizes, and scanned documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaflow.functions.text import MAYBE_SPACES, SPACES, strip
from glossaflow.schema import HEADING, LIST_ITEM, PARAGRAPH

# Heading and list patterns of laid-out pages, and the size ratios of heading levels.
CHAPTER_LINE = rf"(?iu)^{MAYBE_SPACES}(?:chapter|part|section|قسم|الفصل){SPACES}[\p{{Nd}}IVXLC]+"
BULLET_TEXT = (
    rf"^{MAYBE_SPACES}([•▪◦‣·–—*]|\(?\p{{Nd}}{{1,2}}[.)]|[a-z][.)]){SPACES}"
)
HEADING_RATIO = 1.12
LEVEL_RATIOS = ((1.7, 1), (1.4, 2), (1.15, 3))
DEFAULT_BODY_SIZE = 11.0
SCAN_CHARS_PER_PAGE = 40.0


def weighted_mode(rows: DataFrame, key: str, value: Column, weight: Column, order: Column, name: str):
    """Per key, the value with the largest total weight; the one seen first wins a tie."""
    totals = rows.groupBy(key, value.alias("_value")).agg(
        F.sum(weight).alias("_weight"), F.min(order).alias("_first")
    )
    # Smallest of (-weight, first place) is the heaviest value that came first.
    return totals.groupBy(key).agg(
        F.min_by("_value", F.struct(-F.col("_weight"), F.col("_first"))).alias(name)
    )


def body_sizes(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Font size that most characters of a document have, over all its pages."""
    counted = (
        spans.select(key, "page", "block", "line", "span", "size", "text")
        .withColumn("_chars", F.length(strip(F.col("text"))))
        .where("_chars > 0")
    )
    place = F.struct("page", "block", "line", "span")
    return weighted_mode(
        counted, key, F.bround("size", 1), F.col("_chars"), place, "body_size"
    )


def classify_layout_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Text spans (key, page, block, line, span, size, text) to headings, list items, paragraphs.

    Texts are dealt once, by page: lines, blocks and places on a page need no further exchange, and
    what is known of a document comes with its pages.
    """
    by_page = spans.select(key, "page", "block", "line", "span", "size", "text").repartition(key, "page")
    lines = by_page.groupBy(key, "page", "block", "line").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]
            ),
            "",
        ).alias("line_text"),
        F.max("size").alias("line_size"),
    )
    found = lines.groupBy(key, "page", "block").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("line", "line_text"))),
                lambda x: x["line_text"],
            ),
            "\n",
        ).alias("_text"),
        F.count("*").alias("_lines"),
        F.max("line_size").alias("_size"),
    )
    text = F.col("text")
    body = F.coalesce(F.col("body_size"), F.lit(DEFAULT_BODY_SIZE))
    ratio = F.when(body > 0, F.col("_size") / body).otherwise(F.lit(1.0))
    chapter = text.rlike(CHAPTER_LINE)
    level = F.when(chapter, 1)
    for least, number in LEVEL_RATIOS:
        level = level.when(ratio >= least, number)
    level = level.otherwise(4)
    heading = (
        (F.col("_lines") == 1)
        & ~F.contains(text, F.lit("\n"))
        & (F.length(text) <= 150)
        & ((F.col("_size") >= body * HEADING_RATIO) | chapter)
    )
    bullet = text.rlike(BULLET_TEXT) & (F.length(text) < 600)
    kind = F.when(heading, HEADING).when(bullet, LIST_ITEM).otherwise(PARAGRAPH)
    # A block's number is its place on the page plus the blocks of earlier pages, so that what is
    # ordered over a whole document is one small row a page.
    kept = found.withColumn("text", strip(F.col("_text"))).where("text <> ''")
    earlier = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    shown = spans.where(strip(F.col("text")) != "").groupBy(key, "page").agg(F.count_distinct("block").alias("n"))
    pages = shown.select(key, "page", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset")).join(
        body_sizes(spans, key), key, "left"
    )
    place = F.row_number().over(Window.partitionBy(key, "page").orderBy("block"))
    return (
        kept.withColumn("_place", place)
        .join(pages, [key, "page"])
        .select(
            key,
            "page",
            (F.col("_offset") + F.col("_place") - 1).cast("int").alias("seq"),
            kind.alias("type"),
            F.when(kind == LIST_ITEM, strip(F.regexp_replace(text, BULLET_TEXT, "")))
            .otherwise(text)
            .alias("text"),
            F.when(kind == HEADING, level).otherwise(0).alias("level"),
            F.when(kind == LIST_ITEM, F.regexp_extract(text, BULLET_TEXT, 1))
            .otherwise("")
            .alias("marker"),
        )
    )


def detect_scanned(page_text: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents (key, page, text, has_image) whose pages hold next to no text, over all pages."""
    chars = F.length(strip(F.coalesce("text", F.lit(""))))
    return (
        page_text.groupBy(key)
        .agg(
            F.count("*").alias("page_count"),
            F.count_if("has_image").alias("pages_with_images"),
            (F.sum(chars) / F.count("*")).alias("_average"),
        )
        .select(
            key,
            "page_count",
            F.bround("_average", 1).alias("avg_chars_per_page"),
            "pages_with_images",
            (F.col("_average") < SCAN_CHARS_PER_PAGE).alias("is_scanned"),
        )
    )
