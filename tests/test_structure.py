"""Structure extraction and chunking against hand-made documents and plain loops."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaflow.functions import blocks as B
from glossaflow.operators import chunking, layout, long_documents, structure
from glossaflow.schema import BLOCK, BLOCKS
from glossaflow.session import shared_folder

TEXT = (
    "Chapter 1 Start\n\nFirst one\nstill first.\n\nSecond.\n\n- item one\n* item two\n\n"
    "1) numbered\n2. again\n\n### Small\n\nALL CAPS\n\nALL CAPS.\n\n- item\nnot item\n\nPart II"
)


def test_text_blocks(value):
    found = [(b.type, b.text, b.level, b.marker) for b in value(B.text_blocks(F.lit(TEXT)))]
    assert found == [
        ("heading", "Chapter 1 Start", 1, ""),
        ("paragraph", "First one still first.", 0, ""),
        ("paragraph", "Second.", 0, ""),
        ("list_item", "item one", 0, "•"),
        ("list_item", "item two", 0, "•"),
        ("list_item", "numbered", 0, "1."),
        ("list_item", "again", 0, "2."),
        ("heading", "Small", 3, ""),
        ("heading", "ALL CAPS", 2, ""),
        ("paragraph", "ALL CAPS.", 0, ""),
        ("paragraph", "- item not item", 0, ""),
        ("heading", "Part II", 1, ""),
    ]


def test_counts_title_chapters(spark, rows):
    documents = structure.document_blocks(spark.createDataFrame([("d", TEXT), ("e", "x" * 200)], "doc_id string, text string"))
    flat = structure.explode_blocks(documents, "doc_id")
    assert rows(structure.block_counts(flat)) == [("d", 4, 4, 4, 0), ("e", 0, 1, 0, 0)]
    assert rows(structure.detect_title(flat, F.lit("none"))) == [("d", "Chapter 1 Start"), ("e", "none")]
    assert rows(structure.chapters(documents, "doc_id")) == [("d", 0, "Chapter 1 Start"), ("d", 1, "Part II")]
    summary = {r.doc_id: r for r in structure.analyze_documents(documents, "doc_id", fallback_title=F.lit("none")).collect()}
    assert summary["d"].estimated_translation_units == 12
    assert summary["d"].estimated_chunks == 2
    assert summary["d"].title == "Chapter 1 Start"
    again = structure.nest_blocks(flat, "doc_id")
    assert rows(structure.explode_blocks(again, "doc_id")) == rows(flat)


def test_page_text(spark, rows):
    pages = spark.createDataFrame(
        [("d", 2, "CHAPTER 2\n\n b \n c "), ("d", 1, "Title case\n\nSHOUT"), ("d", 3, " ")], "doc_id string, page int, text string"
    )
    found = structure.page_text_to_blocks(pages).select("seq", "page", "type", "text", "level")
    assert rows(found) == [
        (0, 1, "paragraph", "Title case", 0),
        (1, 1, "heading", "SHOUT", 2),
        (2, 2, "heading", "CHAPTER 2", 1),
        (3, 2, "paragraph", "b c", 0),
    ]


def test_layout(spark, rows):
    body = "plain words that fill the body of the page " * 3
    spans = [
        ("d", 1, 0, 0, 0, 22.0, "Big title"),
        ("d", 1, 1, 0, 0, 11.0, body),
        ("d", 1, 1, 1, 0, 11.0, "second "),
        ("d", 1, 1, 1, 1, 11.0, "half"),
        ("d", 1, 2, 0, 0, 11.0, "• a point"),
        ("d", 1, 3, 0, 0, 13.0, "Smaller head"),
        ("d", 2, 0, 0, 0, 11.0, "Chapter 4 plain size"),
        ("d", 2, 1, 0, 0, 22.0, " "),
    ]
    frame = spark.createDataFrame(spans, "doc_id string, page int, block int, line int, span int, size double, text string")
    found = layout.classify_layout_spans(frame).orderBy("seq").select("seq", "type", "text", "level", "marker")
    assert [tuple(r) for r in found.collect()] == [
        (0, "heading", "Big title", 1, ""),
        (1, "paragraph", (body + "\nsecond half"), 0, ""),
        (2, "list_item", "a point", 0, "•"),
        (3, "heading", "Smaller head", 3, ""),
        (4, "heading", "Chapter 4 plain size", 1, ""),
    ]


def test_scanned(spark, rows):
    pages = [("text", p, "x" * 100, False) for p in range(1, 4)] + [("scan", p, " ", True) for p in range(1, 4)]
    pages += [("late", p, "x" * 100 if p <= 10 else "", True) for p in range(1, 40)]
    pages += [("cover", p, "" if p <= 10 else "x" * 100, True) for p in range(1, 40)]
    frame = spark.createDataFrame(pages, "doc_id string, page int, text string, has_image boolean")
    found = layout.detect_scanned(frame).select("doc_id", "page_count", "avg_chars_per_page", "is_scanned")
    assert rows(found) == [("cover", 39, 74.4, False), ("late", 39, 25.6, True), ("scan", 3, 0.0, True), ("text", 3, 100.0, False)]


def test_body_size_is_that_of_all_pages(spark):
    spans = [("d", p, 0, 0, 0, 11.0 if p % 2 else 14.0, "x" * (10 if p % 2 else 30)) for p in range(1, 61)]
    frame = spark.createDataFrame(spans, "doc_id string, page int, block int, line int, span int, size double, text string")
    assert layout.body_sizes(frame).first()["body_size"] == 14.0


def test_html_blocks(value):
    html = (
        "<html><head><title>T</title></head><body><!-- <p>no</p> --><script>var t='</p>';</script>"
        "<h2 class=a>Head &amp; more</h2><p>One <b>bold <i>deep</i></b> end<br>next<p><a href=x>all linked</a></p>"
        "<ul><li><a href='/a'>item</a></li><li> two\n words </li></ul><div>loose<footer>foot</footer></div></body></html>"
    )
    found = value(structure.html_to_blocks(F.lit(html)))
    assert [(b.seq, b.type, b.text, b.level, b.marker) for b in found] == [
        (0, "heading", "Head & more", 2, ""), (1, "paragraph", "One bold deep end", 0, ""), (2, "paragraph", "next", 0, ""),
        (3, "paragraph", "all linked", 0, ""), (4, "list_item", "item", 0, "•"), (5, "list_item", "two words", 0, "•"),
        (6, "paragraph", "loose", 0, ""), (7, "paragraph", "foot", 0, ""),
    ]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("a &mdash; b &#8212; c &#x2014; d", "a — b — c — d"), ("caf&eacute; &amp;lt; &lt;x&gt;", "café &lt; <x>"),
        ("&unknown; & &; &#0; &#xD800; &#99999999; AT&T", "&unknown; & &; &#0; &#xD800; &#99999999; AT&T"),
        ("&#128512;&#39;&frac12;", "😀'½"), ("none", "none"),
    ],
)
def test_character_references(value, given, wanted):
    assert value(structure.decode_entities(F.lit(given))) == wanted


def test_unclosed_scripts_and_comments_show_nothing(value):
    for tail in ("<script>var x = '<p>no</p>';", "<style>p {}", "<!-- never closed <p>no</p>"):
        found = value(structure.html_to_blocks(F.lit(f"<p>yes</p>{tail}")))
        assert [b.text for b in found] == ["yes"], tail


def test_summary_with_pages(spark):
    documents = documents_of(spark, [block(0, "paragraph", "text")])
    pages = spark.createDataFrame([("d", p, "", True) for p in (1, 2)], "doc_id string, page int, text string, has_image boolean")
    found = structure.analyze_documents(documents, "doc_id", fallback_title=F.lit(""), scanned=layout.detect_scanned(pages)).first()
    assert (found["page_count"], found["is_scanned"]) == (2, True)


def test_chapters_are_all_listed_whole(spark):
    documents = documents_of(spark, [block(i, "heading", f"{i} " + "x" * 300, 1) for i in range(70)])
    found = structure.chapters(documents, "doc_id").collect()
    assert len(found) == 70 and all(len(r["chapter"]) > 300 for r in found)


def block(seq, kind, text="", level=0, page=-1, rows=()):
    return (seq, kind, text, page, level, "", [list(r) for r in rows], False, False)


def documents_of(spark, blocks):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("blocks", T.ArrayType(BLOCK))])
    return spark.createDataFrame([("d", blocks)], schema)


def chunked(spark, blocks, target, maximum):
    return chunking.chunk_documents(documents_of(spark, blocks), "doc_id", target=target, maximum=maximum).orderBy("chunk_index").collect()


def test_one_chunk(spark):
    [only] = chunked(spark, [block(0, "heading", "One", 1, 10), block(1, "heading", "Two", 2, 11), block(2, "paragraph", "Body.", page=12)], 4000, 6000)
    assert (only.chapter, only.section, only.page_start, only.page_end, only.chunk_index) == ("One", "Two", 10, 12, 0)
    assert only.source_text == "One\n\nTwo\n\nBody."
    assert only.char_count == 15


def test_chapters_do_not_mix(spark):
    blocks = [block(0, "heading", "A", 1)] + [block(i, "paragraph", "word " * 10) for i in range(1, 31)]
    blocks += [block(31, "heading", "B", 1), block(32, "paragraph", "end")]
    found = chunked(spark, blocks, 500, 900)
    assert {c.chapter for c in found} == {"A", "B"}
    assert [c.source_text for c in found if c.chapter == "B"] == ["B\n\nend"]


def test_heading_stays_with_content(spark):
    blocks = [block(i, "paragraph", f"para {i} " * 3) for i in range(40)]
    blocks += [block(40, "heading", "Head", 2), block(41, "paragraph", "text after head")]
    last = chunked(spark, blocks, 400, 600)[-1]
    assert "Head" in last.source_text and "text after head" in last.source_text
    assert last.section == "Head"


def test_long_paragraph(spark):
    sentence = "This is one of many equal sentences here."
    found = chunked(spark, [block(0, "paragraph", " ".join([sentence] * 80))], 500, 700)
    assert len(found) >= 2
    assert all(b.text.endswith(".") and len(b.text) <= 500 for c in found for b in c.source_blocks)
    assert " ".join(b.text for c in found for b in c.source_blocks) == " ".join([sentence] * 80)


def test_long_table(spark):
    cells = [[f"r{r}c{c} some cell text" for c in range(4)] for r in range(20)]
    found = chunked(spark, [block(0, "table", rows=cells)], 200, 300)
    groups = [b.rows for c in found for b in c.source_blocks]
    assert len(found) == 1 and len(groups) > 1
    assert [r for g in groups for r in g] == cells


def test_text_is_kept(spark):
    blocks = [block(i, "paragraph", f"paragraph number {i} " + "x" * (i % 50)) for i in range(500)]
    found = chunked(spark, blocks, 800, 1200)
    assert len(found) > 10
    assert [c.chunk_index for c in found] == list(range(len(found)))
    assert "\n\n".join(c.source_text for c in found) == "\n\n".join(b[2] for b in blocks)


def plain_chunks(blocks, target):
    """The packing rule as a loop, for comparison."""
    result, chars, count, after_heading = [], 0, 0, False
    for _, kind, text, _, level, *_ in blocks:
        heading = kind == "heading"
        if not result:
            fresh = True
        elif heading:
            fresh = level == 1 or chars + len(text) >= target
        elif after_heading and (chars < target * 0.8 or count == 1):
            fresh = False
        else:
            fresh = chars + len(text) > target
        if fresh:
            result.append([])
            chars = count = 0
        result[-1].append(text)
        chars, count, after_heading = chars + len(text) + 2, count + 1, heading
    return ["\n\n".join(t for t in c if t) for c in result]


@pytest.mark.parametrize("seed", range(6))
def test_packing_rule(spark, seed):
    pick = random.Random(seed)
    blocks = []
    for i in range(300):
        kind = pick.choice(["heading", "paragraph", "paragraph", "list_item"])
        level = pick.choice([1, 2, 2, 3, 3, 4]) if kind == "heading" else 0
        blocks.append(block(i, kind, "x" * pick.choice([0, 5, 20, 60, 120, 240]), level))
    found = chunked(spark, blocks, 200, 100000)
    assert [c.source_text for c in found] == plain_chunks(blocks, 200)


def test_long_words(value):
    text = "short one. " + "word " * 100 + "end. Next one."
    pieces = value(chunking.split_long_text(F.lit(text.strip()), 60))
    assert " ".join(pieces) == text.strip()
    assert all(len(p) <= 60 for p in pieces)


def test_a_long_sentence_starts_its_own_piece(value):
    text = "Short one here. Word " + "abcd " * 60 + "end."
    pieces = value(chunking.split_long_text(F.lit(text), 100))
    assert pieces[0] == "Short one here." and pieces[1].startswith("Word abcd")
    assert " ".join(pieces) == text


def test_blocks_as_rows_make_the_same_chunks(spark):
    """Random headings, tables and long texts: rows streamed by chapter against the fold in a row."""
    pick = random.Random(21)
    documents = []
    for k in range(30):
        blocks = []
        for seq in range(pick.randint(0, 60)):
            kind = pick.choice(["paragraph"] * 6 + ["heading"] * 2 + ["list_item", "table"])
            text = " ".join(f"Word {pick.randrange(9)}." for _ in range(pick.choice([1, 5, 20, 90])))
            level = pick.choice([1, 2, 2, 3, 4]) if kind == "heading" else 0
            table = [[f"c{j}", "value"] for j in range(pick.randint(1, 40))] if kind == "table" else []
            blocks.append((seq, kind, text, seq // 7, level, "", table, False, False))
        documents.append((k, blocks))
    schema = T.StructType([T.StructField("doc_id", T.IntegerType()), T.StructField("blocks", BLOCKS)])
    given = spark.createDataFrame(documents, schema)
    rows = given.select("doc_id", F.inline("blocks")).repartition(5)
    wanted = chunking.chunk_documents(given, "doc_id", target=300, maximum=450)
    found = long_documents.chunk_block_rows(rows, "doc_id", target=300, maximum=450)
    assert sorted(found.columns) == sorted(wanted.columns)
    order = lambda frame: sorted(map(str, frame.select(*wanted.columns).collect()))
    assert order(found) == order(wanted) and found.count() > 100


def test_a_document_of_many_blocks_spans_tasks(spark):
    block = F.struct(
        F.col("id").cast("int").alias("seq"),
        F.when(F.col("id") % 10_000 == 0, "heading").otherwise("paragraph").alias("type"),
        F.concat(F.lit("block "), F.col("id")).alias("text"),
        F.lit(0).alias("page"),
        F.when(F.col("id") % 10_000 == 0, 1).otherwise(0).alias("level"),
        F.lit("").alias("marker"),
        F.array().cast("array<array<string>>").alias("rows"),
        F.lit(False).alias("bold"),
        F.lit(False).alias("italic"),
    )
    rows = spark.range(300_000).select(F.lit(1).alias("doc_id"), block.alias("b")).select("doc_id", "b.*")
    # Chapters meet in tasks of their own; here small ones would be put together.
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        placed = long_documents.assign_block_rows(rows, "doc_id")
        by_task = placed.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset(coalesce)
    assert len(by_task) == 8
    # Each chunk is a run of blocks, and chunks follow each other.
    runs = placed.groupBy("chunk_index").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.count("*").alias("n")).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in runs] == list(range(len(runs)))
    assert all(r["b"] - r["a"] + 1 == r["n"] for r in runs)
    assert [r["a"] for r in runs[1:]] == [r["b"] + 1 for r in runs[:-1]]


def _given(spark, frame):
    """The frame as a table of its own, and the folder it lies in."""
    path = shared_folder(spark, "given")
    frame.write.parquet(path)
    return spark.read.parquet(path), path


def test_rows_of_blocks_are_packed_once(spark):
    fields = [F.col("id").cast("int").alias("seq"), F.lit("paragraph").alias("type"), F.lit("text").alias("text"), F.lit(0).alias("page")]
    fields += [F.lit(0).alias("level"), F.lit("").alias("marker"), F.array().cast("array<array<string>>").alias("rows")]
    fields += [F.lit(False).alias("bold"), F.lit(False).alias("italic")]
    blocks, path = _given(spark, spark.range(20).select(F.lit(1).alias("doc_id"), *fields))
    found = long_documents.chunk_block_rows(blocks, "doc_id")
    assert found.select("source_text").first()[0] == "\n\n".join(["text"] * 20)
    # What is used several times is read from what was written once.
    assert found.inputFiles() and not [f for f in found.inputFiles() if path in f]
    assert "MapInPandas" not in found._jdf.queryExecution().analyzed().toString()


def test_layout_moves_texts_once(spark, rows):
    """A block of blank spans alone counts nowhere; texts are exchanged by page and not again."""
    spans = [("d", p, b, l, s, 11.0, " " if b == 1 else f"{p}{b}{l}{s}") for p in (1, 2, 3) for b in range(3) for l in (0, 1) for s in (0, 1)]
    given, _ = _given(
        spark,
        spark.createDataFrame(spans, "doc_id string, page int, block int, line int, span int, size double, text string"),
    )
    found = layout.classify_layout_spans(given)
    assert rows(found.select("seq", "page", "text")) == [
        (2 * (p - 1) + k, p, f"{p}{b}00{p}{b}01\n{p}{b}10{p}{b}11") for p in (1, 2, 3) for k, b in enumerate((0, 2))
    ]
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = found._jdf.queryExecution().explainString(mode)
    exchanges = [part.split("\n\n")[0] for part in plan.split("\n(") if " Exchange\n" in part]
    moved = [e for e in exchanges if "text#" in e or "_text#" in e]
    assert exchanges and len(moved) == 1, moved
