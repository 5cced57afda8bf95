"""Text, table, markup, response and name expressions."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from glossaflow.functions import blocks as B
from glossaflow.functions import markup, names, responses, tables, text
from glossaflow.functions.register import register_functions

L = F.lit


def test_normal_form_and_hash(value):
    raw = "  One\u00a0 Two\n\tTHREE\u2003four \x1c five  "
    normal = re.sub(r"\s+", " ", raw.strip()).lower()
    assert value(text.normalize_text(L(raw))) == normal
    assert value(text.source_hash(L(raw))) == hashlib.sha256(normal.encode()).hexdigest()


def test_space_patterns_agree_with_unicode(value):
    kept = value(F.regexp_replace(L(f"a{text.WHITESPACE}b"), text.SPACES, ""))
    assert kept == "ab"
    assert value(F.regexp_replace(L("a\u200b_b\u180ec"), text.SPACES, "")) == "a\u200b_b\u180ec"


@pytest.mark.parametrize(
    "raw, expected",
    [("", 1), ("abcdefgh", 2), ("ابت", 1), ("ابتابت" + "abcd", 3), ("a" * 400, 100)],
)
def test_tokens(value, raw, expected):
    assert value(text.estimate_tokens(L(raw))) == expected


def test_mostly_arabic(value):
    assert value(text.is_mostly_arabic(L("نص عربي with"))) is True
    assert value(text.is_mostly_arabic(L("English words ن"))) is False
    assert value(text.is_mostly_arabic(L("123"))) is False


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("One here. Two here! Three here? Four here.", ["One here.", "Two here!", "Three here?", "Four here."]),
        ("Dr. Smith came. He left.", ["Dr. Smith came.", "He left."]),
        ("He met J. Smith. Then more.", ["He met J.", "Smith.", "Then more."]),
        ("A. B. C. D.", ["A. B.", "C. D."]),
        ("no split. here", ["no split. here"]),
        ("انتهى؟ نعم. 3 items", ["انتهى؟", "نعم.", "3 items"]),
        ("Yes. Then on.", ["Yes. Then on."]),
        ("   ", []),
    ],
)
def test_sentences(value, raw, expected):
    assert value(text.split_sentences(L(raw))) == expected


def test_fences(value):
    assert value(responses.strip_code_fences(L("```text\na\nb\n```"))) == "a\nb"
    assert value(responses.strip_code_fences(L("```a```"))) == "```a```"
    assert value(responses.strip_code_fences(L("  plain "))) == "plain"


def test_prefix(value):
    assert value(responses.strip_response_prefix(L("Translation: x"))) == "x"
    assert value(responses.strip_response_prefix(L("الترجمة: – نص"))) == "نص"
    assert value(responses.strip_response_prefix(L("My translation: x"))) == "My translation: x"


@pytest.mark.parametrize(
    "raw, expected",
    [
        ('{"a": 1}', True),
        (' {"a": {"b": [1, 2]}} ', True),
        ("{}", True),
        ('{"a": 1', False),
        ('{"a":1} {"b":2}', False),
        ('{"a":1},{"b":2}', False),
        ("{'a': 1}", False),
        ("[1]", False),
        ("plain", False),
    ],
)
def test_json_object(value, raw, expected):
    assert value(responses.looks_like_json_object(L(raw))) is expected


@pytest.mark.parametrize(
    "raw, finish, expected",
    [
        ("fine", "stop", None),
        ("fine", "length", "truncated"),
        ("", "stop", "empty"),
        ('{"a":1}', "stop", "json_object"),
        ("x == TEXT == y", "stop", "prompt_echo"),
        ("Note: more", "stop", "comment"),
        ("Translation:", "stop", "empty_after_cleaning"),
    ],
)
def test_model_output(value, raw, finish, expected):
    assert value(responses.classify_model_output(L(raw), L(finish))) == expected


def test_row_markers(value):
    raw = "a | b\nplain\nc | d | e"
    numbered = value(tables.number_table_rows(L(raw)))
    assert numbered == "[1] a | b\nplain\n[2] c | d | e"
    assert value(tables.strip_row_markers(L(numbered))) == raw
    assert value(tables.extract_row_markers(L(numbered))) == [1, 2]
    assert value(tables.row_cell_counts(L(numbered))) == {1: 2, 2: 3}
    assert value(tables.number_table_rows(L(""))) == ""


def test_arabic_indic_markers(value):
    raw = "[١] أ | ب\n[١٢] ج"
    assert value(tables.extract_row_markers(L(raw))) == [1, 12]
    assert value(tables.strip_row_markers(L(raw))) == "أ | ب\nج"
    assert value(tables.row_cell_counts(L("[1] a\n[1] b | c"))) == {1: 2}
    assert value(tables.extract_row_markers(L("x [1]\n[12345] y"))) == []


def _rows(*sizes):
    return F.array(*[F.array(*[L(f"s{i}") for i in range(n)]) for n in sizes])


@pytest.mark.parametrize(
    "raw, sizes, expected",
    [
        ("| a | b |\nc|d", (2, 2), [["a", "b"], ["c", "d"]]),
        ("a", (3,), [["a", "", ""]]),
        ("a | b | c | d", (2,), [["a", "b | c | d"]]),
        ("[1] a | b\n\n[2] c", (2, 1), [["a", "b"], ["c"]]),
        ("a | b\nc | d", (2,), [["a", "b"], ["c", "d"]]),
        ("  ", (2,), [["s0", "s1"]]),
    ],
)
def test_reshape(value, raw, sizes, expected):
    assert value(tables.reshape_table_rows(L(raw), _rows(*sizes))) == expected


def test_runs(value):
    found = value(markup.inline_runs(L("a **b** *c* ***d*** e* ****")))
    assert [tuple(r) for r in found] == [
        ("a ", False, False),
        ("b", True, False),
        (" ", False, False),
        ("c", False, True),
        (" ", False, False),
        ("d", True, True),
        (" e", False, False),
        (" ", False, True),
        ("*", False, True),
    ]


def test_mark_runs(value):
    run = lambda t, b, i: F.struct(L(t).alias("text"), L(b).alias("bold"), L(i).alias("italic"))
    marked = markup.mark_runs(F.array(run(" a ", True, False), run("b", False, True), run("  ", True, True), run("c", True, True)))
    assert value(marked) == " **a** *b*  ***c***"
    assert value(markup.heading_style_level(L("Heading 7"))) == 4
    assert value(markup.heading_style_level(L("Title"))) == 1
    assert value(markup.heading_style_level(L("Normal"))) is None


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("report.pdf", "report.pdf"),
        ("../../etc/passwd", "passwd"),
        ("C:\\docs\\a<b>.txt", "a_b_.txt"),
        (" ..hidden. ", "hidden"),
        ("..", None),
        ("", None),
        ("a/", None),
        ("x" * 130 + ".docx", "x" * 112 + ".docx"),
    ],
)
def test_file_names(value, raw, expected):
    assert value(names.sanitize_filename(L(raw))) == expected


def test_extensions(value):
    assert value(names.extension_verdict(L("a.PDF"))) == "ok"
    assert value(names.extension_verdict(L("a.epub"))) == "planned"
    assert value(names.extension_verdict(L("a"))) == "unsupported"
    assert value(names.file_suffix(L(".txt"))) == ""
    assert value(names.output_name(L("Été: a/b"))) == "Été_ a_b_arabic.docx"
    assert value(names.output_name(L("   "))) == "document_arabic.docx"


def test_block_json(value):
    stored = '[{"text": "a", "unknown": 1}, {"seq": 7, "type": "table", "rows": [["x", "y"], ["z"]]}]'
    first, second = value(B.blocks_from_json(L(stored)))
    assert (first.seq, first.type, first.page, first.level, first.rows) == (0, "paragraph", -1, 0, [])
    assert (second.seq, second.type, second.rows) == (7, "table", [["x", "y"], ["z"]])
    assert value(B.block_plain_text(B.blocks_from_json(L(stored))[1])) == "x | y\nz"
    assert value(B.blocks_from_json(L(None).cast("string"))) == []


def test_sql_functions_agree(spark):
    register_functions(spark)
    samples = ["Dr. A. said so. Then “b”! 3 x", "[1] a | b\nc\n[٣] d", "نص عربي. ثم آخر", "  ", ""]
    frame = spark.createDataFrame([(s,) for s in samples], "x string")
    for name, function in {
        "normalize_text": text.normalize_text,
        "source_hash": text.source_hash,
        "estimate_tokens": text.estimate_tokens,
        "is_mostly_arabic": text.is_mostly_arabic,
        "split_sentences": text.split_sentences,
        "number_table_rows": tables.number_table_rows,
        "extract_row_markers": tables.extract_row_markers,
        "strip_row_markers": tables.strip_row_markers,
        "normalize_arabic_digits": tables.normalize_arabic_digits,
    }.items():
        both = frame.select(F.expr(f"{name}(x)").alias("a"), function(F.col("x")).alias("b")).collect()
        assert all(r.a == r.b for r in both), name
