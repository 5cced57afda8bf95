"""Expressions that clean and judge raw model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaflow.functions.text import LINE_ENDS, MAYBE_INLINE_SPACES, strip

# Labels a model may put before its answer, and openings that mark a comment.
RESPONSE_LABELS = (
    "translation:",
    "the translation:",
    "translated text:",
    "الترجمة:",
    "النص المترجم:",
)
COMMENT_OPENINGS = ("Note:", "Explanation:")
# Headings of our prompts; output that repeats one of them is an echo.
PROMPT_HEADINGS = ("== TEXT ==", "== TERMS ==")


def strip_code_fences(c: Column) -> Column:
    """Drop an opening fence line and the closing fence of a fenced text of two lines or more."""
    text = strip(c)
    lines = F.regexp_replace(text, LINE_ENDS, "\n")
    body = F.regexp_replace(lines, r"^```[^\n]*\n", "")
    inner = F.regexp_replace(body, rf"(?:^|\n){MAYBE_INLINE_SPACES}```[^\n]*$", "")
    return F.when(text.startswith("```") & F.contains(lines, F.lit("\n")), strip(inner)).otherwise(
        text
    )


def strip_response_prefix(c: Column) -> Column:
    labels = "|".join(RESPONSE_LABELS)
    return strip(F.regexp_replace(strip_code_fences(c), rf"(?iu)^(?:{labels})[ :–-]*", ""))


def looks_like_json_object(c: Column) -> Column:
    """One JSON object and nothing else."""
    text = strip(c)
    braces = text.startswith("{") & text.endswith("}")
    single = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.coalesce(braces & single & F.try_parse_json(text).isNotNull(), F.lit(False))


def classify_model_output(
    text: Column, finish_reason: Column, headings: tuple[str, ...] = PROMPT_HEADINGS
) -> Column:
    """Reason to reject an output, or null if it can be used."""
    raw = F.coalesce(text, F.lit(""))
    cut_off = F.coalesce(finish_reason == "length", F.lit(False))
    clean = strip_response_prefix(raw)
    echo = F.lit(False)
    for heading in headings:
        echo = echo | F.contains(clean, F.lit(heading))
    comment = F.lit(False)
    for opening in COMMENT_OPENINGS:
        comment = comment | clean.startswith(opening)
    return (
        F.when(cut_off, "truncated")
        .when(F.length(strip(raw)) == 0, "empty")
        .when(looks_like_json_object(clean), "json_object")
        .when(echo, "prompt_echo")
        .when(comment, "comment")
        .when(F.length(clean) == 0, "empty_after_cleaning")
    )
