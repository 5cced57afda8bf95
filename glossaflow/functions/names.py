"""Expressions for file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaflow.functions.text import strip

# Accepted extensions, those named as planned, and limits.
ALLOWED_EXTENSIONS = (".pdf", ".docx", ".txt")
PLANNED_EXTENSIONS = (".epub", ".pptx")
NAME_LIMIT = 120
TITLE_LIMIT = 80
OUTPUT_SUFFIX = "_arabic.docx"


def file_suffix(name: Column) -> Column:
    """Extension with its dot; empty for names without one, dot files and a final dot."""
    return F.regexp_extract(name, r"(?s)^(?=.*[^.])\.*[^.].*?(\.[^.]+)$", 1)


def sanitize_filename(c: Column) -> Column:
    """A safe base name of at most 120 characters, null where none can be made."""
    base = strip(F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1))
    safe = F.btrim(F.regexp_replace(base, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(". "))
    short = F.concat(
        F.substring(safe, 1, NAME_LIMIT - 8), F.substring(file_suffix(safe), 1, 7)
    )
    invalid = base.isin("", ".", "..") | (safe == "")
    return F.when(~invalid, F.when(F.length(safe) > NAME_LIMIT, short).otherwise(safe))


def extension_verdict(name: Column) -> Column:
    extension = F.lower(file_suffix(name))
    return (
        F.when(extension.isin(*ALLOWED_EXTENSIONS), "ok")
        .when(extension.isin(*PLANNED_EXTENSIONS), "planned")
        .otherwise("unsupported")
    )


def output_name(title: Column, suffix: str = OUTPUT_SUFFIX) -> Column:
    safe = F.substring(strip(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "_")), 1, TITLE_LIMIT)
    return F.concat(F.when(safe == "", "document").otherwise(safe), F.lit(suffix))
