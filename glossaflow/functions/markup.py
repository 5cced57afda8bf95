"""Expressions for inline ``*`` / ``**`` / ``***`` emphasis markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaflow.functions.text import CUT, MAYBE_SPACES

_EMPHASIS = r"(\*\*\*[^\n]+?\*\*\*|\*\*[^\n]+?\*\*|\*[^\n]+?\*)"


def inline_runs(c: Column) -> Column:
    """Text with emphasis markers as an array of (text, bold, italic)."""
    parts = F.filter(
        F.split(F.regexp_replace(c, _EMPHASIS, f"{CUT}$1{CUT}"), CUT), lambda p: F.length(p) > 0
    )

    def wrapped(part: Column, marker: str) -> Column:
        size = len(marker)
        return part.startswith(marker) & part.endswith(marker) & (F.length(part) > 2 * size)

    def run(part: Column) -> Column:
        def inner(size: int) -> Column:
            return F.substring(part, F.lit(size + 1), F.length(part) - 2 * size)

        three, two, one = (wrapped(part, "*" * n) for n in (3, 2, 1))
        return F.struct(
            F.when(three, inner(3)).when(two, inner(2)).when(one, inner(1)).otherwise(part).alias(
                "text"
            ),
            (three | two).alias("bold"),
            (three | (one & ~two)).alias("italic"),
        )

    return F.transform(parts, run)


def mark_runs(runs: Column) -> Column:
    """The inverse: (text, bold, italic) runs as marked text, markers inside outer white space."""

    def mark(run: Column) -> Column:
        text = F.coalesce(run["text"], F.lit(""))
        bold = F.coalesce(run["bold"], F.lit(False))
        italic = F.coalesce(run["italic"], F.lit(False))
        marker = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
        lead = F.regexp_extract(text, rf"^{MAYBE_SPACES}", 0)
        trail = F.regexp_extract(text, rf"{MAYBE_SPACES}$", 0)
        core = F.substring(
            text, F.length(lead) + 1, F.length(text) - F.length(lead) - F.length(trail)
        )
        return F.when(F.length(core) <= 0, text).otherwise(
            F.concat(lead, marker, core, marker, trail)
        )

    return F.array_join(F.transform(runs, mark), "")


def heading_style_level(style: Column) -> Column:
    """Heading level 1-4 of a paragraph style name, null for other styles."""
    digit = F.regexp_extract(style, rf"(?i)^heading{MAYBE_SPACES}(\d)", 1)
    return F.when(digit != "", F.least(F.lit(4), F.greatest(F.lit(1), digit.cast("int")))).when(
        F.lower(style) == "title", 1
    )
