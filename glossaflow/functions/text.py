"""Text expressions.  Each function maps Columns to a Column and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point that counts as white space, derived from the Unicode tables.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
# The same set for patterns: the Unicode property and the four separators it leaves out.  Listing the
# code points one by one makes a search several times slower.
_SPACE = r"\s\x1c-\x1f"
SPACES = f"(?U:[{_SPACE}]+)"
MAYBE_SPACES = f"(?U:[{_SPACE}]*)"
WORD = f"(?U:[^{_SPACE}]+)"
# White space other than the line feed, for patterns that work line by line.
MAYBE_INLINE_SPACES = f"(?U:[{_SPACE}&&[^\\n]]*)"
# Line ends other than a lone line feed.
LINE_ENDS = "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85" + chr(0x2028) + chr(0x2029) + "]"
# A Unicode noncharacter, which valid text never holds; marks cut points.
CUT = "\uffff"

ARABIC_CLASS = "[؀-ۿ]"
# Characters that end a sentence and characters that can open the next one.
SENTENCE_END = "[.!?؟]"
SENTENCE_START = "[A-Zء-ي0-9\"'(\\[]"
# A fragment that is only such a word and a dot does not end a sentence.
ABBREVIATION = r"(?:[a-z]{1,3}|prof|e\.g|i\.e)\."


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(c, SPACES, " ")


def is_blank(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) == 0


def split_lines(c: Column) -> Column:
    """Lines of a text, with every kind of line end."""
    return F.split(F.regexp_replace(c, LINE_ENDS, "\n"), "\n")


def split_paragraphs(c: Column, separator: str = rf"\n{MAYBE_SPACES}\n") -> Column:
    """Stripped, non-blank paragraphs in order."""
    parts = F.transform(F.split(c, separator), strip)
    return F.filter(parts, lambda p: F.length(p) > 0)


def normalize_text(c: Column) -> Column:
    return F.lower(collapse_space(strip(c)))


def source_hash(c: Column) -> Column:
    return F.sha2(normalize_text(c), 256)


def arabic_count(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, ARABIC_CLASS, ""))


def estimate_tokens(c: Column) -> Column:
    """About four characters a token, three for Arabic, never below one."""
    arabic = arabic_count(c)
    tokens = (F.length(c) - arabic) / F.lit(4.0) + arabic / F.lit(3.0)
    return F.greatest(F.lit(1), F.floor(tokens).cast("int"))


def is_mostly_arabic(c: Column) -> Column:
    arabic = arabic_count(c)
    latin = F.length(c) - F.length(F.regexp_replace(c, "[A-Za-z]", ""))
    return (arabic > 0) & (arabic >= latin)


def split_sentences(c: Column) -> Column:
    """Sentences of a text.

    Cut points are marked first.  A fragment that is a lone abbreviation is then joined to its
    successor by consuming the mark between them; matching left to right means a fragment that has
    been joined to its predecessor is not tested again.
    """
    text = strip(F.coalesce(c, F.lit("")))
    marked = F.regexp_replace(
        text, f"({SENTENCE_END}){SPACES}(?={SENTENCE_START})", "$1" + CUT
    )
    joined = F.regexp_replace(marked, f"(?i)(^|{CUT})({ABBREVIATION}){CUT}", "$1$2 ")
    return F.when(F.length(text) > 0, F.split(joined, CUT)).otherwise(
        F.array().cast("array<string>")
    )


def preview(c: Column, size: int = 200) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, size)


def tail(c: Column, size: int) -> Column:
    """The last ``size`` characters."""
    return F.when(F.length(c) > size, F.substring(c, -size, size)).otherwise(c)


def usage_estimate(c: Column) -> Column:
    tokens = estimate_tokens(c)
    return F.struct(
        tokens.alias("input_tokens"),
        tokens.alias("output_tokens"),
        F.length(c).alias("characters"),
    )


def quick_usage(c: Column) -> Column:
    """The coarser figure shown before a job starts: characters / 4, both ways."""
    tokens = F.round(F.length(c) / 4).cast("long")
    return F.struct(tokens.alias("input_tokens"), (tokens * 2).alias("total_tokens"))


def contains_arabic(c: Column) -> Column:
    return c.rlike(ARABIC_CLASS)


def english_word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z]{3,}"))
