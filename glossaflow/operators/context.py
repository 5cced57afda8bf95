"""What goes with a chunk into its prompt, and the prompt itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaflow.functions.responses import PROMPT_HEADINGS
from glossaflow.functions.tables import number_table_rows
from glossaflow.functions.text import tail

CONTEXT_CHARS = 1500
PROMPT_VERSION = "1"
_TEXT_HEADING, _TERMS_HEADING = PROMPT_HEADINGS
# The style used when a job names none or an unknown one.
STYLES = ("Academic", "Scientific", "Educational", "Technical", "General")
DEFAULT_STYLE = "Academic"


def neighbour_context(
    chunks: DataFrame,
    key: str = "job_id",
    source: str = "source_text",
    translation: str = "translation",
    budget: int = CONTEXT_CHARS,
) -> DataFrame:
    """Add the end of the previous source and translation and the start of the next source.

    Only the chunk at exactly one index lower or higher counts.  Each chunk sends its bounded ends
    to its neighbours' index, so no job is gathered in one place and hot jobs spread by index.
    """
    half = budget // 2
    index = F.col("chunk_index")
    before = chunks.select(
        key,
        (index + 1).alias("chunk_index"),
        tail(F.col(source), budget).alias("previous_text"),
        tail(F.col(translation), half).alias("previous_translation"),
    )
    after = chunks.select(
        key, (index - 1).alias("chunk_index"), F.substring(source, 1, half).alias("next_text")
    )
    return chunks.join(before, [key, "chunk_index"], "left").join(
        after, [key, "chunk_index"], "left"
    )


def terms_section(relevant: DataFrame, keys: list[str]) -> DataFrame:
    """One text a chunk from its ranked terms; at most the cap of ``relevant_terms`` each."""
    others = F.array_join("alternatives", ", ")
    line = F.concat(
        F.lit("- "),
        "english",
        F.lit(" = "),
        "preferred",
        F.when(others != "", F.concat(F.lit(" (also: "), others, F.lit(")"))).otherwise(""),
    )
    return relevant.groupBy(*keys).agg(_ordered_lines(line).alias("terms_text"))


def memory_section(matches: DataFrame, keys: list[str]) -> DataFrame:
    """One text a chunk from its ranked memory matches, three at most."""
    line = F.concat(F.lit("- "), "source", F.lit("\n  -> "), "target")
    return matches.groupBy(*keys).agg(_ordered_lines(line).alias("memory_text"))


def _ordered_lines(line: Column) -> Column:
    entries = F.array_sort(F.collect_list(F.struct(F.col("rank"), line.alias("line"))))
    return F.array_join(F.transform(entries, lambda e: e["line"]), "\n")


def _section(heading: str, body: Column) -> Column:
    """Heading and body, null if the body is empty, so that joining leaves the section out."""
    return F.when(F.length(body) > 0, F.concat(F.lit(heading + "\n"), body))


def _line(label: str, value: Column) -> Column:
    return F.when(F.length(value) > 0, F.concat(F.lit(label + ": "), value))


def system_prompt(style: Column, domain: Column, language: Column) -> Column:
    known = F.when(style.isin(*STYLES), style).otherwise(DEFAULT_STYLE)
    return F.concat_ws(
        "\n",
        F.concat(
            F.lit("Translate into "), language, F.lit(". Field: "), domain,
            F.lit(". Style: "), known, F.lit("."),
        ),
        F.lit("Give the whole translation and nothing else: no comments, labels or code fences."),
        F.lit("Keep the paragraphs and the blank lines between them, and one list item a line."),
        F.lit("Keep every [n] row marker, in order, and the number of cells of each row."),
        F.lit("Keep ** and * around the same words. Use the given terms as they are."),
    )


def user_prompt(chunk: dict[str, Column]) -> Column:
    meta = F.concat_ws(
        "\n",
        _line("Title", chunk["title"]),
        _line("Chapter", chunk["chapter"]),
        _line("Section", chunk["section"]),
        _line("Field", chunk["domain"]),
        _line("Style", chunk["style"]),
    )
    return F.concat_ws(
        "\n\n",
        _section("== DOCUMENT ==", meta),
        _section(_TERMS_HEADING, chunk["terms_text"]),
        _section("== EARLIER TRANSLATIONS ==", chunk["memory_text"]),
        _section("== TEXT BEFORE (do not translate) ==", chunk["previous_text"]),
        _section("== YOUR TRANSLATION BEFORE ==", chunk["previous_translation"]),
        _section("== TEXT AFTER (do not translate) ==", chunk["next_text"]),
        F.concat(F.lit(_TEXT_HEADING + "\n"), number_table_rows(chunk["source_text"])),
    )


def build_prompts(
    chunks: DataFrame, terms_text: DataFrame, memory_text: DataFrame, keys: list[str]
) -> DataFrame:
    """One prompt a chunk, from chunks with neighbour context and the two prepared sections.

    ``chunks`` has title, chapter, section, domain, style, target_language, source_text and the
    columns of ``neighbour_context``.
    """
    joined = chunks.join(terms_text, keys, "left").join(memory_text, keys, "left")
    names = (
        "title", "chapter", "section", "domain", "style", "terms_text", "memory_text",
        "previous_text", "previous_translation", "next_text", "source_text",
    )
    return joined.select(
        *keys,
        "source_text",
        system_prompt(F.col("style"), F.col("domain"), F.col("target_language")).alias("system"),
        user_prompt({n: F.col(n) for n in names}).alias("prompt"),
        F.lit(PROMPT_VERSION).alias("prompt_version"),
    )


def corrective_prompt(prompt: Column, output: Column, reason: Column) -> Column:
    """The prompt again, with the refused output and why it was refused."""
    return F.concat_ws(
        "\n\n",
        prompt,
        _section("== YOUR OUTPUT ==", output),
        F.concat(
            F.lit("== REFUSED ==\n"), reason, F.lit("\nGive the whole translation again, corrected.")
        ),
    )
