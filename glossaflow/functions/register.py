"""The text functions under SQL names, as SQL functions without Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from glossaflow.functions.tables import ARABIC_DIGITS
from glossaflow.functions.text import (
    ABBREVIATION,
    ARABIC_CLASS,
    CUT,
    MAYBE_INLINE_SPACES,
    SENTENCE_END,
    SENTENCE_START,
    SPACES,
    WHITESPACE,
)


def _raw(value: str) -> str:
    """A SQL string literal without escapes."""
    return 'r"' + value.replace('"', r"\x22") + '"'


def _bodies() -> dict[str, tuple[str, str]]:
    strip = f"btrim(x, {_raw(WHITESPACE)})"
    normal = f"lower(regexp_replace({strip}, {_raw(SPACES)}, ' '))"
    arabic = f"(length(x) - length(regexp_replace(x, {_raw(ARABIC_CLASS)}, '')))"
    latin = "(length(x) - length(regexp_replace(x, '[A-Za-z]', '')))"
    cut = _raw(f"({SENTENCE_END}){SPACES}(?={SENTENCE_START})")
    marked = f"regexp_replace({strip}, {cut}, '$1{CUT}')"
    short = _raw(f"(?i)(^|{CUT})({ABBREVIATION}){CUT}")
    joined = f"regexp_replace({marked}, {short}, '$1$2 ')"
    marker = r"\[([0-9٠-٩]{1,4})\]"
    digits = f"translate(d, '{ARABIC_DIGITS}', '0123456789')"
    found = f"regexp_extract_all(x, {_raw(f'(?:^|' + chr(10) + f'){MAYBE_INLINE_SPACES}{marker}')}, 1)"
    rows = r'split(concat("\n", x), r"(?<=\n)(?=[^\n]* \| )")'
    numbered = f"array_join(transform({rows}, (p, i) -> if(i = 0, p, concat('[', i, '] ', p))), '')"
    return {
        "normalize_text": ("STRING", normal),
        "source_hash": ("STRING", f"sha2({normal}, 256)"),
        "estimate_tokens": (
            "INT",
            f"greatest(1, int(floor((length(x) - {arabic}) / 4D + {arabic} / 3D)))",
        ),
        "is_mostly_arabic": ("BOOLEAN", f"{arabic} > 0 AND {arabic} >= {latin}"),
        "split_sentences": (
            "ARRAY<STRING>",
            f"if(length({strip}) > 0, split({joined}, '{CUT}'), cast(array() AS ARRAY<STRING>))",
        ),
        "number_table_rows": ("STRING", f"substring({numbered}, 2)"),
        "extract_row_markers": ("ARRAY<INT>", f"transform({found}, d -> int({digits}))"),
        "strip_row_markers": (
            "STRING",
            f"regexp_replace(x, {_raw(r'(?<![^' + chr(10) + '])' + marker + MAYBE_INLINE_SPACES)}, '')",
        ),
        "normalize_arabic_digits": ("STRING", digits.replace("translate(d,", "translate(x,")),
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    bodies = _bodies()
    for name, (returns, body) in bodies.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {returns} RETURN {body}"
        )
    return list(bodies)
