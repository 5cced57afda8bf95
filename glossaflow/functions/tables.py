"""Expressions for pipe-separated table rows and their ``[n]`` row markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaflow.functions.text import MAYBE_INLINE_SPACES, MAYBE_SPACES, split_lines, strip

# The cell separator, and Arabic-Indic digits in order.
CELL_SEPARATOR = " | "
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"

_MARKER = r"\[([0-9٠-٩]{1,4})\]"
_LINE_START = r"(?<![^\n])"


def normalize_arabic_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_DIGITS, "0123456789")


def number_table_rows(c: Column) -> Column:
    """Put ``[n] `` before each line that holds a cell separator; n counts those lines only.

    The text is cut in front of every such line, so the position of a piece is its number.  The
    line feed put in front keeps the first piece from being empty.
    """
    pieces = F.split(F.concat(F.lit("\n"), c), r"(?<=\n)(?=[^\n]* \| )")
    numbered = F.transform(
        pieces,
        lambda piece, i: F.when(i == 0, piece).otherwise(
            F.concat(F.lit("["), i.cast("string"), F.lit("] "), piece)
        ),
    )
    marked = F.array_join(numbered, "")
    return F.substring(marked, F.lit(2), F.length(marked))


def strip_row_markers(c: Column) -> Column:
    return F.regexp_replace(c, _LINE_START + _MARKER + MAYBE_INLINE_SPACES, "")


def _as_number(digits: Column) -> Column:
    return normalize_arabic_digits(digits).cast("int")


def extract_row_markers(c: Column) -> Column:
    """Numbers of the row markers, in order of the lines."""
    found = F.regexp_extract_all(c, F.lit(rf"(?:^|\n){MAYBE_INLINE_SPACES}{_MARKER}"), F.lit(1))
    return F.transform(found, _as_number)


def row_cell_counts(c: Column) -> Column:
    """Map of row marker to number of cells; the last row with a marker wins."""
    lines = F.filter(
        F.split(c, "\n"), lambda line: strip(line).rlike(rf"^{_MARKER}")
    )
    entries = F.reverse(
        F.transform(
            lines,
            lambda line: F.struct(
                _as_number(F.regexp_extract(strip(line), rf"^{_MARKER}", 1)).alias("marker"),
                _cell_count(line).alias("cells"),
            ),
        )
    )
    markers = F.transform(entries, lambda e: e["marker"])
    return F.map_from_entries(
        F.filter(entries, lambda e, i: F.array_position(markers, e["marker"]) == i + 1)
    )


def _cell_count(line: Column) -> Column:
    without = F.replace(line, F.lit(CELL_SEPARATOR), F.lit(""))
    return ((F.length(line) - F.length(without)) / len(CELL_SEPARATOR)).cast("int") + 1


def render_rows(rows: Column) -> Column:
    """Rows as text: cells joined by the separator, one row a line."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, CELL_SEPARATOR)), "\n")


def _slice_from(cells: Column, first: int) -> Column:
    return F.slice(cells, first, F.size(cells))


def _drop_edge_cells(cells: Column) -> Column:
    """Leave out an empty first cell, then an empty last one, as outer pipes make them."""
    after_first = lambda c: F.when(F.get(c, F.lit(0)) == "", _slice_from(c, 2)).otherwise(c)
    first_gone = after_first(cells)
    return F.reverse(after_first(F.reverse(first_gone)))


def _fit_cells(cells: Column, source_row: Column) -> Column:
    """Pad or merge cells to the number of cells of the source row, where there is one."""
    want = F.size(source_row)
    have = F.size(cells)
    padded = F.concat(cells, F.array_repeat(F.lit(""), want - have))
    rest = F.array_join(F.slice(cells, want, have), CELL_SEPARATOR)
    merged = F.concat(F.slice(cells, F.lit(1), want - 1), F.array(rest))
    return (
        F.when(source_row.isNull(), cells)
        .when(have < want, padded)
        .when((have > want) & (want > 0), merged)
        .otherwise(cells)
    )


def reshape_table_rows(text: Column, source_rows: Column) -> Column:
    """Cells of translated pipe rows in the shape of the source rows; the source rows if none."""
    lines = F.filter(
        F.transform(
            split_lines(F.regexp_replace(text, _LINE_START + _MARKER + MAYBE_SPACES, "")), strip
        ),
        lambda line: F.length(line) > 0,
    )
    shaped = F.transform(
        lines,
        lambda line, i: _fit_cells(
            _drop_edge_cells(F.transform(F.split(line, r"\|"), strip)), F.get(source_rows, i)
        ),
    )
    return F.when(F.size(lines) > 0, shaped).otherwise(source_rows)
