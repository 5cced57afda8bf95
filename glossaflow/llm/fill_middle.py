"""Fill-in-the-middle transformation with cuts from one repeated-capture match.

A text is a row of units, such as code points, words or grapheme clusters.  One ``fullmatch`` of
``(unit)*`` keeps every repetition of the group, so ``match.ends(1)`` lists where each unit ends:
its length is the number of units, and two of its entries are the cuts.  Prefix, middle and suffix
are then cut and put together by expressions, and so is the way back from output to text.

Drawn numbers come from a hash of the document's number, so that reruns agree.

A match keeps about 150 bytes for each unit of the text that is being matched, one text at a time;
batches that go to Python are bounded in bytes by Spark.

Defined results: null is an empty text.  Empty texts, texts that contain a marker, texts that the
units do not cover (0 units) and the share of texts that the rate leaves out stay plain.  Bytes that
are not UTF-8 become replacement characters.  A null number draws from the empty number; equal rows
give equal results.  An empty table gives an empty table; other columns, whatever their names, are
kept except those that the result names.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units: code points, words with the blanks before them, grapheme clusters.
CODE_POINT, WORD, CLUSTER = r"(?s:.)", r"\s*\S+(?:\s+\Z)?|\s+\Z", r"\X"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT, SPM_PERCENT = 90, 20

_CUTS = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("first", T.LongType()),
        T.StructField("second", T.LongType()),
    ]
)


@cache
def _repeated(unit: str) -> regex.Pattern:
    return regex.compile(f"((?:{unit}))*")


def cuts(text: str, unit: str, first: int, second: int) -> tuple[int, int, int]:
    """Number of units, and the places at which prefix and middle end.

    The prefix has the smaller, the middle ends after the larger of the two draws modulo n + 1.
    """
    match = _repeated(unit).fullmatch(text)
    ends = match.ends(1) if match else []
    n = len(ends)
    a, b = sorted((first % (n + 1), second % (n + 1)))
    return n, ends[a - 1] if a else 0, ends[b - 1] if b else 0


@cache
def _cuts_by(unit: str):
    @F.arrow_udf(_CUTS)
    def found(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        rows = [
            cuts(x.as_py(), unit, a, b)
            for x, a, b in zip(texts, first.to_pylist(), second.to_pylist())
        ]
        return pa.StructArray.from_arrays(
            [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["n", "first", "second"]
        )

    return found


def draws(number: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of ``seed:number``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(number.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    at = lambda k: F.get(parts, F.lit(k))
    return (
        F.when(form == "psm", F.concat(at(1), at(3), at(2)))
        .when(form == "spm", F.concat(at(2), at(3), at(1)))
        .otherwise(output)
    )


def transform(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    unit: str = CODE_POINT,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    seed: int = 1,
) -> DataFrame:
    """The rows with ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``."""
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    h1, h2, h3, h4 = draws(F.col(doc_id), seed)
    whole = F.make_valid_utf8(F.coalesce(F.col(text), F.lit("")))
    kept = [c for c in docs.columns if c not in made]
    drawn = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"),
        whole.alias("_text"),
        h3.alias("_h3"),
        h4.alias("_h4"),
        _cuts_by(unit)(whole, h1, h2).alias("_cuts"),
    )
    body, n = F.col("_text"), F.col("_cuts.n")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | body.contains(mark)
    form = (
        F.when((n == 0) | marked | (F.col("_h3") % 100 >= fim_percent), "plain")
        .when(F.col("_h4") % 100 < spm_percent, "spm")
        .otherwise("psm")
    )
    first, second = F.col("_cuts.first"), F.col("_cuts.second")
    length = F.char_length(body)
    piece = lambda start, stop: F.substring(body, (start + 1).cast("int"), (stop - start).cast("int"))
    prefix, middle, suffix = piece(F.lit(0), first), piece(first, second), piece(second, length)
    cut = F.col("form") != "plain"
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(body)
    )
    return drawn.withColumn("form", form).select(
        "_row.*",
        n.alias("n"),
        "form",
        F.when(cut, first).alias("prefix_chars"),
        F.when(cut, second - first).alias("middle_chars"),
        output.alias("output"),
    )
