"""Quality rules: robust multivariate outliers of text statistics, per language and source.

Every text is reduced to a few counts.  They are transformed into four nearly symmetric measures:
length of words, share of symbols, share of repeated lines, share of repeated three-word windows.
For each group the minimum covariance determinant estimate is found by concentration steps: from
the coordinate-wise medians on, keep the three quarters of the rows with the smallest Mahalanobis
distance, take their mean and covariance, repeat until nothing changes.  Rows beyond a chi-square
quantile go.

Three quarters hold only if no more than a quarter of a group is bad.  A second estimate keeps just
(n + p + 1) / 2 rows of each group, with only the needed fraction of the last class of distance, so
copies of one text do not come in as a whole.  Where it puts more than a quarter of a group beyond
the quantile, the group is judged by it.

A concentration step is one aggregation.  Rows are added up by (group, class of distance), so the
rows to keep are a cumulative sum over a few hundred classes and no group is sorted or gathered.
Measures are whole multiples of 1/256, so that the sums do not depend on the order of addition.
Groups share a pooled estimate in proportion to how few rows they have.

Defined results: null texts have no words and fail.  Null languages and sources are groups like any
other.  Repeated rows count as often as they occur.  An empty table gives an empty table.  Columns
that the caller has are left as they are; counts are in one struct, named by the caller.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaflow.llm.common import cut

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_KIND = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
_BLANK = b" \t\n\v\f\r"
_NOT_COUNTED = _BLANK + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"

SCALE = 256
#: Pseudo-words that pull short texts to the centre, and their characters each.
PRIOR_WORDS, PRIOR_CHARS = 50, 5
#: Standard deviations below which a measure never counts as spread, so that groups whose texts all
#: agree in a measure do not reject the slightest difference.
LEAST_SPREAD = (0.12, 0.35, 0.45, 0.35)
KEPT_SHARE = 0.75
#: Steps end when the sums do not change any more, or come back to earlier ones; at most so many.
MOST_STEPS = 60
#: Steps of the plain version that tests compare with.
STEPS = 5
#: Rows of the pooled estimate that every group is given.
POOLED_ROWS = 20
QUANTILE = 0.9999
P = 4
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_SUMS = [f"s{i}" for i in range(P)] + [f"s{i}{j}" for i, j in _PAIRS]


def _repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, which, count = np.unique(
        pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True
    )
    if len(count) == n:
        return 0
    again = np.flatnonzero(count[which] > 1)
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[again + k] = True
    return int(inside.sum())


def _dup_lines(text: bytes) -> tuple[int, int]:
    """Lines, and lines with a word that equal an earlier one."""
    lines = text.split(b"\n")
    worded = [x for x in lines if x.strip(_BLANK)]
    return len(lines), len(worded) - len(set(worded))


def count_text(text: bytes | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    lines, again = _dup_lines(text)
    return (
        len(words),
        len(text.translate(None, _NOT_COUNTED)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        lines,
        again,
        _repeat_words(words),
    )


@F.arrow_udf(_KIND)
def _counts(texts: pa.Array) -> pa.Array:
    rows = [count_text(x.as_py()) for x in texts]
    columns = zip(*rows) if rows else [()] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COUNTS)


# Declared so, it is not copied into each condition that its result goes into, and texts are read once.
_counted_once = _counts.asNondeterministic()


def text_counts(text: Column) -> Column:
    """Struct of ``COUNTS`` of a whole text."""
    return _counted_once(text.cast("binary"))


def base_failed(counts: Column) -> Column:
    words = counts["n_words"]
    return (words < 50) | (100 * counts["n_repeat_words"] > 50 * words)


def measures(counts: Column) -> list[Column]:
    """The transformed statistics, as whole multiples of 1/256."""
    words = counts["n_words"] + PRIOR_WORDS
    share = lambda part, whole, weight: F.log2(1 + weight * part / whole)
    exact = [
        F.log2((counts["word_chars"] + PRIOR_WORDS * PRIOR_CHARS) / words),
        share(counts["n_symbols"], words, 20),
        share(counts["n_dup_lines"], counts["n_lines"] + 8, 8),
        share(counts["n_repeat_words"], words, 8),
    ]
    return [F.round(x * SCALE).cast("double") for x in exact]


def _chi_square(x: float) -> tuple[float, float]:
    """Distribution functions with 4 and 6 degrees of freedom."""
    y = x / 2
    return 1 - math.exp(-y) * (1 + y), 1 - math.exp(-y) * (1 + y + y * y / 2)


def chi_square_quantile(q: float) -> float:
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square(mid)[0] < q else (low, mid)
    return high


def _distance(columns: list[Column], estimate: Column) -> Column:
    """Squared Mahalanobis distance; estimate: centre, then the upper half of the precision."""
    off = [columns[i] - estimate[i] for i in range(P)]
    terms = [
        (1 if i == j else 2) * off[i] * off[j] * estimate[P + k] for k, (i, j) in enumerate(_PAIRS)
    ]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _estimate(n: float, sums, pooled, factor: float) -> list[float]:
    """Centre and precision from sums, with the pooled centre and covariance mixed in."""
    centre, spread = np.array(sums[:P], float) / max(n, 1), np.zeros((P, P))
    for k, (i, j) in enumerate(_PAIRS):
        spread[i, j] = spread[j, i] = sums[P + k] / max(n, 1) - centre[i] * centre[j]
    if pooled is not None:
        share = POOLED_ROWS / (n + POOLED_ROWS)
        centre = (1 - share) * centre + share * pooled[0]
        spread = (1 - share) * spread + share * pooled[1]
    floor = np.diag([(s * SCALE) ** 2 for s in LEAST_SPREAD])
    precision = np.linalg.inv(factor * spread + floor)
    return [*centre, *(precision[i, j] for i, j in _PAIRS)]


def _wanted(n: Column, half: bool) -> Column:
    """Rows that an estimate keeps of a group of ``n``."""
    return F.least(n, F.floor((n + P + 1) / 2)) if half else F.ceil(KEPT_SHARE * n)


def _kept_sums(rows: DataFrame, by: list[str], half: bool = False) -> DataFrame:
    """Sums over the rows with the smallest distances ``d`` of each group, three quarters of it.

    The last class of distance counts as a whole; with ``half``, by the fraction that is needed.
    """
    level = F.floor(16 * F.log2(F.col("d") + 2.0**-10)).cast("int")
    x = [F.col(f"x{i}") for i in range(P)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(P)]
    sums += [F.sum(x[i] * x[j]).alias(f"s{i}{j}") for i, j in _PAIRS]
    levels = rows.groupBy(*by, level.alias("level")).agg(F.count("*").alias("n"), *sums)
    whole = Window.partitionBy(*by)
    before = whole.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    kept = levels.select(
        "*",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("all"),
    ).where(F.col("before") < _wanted(F.col("all"), half))
    if half:
        part = F.least(F.lit(1.0), (_wanted(F.col("all"), half) - F.col("before")) / F.col("n"))
        kept = kept.select(*by, *[(part * F.col(c)).alias(c) for c in ("n", *_SUMS)])
    return kept.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in _SUMS])


def _medians(rows: DataFrame, by: list[str]) -> DataFrame:
    """Coordinate-wise medians of each group, from counts of the distinct values."""
    each = rows.select(*by, F.posexplode(F.array(*[f"x{i}" for i in range(P)])).alias("k", "x"))
    values = each.groupBy(*by, "k", "x").count()
    whole = Window.partitionBy(*by, "k")
    up_to = whole.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    half = values.select(
        "*", F.sum("count").over(up_to).alias("up_to"), F.sum("count").over(whole).alias("all")
    ).where(2 * F.col("up_to") >= F.col("all"))
    return half.groupBy(*by).pivot("k", list(range(P))).agg(F.min("x"))


def fit(rows: DataFrame, by: list[str], steps: int = MOST_STEPS, half: bool = False) -> DataFrame:
    """Minimum covariance determinant estimates: by, estimate (centre and precision).

    ``rows`` has the columns ``by`` and the measures x0 to x3.
    """
    # The covariance of the inner rows is too small for all rows by this factor.
    share = 0.5 if half else KEPT_SHARE
    factor = share / _chi_square(chi_square_quantile(share))[1]
    start = [1 / (s * SCALE) ** 2 for s in LEAST_SPREAD]
    zero = [F.lit(start[i] if i == j else 0.0) for i, j in _PAIRS]
    estimates = cut(
        _medians(rows, by).select(
            *by, F.array(*[F.col(str(i)) for i in range(P)], *zero).alias("estimate")
        ),
        "medians",
    )
    keys = ", ".join(f"{d[0]} {d[1]}" for d in rows.select(*by).dtypes)
    seen = set()
    for _ in range(steps):
        near = with_distance(rows, estimates, by).where("d IS NOT NULL")
        sums = cut(_kept_sums(near, by, half), "sums")
        # The hashes tell whether any group has changed; the totals are summed in any order.
        state = F.sum(F.xxhash64(*by, *[F.round(c, 3) for c in ("n", *_SUMS)]).cast("decimal(38,0)"))
        total = sums.agg(F.sum("n"), *[F.sum(s) for s in _SUMS], state).first()
        if total[-1] in seen:
            break
        seen.add(total[-1])
        pooled = None
        if total[0]:
            n, all_sums = float(total[0]), total[1:-1]
            centre, spread = np.array(all_sums[:P], float) / n, np.zeros((P, P))
            for k, (i, j) in enumerate(_PAIRS):
                spread[i, j] = spread[j, i] = all_sums[P + k] / n - centre[i] * centre[j]
            pooled = (centre, spread)

        def solved(frames, pooled=pooled):
            for frame in frames:
                out = frame[by].copy()
                out["estimate"] = [
                    _estimate(n, s, pooled, factor)
                    for n, s in zip(frame["n"], frame[_SUMS].to_numpy(float))
                ]
                yield pd.DataFrame(out)

        estimates = cut(sums.mapInPandas(solved, f"{keys}, estimate array<double>"), "estimates")
    return estimates


def with_distance(rows: DataFrame, estimates: DataFrame, by: list[str]) -> DataFrame:
    """The rows with ``d``, their squared distance from the centre of their group."""
    named = estimates.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("estimate").alias("_e"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    columns = [F.col(f"x{i}") for i in range(P)]
    return (
        rows.join(named, same, "left")
        .withColumn("d", _distance(columns, F.col("_e")))
        .drop("_e", *[f"_{c}" for c in by])
    )


def with_measures(rows: DataFrame, counts: str) -> DataFrame:
    return rows.select("*", *[m.alias(f"x{i}") for i, m in enumerate(measures(F.col(counts)))])


def fit_adapted(rows: DataFrame, by: list[str], quantile: float = QUANTILE) -> DataFrame:
    """The estimate of three quarters, or that of half the rows where over a quarter lies beyond it."""
    most, half = fit(rows, by), fit(rows, by, half=True)
    far = F.count_if(F.col("d") > chi_square_quantile(quantile))
    n = F.count("*")
    bad = with_distance(rows, half, by).groupBy(*by).agg((far > n - _wanted(n, False)).alias("_bad"))
    named = half.select(*[F.col(c).alias(f"_h{c}") for c in by], F.col("estimate").alias("_half"))
    marks = bad.where("_bad").select(*[F.col(c).alias(f"_b{c}") for c in by], "_bad")
    same = lambda k: [F.col(c).eqNullSafe(F.col(f"_{k}{c}")) for c in by]
    both = most.join(named, same("h"), "left").join(marks, same("b"), "left")
    return cut(
        both.select(*by, F.when(F.col("_bad"), F.col("_half")).otherwise(F.col("estimate")).alias("estimate")),
        "adapted",
    )


def fitted(counted: DataFrame, by: list[str], counts: str) -> DataFrame:
    """Estimates of all rows that pass the base rules.  ``counted`` should be a written table."""
    passed = with_measures(counted.where(~base_failed(F.col(counts))), counts)
    return fit_adapted(passed.select(*by, *[f"x{i}" for i in range(P)]), by)


def judged(
    counted: DataFrame, estimates: DataFrame, by: list[str], counts: str, quantile: float = QUANTILE
) -> DataFrame:
    """The rows with ``base_failed`` and ``kept``."""
    failed = base_failed(F.col(counts))
    far = F.coalesce(F.col("d"), F.lit(0.0)) > chi_square_quantile(quantile)
    return (
        with_distance(with_measures(counted, counts), estimates, by)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~far)
        .drop("d", *[f"x{i}" for i in range(P)])
    )


def filter_documents(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source")):
    """The documents that pass, with their columns as they are.

    Counts are taken twice, once for the estimates and once in the row that is judged: reading the
    texts again is cheaper than moving them to where their verdict is.
    """
    keys = list(by)
    counted = cut(docs.select(*keys, text_counts(F.col(text)).alias("_counts")), "counts")
    estimates = fitted(counted, keys, "_counts")
    rows = docs.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(keys)],
        F.struct("*").alias("_row"),
        text_counts(F.col(text)).alias("_counts"),
    )
    named = estimates.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(keys)], "estimate"
    )
    kept = judged(rows, named, [f"_by{i}" for i in range(len(keys))], "_counts").where("kept")
    return kept.select("_row.*")
