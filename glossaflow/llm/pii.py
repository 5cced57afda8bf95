"""Personal data by candidate generation and gradient boosting, in DataFrame functions only.

Generators with high recall propose spans, which may overlap: the four base kinds, spelled-out
addresses, long groups of digits, and groups of hexadecimal digits with colons.  Base spans that
pass their check stay.  Every other span is scored by boosted trees over features of its format and
context, and kept if its score passes a calibrated threshold.

The trees are fitted to all candidates.  Examples are the checked base spans and what overlaps them,
and, so that the trees can add what no base pattern holds, candidates with a sign of their own:
spelled-out addresses whose host ends in letters, groups with colons that are a whole or shortened
IPv6 or a hardware address, and numbers of 7 to 19 digits right after a naming word.  All others are
counter-examples.  Features are small whole numbers, so the candidates are first counted by feature
vector; the number of such cells is bounded by the product of the features' ranges, and only cells
reach the driver.  One of two halves, by hash, fits the trees; on the other each generator gets a
threshold, the lowest score from which on at least ``PRECISION`` of its candidates are examples.
The trees come back as CASE expressions.  A candidate is added if it overlaps no checked base span
and its score reaches its generator's threshold.

Places come from the pieces between matches: the start of a match is the length of all pieces and
matches before it, a running sum in the row's own small partition.

Defined results: null and empty texts have no spans.  Repeated rows are told apart by their place.
With no candidates nothing is fitted or added.  An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaflow.llm.common import cut

BASE = ("email", "ip", "card", "phone")
OTHER = ("spelled", "digits", "colons")
KINDS = BASE + OTHER + ("found",)

# The base patterns, so written that no run of characters is tried from each of its places: a match
# starts where such a run starts, or where the last match ended.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "spelled": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[\[({]\x20?at\x20?[\])}]\x20?"
    r"[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({]\x20?dot\x20?[\])}])\x20?[A-Za-z0-9-]++)++",
    "digits": r"[0-9](?:[\x20().-]{0,3}+[0-9]){6,}+",
    "colons": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]*+(?::[0-9A-Fa-f]*+){2,}+(?![0-9A-Za-z])",
}
#: What a text must hold for a pattern to be tried.
_NEEDS = {"email": "@", "phone": "+", "colons": ":"}
CONTEXT = 24
PRECISION, ROUNDS, RATE, BINS = 0.95, 12, 0.4, 6
_WORDS = r"(?i)(?:phone|tel|call|fax|mobile|mail|e-mail|contact|card|visa|account|ssn|passport|ip|address)\W*$"


def _matches(text: Column, kind: str) -> Column:
    """Array of the matches of a kind with what surrounds them."""
    pattern = F.lit(PATTERNS[kind])
    pieces, found = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, pattern, F.lit(0))
    each = F.transform(
        F.arrays_zip(
            found.alias("value"),
            F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))).alias("before"),
            F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))).alias("after"),
        ),
        lambda m, k: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            k.alias("k"),
            F.length(m["before"]).alias("gap"),
            m["value"].alias("value"),
            F.right(m["before"], F.lit(CONTEXT)).alias("before"),
            F.left(m["after"], F.lit(1)).alias("after"),
        ),
    )
    needed = F.rlike(text, F.lit("[0-9]")) if kind in ("ip", "card", "digits") else None
    if kind in _NEEDS:
        needed = F.contains(text, F.lit(_NEEDS[kind]))
    if kind == "spelled":
        needed = F.contains(text, F.lit("at")) & F.rlike(text, F.lit(r"[\[({]\x20?at\x20?[\])}]"))
    none = F.array().cast("array<struct<kind:int,k:int,gap:int,value:string,before:string,after:string>>")
    return F.when(needed, each).otherwise(none)


def candidates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """All proposed spans: row, id, kind, start, end, value, before, after.

    Each row of ``docs`` has one more entry of kind null.
    """
    none = F.struct(
        F.lit(None).cast("int").alias("kind"), F.lit(0).alias("k"), F.lit(0).alias("gap"),
        F.lit("").alias("value"), F.lit("").alias("before"), F.lit("").alias("after"),
    )
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(doc_id).alias("_id"),
        F.coalesce(text, F.lit("")).alias("_text"),
    )
    found = F.concat(F.array(none), *[_matches(F.col("_text"), kind) for kind in BASE + OTHER])
    each = rows.select("_row", "_id", F.explode(found).alias("m")).select("_row", "_id", "m.*")
    within = Window.partitionBy("_row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(within)
    return each.select(
        "_row", "_id", "kind", (end - F.length("value")).alias("start"), end.alias("end"), "value", "before", "after"
    )


def _luhn(digits: Column) -> Column:
    each = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    worth = F.transform(
        each,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def checked(kind: Column, value: Column) -> Column:
    """Whether a match of a base kind passes its check."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    size = F.length(digits)
    small = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == 0, True)
        .when(kind == 1, F.rlike(value, F.lit(rf"^{small}(?:\.{small}){{3}}$")))
        .when(kind == 2, (size >= 13) & (size <= 19) & _luhn(digits))
        .when(kind == 3, (size >= 9) & (size <= 15))
        .otherwise(False)
    )


def signed(kind: Column, value: Column, before: Column) -> Column:
    """Whether a candidate of the other generators shows by itself what it is."""
    group = "[0-9A-Fa-f]{1,4}"
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    shortened = F.rlike(value, F.lit(rf"^(?:{group}(?::{group})*+)?::(?:{group}(?::{group})*+)?$"))
    digits = F.length(value) - F.length(F.regexp_replace(value, "[0-9]", ""))
    return (
        F.when(kind == KINDS.index("spelled"), F.rlike(value, F.lit(r"[A-Za-z]{2,}$")))
        .when(
            kind == KINDS.index("colons"),
            F.rlike(value, F.lit(rf"^{group}(?::{group}){{7}}$"))
            | F.rlike(value, F.lit(r"^[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}$"))
            | (shortened & (groups >= 2) & (groups <= 7) & F.rlike(value, F.lit("[0-9]")) & (F.length(value) >= 6)),
        )
        .when(kind == KINDS.index("digits"), F.rlike(before, F.lit(_WORDS)) & (digits >= 7) & (digits <= 19))
        .otherwise(False)
    )


def features() -> dict[str, tuple[Column, int]]:
    """Name: (small whole number, how many values it can have)."""
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    count = lambda p: F.length(value) - F.length(F.regexp_replace(value, p, ""))
    step = lambda x, *limits: sum((F.when(x >= n, 1).otherwise(0) for n in limits), F.lit(0))
    flag = lambda test: F.when(test, 1).otherwise(0)
    return {
        "kind": (F.coalesce(F.col("kind"), F.lit(0)), len(BASE + OTHER)),
        "digits": (step(count("[0-9]"), 7, 9, 12, 16, 20), BINS),
        "signs": (step(count("[^0-9A-Za-z]"), 1, 2, 4, 7, 12), BINS),
        "letters": (step(count("[A-Za-z]"), 1, 9), 3),
        "plus": (flag(F.rlike(before, F.lit(r"\+$")) | F.startswith(value, F.lit("+"))), 2),
        "groups": (step(count(":"), 2, 3, 5, 7, 8), BINS),
        "short": (flag(F.contains(value, F.lit("::"))), 2),
        "ends": (flag(F.rlike(value, F.lit("[A-Za-z]{2,}$"))), 2),
        "named": (flag(F.rlike(before, F.lit(_WORDS))), 2),
        "apart": (flag(F.rlike(before, F.lit(r"(?:^|[\s(\[<\"'])$")) & ~F.rlike(after, F.lit("[A-Za-z0-9]"))), 2),
    }


# -- boosted trees over counted cells


def _stump(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[float, int, int]:
    """Best split (gain, feature, least value on the right) of the rows."""
    best = (0.0, -1, 0)
    total_g, total_w = gradient.sum(), weight.sum()
    for f in range(x.shape[1]):
        size = int(x[:, f].max()) + 1 if len(x) else 1
        g, w = np.bincount(x[:, f], gradient, size).cumsum(), np.bincount(x[:, f], weight, size).cumsum()
        for cut_at in range(1, size):
            gl, wl = g[cut_at - 1], w[cut_at - 1]
            gain = gl * gl / (wl + 1) + (total_g - gl) ** 2 / (total_w - wl + 1) - total_g**2 / (total_w + 1)
            if gain > best[0] + 1e-9:
                best = (float(gain), f, cut_at)
    return best


def fit_trees(x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> list:
    """Trees of depth two for the logistic loss; x: cells, with counts of either label."""
    score, trees = np.zeros(len(x)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        gradient = positive * (1 - p) - negative * p
        weight = (positive + negative) * p * (1 - p)

        def leaf(rows):
            return float(RATE * gradient[rows].sum() / (weight[rows].sum() + 1))

        def split(rows, depth):
            _, f, at = _stump(x[rows], gradient[rows], weight[rows])
            if depth == 0 or f < 0:
                return leaf(rows)
            right = x[rows, f] >= at
            return (f, at, split(rows[~right], depth - 1), split(rows[right], depth - 1))

        tree = split(np.arange(len(x)), 2)
        trees.append(tree)
        score += np.array([_value(tree, row) for row in x])
    return trees


def _value(tree, row) -> float:
    while isinstance(tree, tuple):
        f, at, left, right = tree
        tree = right if row[f] >= at else left
    return tree


def _expression(tree, columns: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, at, left, right = tree
    return F.when(columns[f] >= at, _expression(right, columns)).otherwise(_expression(left, columns))


def threshold(scores: np.ndarray, positive: np.ndarray, negative: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest score from which on the share of examples is high enough at every higher score."""
    found = np.inf
    yes = no = 0
    for s in sorted(set(scores.tolist()), reverse=True):
        at = scores == s
        yes, no = yes + positive[at].sum(), no + negative[at].sum()
        if yes < precision * (yes + no):
            break
        found = s
    return float(found)


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its number, and ``spans``, an array of (kind, start, end).

    The kind ``found`` stands for what the trees add.
    """
    proposed = candidates(docs, doc_id, text)
    names = features()
    proposed = cut(
        proposed.select(
            "_row", "_id", "kind", "start", "end", checked(F.col("kind"), F.col("value")).alias("ok"),
            signed(F.col("kind"), F.col("value"), F.col("before")).alias("sign"),
            F.pmod(F.xxhash64("value", "before"), F.lit(2)).alias("half"),
            *[c.cast("int").alias(n) if n != "kind" else c.alias("_kind") for n, (c, _) in names.items()],
        ),
        "candidates",
    )
    columns = [n if n != "kind" else "_kind" for n in names]
    # A candidate overlaps a checked base span of its row if one that starts no later ends beyond
    # its start, or one that follows starts before its end.
    by_start = Window.partitionBy("_row").orderBy("start", "end")
    ends = F.max(F.when(F.col("ok"), F.col("end"))).over(
        by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    starts = F.min(F.when(F.col("ok"), F.col("start"))).over(
        by_start.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    real = proposed.where(F.col("kind").isNotNull())
    marked = cut(
        real.select(
            "*",
            (F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("end"), F.lit(False))).alias("hit"),
        ),
        "marked",
    )
    example = F.col("hit") | F.col("sign")
    cells = marked.groupBy(*columns, "half").agg(
        F.count_if(example).alias("yes"), F.count_if(~example).alias("no")
    )
    rows = cells.collect()
    base = marked.where("ok").select("_row", F.struct("kind", "start", "end").alias("span"))
    added = None
    fits = [[r for r in rows if r["half"] == h] for h in (0, 1)]
    if all(fits):
        x, yes, no = zip(*[
            (np.array([[r[c] for c in columns] for r in part]), np.array([r["yes"] for r in part], float), np.array([r["no"] for r in part], float))
            for part in fits
        ])
        trees = fit_trees(x[0], yes[0], no[0])
        scores = np.array([sum(_value(t, row) for t in trees) for row in x[1]])
        score = sum((_expression(t, [F.col(c) for c in columns]) for t in trees), F.lit(0.0))
        kinds = x[1][:, columns.index("_kind")]
        enough = F.lit(False)
        for kind in np.unique(kinds).tolist():
            own = kinds == kind
            least = threshold(scores[own], yes[1][own], no[1][own])
            if np.isfinite(least):
                enough = enough | ((F.col("_kind") == kind) & (F.col("_score") >= least - 1e-9))
        if kinds.size:
            kept = marked.where(~F.col("hit")).withColumn("_score", score).where(enough)
            added = kept.select(
                "_row", F.struct(F.lit(KINDS.index("found")).alias("kind"), F.col("start"), F.col("end")).alias("span")
            )
    nothing = F.lit(None).cast("struct<kind:int,start:bigint,end:bigint>")
    every = proposed.where(F.col("kind").isNull()).select("_row", "_id", nothing.alias("span"))
    found = base.unionByName(added) if added is not None else base
    found = found.withColumn("_id", F.lit(None).cast(dict(proposed.dtypes)["_id"]))
    return (
        every.unionByName(found)
        .groupBy("_row")
        .agg(F.max("_id").alias(doc_id), F.array_sort(F.collect_set("span")).alias("spans"))
        .drop("_row")
    )


def said(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
