"""Mixing sources to target weights: repetition rates and hash-seeded copies.

Words are added up per source.  A source's target is its weight's part of the total, at most twice
what it has; what is cut off goes to the other sources by weight, until none is above.  With the
rate target / size, every document is emitted floor(rate) times, and once more if a number hashed
from its key is below the fraction.  Decisions depend on the document alone, so reruns agree.

One row for each source is all that is gathered; documents are never grouped or sorted.

Defined results: null texts have size zero.  A null source is a source, ordered last.  Sources
without words have target zero and their documents are not taken.  Repeated rows are decided alike.
An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.llm.common import SPACE_CLASS, cut, numbered

WEIGHTS = (5, 2, 1)
SHARE, LIMIT, SEED = 1.5, 2, 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_CLASS)), F.lit(0)).cast("bigint")


def rates(
    sized: DataFrame,
    source: str,
    size: str,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    limit: int = LIMIT,
) -> DataFrame:
    """A row for each source: source_size, target, rate.  ``sized`` should be a written table."""
    totals = sized.groupBy(source).agg(F.sum(size).alias("source_size"))
    order = [F.col(source).isNull(), F.col(source)]
    ranked = numbered(totals, order, "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = cut(ranked.select(source, "source_size", weight.alias("_weight")), "sources")
    most = limit * F.col("source_size").cast("double")
    # Fill up level by level; a source that reaches its limit stays there, so this ends.
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = most <= level * F.col("_weight")
        row = sources.agg(
            F.count(F.when(over, 1)).alias("full"),
            F.sum(F.when(over, most).otherwise(0.0)).alias("capped"),
            F.sum(F.when(~over, F.col("_weight")).otherwise(0.0)).alias("open"),
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (share * total - row["capped"]) / row["open"]
    target = F.least(most, level * F.col("_weight"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return cut(sources.select(source, "source_size", target.alias("target"), rate.alias("rate")), "rates")


def copies(key: Column, rate: Column, seed: int = SEED) -> Column:
    """How often a document is emitted."""
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))
    return F.floor(rate) + F.when(unit < rate - F.floor(rate), 1).otherwise(0)


def key_of(doc_id: str, text: str) -> Column:
    """The number of a document, or the hash of its text where it has none."""
    return F.coalesce(F.col(doc_id).cast("string"), F.sha2(text, 256), F.lit(""))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every document as often as it is taken, with its columns as they are."""
    sized = docs.select(F.col(source).alias("_source"), n_words(F.col(text)).alias("_size"))
    found = rates(cut(sized, "sizes"), "_source", "_size").select("_source", "rate")
    rows = docs.select(
        F.struct("*").alias("_row"), F.col(source).alias("_own"), key_of(doc_id, text).alias("_key")
    )
    joined = rows.join(found, F.col("_own").eqNullSafe(F.col("_source")))
    times = F.array_repeat(F.lit(1), copies(F.col("_key"), F.col("rate")).cast("int"))
    return joined.select("_row", F.explode(times)).select("_row.*")
