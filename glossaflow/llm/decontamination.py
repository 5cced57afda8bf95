"""Benchmark decontamination with a broadcast set of test n-grams, in DataFrame functions only.

A benchmark item gives windows of ten consecutive normalised words, or one window of all its words
if it has fewer.  The 64-bit hashes of all windows are the set.  Every window of every document is
hashed and looked up; each hit is then compared with the words of the window themselves, so that a
collision is no hit.  Words inside a true hit are marked.

The set is broadcast, at most ``MOST_BROADCAST`` entries at a time: it is counted first, and a larger
set is looked up in several passes over the documents, each with its part of the hashes; then the
documents must be a plan with the same partitions each time, such as a scan.  A document's windows
never leave its row; only hits do.

Defined results: null and wordless texts have no words and no hits; null items have no windows.
Items without a number mark words but are not counted or listed.  Equal items each count.  Rows of
``docs`` are told apart by their place, so repeated numbers are judged row by row.  Empty tables
give no rows or no hits.  Columns of the caller that clash with names here do not matter: only the
two that are named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.llm.common import cut, lower_ascii

WINDOW = 10
MOST_BROADCAST = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Normalised words of a whole text."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _digest(window: Column) -> Column:
    return F.xxhash64(window)


def windows(items: DataFrame, item_id: str, text: str, size: int = WINDOW) -> DataFrame:
    """Distinct windows: hash, length, words, and the numbers of the items that hold them."""
    found = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(
        F.size("w") > 0
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = found.select(
        "item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window")
    )
    return each.groupBy("window").agg(F.collect_set("item").alias("items")).select(
        _digest(F.col("window")).alias("h"), F.size("window").alias("n"), "window", "items"
    )


def hits(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows of ``docs`` with their hits: row, id, n_words, and for each true hit at, n, items.

    Each row has one more entry without items, so that rows without a hit stay.
    """
    shape = found.agg(F.collect_set("n").alias("n"), F.sum(F.size("items")).alias("size")).first()
    lengths, blocks = sorted(shape["n"]), -(-(shape["size"] or 0) // MOST_BROADCAST)
    rows = docs.select(F.col(doc_id).alias("_id"), words(F.col(text)).alias("_w")).select(
        F.monotonically_increasing_id().alias("_row"), "_id", "_w", F.size("_w").alias("n_words")
    )
    w = F.col("_w")

    def of_length(n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            starts,
            lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), _digest(F.slice(w, i, n)).alias("h")),
        )

    # The first entry has no place: it looks up nothing and keeps the row.
    entry = "array<struct<at:int,n:int,h:bigint>>"
    nowhere = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(None).alias("h"))).cast(entry)
    none = F.array().cast(entry)
    windowed = F.concat(none, *map(of_length, lengths))
    marks = None
    for k in range(max(blocks, 1)):
        block = found.where(F.pmod("h", F.lit(max(blocks, 1))) == k).select(
            F.col("h").alias("_h"), F.col("window").alias("_window"), "items"
        )
        entries = F.concat(nowhere, windowed) if k == 0 else windowed
        # Equal hashes join; the words are compared only where they do.
        same = F.slice("_w", F.greatest(F.col("e.at"), F.lit(1)), F.col("e.n")) == F.col("_window")
        true = (
            rows.select("_row", "_id", "n_words", "_w", F.explode(entries).alias("e"))
            .join(F.broadcast(block), F.col("e.h") == F.col("_h"), "left")
            .select(
                "_row", "_id", "n_words", F.col("e.at").alias("at"), F.col("e.n").alias("n"),
                F.when(F.col("_h").isNotNull() & same, F.col("items")).alias("items"),
            )
            .where("at = 0 OR items IS NOT NULL")
        )
        marks = true if marks is None else marks.unionByName(true)
    return marks


def judged(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_hit, n_items, item_ids, contaminated."""
    found = cut(windows(items, item_id, item_text), "windows")
    marks = hits(docs, found, doc_id, text)
    true = F.col("items").isNotNull()
    spans = F.array_sort(
        F.collect_set(F.when(true, F.struct(F.col("at"), (F.col("at") + F.col("n")).alias("end"))))
    )
    grouped = marks.groupBy("_row", "_id", "n_words").agg(
        spans.alias("spans"), F.flatten(F.collect_set("items")).alias("items")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("reach"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["reach"], s["end"]).alias("reach"),
            (a["n"] + F.greatest(s["end"] - F.greatest(a["reach"], s["at"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )
    return grouped.select(
        F.col("_id").alias(doc_id),
        F.col("n_words").cast("bigint").alias("n_words"),
        covered.alias("n_hit"),
        F.sort_array(F.array_distinct("items")).alias("item_ids"),
        "spans",
    ).select("*", F.size("item_ids").cast("bigint").alias("n_items"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a hit, with their columns as they are.

    Of rows with one number all go if one of them is hit.  A hit row without a number goes too: it
    is found again by the hash of its text.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.sha2(text, 256)))
    named = docs.select(key.alias("_key"), F.col(text).alias("_text"))
    bad = cut(
        judged(named, items, "_key", "_text").where("contaminated").select(F.col("_key")).distinct(), "hit"
    )
    return docs.join(bad, key.eqNullSafe(F.col("_key")), "leftanti")
