"""Substring search in a stored memory by posting lists of trigrams.

For each sequence of three characters of an entry, in lower case, a row names the entry and its fields.  Rows lie
in buckets by sequence, sorted, so a search reads the buckets of its needle's sequences and there
the row groups that hold them.  Entries that have all sequences are then read from their own
buckets and compared in full.  A needle without three characters in a row scans the entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.operators.terms import like_pattern

GRAM = 3
POSTING_BUCKETS, ENTRY_BUCKETS = 256, 64
SEARCHED = ("source_text", "target_text")


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def _grams(text: Column) -> Column:
    """The distinct sequences of a text in lower case."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1))
    return F.array_distinct(F.filter(found, lambda g: g != ""))


def write_index(
    tm: DataFrame, path: str, postings: int = POSTING_BUCKETS, entries: int = ENTRY_BUCKETS
) -> None:
    """Store a memory with its posting lists; a row tells which fields hold the sequence, as bits."""
    tm.withColumn("entry_bucket", _bucket(F.col("id"), entries)).hint("rebalance", "entry_bucket").write.partitionBy(
        "entry_bucket"
    ).parquet(f"{path}/entries")
    # What was stored is read again, so that the memory is not made a second time.
    stored = tm.sparkSession.read.schema(tm.schema).parquet(f"{path}/entries").select("id", *SEARCHED)
    one, two = [_grams(F.coalesce(c, F.lit(""))) for c in SEARCHED]
    # A translation often repeats its source: a sequence of both fields is one row.
    held = F.array(
        *[
            F.struct(F.lit(fields).alias("fields"), grams.alias("grams"))
            for fields, grams in ((1, F.array_except("one", "two")), (2, F.array_except("two", "one")), (3, F.array_intersect("one", "two")))
        ]
    )
    each = (
        stored.select("id", one.alias("one"), two.alias("two"))
        .select("id", F.explode(held).alias("f"))
        .select("id", "f.fields", F.explode("f.grams").alias("gram"))
    )
    listed = each.withColumn("posting_bucket", _bucket(F.col("gram"), postings)).hint("rebalance", "posting_bucket")
    listed.sortWithinPartitions("posting_bucket", "gram").write.partitionBy("posting_bucket").parquet(f"{path}/postings")
    spark = tm.sparkSession
    spark.createDataFrame([(postings, entries)], "postings int, entries int").coalesce(1).write.parquet(f"{path}/sizes")


def _needle(spark: SparkSession, search: str, buckets: int) -> list[tuple[str, int]]:
    """Sequences that every match holds, with their buckets; ``%`` and ``_`` stand for anything."""
    pieces = F.filter(F.split(F.lit(search.strip()), r"[%_\\]"), lambda p: F.length(p) >= GRAM)
    grams = spark.range(1).select(F.explode(F.array_distinct(F.flatten(F.transform(pieces, _grams)))).alias("g"))
    return [(r["g"], r["b"]) for r in grams.select("g", _bucket(F.col("g"), buckets).alias("b")).collect()]


def candidates(spark: SparkSession, path: str, search: str) -> DataFrame | None:
    """Numbers of the entries that hold all of the needle's sequences in one field; None if it has none."""
    sizes = spark.read.parquet(f"{path}/sizes").first()
    grams = _needle(spark, search, sizes["postings"])
    if not grams:
        return None
    listed = spark.read.parquet(f"{path}/postings").where(
        F.col("posting_bucket").isin(sorted({b for _, b in grams})) & F.col("gram").isin(*[g for g, _ in grams])
    )
    in_field = [F.count_if(F.col("fields").bitwiseAND(1 << k) != 0) == len(grams) for k in range(len(SEARCHED))]
    held = listed.groupBy("id").agg((in_field[0] | in_field[1]).alias("whole")).where("whole")
    return held.select("id", _bucket(F.col("id"), sizes["entries"]).alias("entry_bucket"))


def search_stored(spark: SparkSession, path: str, search: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the entries that hold the search text, newest first, with the number of all that match.

    The entries of the candidates' buckets are read by pruning; every candidate is compared in full.
    """
    entries = spark.read.parquet(f"{path}/entries")
    if search.strip():
        hit = like_pattern(search)
        found = candidates(spark, path, search)
        if found is not None:
            entries = entries.join(found, ["entry_bucket", "id"], "leftsemi")
        entries = entries.where(F.col("source_text").ilike(hit) | F.col("target_text").ilike(hit))
    total = entries.agg(F.count("*")).scalar()
    return (
        entries.drop("entry_bucket").orderBy(F.col("id").desc()).offset(offset).limit(limit).withColumn("total", total)
    )
