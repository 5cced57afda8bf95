"""Translation memory: build, maintain, exact and fuzzy lookup."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaflow.functions.text import normalize_text, source_hash, strip
from glossaflow.operators import edits
from glossaflow.operators.terms import like_pattern, page_of
from glossaflow.session import written

# Fixed value: the share in common from which on an entry is similar.
FUZZY_THRESHOLD = 0.72
# Segments of so many characters are rare enough to propose entries by.
RARE_LENGTH = 5
# Texts whose lengths are compared in one block: lengths at most so far apart, so many texts or characters.
LENGTH_STEP, BLOCK_TEXTS, BLOCK_CHARACTERS = 1.05, 1024, 262144


def build_tm(pairs: DataFrame, order: list[Column], language: Column | str = "ar") -> DataFrame:
    """Memory from (source_text, translation): the first pair of a source, repeats counted.

    One aggregate with partial sums, so copies of one source meet already before the shuffle.
    """
    language = language if isinstance(language, Column) else F.lit(language)
    stored = pairs.select(
        strip(F.col("source_text")).alias("source_text"),
        strip(F.col("translation")).alias("target_text"),
        language.alias("target_language"),
        F.struct(*order).alias("_order"),
    ).where("source_text <> '' and target_text <> ''")
    return (
        stored.withColumn("source_hash", source_hash(F.col("source_text")))
        .groupBy("source_hash", "target_language")
        .agg(
            F.min_by(F.struct("source_text", "target_text"), "_order").alias("_first"),
            (F.count("*") - 1).alias("use_count"),
            F.min("_order").alias("first_seen"),
        )
        .select(
            "source_hash", "target_language", "_first.source_text", "_first.target_text",
            "use_count", "first_seen",
        )
    )


def upsert_tm(tm: DataFrame, batch: DataFrame) -> DataFrame:
    """Memory after a batch built by ``build_tm``: hits raise the count, misses are added.

    A hit counts every pair of the batch, a miss all but the one that made the entry.
    """
    keys = ["source_hash", "target_language"]
    old, new = tm.alias("old"), batch.alias("new")
    hit = F.col("old.use_count").isNotNull()
    added = F.coalesce(F.col("new.use_count") + 1, F.lit(0))
    shared = [c for c in batch.columns if c not in keys + ["use_count"]]
    return old.join(new, keys, "full").select(
        *keys,
        *[F.when(hit, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in shared],
        F.when(hit, F.col("old.use_count") + added)
        .otherwise(F.col("new.use_count"))
        .alias("use_count"),
    )


def search_tm(tm: DataFrame, search: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of entries, newest first, with the number of all that match."""
    found = tm
    if search.strip():
        hit = like_pattern(search)
        found = found.where(F.col("source_text").ilike(hit) | F.col("target_text").ilike(hit))
    return page_of(found, [F.col("id").desc()], limit, offset)


def tm_stats(tm: DataFrame) -> DataFrame:
    return tm.agg(F.count("*").alias("total_entries"))


def delete_tm(tm: DataFrame, ids: DataFrame) -> DataFrame:
    return tm.join(ids.select("id"), "id", "left_anti")


def approved_entries(tm: DataFrame, language: str) -> DataFrame:
    return tm.where(F.col("approved") & (F.col("target_language") == language))


def tm_exact(
    texts: DataFrame, keys: list[str], text: str, tm: DataFrame, language: str = "ar"
) -> DataFrame:
    """(keys, source, target, similarity 1.0) of texts that are in memory but for case and space.

    The texts are reduced to their hash before the shuffle.
    """
    entries = approved_entries(tm, language).select(
        "source_hash", F.col("source_text").alias("source"), F.col("target_text").alias("target")
    )
    return (
        texts.select(*keys, source_hash(F.col(text)).alias("source_hash"))
        .join(entries, "source_hash")
        .select(*keys, "source", "target", F.lit(1.0).alias("similarity"))
    )


def word_pairs(form: Column) -> Column:
    """Hashes of the distinct neighbouring words of a normal form; a single word stands alone."""
    words = F.split(form, " ")
    pairs = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1)),
    )
    return F.array_distinct(pairs)


def _rarest(sets: DataFrame, key: str, numbers: DataFrame, threshold: float) -> DataFrame:
    """(key, token, size): of each set the rarest tokens, as many as a similar set must touch.

    Two sets whose share in common is at least the threshold have so many tokens in common that, in
    any one order of all tokens, the first ones of each overlap.  Rare tokens come first, so that
    what everybody has is hardly ever joined on.
    """
    order = Window.partitionBy(key).orderBy("_count", "token")
    shared = F.ceil(F.col("size") * (threshold / (2 - threshold)) - F.lit(1e-9))
    return (
        sets.select(key, F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
        .join(numbers, "token")
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= F.col("size") - shared + 1)
        .select(key, "token", "size")
    )


def tm_overlap(
    texts: DataFrame,
    keys: list[str],
    text: str,
    tm: DataFrame,
    language: str = "ar",
    threshold: float = FUZZY_THRESHOLD,
    matches: int | None = None,
) -> DataFrame:
    """The memory entries with the same wording of each text that has no exact entry, best first.

    Similarity is the share of neighbouring word pairs that two texts have in common, twice the
    common ones over all, compared over the whole memory.  An equi-join on each text's rarest pairs
    proposes entries without losing one that reaches the threshold, and those are then compared.
    Copies of a text are scored once.  Ties go to the entry with the larger number.
    """
    approved = approved_entries(tm, language)
    hashed = texts.select(*keys, source_hash(F.col(text)).alias("source_hash"))
    asked = (
        texts.select(normalize_text(F.col(text)).alias("form"))
        .select(F.sha2("form", 256).alias("source_hash"), word_pairs(F.col("form")).alias("tokens"))
        .dropDuplicates(["source_hash"])
        .join(approved.select("source_hash"), "source_hash", "left_anti")
    )
    known = approved.select("id", word_pairs(normalize_text(F.col("source_text"))).alias("tokens"))
    # Only order depends on the numbers, so tokens that no entry has need none.
    numbers = (
        known.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("_count"))
    )
    # A token that no entry has comes before all others, and finds nothing.
    every = (
        asked.select(F.explode("tokens").alias("token"))
        .distinct()
        .join(numbers, "token", "left")
        .select("token", F.coalesce("_count", F.lit(0)).alias("_count"))
    )
    mine = _rarest(asked, "source_hash", every, threshold)
    theirs = _rarest(known, "id", numbers, threshold).withColumnRenamed("size", "_size")
    least = threshold / (2 - threshold) - 1e-9
    proposed = (
        mine.join(theirs, "token")
        .where((F.col("size") >= least * F.col("_size")) & (F.col("_size") >= least * F.col("size")))
        .select("source_hash", "id")
        .distinct()
    )
    common = F.size(F.array_intersect("tokens", "_tokens"))
    share = 2.0 * common / (F.size("tokens") + F.size("_tokens"))
    scored = (
        proposed.join(asked, "source_hash")
        .join(known.withColumnRenamed("tokens", "_tokens"), "id")
        .select("source_hash", "id", share.alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )
    return _best(hashed, keys, scored, approved, matches)


def _best(
    hashed: DataFrame, keys: list[str], scored: DataFrame, approved: DataFrame, matches: int | None
) -> DataFrame:
    """The scored entries of each text with their rank; ties go to the entry with the larger number."""
    best = Window.partitionBy("source_hash").orderBy(F.col("similarity").desc(), F.col("id").desc())
    scored = scored.withColumn("rank", F.row_number().over(best))
    if matches is not None:
        scored = scored.where(F.col("rank") <= matches)
    sources = approved.select(
        "id", F.col("source_text").alias("source"), F.col("target_text").alias("target")
    )
    return (
        hashed.join(scored, "source_hash")
        .join(sources, "id")
        .select(*keys, "rank", "id", "source", "target", "similarity")
    )


def gram_length(threshold: float) -> int:
    """Characters of a segment so that similar texts have segments in common.

    Each edit changes as many segments as a segment has characters.  Longer segments are rarer, but
    fewer of them stay whole: here 15 % of the longer text's segments at least.
    """
    apart = 1 - threshold
    return max(1, min(8, int(0.85 / apart))) if apart > 0 else 8


def _segments(forms: DataFrame, key: str, length: int) -> DataFrame:
    """(key, n, segment): the overlapping segments of each form, a repeated one with its number.

    Ends are padded, so that every character lies in as many segments as one has characters.
    """
    pad = F.lit("\u0001" * (length - 1))
    every = F.regexp_extract_all(
        F.concat(pad, "form", pad), F.lit(f"(?s)(?=(.{{{length}}}))."), F.lit(1)
    )
    found = forms.select(key, "n", F.explode(every).alias("segment")).where("segment <> ''")
    numbered = found.groupBy(key, "n", "segment").count()
    return numbered.select(
        key, "n", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("k"), "segment"
    ).select(key, "n", F.xxhash64("segment", "k").alias("segment"))


def _rarest_segments(
    segments: DataFrame, key: str, numbers: DataFrame, length: int, threshold: float
) -> DataFrame:
    """(key, n, segment): of each text the rarest segments, as many as a similar text must touch."""
    order = Window.partitionBy(key).orderBy(F.coalesce("_count", F.lit(0)), "segment")
    # A text of n characters has n + length - 1 segments; d edits change length * d of them at most.
    whole = F.ceil(F.col("n") * (1 - length * (1 - threshold)) + (length - 1) - 1e-9)
    return (
        segments.join(numbers, "segment", "left")
        .withColumn("_place", F.row_number().over(order))
        .where((F.col("_place") <= F.col("n") + length - whole) & F.col("_count").isNotNull())
        .select(key, "n", "segment")
    )


def _by_segments(asked: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(source_hash, id): pairs that have one of their rarest segments in common, none lost that is similar."""
    length = gram_length(threshold)
    mine = written(_segments(asked, "source_hash", length), "asked_segments")
    theirs = written(_segments(known, "id", length), "known_segments")
    # Only order depends on the numbers; a segment that no entry has comes first and finds nothing.
    numbers = written(theirs.groupBy("segment").agg(F.count("*").alias("_count")), "segment_counts")
    few = _rarest_segments(theirs, "id", numbers, length, threshold).withColumnRenamed("n", "_n")
    return (
        _rarest_segments(mine, "source_hash", numbers, length, threshold)
        .join(few, "segment")
        .where(F.least("n", "_n") >= F.greatest("n", "_n") * threshold - 1e-9)
        .select("source_hash", "id")
        .distinct()
    )


def _binned(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forms with their bin of length, and each bin's lengths and number of blocks.

    A bin has lengths of one step, fewer where these have texts for more than one block, so that texts of a block
    are as near in length as their number allows.  Only a length with texts for several blocks is dealt by hash.
    """
    share = F.greatest(F.col("count") / BLOCK_TEXTS, F.col("count") * F.col("n") / BLOCK_CHARACTERS)
    earlier = Window.partitionBy("_step").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ["_step", "_part"]
    lengths = (
        forms.where("n > 0").groupBy("n").count()
        .withColumn("_step", F.floor(F.log("n") / F.log(F.lit(LENGTH_STEP))).cast("int"))
        .withColumn("_share", share)
        .withColumn("_part", F.floor(F.sum("_share").over(earlier) - F.col("_share") / 2))
        .withColumn("bin", F.min("n").over(Window.partitionBy(*own)))
    )
    lengths = written(lengths.select("n", "bin", "_share"), "lengths")
    blocks = F.greatest(F.round(F.sum("_share")), F.lit(1)).cast("int")
    bins = lengths.groupBy("bin").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), blocks.alias("blocks"))
    return forms.join(F.broadcast(lengths.select("n", "bin")), "n"), bins


def _by_blocks(asked: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(source_hash, id, _edits): all pairs of like length, compared block by block.

    Both sides are dealt into small blocks of like length, and each pair of blocks is a group of its
    own.  Edits are -1 for long texts that may be similar and are still to be compared.
    """
    session = asked.sparkSession
    mine, my_bins = _binned(asked)
    theirs, their_bins = _binned(known)
    a, k = my_bins.alias("a"), their_bins.alias("k")
    partners = written(
        a.join(
            k,
            (F.col("a.hi") >= F.col("k.lo") * threshold - 1e-9) & (F.col("k.hi") >= F.col("a.lo") * threshold - 1e-9),
        ).select(
            F.col("a.bin").alias("asked_bin"), F.col("a.blocks").alias("asked_blocks"),
            F.col("k.bin").alias("known_bin"), F.col("k.blocks").alias("known_blocks"),
        ),
        "partners",
    )
    group = ["asked_bin", "asked_block", "known_bin", "known_block"]
    # So many tasks at least, as the work in a group is far larger than its bytes.
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)

    def dealt(rows: DataFrame, key: str, side: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64(key), F.col(f"{side}_blocks")).cast("int")
        return (
            rows.withColumnRenamed("bin", f"{side}_bin")
            .join(F.broadcast(partners), f"{side}_bin")
            .withColumn(f"{side}_block", own)
            .withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
            .select(*group, key, "form")
            .repartition(tasks, *group)
        )

    def compared(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"source_hash": [], "id": [], "_edits": []})
        i, j, found = edits.close_pairs(list(left["form"]), list(right["form"]), threshold)
        return pd.DataFrame(
            {"source_hash": left["source_hash"].to_numpy()[i], "id": right["id"].to_numpy()[j], "_edits": found}
        )

    schema = T.StructType([asked.schema["source_hash"], known.schema["id"], T.StructField("_edits", T.LongType())])
    return (
        dealt(mine, "source_hash", "asked", "known")
        .groupBy(*group)
        .cogroup(dealt(theirs, "id", "known", "asked").groupBy(*group))
        .applyInPandas(compared, schema)
    )


def tm_fuzzy(
    texts: DataFrame,
    keys: list[str],
    text: str,
    tm: DataFrame,
    language: str = "ar",
    threshold: float = FUZZY_THRESHOLD,
    matches: int | None = None,
) -> DataFrame:
    """The similar memory entries of each text that has no exact entry, most similar first.

    Similarity is over the characters of the normal forms: one minus the edit distance over the
    longer length, which is never above the share of matching characters, 2 M / (|a| + |b|).  The
    whole memory is compared, and no entry that reaches the threshold is lost.

    What the threshold allows of edits leaves some segments of a few characters whole.  Where these are
    long enough to be rare, at thresholds of about 0.83 and more, an equi-join on the rarest segments
    proposes entries of like length and the built-in edit distance decides.  Below, nearly all texts of
    like length share a segment, so blocks of like length are compared pair by pair: counts of
    character pairs tell most apart, bit vectors compare the others; the built-in edit distance is
    left with long texts.  Copies of a text are scored once.  Ties go to the entry with the larger
    number.  The threshold must be above 0.
    """
    approved = approved_entries(tm, language)
    hashed = texts.select(*keys, source_hash(F.col(text)).alias("source_hash"))
    asked = written(
        texts.select(normalize_text(F.col(text)).alias("form"))
        .select(F.sha2("form", 256).alias("source_hash"), "form", F.length("form").alias("n"))
        .dropDuplicates(["source_hash"])
        .join(approved.select("source_hash"), "source_hash", "left_anti"),
        "asked",
    )
    known = written(
        approved.select("id", normalize_text(F.col("source_text")).alias("form")).withColumn("n", F.length("form")),
        "known",
    )
    if gram_length(threshold) >= RARE_LENGTH:
        proposed = _by_segments(asked, known, threshold).withColumn("_edits", F.lit(edits.UNDECIDED))
    else:
        proposed = written(_by_blocks(asked, known, threshold), "compared")
    longer = F.greatest("n", "_n")
    allowed = F.floor(longer * (1 - threshold) + 1e-9).cast("int")
    open_ = F.col("_edits") == edits.UNDECIDED
    # The lengths decide a similarity; only undecided pairs need the texts.
    scored = (
        proposed.join(asked.withColumnRenamed("form", "_asked"), "source_hash")
        .join(known.withColumnRenamed("form", "_form").withColumnRenamed("n", "_n"), "id")
        .withColumn(
            "_edits",
            F.when(open_, F.call_function("levenshtein", F.col("_asked"), F.col("_form"), allowed)).otherwise(
                F.col("_edits")
            ),
        )
        .where("_edits >= 0")
        .select("source_hash", "id", (1 - F.col("_edits") / longer).alias("similarity"))
    )
    return _best(hashed, keys, scored, approved, matches)


def lookup(
    texts: DataFrame, keys: list[str], text: str, tm: DataFrame, language: str = "ar", **fuzzy
) -> DataFrame:
    """Exact entry of each text, or its fuzzy ones."""
    exact = tm_exact(texts, keys, text, tm, language).select(
        *keys, F.lit(1).alias("rank"), "source", "target", "similarity", F.lit(True).alias("exact")
    )
    similar = tm_fuzzy(texts, keys, text, tm, language, **fuzzy).select(
        *keys, "rank", "source", "target", "similarity", F.lit(False).alias("exact")
    )
    return exact.unionByName(similar)
