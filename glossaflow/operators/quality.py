"""Validation of translations, terminology consistency, completeness and usage of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaflow.functions.tables import extract_row_markers, number_table_rows, row_cell_counts
from glossaflow.functions.text import (
    ARABIC_CLASS,
    SPACES,
    collapse_space,
    english_word_count,
    split_paragraphs,
    strip,
)
from glossaflow.operators.matching import find_patterns
from glossaflow.operators.terms import WHOLE_WORD_BELOW, term_key

# The limits of the checks.
MIN_CHARS = 10
MIN_LENGTH_SHARE = 0.25
MIN_ENGLISH_WORDS = 8
INDEX_BUCKET = 1024


def validate_translations(
    pairs: DataFrame, source: str = "source_text", target: str = "translation",
    script: str = ARABIC_CLASS,
) -> DataFrame:
    """Add one flag per check and ``reason``, the first check that fails (null if none does)."""
    src, out = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    flagged = pairs.withColumns(
        {
            "_numbered": number_table_rows(src),
            "_stripped": F.length(strip(out)),
        }
    ).withColumns(
        {"_expected": extract_row_markers(F.col("_numbered")), "_got": extract_row_markers(out)}
    )
    tables = F.size("_expected") > 0
    same_cells = F.when(tables, _same_cells(F.col("_numbered"), out)).otherwise(True)
    out_paragraphs, src_paragraphs = F.size(split_paragraphs(out)), F.size(split_paragraphs(src))
    flagged = flagged.withColumns(
        {
            "is_empty": F.col("_stripped") == 0,
            "is_short": F.col("_stripped")
            < F.greatest(F.lit(float(MIN_CHARS)), F.length(strip(src)) * F.lit(MIN_LENGTH_SHARE)),
            "markers_differ": tables & (F.col("_expected") != F.col("_got")),
            "cells_differ": tables & (F.col("_expected") == F.col("_got")) & ~same_cells,
            "paragraphs_lost": (out_paragraphs > 0)
            & (src_paragraphs > 0)
            & (out_paragraphs < F.greatest(F.lit(1), src_paragraphs - 1)),
            "wrong_script": (english_word_count(src) >= MIN_ENGLISH_WORDS) & ~out.rlike(script),
        }
    )
    reason = (
        F.when(F.col("is_empty"), "empty")
        .when(F.col("is_short"), "short")
        .when(F.col("markers_differ"), "markers")
        .when(F.col("cells_differ"), "cells")
        .when(F.col("paragraphs_lost"), "paragraphs")
        .when(F.col("wrong_script"), "language")
    )
    return flagged.withColumn("reason", reason).drop("_numbered", "_stripped", "_expected", "_got")


def _same_cells(numbered: Column, out: Column) -> Column:
    """Every marker of the source has the same number of cells in the output."""
    return F.aggregate(
        F.map_entries(row_cell_counts(numbered)),
        F.lit(True),
        lambda same, e: same
        & F.coalesce(F.try_element_at(row_cell_counts(out), e["key"]) == e["value"], F.lit(False)),
    )


def dictionary(terms: DataFrame) -> DataFrame:
    """The entries that checks look at: active ones, one row a term of a domain."""
    return terms.where("active")


def term_usage(
    pairs: DataFrame, keys: list[str], terms: DataFrame, domains: str | None = None
) -> DataFrame:
    """How each active term that occurs in a source is rendered in its translation.

    (keys, id, variant, found): variant is ``preferred``, ``alternative`` or ``other``, found the
    wording.  ``domains`` names an array column of the pairs with the dictionaries of their job; only
    terms of those count.  Sources are searched for terms, translations for the distinct
    wordings, and only the small sets of matches are joined.
    """
    active = dictionary(terms)
    wording = active.select(
        "id",
        F.posexplode(
            F.concat(
                F.array(strip(F.col("preferred"))),
                F.coalesce("alternatives", F.array().cast("array<string>")),
            )
        ).alias("place", "found"),
    ).where(F.length(strip(F.col("found"))) > 0)
    pattern = lambda id_, place: F.struct(id_.alias("id"), place.cast("int").alias("place"))
    # An alternative is compared with its outer white space; the pattern search is on its core.  Many
    # terms share a wording, so it is looked for once and leads back to its terms where they are used.
    wording = wording.withColumn("pattern", strip(collapse_space(F.col("found"))))
    texts = lambda text: pairs.select(*keys, text.alias("_text"))
    in_source = find_patterns(
        texts(F.lower("source_text")),
        keys,
        F.col("_text"),
        active.where(term_key() != "").select(
            "id", term_key().alias("pattern"), (F.length(term_key()) < WHOLE_WORD_BELOW).alias("whole_word")
        ),
        "id",
    )
    if domains is not None:
        wanted = pairs.select(*keys, F.col(domains).alias("_domains"))
        in_source = (
            in_source.join(active.select("id", "domain"), "id")
            .join(wanted, keys)
            .where(F.array_contains("_domains", F.col("domain")))
            .select(*keys, "id")
        )
    in_translation = find_patterns(
        texts(collapse_space(F.coalesce("translation", F.lit("")))),
        keys,
        F.col("_text"),
        wording.select("pattern", F.lit(False).alias("whole_word"), F.col("pattern").alias("_wording")).distinct(),
        "_wording",
    ).withColumn("_there", F.lit(True))
    looked_for = wording.select("id", "place", F.col("pattern").alias("_wording"))
    used = (
        in_source.join(looked_for, "id", "left")
        .join(in_translation, [*keys, "_wording"], "left")
        .groupBy(*keys, "id")
        .agg(F.min(F.when(F.col("_there"), F.col("place"))).alias("place"))
    )
    variant = (
        F.when(F.col("place") == 0, "preferred")
        .when(F.col("place") > 0, "alternative")
        .otherwise("other")
    )
    return used.join(wording, ["id", "place"], "left").select(
        *keys, "id", variant.alias("variant"), "found"
    )


def check_terms(
    pairs: DataFrame,
    keys: list[str],
    terms: DataFrame,
    cap: int | None = None,
    domains: str | None = None,
) -> DataFrame:
    """Issues per chunk: a term in the source without its preferred translation.

    ``cap`` keeps the first issues of a chunk in term order, as stored with a chunk.
    """
    named = terms.select("id", "english", F.col("preferred").alias("expected"))
    issues = (
        term_usage(pairs, keys, terms, domains)
        .where("variant <> 'preferred'")
        .join(named, "id")
        .select(
            *keys,
            "id",
            F.when(F.col("variant") == "alternative", "alternative_used")
            .otherwise("preferred_missing")
            .alias("issue"),
            "english",
            "expected",
            "found",
        )
    )
    if cap is None:
        return issues
    order = Window.partitionBy(*keys).orderBy(F.length("english").desc(), F.col("id").asc())
    return (
        issues.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= cap).drop("_rank")
    )


def term_variants(
    usage: DataFrame, terms: DataFrame, index: str, *groups: str, listed: int | None = None
) -> DataFrame:
    """Chunks per term and wording: count, and their indexes, all or the first ``listed``.

    ``groups`` are further columns to report by, such as the job.  A term in every chunk is counted
    by buckets of indexes first, each of a fixed width, so no rows of a group of any size meet in one
    task.
    """
    label = (
        F.when(F.col("variant") == "preferred", F.col("preferred"))
        .when(F.col("variant") == "alternative", F.concat(F.lit("alt: "), "found"))
        .otherwise("other")
    )
    def first(indexes: Column) -> Column:
        every = F.array_sort(F.array_distinct(indexes))
        return every if listed is None else F.slice(every, 1, listed)

    keys = [*groups, "id", "english", "preferred", "label"]
    return (
        usage.join(terms.select("id", "english", "preferred"), "id")
        .withColumn("label", label)
        .groupBy(*keys, F.floor(F.col(index) / INDEX_BUCKET))
        .agg(F.count("*").alias("chunks"), first(F.collect_set(index)).alias("first_chunks"))
        .groupBy(*keys)
        .agg(
            F.sum("chunks").alias("chunks"),
            first(F.flatten(F.collect_list("first_chunks"))).alias("first_chunks"),
        )
    )


def consistency_report(
    usage: DataFrame, terms: DataFrame, index: str, *groups: str, listed: int | None = None
) -> DataFrame:
    """One row a term that occurs: its wordings and whether they agree.

    More than one wording is inconsistent; a single one other than ``other`` is consistent.
    """
    variants = term_variants(usage, terms, index, *groups, listed=listed)
    wordings = F.array_sort(F.collect_list(F.struct("label", "chunks", "first_chunks")))
    return (
        variants.groupBy(*groups, "id", "english", "preferred")
        .agg(
            wordings.alias("wordings"),
            F.count("*").alias("variant_count"),
            F.sum("chunks").alias("chunk_count"),
            F.max(F.when(F.col("label") == "other", F.col("first_chunks"))).alias(
                "chunks_without_preferred"
            ),
        )
        .withColumn("inconsistent", F.col("variant_count") > 1)
        .withColumn(
            "consistent",
            (F.col("variant_count") == 1) & (F.get("wordings", F.lit(0))["label"] != "other"),
        )
    )


def consistency_totals(report: DataFrame, *groups: str) -> DataFrame:
    return report.groupBy(*groups).agg(
        F.count("*").alias("terms_used"),
        F.count_if("consistent").alias("consistent_terms"),
        F.count_if("inconsistent").alias("inconsistent_terms"),
    )


def index_runs(chunks: DataFrame, job: str) -> DataFrame:
    """A row a job and bucket: counts, runs (first, last) of its indexes, and those that are repeated."""
    status, index = F.col("status"), F.col("chunk_index").cast("long")
    blank = F.length(strip(F.coalesce("translation", F.lit("")))) == 0
    each = chunks.groupBy(job, index.alias("_index")).agg(
        F.count("*").alias("n"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(blank).alias("blank"),
    )
    place = F.col("_index")
    buckets = each.groupBy(job, F.floor(place / INDEX_BUCKET).alias("_bucket")).agg(
        *[F.sum(c).alias(c) for c in ("n", "failed", "completed", "blank")],
        F.count(place).alias("distinct"),
        F.array_sort(F.collect_list(place)).alias("_seen"),
        F.array_sort(F.collect_list(F.when(F.col("n") > 1, place))).alias("again"),
    )
    other = lambda k: F.coalesce(F.get("_seen", k), F.lit(-(1 << 62)))
    runs = F.arrays_zip(
        F.filter("_seen", lambda i, k: other(k - 1) != i - 1).alias("first"),
        F.filter("_seen", lambda i, k: other(k + 1) != i + 1).alias("last"),
    )
    return buckets.withColumn("runs", runs).drop("_seen")


def completeness(
    chunks: DataFrame, job: str = "job_id", jobs: DataFrame | None = None, listed: int | None = None
) -> DataFrame:
    """Whether each job can be assembled: counts, gaps, and the first reason why not.

    ``chunks`` has job, chunk_index, status and translation.  With ``jobs`` (column ``id``) every job
    has a row, and the reason of one without chunks is ``none``.

    Chunks are added up by index, and indexes in buckets of a fixed width, so a job of any length spreads
    over tasks and no set is larger than a bucket.  A bucket hands on its runs of neighbouring indexes,
    a single one where none is missing; a job's gaps are what lies between its runs.  So what a job
    gathers is as large as its missing and repeated indexes, and one run a bucket.
    ``listed`` keeps the first missing and repeated indexes; all are listed otherwise.
    """
    counts = (
        index_runs(chunks, job)
        .groupBy(job)
        .agg(
            F.sum("n").alias("total_chunks"),
            F.sum("completed").alias("completed_chunks"),
            F.sum("failed").alias("failed_chunks"),
            F.sum("blank").alias("empty_translations"),
            F.sum("distinct").alias("_distinct"),
            F.min(F.get("runs", F.lit(0))["first"]).alias("_lowest"),
            F.max(F.try_element_at("runs", F.lit(-1))["last"]).alias("_highest"),
            F.array_sort(F.flatten(F.array_agg("runs"))).alias("_runs"),
            F.array_sort(F.flatten(F.array_agg("again"))).alias("duplicate_indexes"),
        )
    )
    if jobs is not None:
        counts = jobs.select(F.col("id").alias(job)).distinct().join(counts, job, "left")
        zero = ["total_chunks", "completed_chunks", "failed_chunks", "empty_translations", "_distinct"]
        counts = counts.fillna(0, zero)
    total = F.col("total_chunks")
    gapless = (F.col("_distinct") == total) & (F.col("_lowest") == 0) & (F.col("_highest") == total - 1)
    reason = (
        F.when(total == 0, "none")
        .when(~gapless, "sequence")
        .when(F.col("failed_chunks") > 0, "failed")
        .when(F.col("completed_chunks") < total, "pending")
        .when(F.col("empty_translations") > 0, "empty")
    )
    none = F.array().cast("array<bigint>")
    end = F.struct(total.alias("first"), total.alias("last"))

    def gap(run: Column, k: Column) -> Column:
        """The indexes from zero to the count of rows between a run and the one before it."""
        low = F.greatest(F.lit(0).cast("long"), F.coalesce(F.get("_runs", k - 1)["last"] + 1, F.lit(0)))
        high = F.least(run["first"], total) - 1
        if listed is not None:
            high = F.least(high, low + listed - 1)
        return F.when(low <= high, F.sequence(low, high)).otherwise(none)

    runs = F.concat(F.coalesce("_runs", F.array().cast("array<struct<first:bigint,last:bigint>>")), F.array(end))
    missing = F.when(F.coalesce(gapless, F.lit(False)) | (total == 0), none).otherwise(
        F.flatten(F.transform(runs, gap))
    )
    first = lambda c: c if listed is None else F.slice(c, 1, listed)
    return counts.select(
        job, "total_chunks", "completed_chunks", "failed_chunks", "empty_translations",
        reason.alias("reason"),
        first(missing).alias("missing_indexes"),
        first(F.coalesce("duplicate_indexes", none)).alias("duplicate_indexes"),
    )


def quality_report(complete: DataFrame, totals: DataFrame, job: str = "job_id") -> DataFrame:
    """Completeness of each job with its terminology totals."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return complete.join(totals, job, "left").select(
        job,
        "total_chunks",
        "completed_chunks",
        "failed_chunks",
        "empty_translations",
        "duplicate_indexes",
        "missing_indexes",
        F.struct(
            zero("terms_used"), zero("consistent_terms"), zero("inconsistent_terms")
        ).alias("terminology"),
    )


def usage_report(chunks: DataFrame, job: str = "job_id", script: str = ARABIC_CLASS) -> DataFrame:
    """Tokens, attempts and words of each job."""
    words = F.split(F.coalesce("translation", F.lit("")), SPACES)
    return chunks.groupBy(job).agg(
        F.sum("prompt_tokens_used").alias("prompt_tokens"),
        F.sum("completion_tokens_used").alias("completion_tokens"),
        F.avg("attempts").alias("avg_attempts"),
        F.sum(F.size(F.filter(words, lambda w: w.rlike(script)))).alias("target_words"),
        (F.sum(F.length("source_text")) / F.lit(6.0)).alias("source_words"),
    )


def preferred_presence(
    pairs: DataFrame, terms: DataFrame, job: str = "job_id", translation: str = "translation"
) -> DataFrame:
    """(job, id) of terms whose preferred translation occurs anywhere in the job's output."""
    patterns = terms.select(
        "id", strip(F.col("preferred")).alias("pattern"), F.lit(False).alias("whole_word")
    ).where("pattern <> ''")
    return find_patterns(pairs, [job], F.coalesce(translation, F.lit("")), patterns, "id")
