"""Terminology dictionaries: matching, selection, maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaflow.functions.text import strip
from glossaflow.operators.matching import find_patterns

# Fixed value: shorter terms match whole words only.
WHOLE_WORD_BELOW = 4
GENERAL = "General"
CUSTOM = "Custom"


def term_key() -> Column:
    return F.lower(strip(F.col("english")))


def longest_first() -> list[Column]:
    return [F.length("english").desc(), F.col("id").asc()]


def select_domains(
    use_global: Column, domain: Column, use_domain: Column, use_custom: Column
) -> Column:
    """Dictionaries a job asks for."""
    own = use_domain & domain.isNotNull() & ~domain.isin("", GENERAL)
    return F.array_compact(
        F.array(F.when(use_global, GENERAL), F.when(own, domain), F.when(use_custom, CUSTOM))
    )


def terms_for_domains(terms: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Active terms, longest first."""
    chosen = terms.where("active")
    if domains:
        chosen = chosen.where(F.col("domain").isin(*domains))
    return chosen.orderBy(*longest_first())


def first_per_term(terms: DataFrame) -> DataFrame:
    """One row per term regardless of case: the longest spelling, then the oldest."""
    best = Window.partitionBy(term_key()).orderBy(*longest_first())
    return (
        terms.where(term_key() != "")
        .withColumn("_rank", F.row_number().over(best))
        .where("_rank = 1")
        .drop("_rank")
    )


def match_terms(texts: DataFrame, keys: list[str], text: str, terms: DataFrame) -> DataFrame:
    """(keys, id) of terms that occur in the text, regardless of case."""
    patterns = terms.where(term_key() != "").select(
        "id",
        term_key().alias("pattern"),
        (F.length(term_key()) < WHOLE_WORD_BELOW).alias("whole_word"),
    )
    return find_patterns(texts, keys, F.lower(F.col(text)), patterns, "id")


def relevant_terms(
    texts: DataFrame,
    keys: list[str],
    text: str,
    terms: DataFrame,
    domains: list[str] | str | None = None,
    cap: int | None = None,
) -> DataFrame:
    """The dictionary entries that go with each text, longest first, ranked from one.

    ``cap`` keeps the first ones of each text.
    ``domains`` is a list for all texts, or the name of an array column of the texts.
    """
    active = terms.where("active")
    by_length = Window.partitionBy(*keys).orderBy(*longest_first())
    if isinstance(domains, str):
        wanted = texts.select(*keys, F.col(domains).alias("_domains"))
        spelling = Window.partitionBy(*keys, term_key()).orderBy(*longest_first())
        found = (
            match_terms(texts, keys, text, active)
            .join(active, "id")
            .join(wanted, keys)
            .where(F.array_contains("_domains", F.col("domain")))
            .withColumn("_spelling", F.row_number().over(spelling))
            .where("_spelling = 1")
            .drop("_domains", "_spelling")
        )
    else:
        if domains:
            active = active.where(F.col("domain").isin(*domains))
        active = first_per_term(active)
        found = match_terms(texts, keys, text, active).join(active, "id")
    ranked = found.withColumn("rank", F.row_number().over(by_length))
    return ranked if cap is None else ranked.where(F.col("rank") <= cap)


def list_terms(
    terms: DataFrame,
    search: str = "",
    domain: str = "",
    active: bool | None = None,
    limit: int = 200,
    offset: int = 0,
) -> DataFrame:
    """A page of terms in order, with the number of all that match."""
    found = terms
    if search.strip():
        hit = like_pattern(search)
        found = found.where(F.col("english").ilike(hit) | F.col("preferred").ilike(hit))
    if domain:
        found = found.where(F.col("domain") == domain)
    if active is not None:
        found = found.where(F.col("active") == active)
    return page_of(found, [F.col("english").asc(), F.col("id").asc()], limit, offset)


def like_pattern(search: str) -> str:
    return f"%{search.strip()}%"


def page_of(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order, each with the total number of rows.

    The page comes from a top-k, the total from a count as a scalar subquery.
    """
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def term_domains(terms: DataFrame) -> DataFrame:
    return terms.where("domain <> ''").select("domain").distinct().orderBy("domain")


def seed_terms(terms: DataFrame, defaults: DataFrame) -> DataFrame:
    """Terms plus those defaults that are not there yet; new ids follow the largest one."""
    key = lambda: [F.lower(strip("english")).alias("_term"), F.lower(strip("domain")).alias("_domain")]
    present = terms.select(*key()).distinct()
    largest = terms.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    fresh = (
        defaults.select("*", *key())
        .join(present, ["_term", "_domain"], "left_anti")
        .withColumn("_rank", F.row_number().over(Window.partitionBy("_term", "_domain").orderBy("id")))
        .where("_rank = 1")
        .withColumn("id", largest + F.col("id"))
    )
    return terms.unionByName(fresh.select(*terms.columns))


def apply_term_changes(terms: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply a batch of changes; returns the new terms and the refused changes.

    ``changes`` has ``change_id``, ``op`` (create, update, delete), and the columns of ``terms``;
    null values of an update leave the old value.  Deletes come first, then updates, then creates.
    A change that would give two entries the same term and domain, regardless of case, is refused;
    of several that compete the earliest is applied.
    """
    fields = [c for c in terms.columns if c != "id"]
    key = lambda: [
        F.lower(strip("english")).alias("_term"),
        F.lower(strip("domain")).alias("_domain"),
    ]
    of = lambda op: changes.where(F.col("op") == op)

    missing = (
        changes.where("op <> 'create'")
        .join(terms.select("id"), "id", "left_anti")
        .select("change_id", "op", F.lit("not_found").alias("reason"))
    )
    kept = terms.join(of("delete").select("id").distinct(), "id", "left_anti")

    latest = (
        of("update")
        .groupBy("id")
        .agg(
            F.max("change_id").alias("change_id"),
            *[
                F.max_by(f, F.when(F.col(f).isNotNull(), F.col("change_id"))).alias(f"new_{f}")
                for f in fields
            ],
        )
    )
    merged = kept.join(latest, "id", "left").withColumns(
        {f"_{f}": F.coalesce(F.col(f"new_{f}"), F.col(f)) for f in fields}
    )
    renamed = F.col("change_id").isNotNull() & (
        (F.col("_english") != F.col("english")) | (F.col("_domain") != F.col("domain"))
    )
    claims = merged.select(
        "id",
        "change_id",
        renamed.alias("renamed"),
        F.lower(strip("_english")).alias("_term"),
        F.lower(strip("_domain")).alias("_claimed"),
        *[F.col(f"_{f}").alias(f"_to_{f}") for f in fields],
        *[F.col(f) for f in fields],
    )
    # Unrenamed rows hold their key; a renamed one gets it only if none does, earliest first.
    holders = Window.partitionBy("_term", "_claimed").orderBy(
        F.col("renamed").asc(), F.col("change_id").asc_nulls_first(), F.col("id")
    )
    # The key a renamed row gives up still counts while the batch is checked.
    old_keys = claims.where("renamed").select(
        F.col("id").alias("_old_id"),
        F.lower(strip("english")).alias("_term"),
        F.lower(strip("domain")).alias("_claimed"),
    )
    taken = claims.where("renamed").join(old_keys, ["_term", "_claimed"]).where(
        "id <> _old_id"
    ).select("id").distinct().withColumn("_taken", F.lit(True))
    judged = (
        claims.withColumn("_place", F.row_number().over(holders))
        .join(taken, "id", "left")
        .withColumn(
            "refused",
            F.col("renamed") & ((F.col("_place") > 1) | F.coalesce("_taken", F.lit(False))),
        )
    )
    updated = judged.select(
        "id",
        *[F.when(F.col("refused"), F.col(f)).otherwise(F.col(f"_to_{f}")).alias(f) for f in fields],
    )
    refused_updates = judged.where("refused").select(
        "change_id", F.lit("update").alias("op"), F.lit("duplicate").alias("reason")
    )

    creates = of("create").select("change_id", *fields, *key())
    existing = updated.select(*key()).distinct().withColumn("_exists", F.lit(True))
    first = Window.partitionBy("_term", "_domain").orderBy("change_id")
    tested = (
        creates.withColumn("_place", F.row_number().over(first))
        .join(existing, ["_term", "_domain"], "left")
        .withColumn("refused", (F.col("_place") > 1) | F.coalesce("_exists", F.lit(False)))
    )
    largest = terms.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    created = tested.where("not refused").select(
        (largest + F.col("change_id")).alias("id"), *fields
    )
    refused_creates = tested.where("refused").select(
        "change_id", F.lit("create").alias("op"), F.lit("duplicate").alias("reason")
    )
    return (
        updated.unionByName(created),
        missing.unionByName(refused_updates).unionByName(refused_creates),
    )
