"""Terminology dictionaries as CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossaflow.functions.text import strip
from glossaflow.sources.files import MAX_FILE_BYTES, _files, decode_files, within_limit

# Column names of dictionary files.
HEADER = ("English", "Arabic", "Domain", "Definition", "Alternatives")
TARGET_NAMES = ("arabic", "arabic_term")

_RECORD = r'(?:[^"\r\n]++|"[^"]*+")++'
_CELL = r',((?:[^",]++|"[^"]*+")*+)'


def _cells(record: Column) -> Column:
    """Cells of a CSV record, quotes resolved."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELL), F.lit(1))
    unquoted = lambda c: F.replace(
        F.regexp_replace(c, r'(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"')
    )
    return F.transform(raw, lambda c: F.when(c.startswith('"'), unquoted(c)).otherwise(c))


def read_terms_csv(spark: SparkSession, path: str, existing: DataFrame | None = None):
    """Accepted, rejected and skipped rows of dictionary files.

    Columns are found by name if the first row names them, by place otherwise.  Skipped are rows
    whose term and domain, regardless of case, are in ``existing`` or came earlier.  A file over the
    size limit is not opened and rejected as line 0.
    """
    files = _files(spark, path)
    texts = decode_files(within_limit(files)).where("text IS NOT NULL")
    records = F.filter(
        F.transform(F.regexp_extract_all("text", F.lit(_RECORD), F.lit(0)), _cells),
        lambda cells: F.exists(cells, lambda c: F.length(strip(c)) > 0),
    )
    rows = texts.select("path", records.alias("records"))
    names = F.transform(F.get("records", F.lit(0)), lambda c: F.lower(strip(c)))
    at = lambda *wanted: F.array_position(
        F.transform("names", lambda n: n.isin(*wanted)), F.lit(True)
    )
    headed = (at("english") > 0) & (at(*TARGET_NAMES) > 0)
    placed = (
        rows.withColumn("names", names)
        .withColumn("headed", headed)
        .withColumns(
            {
                "en": F.when(F.col("headed"), at("english")).otherwise(1).cast("int"),
                "ar": F.when(F.col("headed"), at(*TARGET_NAMES)).otherwise(2).cast("int"),
                "dom": F.when(F.col("headed"), at("domain")).otherwise(3).cast("int"),
                "def": F.when(F.col("headed"), at("definition")).otherwise(0).cast("int"),
                "alt": F.when(F.col("headed"), at("alternatives")).otherwise(0).cast("int"),
            }
        )
        .select("path", "headed", "en", "ar", "dom", "def", "alt", F.posexplode("records").alias("pos", "cells"))
        .where(~F.col("headed") | (F.col("pos") > 0))
    )
    cell = lambda place: strip(F.coalesce(F.get("cells", F.col(place) - 1), F.lit("")))
    domain = cell("dom")
    parsed = placed.select(
        "path",
        (F.col("pos") + 1).alias("line"),
        (F.size("cells") < F.greatest("en", "ar")).alias("short"),
        cell("en").alias("english"),
        cell("ar").alias("preferred"),
        F.when(domain == "", "General").otherwise(domain).alias("domain"),
        cell("def").alias("definition"),
        F.filter(F.transform(F.split(cell("alt"), ";"), strip), lambda a: F.length(a) > 0).alias(
            "alternatives"
        ),
    )
    reason = F.when(F.col("short"), "missing column").when(
        (F.col("english") == "") | (F.col("preferred") == ""), "empty value"
    )
    judged = parsed.withColumn("reason", reason).drop("short")
    rejected = judged.where("reason is not null").select("path", "line", "reason")
    too_large = files.where(F.col("length") > MAX_FILE_BYTES).select(
        "path", F.lit(0).alias("line"), F.lit("file too large").alias("reason")
    )
    rejected = rejected.unionByName(too_large)
    key = ["_term", "_domain"]
    good = judged.where("reason is null").drop("reason").withColumns(
        {"_term": F.lower("english"), "_domain": F.lower("domain")}
    )
    first = Window.partitionBy(*key).orderBy("path", "line")
    ranked = good.withColumn("_rank", F.row_number().over(first))
    if existing is not None:
        known = existing.select(
            F.lower(strip(F.col("english"))).alias("_term"),
            F.lower(strip(F.col("domain"))).alias("_domain"),
        ).distinct().withColumn("_known", F.lit(True))
        ranked = ranked.join(known, key, "left")
    else:
        ranked = ranked.withColumn("_known", F.lit(None).cast("boolean"))
    duplicate = (F.col("_rank") > 1) | F.coalesce("_known", F.lit(False))
    accepted = ranked.where(~duplicate).drop(*key, "_rank", "_known")
    skipped = ranked.where(duplicate).select("path", "line", "english", "domain")
    return accepted, rejected, skipped


def import_report(
    accepted: DataFrame, rejected: DataFrame, skipped: DataFrame, listed: int | None = None
) -> DataFrame:
    """Numbers of an import, with all errors or the first ones."""
    first = rejected if listed is None else rejected.orderBy("path", "line").limit(listed)
    errors = first.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("path", "line", "reason"))),
            lambda e: F.struct(e["line"].alias("line"), e["reason"].alias("reason")),
        ).alias("errors")
    )
    return errors.select(
        accepted.agg(F.count("*")).scalar().alias("imported"),
        skipped.agg(F.count("*")).scalar().alias("skipped_duplicates"),
        rejected.agg(F.count("*")).scalar().alias("rejected"),
        "errors",
    )


def terms_csv_rows(terms: DataFrame) -> DataFrame:
    """The five columns of a dictionary file, in order of the terms."""
    values = (
        F.col("english"),
        F.col("preferred"),
        F.col("domain"),
        F.coalesce("definition", F.lit("")),
        F.array_join("alternatives", ";"),
    )
    return terms.orderBy("english").select(*[v.alias(n) for v, n in zip(values, HEADER)])


def write_terms_csv(terms: DataFrame, path: str) -> None:
    terms_csv_rows(terms).write.option("escape", '"').option("emptyValue", "").csv(path, header=True)
