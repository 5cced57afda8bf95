"""Files as rows: text documents, an inventory with verdicts, stale files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaflow.functions.names import extension_verdict, file_suffix
from glossaflow.sources.file_heads import read_heads, with_encoding

# Size limit, and first bytes of known types.
MAX_FILE_BYTES = 100 * 1024 * 1024
MAGIC = (("%PDF", ".pdf"), ("PK\x03\x04", ".docx"))
FALLBACK_CODE_PAGES = ("cp1256", "cp1252", "latin-1")


@F.pandas_udf(T.StringType())
def decode_code_page(content: pd.Series) -> pd.Series:
    """Text of bytes that are not UTF-8; null stays null."""

    def decode(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for name in FALLBACK_CODE_PAGES:
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
        return raw.decode("utf-8", errors="replace")

    return content.map(decode)


def file_name(path: Column) -> Column:
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def decode_files(files: DataFrame) -> DataFrame:
    """Replace ``content`` by ``text``, in one reading.

    UTF-8 is decoded natively; Python is handed the bytes of the other files only, null otherwise.
    """
    valid = F.is_valid_utf8("content")
    plain = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    other = decode_code_page(F.when(~valid, F.col("content")))
    return files.withColumn("_other", other).withColumn(
        "text", F.coalesce("_other", F.when(valid, plain))
    ).drop("content", "_other")


def within_limit(files: DataFrame) -> DataFrame:
    """The files with their content, null for those over the size limit, which are not opened.

    The content of the others comes from a reading of its own, so that the limit reaches the source.
    """
    small = files.where(F.col("length") <= MAX_FILE_BYTES).select("path", "length", "content")
    large = files.where(F.col("length") > MAX_FILE_BYTES).select(
        "path", "length", F.lit(None).cast("binary").alias("content")
    )
    return small.unionByName(large)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length, text, verdict) of the files of a folder.

    A file over the size limit is not opened: its text is null and its verdict ``too_large``.
    """
    verdict = F.when(F.col("length") > MAX_FILE_BYTES, "too_large").otherwise("ok")
    return decode_files(within_limit(_files(spark, path))).select(
        "path", file_name(F.col("path")).alias("name"), "length", "text", verdict.alias("verdict")
    )


def file_inventory(
    spark: SparkSession, path: str, include_empty: bool = True, check_text: bool = False
) -> DataFrame:
    """Each file with its size, claimed and found type, encoding, and whether it is accepted.

    The first bytes tell the known types.  A file claimed to be text is read whole and is text if it can be
    decoded, from its first byte to its last, by one of the encodings that ``read_text_documents`` tries.
    ``check_text`` also tells whether that is UTF-8.
    """
    heads = read_heads(spark, path)
    if not include_empty:
        heads = heads.where("length > 0")
    named = heads.withColumn("name", file_name(F.col("path")))
    listed = named.withColumns(
        {
            "extension": F.lower(file_suffix(F.col("name"))),
            "name_verdict": extension_verdict(F.col("name")),
        }
    )
    start = F.substring("head", 1, 4)
    kind = None
    for magic, extension in MAGIC:
        test = start == F.lit(magic.encode("latin-1"))
        kind = F.when(test, extension) if kind is None else kind.when(test, extension)
    opened = (F.col("length") > 0) & (F.col("length") <= MAX_FILE_BYTES) & (F.col("name_verdict") == "ok")
    started = listed.withColumn("found", F.when(opened, kind)).drop("head")
    is_text = opened & F.col("found").isNull() & (F.col("extension") == ".txt")
    read = with_encoding(started, path, is_text, ("utf-8", *FALLBACK_CODE_PAGES))
    found = F.coalesce("found", F.when(F.col("encoding").isNotNull(), ".txt"))
    verdict = (
        F.when(F.col("name_verdict") != "ok", F.col("name_verdict"))
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > MAX_FILE_BYTES, "too_large")
        .when(F.col("found").isNull(), "unknown_content")
        .when(F.col("found") != F.col("extension"), "content_mismatch")
        .otherwise("ok")
    )
    checked = read.withColumn("found", found).withColumn("verdict", verdict).drop("name_verdict")
    return checked.withColumn("utf8", F.col("encoding") == "utf-8") if check_text else checked


def stale_files(spark: SparkSession, path: str, hours: float = 24, now: Column | None = None) -> DataFrame:
    """Files last changed before the cutoff; they are listed, not removed."""
    cutoff = (now if now is not None else F.current_timestamp()) - F.make_dt_interval(
        hours=F.lit(int(hours)), mins=F.lit(int(hours * 60 % 60))
    )
    return (
        _files(spark, path)
        .where(F.col("modificationTime") < cutoff)
        .select("path", file_name(F.col("path")).alias("name"), "length", "modificationTime")
    )
