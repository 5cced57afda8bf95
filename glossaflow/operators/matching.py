"""Substring search of many patterns in many texts, by their words.

A contains-join would compare every text with every pattern.  Here words and patterns meet by
equality, in one of two ways, and then the two are compared.

Patterns of one word that may stand inside others, if the dictionary has up to ``BROADCAST`` of them,
are handed to all tasks.  Each text's distinct words meet them by their four-character sequences,
patterns of six characters and more by six-character ones.  Only matches are shuffled.

For all other patterns the texts are first reduced to their distinct words, the dictionary is compared
with that vocabulary once, and only words that hold a pattern lead back to texts.  A pattern of several
words is looked up among the distinct runs of as many words, so that its length costs only where such
runs exist.  Vocabulary and patterns meet by these keys: a pattern's first four characters and the four-character
sequences of a word; for patterns of whole words their first word and the words' parts; for runs the
end of the first word.  Shorter patterns use sequences of their own length, and only if the
dictionary has any.  Texts stay in their rows: what is shuffled is the
vocabulary, and for each text the 96-bit hashes of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.functions.text import SPACES, WORD
from glossaflow.session import written

GRAM, LONG_GRAM = 4, 6
#: So many patterns of one word are handed to all tasks; more of them meet the vocabulary.
BROADCAST = 50_000
_INNER = r"(?U)\w+"


def _runs(text: Column, sizes: Column) -> Column:
    """Distinct runs of as many words as ``sizes`` says, with their inner white space."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    longer = lambda k: F.concat(
        F.lit(f"(?=({WORD}(?:{SPACES}{WORD}){{"), (k - 1).cast("string"), F.lit(f"}})){WORD}")
    )
    return F.flatten(
        F.transform(
            F.coalesce(sizes, F.array().cast("array<int>")),
            lambda k: F.transform(
                F.array_distinct(
                    F.when(k == 1, words).otherwise(F.regexp_extract_all(text, longer(k), F.lit(1)))
                ),
                lambda run: F.struct(k.alias("size"), run.alias("run")),
            ),
        )
    )


def _hash(run: Column) -> list[Column]:
    return [F.xxhash64(run).alias("_h1"), F.hash(run).alias("_h2")]


def _key(mark: str, text: Column) -> Column:
    """What stands for a piece of text in the join; what collides is told apart by the comparison."""
    return F.xxhash64(F.lit(mark), text)


def _sequences(run: Column, length: Column) -> Column:
    """The keys of the character sequences of a length."""
    starts = F.when(
        F.length(run) >= length, F.sequence(F.lit(1), F.length(run) - length + 1)
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: _key("g", F.substr(run, i, length)))


def _run_keys(size: Column, run: Column, short: Column, whole: Column) -> Column:
    """What a run can be found under."""
    none = F.array().cast("array<bigint>")
    grams = F.concat(
        _sequences(run, F.lit(GRAM)),
        F.flatten(F.transform(F.coalesce(short, F.array().cast("array<int>")), lambda n: _sequences(run, n))),
    )
    # A pattern without a letter or digit is found under the mark alone.
    parts = F.concat(F.regexp_extract_all(run, F.lit(_INNER), F.lit(0)), F.array(F.lit("")))
    inner = F.when(whole, F.transform(parts, lambda p: _key("w", p))).otherwise(none)
    first = F.regexp_extract(run, WORD, 0)
    ends = F.transform(
        F.sequence(F.lit(1), F.least(F.length(first), F.lit(GRAM))),
        lambda n: _key("e", F.right(first, n)),
    )
    return F.array_distinct(F.when(size == 1, F.concat(grams, inner)).otherwise(ends))


def _in_vocabulary(texts: DataFrame, keys: list[str], text: Column, patterns: DataFrame, pattern_id: str) -> DataFrame:
    """(keys, pattern_id) of all kinds of patterns, by the words and runs of the texts."""
    first = F.regexp_extract("pattern", WORD, 0)
    indexed = patterns.withColumn(
        "_key",
        F.when(F.col("_size") > 1, _key("e", F.right(first, F.lit(GRAM))))
        .when(F.col("whole_word"), _key("w", F.regexp_extract("pattern", _INNER, 0)))
        .otherwise(_key("g", F.substring("pattern", 1, GRAM))),
    )
    # What the dictionary asks for, as subqueries of the one plan.
    alone = (F.col("_size") == 1) & ~F.col("whole_word")
    sizes = indexed.agg(F.collect_set("_size")).scalar()
    short = indexed.agg(
        F.collect_set(F.when(alone & (F.length("pattern") < GRAM), F.length("pattern")))
    ).scalar()
    whole = indexed.agg(F.coalesce(F.bool_or("whole_word"), F.lit(False))).scalar()

    runs = (
        texts.select(*keys, text.alias("_text"), sizes.alias("_sizes"))
        .select(*keys, F.explode(_runs(F.col("_text"), F.col("_sizes"))).alias("_r"))
        .select(*keys, "_r.size", "_r.run")
    )
    vocabulary = runs.select("size", "run").distinct()
    run_keys = _run_keys(F.col("size"), F.col("run"), F.col("_short"), F.col("_whole"))
    listed = vocabulary.select("size", "run", short.alias("_short"), whole.alias("_whole")).select(
        "size", "run", F.explode(run_keys).alias("_key")
    )
    bounded = F.concat(
        F.lit(r"(?U)\b\Q"), F.replace("pattern", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b")
    )
    holds = (
        listed.join(indexed, "_key")
        .where(
            (F.col("size") == F.col("_size"))
            & F.contains("run", "pattern")
            & (~F.col("whole_word") | F.rlike("run", bounded))
        )
        .select(*_hash(F.col("run")), pattern_id)
        .distinct()
    )
    return (
        runs.select(*keys, *_hash(F.col("run")))
        .join(holds, ["_h1", "_h2"])
        .select(*keys, pattern_id)
    )


def _in_words(texts: DataFrame, keys: list[str], text: Column, patterns: DataFrame, pattern_id: str) -> DataFrame:
    """(keys, pattern_id) of patterns that stand inside a word; the patterns go to all tasks."""
    key = lambda run, start, length: F.xxhash64(F.substr(run, start, length))
    size = lambda long: F.when(long, F.lit(LONG_GRAM)).otherwise(F.lit(GRAM))
    listed = patterns.select(
        pattern_id, "pattern", key(F.col("pattern"), F.lit(1), size(F.length("pattern") >= LONG_GRAM)).alias("_key")
    )
    words = (
        texts.select(*keys, F.explode(F.array_distinct(F.split(text, SPACES))).alias("run"))
        .withColumn("_length", F.length("run"))
        .where(F.col("_length") >= GRAM)
    )
    # Where a sequence starts; below zero for the long ones.
    longer = F.when(
        F.col("_length") >= LONG_GRAM, F.sequence(F.lit(-1), F.lit(LONG_GRAM - 1) - F.col("_length"), F.lit(-1))
    ).otherwise(F.array().cast("array<int>"))
    starts = F.concat(F.sequence(F.lit(1), F.col("_length") - (GRAM - 1)), longer)
    return (
        words.select(*keys, "run", F.explode(starts).alias("_at"))
        .select(*keys, "run", key(F.col("run"), F.abs("_at"), size(F.col("_at") < 0)).alias("_key"))
        .join(F.broadcast(listed), "_key")
        .where(F.contains("run", "pattern"))
        .select(*keys, pattern_id)
    )


def find_patterns(
    texts: DataFrame, keys: list[str], text: Column, patterns: DataFrame, pattern_id: str
) -> DataFrame:
    """Distinct (keys, pattern_id) where the text contains the pattern.

    ``patterns`` has ``pattern_id``, ``pattern`` (no outer white space, not empty) and
    ``whole_word``, which asks for word boundaries on both sides.
    """
    # Patterns are used several times and are few; written, they are made once.
    listed = written(patterns.select(
        pattern_id, "pattern", "whole_word", F.size(F.split("pattern", SPACES)).alias("_size")
    ), "patterns")
    inside = F.coalesce((F.col("_size") == 1) & ~F.col("whole_word") & (F.length("pattern") >= GRAM), F.lit(False))
    counted = listed.agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("others")).first()
    if not 0 < counted["inside"] <= BROADCAST:
        return _in_vocabulary(texts, keys, text, listed, pattern_id).distinct()
    found = _in_words(texts, keys, text, listed.where(inside), pattern_id)
    if counted["others"]:
        found = found.unionByName(_in_vocabulary(texts, keys, text, listed.where(~inside), pattern_id))
    return found.distinct()
