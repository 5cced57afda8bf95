"""MinHash near-duplicates by an inverted join over signature coordinates.

A text is the set of its distinct word shingles.  Its signature has one least hash value for each of
``COORDINATES`` hash functions.  Two sets of Jaccard similarity J agree in a coordinate with
probability J, so a pair at the threshold agrees in fewer than ``MATCHES`` coordinates with
probability below 4e-8 (of 40 coordinates at 0.8, 32 are expected and 17 are asked for).

Each coordinate-value pair is a posting list of the texts that have it.  Values that one text alone
has make no pair.  What is left of a signature is ordered from rare to common, and a text is posted
under its rarest values only, so many that two texts with ``MATCHES`` equal coordinates meet in a
list for certain (prefix).  Texts with fewer shared values than ``MATCHES`` are posted nowhere.

Lists are merged by leaders, not by all pairs:

1. Each list's leader is the text whose values are the most common.  Every other text of the list is
   compared with it, once for all lists that have the two.  Links make first components.
2. A list whose texts are all in one component is skipped.  In the rest, texts outside their leader's
   component meet texts of other components: in lists of up to ``SHORT`` texts all of the list's, in
   longer ones by their full sets, as two linked sets have one of their rarest members in common, and
   the place of the first bounds how many they share.

A met pair's equal coordinates are counted over the whole signatures (lists beyond the prefix are
probed, not merged); pairs with ``MATCHES`` or more are confirmed on full sets of 64-bit hashes.
Within a component no further links are sought, as they change nothing; so copies and near copies of
one text cost a comparison each, whatever their number.  Between components every link counts and
none is lost.  Texts with equal sets are one class from the start.

Work that stays: texts of long lists that share their rarest members as well are compared in pairs.

Defined results: null texts and texts without words have an empty set, are linked with nothing and
kept.  A text of fewer words than a shingle is one shingle.  A null number counts as none when the
smallest of a component is taken, and a component without a number has none.  Repeated rows are
copies like any other.  Long texts are hashed in blocks.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaflow.llm.common import cut
from glossaflow.llm.simhash import components

SEED, WORDS, PERCENT = 42, 2, 80
COORDINATES, MATCHES = 40, 17
#: In lists up to this length, those that are left meet in pairs.
SHORT = 16
_BLOCK = 1 << 12

_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of so many words."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in found), np.uint64, len(found))
    length = min(words, len(found))
    n = len(found) - length + 1
    value = np.full(n, length, np.uint64)
    for k in range(length):
        value = _mixed(value + hashes[k : k + n])
    return np.unique(value)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function, its upper 32 bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), _BLOCK):
        values = hashes[k : k + _BLOCK, None] * _FACTORS + _SHIFTS
        np.minimum(least, values.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


_SKETCH = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("signature", T.ArrayType(T.IntegerType())),
    ]
)


def sketch(text: Column, words: int = WORDS) -> Column:
    """Of a whole text: the size of its set, a key of the set, and its signature."""

    @F.arrow_udf(_SKETCH)
    def of(texts: pa.Array) -> pa.Array:
        sizes, keys, signs = [], [], []
        for x in texts:
            found = shingles(x.as_py(), words)
            sizes.append(len(found))
            keys.append(xxhash.xxh3_128_hexdigest(found.tobytes()) if len(found) else None)
            signs.append(signature(found) if len(found) else None)
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.array(signs, pa.list_(pa.int32()))],
            ["n", "key", "signature"],
        )

    return of(text.cast("binary"))


def whole_set(text: Column, words: int = WORDS) -> Column:
    """All of a text's shingles, as 64-bit hashes."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(x.as_py(), words).view(np.int64) for x in texts], pa.list_(pa.int64()))

    return of(text.cast("binary"))


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2")]


def posted(classes: DataFrame) -> DataFrame:
    """Classes that can have a partner, with ``values`` from rare to common and their ``weight``.

    The weight is the number of texts that have
    the class's values, each value counted: it is large in the middle of a large group.
    """
    values = classes.select("row", F.posexplode("signature").alias("k", "v")).select(
        "row", F.xxhash64("k", "v").alias("value")
    )
    shared = cut(values.groupBy("value").agg(F.count("*").alias("held")).where("held > 1"), "values")
    met = values.join(shared, "value")
    held = met.groupBy("row").agg(
        F.sum("held").alias("weight"), F.sort_array(F.collect_list(F.struct("held", "value"))).alias("values")
    )
    enough = held.where(F.size("values") >= MATCHES).withColumn("values", F.col("values.value"))
    return enough.join(classes.drop("signature"), "row")


def _alike_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


#: Spark's own Bloom filter for a shuffled join with a table of any size, of 4 MB at most.
_BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10GB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "33554432",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "33554432",
}


@contextmanager
def _filtered_joins(spark: SparkSession) -> Iterator[None]:
    """Shuffled joins drop rows without a partner before they move, if the other side is filtered."""
    before = {k: spark.conf.get(k, None) for k in _BLOOM}
    try:
        for k, v in _BLOOM.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def texts_of(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """The text of each wanted row (``row``, ``t1``, ``t2``).  Of the other texts few are shuffled.

    The condition holds for all rows; Spark makes a Bloom filter of a side only if it is filtered.
    Rows and text keys go together, so copies of a text are dropped where the join has brought them.
    """
    return (
        texts.select("text", *_text_key(F.col("text")))
        .join(wanted.where("row >= 0"), ["t1", "t2"])
        .dropDuplicates(["row", "t1", "t2"])
        .select("row", "text")
    )


def whole_sets(rows: DataFrame, candidates: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The whole sets of these rows; only their texts are read again."""
    wanted = cut(candidates.join(rows, "row", "leftsemi").select("row", "t1", "t2"), "wanted")
    with _filtered_joins(texts.sparkSession):
        return cut(
            texts_of(wanted, texts).select("row", whole_set(F.col("text"), words).alias("hashes")), "sets"
        )


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """The rarest members of each set (``row``, ``n``, ``member``, ``place``) that others have too.

    Sets are ordered from rare to common.  A set of n shares ``percent`` of n with whatever it is
    linked to, so the two have a member in common among the first n - share + 1 of each.  Members
    that one set alone has count as the first and are left out.  ``place`` is the number of members
    before this one.
    """
    members = sets.select("row", F.explode("hashes").alias("member"))
    shared = members.groupBy("member").agg(F.count("*").alias("held")).where("held > 1")
    ordered = (
        members.join(shared, "member")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("held", "member"))).alias("members"))
        .join(sets.select("row", F.size("hashes").alias("n")), "row")
        .withColumn("own", F.col("n") - F.size("members"))
    )
    length = F.floor(F.col("n") * (100 - percent) / 100).cast("int") + 1 - F.col("own")
    return ordered.where(length > 0).select(
        "row", "n", "own", F.posexplode(F.slice("members.member", F.lit(1), length)).alias("at", "member")
    ).select("row", "n", (F.col("own") + F.col("at")).alias("place"), "member")


def met(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different ``root`` that may be similar; u is ``outer``, and of two such the lesser.

    At the first member that two sets share, what is left of the shorter end bounds what they share.
    """
    v = prefixes.select(F.col("row").alias("v"), "n", "root", "outer", "place", "member")
    u = prefixes.where("outer").select(
        F.col("row").alias("u"),
        F.col("n").alias("m"),
        F.col("root").alias("r"),
        F.col("place").alias("at"),
        "member",
    )
    most = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at"))
    return (
        v.join(u, "member")
        .where(
            (F.col("root") != F.col("r"))
            & (F.col("outer").isNull() | (F.col("u") < F.col("v")))
            & _alike_sizes(F.col("n"), F.col("m"), percent)
            & (most * (100 + percent) >= (F.col("n") + F.col("m")) * percent)
        )
        .select("u", "v")
        .distinct()
    )


def confirmed(pairs: DataFrame, candidates: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v) that agree in enough coordinates and are similar on full sets.

    Only texts of pairs that pass the count are read again for their sets.  Few texts are ``u`` in
    many pairs (leaders), so their sets are looked up last: Spark broadcasts what is small, and else
    shuffles.
    """
    values = candidates.select("row", "values")
    v = values.select(F.col("row").alias("v"), F.col("values").alias("b"))
    u = values.select(F.col("row").alias("u"), F.col("values").alias("a"))
    agree = F.size(F.array_intersect("a", "b")) >= MATCHES
    counted = cut(pairs.join(v, "v").join(u, "u").where(agree).select("u", "v"), "counted")
    rows = counted.select(F.col("u").alias("row")).unionByName(counted.select(F.col("v").alias("row"))).distinct()
    sets = whole_sets(rows, candidates, texts, words)
    leaders = cut(
        sets.join(counted.select(F.col("u").alias("row")).distinct(), "row", "leftsemi"), "leaders"
    )
    v = sets.select(F.col("row").alias("v"), F.col("hashes").alias("y"))
    u = leaders.select(F.col("row").alias("u"), F.col("hashes").alias("x"))
    common = F.size(F.array_intersect("x", "y"))
    return (
        counted.join(v, "v")
        .join(u, "u")
        .where(common * (100 + percent) >= (F.size("x") + F.size("y")) * percent)
        .select("u", "v")
    )


def links(classes: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Edges (u, v) between classes that span all links.

    ``classes`` has ``row``, ``n``, ``signature`` and the hashes ``t1``, ``t2`` of one text of the
    class; ``texts`` has ``text``.
    """
    candidates = cut(posted(classes), "posted")
    # The first size - MATCHES + 1 values: two texts with MATCHES in common share one of them.
    rarest = F.slice("values", 1, F.size("values") - MATCHES + 1)
    lists = cut(candidates.select("row", "n", "weight", F.explode(rarest).alias("value")), "lists")
    best = F.max(F.struct("weight", "row", "n"))
    leaders = cut(
        lists.groupBy("value")
        .agg(best.alias("best"), F.count("*").alias("size"))
        .where("size > 1")
        .select("value", "size", F.col("best.row").alias("u"), F.col("best.n").alias("m")),
        "leaders",
    )
    led = (
        lists.join(leaders, "value")
        .where((F.col("row") != F.col("u")) & _alike_sizes(F.col("n"), F.col("m"), percent))
        .select("u", F.col("row").alias("v"))
        .distinct()
    )
    first = cut(confirmed(cut(led, "led"), candidates, texts, words, percent), "links")
    roots = components(first).withColumnRenamed("node", "row")
    placed = cut(
        lists.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")), "placed"
    )
    # Lists of one component are skipped.
    homes = leaders.join(roots.withColumnRenamed("row", "u"), "u", "left").select(
        "value", "size", F.col("u").alias("leader"), F.coalesce("root", "u").alias("home")
    )
    outside = (
        placed.join(homes, "value")
        .where((F.col("root") != F.col("home")) & (F.col("row") != F.col("leader")))
        .select(
            "value", "size", F.col("row").alias("u"), F.col("n").alias("m"), F.col("root").alias("r"), "leader", "home"
        )
    )
    outside = cut(outside, "outside")
    # The leader was met already; two texts outside meet once.
    short = (
        placed.join(outside.where(F.col("size") <= SHORT), "value")
        .where(
            (F.col("row") != F.col("leader"))
            & (F.col("root") != F.col("r"))
            & ((F.col("root") == F.col("home")) | (F.col("u") < F.col("row")))
            & _alike_sizes(F.col("n"), F.col("m"), percent)
        )
        .select("u", F.col("row").alias("v"))
        .distinct()
    )
    # In long lists the sets decide who meets.
    long = outside.where(F.col("size") > SHORT)
    outer = long.select(F.col("u").alias("row")).distinct().withColumn("outer", F.lit(True))
    parties = cut(
        placed.join(long.select("value").distinct(), "value", "leftsemi")
        .select("row", "root")
        .distinct()
        .join(outer, "row", "left"),
        "parties",
    )
    sets = whole_sets(parties.select("row"), candidates, texts, words)
    left = short.unionByName(met(cut(prefixes(sets, percent).join(parties, "row"), "prefixes"), percent)).distinct()
    return first.unionByName(confirmed(cut(left, "left"), candidates, texts, words, percent))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """A row for each row of ``docs``: its number, ``n_shingles``, ``component_id`` and ``kept``."""
    rows = cut(
        docs.select(F.col(doc_id).alias("id"), *_text_key(F.col(text)), sketch(F.col(text), words).alias("s")).select(
            F.monotonically_increasing_id().alias("row"), "id", "t1", "t2", "s.*"
        ),
        "sketches",
    )
    classes = cut(
        rows.where("n > 0").groupBy("key").agg(F.min("row").alias("row"), F.min("id").alias("first")), "classes"
    )
    sets = rows.join(classes.select("row"), "row", "leftsemi").select("row", "n", "t1", "t2", "signature")
    found = links(sets, docs.select(F.col(text).alias("text")), words, percent)
    joined = components(found).withColumnRenamed("node", "row")
    # Roots are no nodes of their own.
    nodes = cut(joined.unionByName(joined.select(F.col("root").alias("row"), "root").distinct()), "nodes")
    placed = cut(classes.join(nodes, "row", "left").select("key", "first", "root"), "placed")
    # A class that stands alone has its own first number; only the others need the join.
    linked, alone = placed.where("root IS NOT NULL"), placed.where("root IS NULL")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = cut(
        alone.select("key", F.col("first").alias("component_id")).unionByName(
            linked.join(least, "root").select("key", "component_id")
        ),
        "labels",
    )
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return rows.select("id", "n", "key").join(labels, "key", "left").select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
