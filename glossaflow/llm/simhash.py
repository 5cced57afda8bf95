"""SimHash near-duplicates by pivot distance tables.

Each text has a 64-bit fingerprint of its word shingles.  A table holds the Hamming distances of
every distinct fingerprint to many reference fingerprints (pivots).  By the triangle inequality two
fingerprints at distance r or less differ by r or less in every coordinate of the table, so pairs
with a larger difference are discarded and only survivors are compared bit by bit.

Candidate pairs come from the table by equality, not by comparing all rows.  Pivots stand in
families: a reference, and the same with one block of bits inverted.  The difference of the two
distances is the distance within that block.  Of five blocks, two fingerprints that differ in two
bits agree in three at least, and hence in all coordinates of those three.  The coordinates of each
choice of three blocks are a key, and equal keys make a candidate pair.

A key that more than ``CROWD`` fingerprints share makes no pairs.  Its fingerprints, the crowd, are
joined exactly in another way: two of them are linked if and only if they have a common fingerprint
within one bit of both, so each is listed under itself and its 64 neighbours, and all that meet
under one are joined to the smallest.  That is linear in the crowd, and no link is lost.

Defined results: null and blank texts have fingerprint zero and are linked like any other.  Equal
rows have one fingerprint.  A null number counts as none when the smallest of a group is taken.  An
empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaflow.llm.common import cut

SEED, WORDS, RADIUS = 42, 3, 2
BLOCKS = (13, 13, 13, 13, 12)
AGREE = 3
PIVOTS = 8
CROWD = 32
_CHUNK = 1 << 14


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: The references: XXH64 of their number.
REFERENCES = [xxhash.xxh64_intdigest(str(k), SEED) for k in range(PIVOTS)]
_STARTS = [sum(BLOCKS[:g]) for g in range(len(BLOCKS))]
MASKS = [((1 << n) - 1) << s for s, n in zip(_STARTS, BLOCKS)]


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Majority bits of the shingles' hashes, as an unsigned number."""
    found = text.lower().split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    firsts, lasts = starts[:n].tolist(), ends[-n:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(firsts[k : k + _CHUNK], lasts[k : k + _CHUNK])],
            "<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in range(64) if 2 * counts[i] > n)


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([_signed(fingerprint(x.as_py())) for x in texts], pa.int64())


def simhash(text: Column) -> Column:
    """The fingerprint of a whole text, as a signed number."""
    return _fingerprints(text.cast("binary"))


def fingerprint_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _bits(value: Column) -> Column:
    return F.bit_count(value)


def pivot_table(prints: DataFrame) -> DataFrame:
    """Distances to the references, and those within each block; ``prints`` has ``fp``."""
    fp = F.col("fp")
    far = [_bits(fp.bitwiseXOR(F.lit(_signed(p)))) for p in REFERENCES]
    table = prints.select("fp", F.array(*far).alias("far"))
    blocks = [
        F.array(
            *[
                (F.col("far")[k] - _bits(fp.bitwiseXOR(F.lit(_signed(p ^ MASKS[g])))) + BLOCKS[g]) / 2
                for k, p in enumerate(REFERENCES)
            ]
        ).cast("array<tinyint>")
        for g in range(len(BLOCKS))
    ]
    return table.select("fp", F.col("far").cast("array<tinyint>").alias("far"), F.array(*blocks).alias("near"))


def keyed(table: DataFrame) -> DataFrame:
    """A row for each fingerprint and choice of blocks, with the key of their coordinates."""
    keys = [
        F.xxhash64(F.lit(c), *[F.col("near")[g] for g in chosen])
        for c, chosen in enumerate(combinations(range(len(BLOCKS)), AGREE))
    ]
    return table.select("fp", "far", F.explode(F.array(*keys)).alias("key"))


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that span all links of at most two bits.

    Outside crowds every link is an edge.  Within crowds an edge may join two fingerprints through
    a third, all of them linked to it or to each other.
    """
    rows = cut(keyed(pivot_table(prints)), "keyed")
    sizes = cut(rows.groupBy("key").count().where("count > 1"), "keys")
    few = sizes.where(F.col("count") <= CROWD).select("key")
    candidates = rows.join(few, "key", "leftsemi")
    a = candidates.select("key", F.col("fp").alias("u"), F.col("far").alias("a"))
    b = candidates.select("key", F.col("fp").alias("v"), F.col("far").alias("b"))
    apart = [F.abs(F.col("a")[k] - F.col("b")[k]) for k in range(PIVOTS)]
    pairs = (
        a.join(b, "key")
        .where(
            (F.col("u") < F.col("v"))
            & (F.greatest(*apart) <= RADIUS)
            & (_bits(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)
        )
        .select("u", "v")
    )
    many = sizes.where(F.col("count") > CROWD).select("key")
    crowd = rows.join(many, "key", "leftsemi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)) for i in range(64)])
    seats = crowd.select("fp", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("fp")))).alias("seat"))
    least = seats.groupBy("seat").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    met = seats.join(least, "seat").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(met).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): a row (node, root) for each node, root the smallest.

    Alternating large-star and small-star steps, each one aggregation and one join.  A written table
    cuts the lineage after each round.
    """
    edges = cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(
            small.unionByName(least.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .where("u <> v")
            .distinct(),
            "stars",
        )
        state = tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first())
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its number, ``fp`` and ``component_id``."""
    prints = cut(docs.select(F.col(doc_id).alias("id"), simhash(F.col(text)).alias("fp")), "prints")
    firsts = cut(prints.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
    joined = components(links(firsts.select("fp")))
    roots = cut(
        firsts.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        ),
        "roots",
    )
    smallest = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    # A fingerprint that stands alone has its own first number; only others need the joins.
    linked = roots.join(joined.select("root").distinct(), "root", "leftsemi")
    merged = linked.join(smallest, "root").select("fp", "component_id")
    labels = cut(
        firsts.join(merged, "fp", "left").select(
            "fp", F.coalesce("component_id", "first").alias("component_id")
        ),
        "labels",
    )
    return prints.join(labels, "fp").select(F.col("id").alias(doc_id), "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the smallest number of their component, one row each.

    Rows without a number cannot be named as a copy of another and stay.  The list of those that go
    grows with the documents, so the two are joined by a shuffle at every size; hashing the list
    spares a sort of the texts.
    """
    found = near_duplicates(docs, doc_id, text).where(F.col(doc_id).isNotNull())
    verdicts = cut(
        found.groupBy(F.col(doc_id).alias("_id")).agg(
            F.max(F.col("component_id") == F.col(doc_id)).alias("_first"), F.count("*").alias("_n")
        ),
        "verdicts",
    )
    gone = verdicts.where("NOT _first").select("_id").hint("shuffle_hash")
    kept = docs.join(gone, F.col(doc_id) == F.col("_id"), "leftanti")
    again = verdicts.where("_first AND _n > 1").select("_id")
    if again.isEmpty():
        return kept
    repeated = kept.join(again, F.col(doc_id) == F.col("_id"), "leftsemi")
    rest = kept.join(again, F.col(doc_id) == F.col("_id"), "leftanti")
    return rest.unionByName(repeated.dropDuplicates([doc_id]))
