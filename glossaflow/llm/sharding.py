"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

The number of rows that partition i sends to shard j is drawn at once for all i and j, from the
distribution that a uniform shuffle of all rows would give.  Then each partition permutes its rows
and deals them out by its row of the matrix, rows are exchanged, and each shard permutes again to
give its rows their slots.  Shard sizes are exact: they differ by one at most.

The local permutation needs only a row's place, so columns stay where they are; the driver holds
one number for each partition and shard.  Within a shard, rows are dealt into small blocks by hash
and numbered there, so that a shard is never sorted as a whole.

``docs`` must be a plan whose partitions are the same each time it runs, such as a scan of files; a
task that meets other row counts than were drawn for stops the job.

Defined results: nulls, repeated rows and equal texts are rows like any other.  With fewer rows than
shards some shards stay empty.  An empty table gives an empty table.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaflow.llm.common import cut

SEED = 5
#: Rows of a block of slots.
BLOCK_ROWS = 1 << 14
_NUMPY_LIMIT = 10**9


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` draws without replacement from good + bad are good."""
    if max(good, bad) < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    total = good + bad
    low, high = max(0, sample - bad), min(sample, good)
    mean = sample * good / total
    wide = 40 + 12 * math.sqrt(max(mean * (bad / total) * (total - sample) / max(total - 1, 1), 0))
    k = np.arange(max(low, math.floor(mean - wide)), min(high, math.ceil(mean + wide)) + 1)
    # Ratios of neighbouring probabilities, added up as logarithms.
    steps = np.log(
        (good - k[:-1]) * (sample - k[:-1]) / ((k[:-1] + 1.0) * (bad - sample + k[:-1] + 1.0))
    )
    weight = np.concatenate(([0.0], np.cumsum(steps)))
    weight = np.exp(weight - weight.max())
    return int(k[np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), side="right")])


def matrix(rows: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Counts by partition and shard with the given row sums and near-equal column sums."""
    total, rng = sum(rows), np.random.default_rng(seed)
    left = np.array([total // shards + (j < total % shards) for j in range(shards)], np.int64)
    drawn = np.zeros((len(rows), shards), np.int64)
    for i, n in enumerate(rows):
        rest = int(left.sum())
        for j in range(shards):
            rest -= int(left[j])
            drawn[i, j] = _hypergeometric(rng, int(left[j]), rest, n) if n else 0
            n -= int(drawn[i, j])
        left -= drawn[i]
    return drawn


@lru_cache(maxsize=2)
def _dealt(seed: int, part: int, counts: tuple[int, ...]) -> np.ndarray:
    """The shard of each place of a partition."""
    shards = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    return np.random.default_rng([seed, part]).permutation(shards)


def shards_of(counts: dict[int, tuple[int, ...]], seed: int):
    """Function of partition and place that gives the shard."""

    @F.arrow_udf(T.IntegerType())
    def shard(part: pa.Array, place: pa.Array) -> pa.Array:
        parts, places = part.to_numpy(zero_copy_only=False), place.to_numpy(zero_copy_only=False)
        out = np.empty(len(parts), np.int32)
        for p in np.unique(parts).tolist():
            own = parts == p
            out[own] = _dealt(seed, p, counts[p])[places[own]]
        return pa.array(out)

    return shard


def shuffle_into(docs: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """The rows with ``shard`` and ``slot``, which take the place of columns of that name."""
    parts = docs.select(F.spark_partition_id().alias("part")).groupBy("part").count()
    rows = {r["part"]: r["count"] for r in parts.collect()}
    order = sorted(rows)
    drawn = matrix([rows[p] for p in order], shards, seed)
    counts = {p: tuple(drawn[i].tolist()) for i, p in enumerate(order)}
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = (
        docs.drop("shard", "slot")
        .select(F.struct("*").alias("_row"), F.spark_partition_id().alias("_part"), place.alias("_place"))
        .withColumn("shard", shards_of(counts, seed)("_part", "_place"))
    )
    at = [F.col("_part"), F.col("_place")]
    blocks = max(1, -(-sum(rows.values()) // (shards * BLOCK_ROWS)))
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), *at), F.lit(blocks)))
    sizes = cut(dealt.groupBy("shard", "_block").count(), "blocks")
    met = {r["shard"]: r["n"] for r in sizes.groupBy("shard").agg(F.sum("count").alias("n")).collect()}
    if any(met.get(j, 0) != n for j, n in enumerate(drawn.sum(axis=0).tolist())):
        raise RuntimeError("the partitions of the documents differ between two runs; write them first")
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_block").orderBy(F.xxhash64(F.lit(seed), F.lit("slot"), *at), *at)
    return (
        dealt.withColumn("_rank", F.row_number().over(within) - 1)
        .join(starts, ["shard", "_block"])
        .select("_row.*", "shard", (F.col("_start") + F.col("_rank")).cast("bigint").alias("slot"))
    )


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
