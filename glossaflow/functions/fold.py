"""Small helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices_at(items: Column, starts: Column) -> Column:
    """Cut an array into consecutive slices that begin at the given zero-based positions."""
    return F.transform(
        starts,
        lambda start, k: F.slice(
            items, start + 1, F.coalesce(F.get(starts, k + 1), F.size(items)) - start
        ),
    )


def greedy_starts(
    items: Column,
    size: Callable[[Column], Column],
    room: int,
    decide: Callable[[Column], Column] | None = None,
) -> Column:
    """Start positions of groups that are filled in order while their sizes add up to ``room``.

    ``decide`` is the size that decides whether an item still fits, where that is not its own.
    """
    decide = decide or size
    int_ = lambda v: F.lit(v).cast("int")

    def step(state: Column, item: Column) -> Column:
        fresh = (state["at"] == 0) | (state["used"] + decide(item) > room)
        return F.struct(
            (state["at"] + 1).alias("at"),
            (F.when(fresh, int_(0)).otherwise(state["used"]) + size(item)).alias("used"),
            F.when(fresh, F.concat(state["starts"], F.array(state["at"])))
            .otherwise(state["starts"])
            .alias("starts"),
        )

    empty = F.struct(
        int_(0).alias("at"),
        int_(0).alias("used"),
        F.array().cast("array<int>").alias("starts"),
    )
    return F.aggregate(items, empty, step, lambda state: state["starts"])
