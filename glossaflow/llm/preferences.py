"""Chat formatting of preferences: one prompt, two masked completions.

A pair has a chosen and a rejected conversation, both as rows of turns.  The turns in which they
begin alike, the longest common prefix, are rendered once as the prompt; what follows is rendered
for each side as a completion, with the character spans that count for the loss: the texts of the
assistant's turns with their end marks.

Turns get their places first: both sides are sorted together over all tasks, by conversation and
turn, so that gaps between turn numbers, equal numbers and null numbers change nothing and no
conversation is sorted in one task.  Conversations then come in parts of ``PART`` places.  Each part
is gathered and rendered on its own, both sides in one grouping, so that a conversation may be
longer than a row; a pair has as many rows as its longer side has parts, nearly always one.  Whether
the prefix reaches into a part is a join of one row a pair.

Defined results: turns are ordered by number, then role, then text; null numbers come first, null
roles and texts are empty.  Rows without a conversation are left out, as no pair can name them.
Repeated turns are turns.  Other columns, whatever their names, are not read.  A text is whole in its
turn, however long; a part holds ``PART`` turns, so these together must fit a row.  A side that is
missing has no turns, so the prompt is empty.  If both sides are equal, all is prompt and both
completions are empty.  An empty table gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.llm.common import numbered

PART = 256
START, END = "<|{role}|>\n", "<|end|>\n"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(END))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """Spans of the assistant's texts and end marks in the rendered turns, as start:end."""

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(turn["role"]) + 5
        end = state["at"] + F.length(_rendered(turn))
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        spans = F.when(turn["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, empty, step, lambda state: F.array_join(state["spans"], ","))


def _placed(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Turns of both sides with their place in the conversation, from 0 without gaps."""
    columns = [
        "pair_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ]
    sides = [f.where(F.col("pair_id").isNotNull()).select(F.lit(k).alias("side"), *columns) for k, f in enumerate((chosen, rejected))]
    order = [F.col(c) for c in ("pair_id", "side", "turn", "role", "text")]
    turns = numbered(sides[0].unionByName(sides[1]), order, "number")
    starts = turns.groupBy("pair_id", "side").agg(F.min("number").alias("start"))
    return turns.join(starts, ["pair_id", "side"]).withColumn("place", F.col("number") - F.col("start"))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """A row for each pair and part: pair_id, part, n_prompt_turns, prompt, chosen, rejected and
    the masks of the completions.  Both inputs have pair_id, turn, role and text.
    """
    turn = F.struct("place", "role", "text")
    of = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, turn)))
    both = (
        _placed(chosen, rejected)
        .groupBy("pair_id", F.floor(F.col("place") / PART).cast("bigint").alias("part"))
        .agg(of(0).alias("c"), of(1).alias("r"))
    )
    same = lambda i: (F.get("c", i)["role"] == F.get("r", i)["role"]) & (
        F.get("c", i)["text"] == F.get("r", i)["text"]
    )
    shorter = F.least(F.size("c"), F.size("r"))
    places = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    differs = F.filter(places, lambda i: ~F.coalesce(same(i), F.lit(False)))
    both = both.withColumn("alike", F.coalesce(F.get(differs, F.lit(0)), shorter))
    broken = both.where((F.col("alike") < F.size("c")) | (F.col("alike") < F.size("r")))
    first = broken.groupBy("pair_id").agg(F.min("part").alias("broken"))
    n = F.when(F.col("broken").isNull() | (F.col("part") <= F.col("broken")), F.col("alike")).otherwise(0)
    cut_at = both.join(first, "pair_id", "left").withColumn("n", n)
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side), F.lit(1)))
    return cut_at.select(
        "pair_id",
        "part",
        F.col("n").alias("n_prompt_turns"),
        _joined(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        rest("c").alias("c"),
        rest("r").alias("r"),
    ).select(
        "pair_id",
        "part",
        "n_prompt_turns",
        "prompt",
        _joined(F.col("c")).alias("chosen"),
        _mask(F.col("c")).alias("chosen_mask"),
        _joined(F.col("r")).alias("rejected"),
        _mask(F.col("r")).alias("rejected_mask"),
    )
