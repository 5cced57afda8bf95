"""Edit distances block by block, against plain dynamic programming."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaflow.operators import edits, memory


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        after = [i]
        for j, y in enumerate(b, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y)))
        row = after
    return row[-1]


def changed(text, share, r):
    letters = list(text)
    for _ in range(int(len(text) * share)):
        k = r.randrange(len(letters))
        letters[k : k + 1] = r.choice(([], ["x"], [letters[k], "é"]))
        letters = letters or ["x"]
    return "".join(letters)


def wanted(left, right, threshold):
    found = {}
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            n, d = max(len(a), len(b)), plain_edits(a, b)
            if d <= math.floor(n * (1 - threshold) + 1e-9):
                found[i, j] = d
    return found


@pytest.mark.parametrize("threshold", [0.3, 0.72, 0.9, 1.0])
def test_close_pairs_equal_dynamic_programming(threshold):
    r = random.Random(7)
    left = ["".join(r.choice("abcé漢😀 ") for _ in range(n)) for n in (1, 2, 9, 63, 64, 65, 127, 128, 129, 200)]
    right = left + [changed(t, s, r) for t in left for s in (0.05, 0.2, 0.28, 0.4)]
    i, j, d = edits.close_pairs(left, right, threshold)
    assert dict(zip(zip(i.tolist(), j.tolist()), d.tolist())) == wanted(left, right, threshold)


def test_long_texts_are_left_undecided():
    i, j, d = edits.close_pairs(["ab" * 1500], ["ab" * 1500, "xy" * 1500, "ab"], 0.72)
    assert (i.tolist(), j.tolist(), d.tolist()) == ([0], [0], [edits.UNDECIDED])


def test_blocks_of_one_length_lose_no_pair(spark, monkeypatch):
    """Many small blocks of few lengths; a text beyond the limit of the blocks is compared too."""
    monkeypatch.setattr(memory, "BLOCK_TEXTS", 4)
    r = random.Random(3)
    left = ["".join(r.choice("ab c") for _ in range(n)).strip() + "z" for n in [40] * 10 + [120] * 6] + ["ab c" * 700]
    right = [changed(t, s, r).strip() or "x" for t in left for s in (0.03, 0.2)]
    forms = lambda rows, key: spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(rows)], f"{key} long, form string, n int")
    found = memory._by_blocks(forms(left, "source_hash"), forms(right, "id"), 0.72).collect()
    got = {(x["source_hash"], x["id"]): x["_edits"] for x in found}
    short = {k: v for k, v in wanted(left[:-1], right[:-2], 0.72).items()}
    assert {k: v for k, v in got.items() if v != edits.UNDECIDED} == short
    assert {k for k, v in got.items() if v == edits.UNDECIDED} == {(16, 32), (16, 33)}
    tm = spark.createDataFrame([(k, t, t) for k, t in enumerate(right)], "id long, source_text string, target_text string")
    tm = tm.withColumns({"source_hash": F.sha2("source_text", 256), "target_language": F.lit("ar"), "approved": F.lit(True)})
    texts = spark.createDataFrame([(16, left[-1])], "k long, text string")
    similar = memory.tm_fuzzy(texts, ["k"], "text", tm).collect()
    assert sorted((x["id"], x["rank"]) for x in similar) == [(32, 1), (33, 2)]


def test_pairs_that_are_put_off_are_compared_too(monkeypatch):
    """Small batches whose last pairs are put off, several words a pair, lengths of all kinds on both sides."""
    for name, value in (("SIDE_BY_SIDE", 32), ("RUN", 4), ("FEW", 3), ("REPEATS", 2)):
        monkeypatch.setattr(edits, name, value)
    r = random.Random(11)
    left = ["".join(r.choice("abc dé") for _ in range(r.choice((3, 40, 70, 180, 260)))) for _ in range(24)]
    right = [changed(t, s, r) for t in left for s in (0.0, 0.1, 0.25)]
    for a, b in ((left, right), (right, left)):
        i, j, d = edits.close_pairs(a, b, 0.72)
        assert dict(zip(zip(i.tolist(), j.tolist()), d.tolist())) == wanted(a, b, 0.72) and len(i) == len(set(zip(i.tolist(), j.tolist())))


def test_bins_hold_no_more_lengths_than_they_must(spark, monkeypatch):
    """Where there are many texts, those of a block differ by few characters, so that few diagonals are compared."""
    monkeypatch.setattr(memory, "BLOCK_TEXTS", 10)
    rows = [(k, "x" * n, n) for k, n in enumerate([200 + n for n in range(10) for _ in range(10)] + [300] * 35 + [39, 40])]
    forms, bins = memory._binned(spark.createDataFrame(rows, "id long, form string, n int"))
    found = sorted((b["lo"], b["hi"], b["blocks"]) for b in bins.collect())
    assert found == [(39, 40, 1), *[(n, n, 1) for n in range(200, 210)], (300, 300, 4)]
    assert forms.groupBy("bin").count().count() == len(found) and forms.count() == len(rows)


def test_unlike_texts_end_before_their_last_character(monkeypatch):
    """Texts of one length and alphabet that are not alike: one word a pair, and fewer steps than they have characters."""
    taken = []

    class Counted:
        def __getattr__(self, name):
            return getattr(np, name)

        def take(self, *args, **kind):
            taken.append(1)
            return np.take(*args, **kind)

    monkeypatch.setattr(edits, "np", Counted())
    r = random.Random(2)
    left, right = (["".join(r.choice("abcde ") for _ in range(220)) for _ in range(40)] for _ in range(2))
    assert len(edits.close_pairs(left, right, 0.72)[0]) == 0
    # Two a step: a letter of the text, and where the pattern has it.
    assert 0 < len(taken) < 2 * 220
