"""The pipeline against a plain version of each stage, over what the stage before it kept."""

import collections
import re

import pytest
from test_llm_queries import BLANK, FOLD, components, fingerprint

import corpus_pipeline
from glossaflow.llm import queries
from glossaflow.llm.common import cut, table

FOLDER = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, found = table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, FOLDER), name)
        found.append(docs)
    return found


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_stages_keep_the_columns(stages):
    assert all(f.columns == COLUMNS for f in stages[:-1])
    assert stages[-1].columns == [*COLUMNS, "shard", "slot"]
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding",
    ]


def test_quality_keeps_what_the_query_keeps(spark, stages):
    kept = queries.op8_robust_quality(spark, FOLDER).where("kept")
    assert ids(stages[0]) == ids(kept)


def test_one_of_each_group_stays(stages):
    given = stages[0].select("doc_id", "text").collect()
    labels = components([(r["doc_id"], fingerprint(r["text"])) for r in given])
    assert ids(stages[1]) == sorted(set(labels)) and len(set(labels)) < len(given)


def test_benchmark_passages_go(spark, stages):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    windows = collections.defaultdict(set)
    for r in table(spark, FOLDER, "benchmark").collect():
        w = words(r["text"])
        windows[min(10, len(w))] |= runs(w, min(10, len(w))) if w else set()
    clean = [
        r["doc_id"] for r in stages[1].collect() if not any(runs(words(r["text"]), n) & found for n, found in windows.items() if n)
    ]
    assert ids(stages[2]) == sorted(clean) and len(clean) < stages[1].count()


def test_mixing_comes_near_its_targets(stages):
    size, taken = collections.Counter(), collections.Counter()
    for rows, count in ((stages[2].collect(), size), (stages[3].collect(), taken)):
        for r in rows:
            count[r["source"]] += len(re.findall(BLANK, r["text"] or ""))
    copies = collections.Counter(r["doc_id"] for r in stages[3].select("doc_id").collect())
    assert set(copies.values()) <= {1, 2} and set(copies) <= set(ids(stages[2]))
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.1)


def test_shards_are_exact(stages):
    rows = stages[4].collect()
    assert sorted(r["doc_id"] for r in rows) == ids(stages[3])
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 24 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_is_the_stages(spark, stages):
    again = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, again.select("doc_id", "lang").collect())) == sorted(map(str, stages[4].select("doc_id", "lang").collect()))
