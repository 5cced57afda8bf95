"""Jobs and state changes."""

import datetime

import pytest
from pyspark.sql import functions as F

from glossaflow.operators import jobs

CHUNKS = "job_id string, chunk_index int, status string, chapter string, section string, error_message string, ts timestamp"


def at(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def chunks_of(spark, *rows):
    return spark.createDataFrame([(j, i, s, f"c{i}", f"s{i}", None, at(i)) for j, i, s in rows], CHUNKS)


def jobs_of(spark, *rows):
    full = [(i, d, s, at(n), at(n) if s == "completed" else None, None) for n, (i, d, s) in enumerate(rows)]
    return spark.createDataFrame(full, "id string, document_id string, status string, updated_at timestamp, completed_at timestamp, error_message string")


def test_progress(spark):
    chunks = chunks_of(
        spark, *[("a", i, "completed") for i in range(4)], ("a", 4, "failed"), ("a", 6, "translating"), ("a", 5, "translating"),
        ("b", 0, "pending"),
    )
    found = {r.job_id: r for r in jobs.job_progress(chunks, time="ts").collect()}
    a, b = found["a"], found["b"]
    assert (a.total_chunks, a.completed_chunks, a.failed_chunks, a.progress_percentage) == (7, 4, 1, 71.4)
    assert (a.current_chunk_index, a.current_chapter, a.current_section) == (5, "c5", "s5")
    assert a.eta_seconds == 3.0
    assert (b.progress_percentage, b.eta_seconds, b.current_chunk_index) == (0.0, None, None)


def test_half_even(value):
    assert value(jobs.progress_percentage(F.lit(1), F.lit(16))) == 6.2
    assert value(jobs.progress_percentage(F.lit(3), F.lit(16))) == 18.8
    assert value(jobs.progress_percentage(F.lit(0), F.lit(0))) == 0.0


def states(frame):
    return {(r.job_id, r.chunk_index): r.status for r in frame.collect()}


def test_transitions(spark):
    all_jobs = jobs_of(spark, ("run", "d1", "translating"), ("stop", "d2", "paused"), ("bad", "d3", "failed"), ("done", "d4", "completed"), ("off", "d5", "cancelled"))
    chunks = chunks_of(spark, *[(j, i, s) for j in ("run", "stop", "bad", "done") for i, s in enumerate(("translating", "failed", "completed", "pending"))])
    apply = lambda action, ids=None: jobs.transition(
        all_jobs, chunks, action, None if ids is None else spark.createDataFrame([(i,) for i in ids], "id string")
    )
    status = lambda frame: {r.id: r.status for r in frame.collect()}
    recovered, same = apply("recover")
    assert status(recovered) == {"run": "paused", "stop": "paused", "bad": "failed", "done": "completed", "off": "cancelled"}
    assert states(same) == states(chunks)
    resumed, back = apply("resume", ["stop", "done", "off"])
    assert status(resumed) == {"run": "translating", "stop": "queued", "bad": "failed", "done": "completed", "off": "queued"}
    assert states(back)[("stop", 0)] == "pending" and states(back)[("stop", 1)] == "failed"
    assert states(back)[("done", 0)] == "translating"
    retried, back = apply("retry_failed", ["bad"])
    assert status(retried)["bad"] == "queued"
    assert [states(back)[("bad", i)] for i in range(4)] == ["pending", "pending", "completed", "pending"]
    assert states(back)[("stop", 1)] == "failed"
    cancelled, _ = apply("cancel")
    ended = {r.id: r.completed_at for r in jobs.transition(all_jobs, chunks, "cancel", now=F.lit(at(99)))[0].collect()}
    assert ended["run"] == at(99) and ended["done"] == at(3)
    assert status(cancelled) == {"run": "cancelled", "stop": "cancelled", "bad": "cancelled", "done": "completed", "off": "cancelled"}


def test_claim_and_open_work(spark):
    all_jobs = jobs_of(spark, ("old", "d", "translating"), ("idle", "d", "paused"), ("new", "d", "translating"))
    chunks = chunks_of(spark, ("new", 0, "pending"), ("old", 11, "pending"), ("old", 2, "pending"), ("old", 1, "completed"), ("idle", 0, "pending"), ("new", 1, "translating"))
    found = jobs.claim_batch(chunks, all_jobs, 3).select("job_id", "chunk_index").collect()
    assert [tuple(r) for r in found] == [("old", 2), ("old", 11), ("new", 0)]
    assert jobs.open_work(chunks, all_jobs).first()[:] == (2, 4)


def test_admission(spark, rows):
    all_jobs = jobs_of(spark, ("j1", "open", "paused"), ("j2", "closed", "completed"))
    requests = spark.createDataFrame([("open",), ("closed",), ("fresh",), ("fresh",)], "document_id string")
    assert rows(jobs.admit_jobs(requests, all_jobs)) == [("closed", None, True), ("fresh", None, True), ("open", "j1", False)]
    assert rows(jobs.latest_completed(all_jobs)) == [("closed", "j2")]


def test_outcome_and_restart(spark, rows):
    results = spark.createDataFrame(
        [("a", 0, "completed", False, None), ("b", 0, "failed", False, "x"), ("c", 0, "failed", True, "no access")],
        "job_id string, chunk_index int, status string, fatal boolean, error_message string",
    )
    assert rows(jobs.job_outcome(results)) == [("a", "assembling", None), ("b", "failed", None), ("c", "failed", "no access")]
    chunks = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "job_id string, chunk_index int")
    assert rows(jobs.unfinished(chunks, results)) == [("a", 1), ("b", 0)]


@pytest.mark.parametrize("limit, offset, expected", [(2, 0, ["j3", "j2"]), (5, 2, ["j1", "j0"])])
def test_paging(spark, limit, offset, expected):
    all_jobs = jobs_of(spark, *[(f"j{i}", "d", "paused") for i in range(4)])
    documents = spark.createDataFrame([("d", "name.pdf")], "id string, original_filename string")
    found = jobs.list_jobs(all_jobs, documents, limit=limit, offset=offset).orderBy(F.col("updated_at").desc()).collect()
    assert [r.id for r in found] == expected
    assert {r.total for r in found} == {4} and {r.document_name for r in found} == {"name.pdf"}


def test_retranslation_starts_anew(spark, rows):
    all_jobs = jobs_of(spark, ("j", "d", "completed"), ("k", "d", "paused"))
    chunks = spark.createDataFrame(
        [("j", 0, "completed", "old", 2, 9, 9, None), ("j", 1, "pending", "half", 1, 3, 0, "x"), ("k", 0, "completed", "kept", 1, 1, 1, None)],
        "job_id string, chunk_index int, status string, translation string, attempts int, prompt_tokens_used long,"
        " completion_tokens_used long, error_message string",
    )
    only = spark.createDataFrame([("j",)], "id string")
    _, after = jobs.transition(all_jobs, chunks, "retranslate", only)
    assert rows(after.select("job_id", "chunk_index", "status", "translation", "attempts", "prompt_tokens_used", "error_message")) == [
        ("j", 0, "pending", None, 0, 0, None), ("j", 1, "pending", None, 0, 0, None), ("k", 0, "completed", "kept", 1, 1, None),
    ]
