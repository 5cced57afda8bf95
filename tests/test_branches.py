"""The registered queries reach the branches that they stand for."""

from pyspark.sql import functions as F

from glossaflow.plans import job_queries, structure_queries, term_queries

FOLDER = "/root/testdata/sf0.01"


def run(spark, module, name):
    return module.QUERIES[name][0](spark, FOLDER)


def test_pages_have_all_kinds_of_blocks(spark):
    kinds = {r["type"]: r["n"] for r in run(spark, structure_queries, "html_to_blocks").groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert kinds["list_item"] > 1000 and kinds["heading"] > 100 and kinds["paragraph"] > 1000
    counts = run(spark, structure_queries, "block_counts").drop("page_id").distinct()
    assert counts.count() > 10


def test_sections_are_carried(spark):
    carried = run(spark, structure_queries, "carry_headings")
    assert carried.where("section <> ''").count() > 100
    assert carried.where("chapter <> ''").count() > 100
    # A chapter that begins in mid-document.
    assert carried.where("chapter = '' AND chunk_index = 0").count() > 0


def test_jobs_of_every_kind(spark):
    complete = run(spark, term_queries, "completeness_of_event_jobs")
    assert {r["reason"] for r in complete.select("reason").distinct().collect()} >= {"none", "sequence"}
    written = run(spark, job_queries, "write_assembled")
    assert written.where("doc_id % 9 = 0").count() == 0 and written.count() > 1000


def test_similar_entries_beyond_the_text_itself(spark):
    found = run(spark, term_queries, "tm_lookup")
    assert found.where("exact").count() > 0 and found.where("NOT exact").count() > 100
