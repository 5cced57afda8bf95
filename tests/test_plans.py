"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from glossaflow.functions.text import source_hash
from glossaflow.operators import alignment, chunking, jobs, memory, quality, structure, terms
from glossaflow.plans import term_queries
from glossaflow.plans import views as V

FOLDER = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def documents(spark):
    return V.table(spark, FOLDER, "documents").select("doc_id", "text")


def test_chunking_does_not_shuffle(spark):
    nested = structure.document_blocks(documents(spark), separator="\n")
    chunks = chunking.chunk_documents(nested, "doc_id")
    assert "Exchange" not in plan(chunks)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(chunks)
    summary = structure.analyze_documents(nested, "doc_id", fallback_title=F.lit(""))
    assert "Exchange" not in plan(summary)


def test_alignment_does_not_shuffle(spark):
    nested = structure.document_blocks(documents(spark), separator="\n")
    chunks = chunking.chunk_documents(nested, "doc_id").withColumn("translation", F.col("source_text"))
    rendered = alignment.render_output_blocks(alignment.align_chunks(chunks, "doc_id", "chunk_index"))
    assert "Exchange" not in plan(rendered)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("broadcast", [True, False])
def test_term_matching_moves_the_vocabulary_and_hashes(spark, request, broadcast):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    frame = terms.match_terms(documents(spark), ["doc_id"], "text", V.terms(spark, FOLDER))
    found = plan(frame)
    assert "NestedLoop" not in found and "Cartesian" not in found and "RoundRobin" not in found
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", found)
    # The distinct words, patterns by their keys, hashes, and matches; never a text.
    assert keys and all(re.match(r"(size|run|_size|_key|_h1|doc_id|english)#", k) for k in keys), keys
    assert not any("text" in k for k in keys)


def test_words_inside_words_are_found_in_one_scan_and_only_matches_move(spark):
    words = V.terms(spark, FOLDER)
    found = plan(terms.match_terms(documents(spark), ["doc_id"], "text", words))
    assert len(re.findall(r"FileScan parquet \[doc_id", found)) == 1
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", found) == ["doc_id"]


def test_fuzzy_lookup_is_native_and_joined_by_equality(spark, no_broadcast):
    tm = documents(spark).select(
        F.col("doc_id").alias("id"), source_hash(F.col("text")).alias("source_hash"), F.col("text").alias("source_text"),
        F.col("text").alias("target_text"), F.lit("ar").alias("target_language"), F.lit(True).alias("approved"),
    )
    found = plan(memory.tm_fuzzy(documents(spark), ["doc_id"], "text", tm))
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian|RoundRobin", found)


def test_completeness_reads_once(spark):
    found = plan(quality.completeness(V.order_chunks(spark, FOLDER)))
    assert found.count("FileScan") == 1 and len(re.findall("Exchange", found)) <= 3


def test_prompts_are_not_dealt_out(spark):
    assert "RoundRobin" not in plan(term_queries.QUERIES["build_prompts"][0](spark, FOLDER))


def test_top_k_is_cut_before_the_shuffle(spark):
    errors = V.status_events(spark, FOLDER).select("job_id", F.col("event_id").alias("id"))
    assert "WindowGroupLimit" in plan(jobs.recent_errors(errors))
    ranked = terms.relevant_terms(documents(spark), ["doc_id"], "text", V.terms(spark, FOLDER), ["General"])
    assert "WindowGroupLimit" in plan(ranked)


def test_lists_take_from_the_top(spark):
    listed = jobs.list_documents(V.job_documents(spark, FOLDER), limit=5)
    assert "TakeOrderedAndProject" in plan(listed)
    assert "TakeOrderedAndProject" in plan(jobs.recent(V.jobs(spark, FOLDER), "updated_at", "id"))


def test_filters_reach_the_scan(spark):
    chunks = V.table(spark, FOLDER, "conversations").select(
        F.col("conv_id").alias("job_id"), F.col("turn").alias("chunk_index"), F.col("role").alias("status"),
        F.col("text").alias("source_text"), F.lit(None).cast("string").alias("translation"),
        F.array().cast("array<string>").alias("source_blocks"),
    )
    found = plan(jobs.list_chunks(chunks, 3, status="user"))
    assert "EqualTo(conv_id,3)" in found and "EqualTo(role,user)" in found
    batch = jobs.latest_completed(V.jobs(spark, FOLDER))
    assert "o_totalprice" not in plan(batch)


def test_exact_lookup_shuffles_hashes(spark):
    tm = documents(spark).select(
        source_hash(F.col("text")).alias("source_hash"), F.col("text").alias("source_text"),
        F.col("text").alias("target_text"), F.lit("ar").alias("target_language"), F.lit(True).alias("approved"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(memory.tm_exact(documents(spark), ["doc_id"], "text", tm))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in found
    left = found.split("SortMergeJoin")[1].split("Sort [")[1]
    assert "Project [doc_id" in left and "AS source_hash" in left
