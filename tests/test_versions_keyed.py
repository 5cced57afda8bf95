"""Tables with versions, and streams with state of their own."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from glossaflow.operators import memory
from glossaflow.session import shared_folder
from glossaflow.sources import ranked, search, versions
from glossaflow.sources.versions import VersionedTable
from glossaflow.streaming import keyed as K
from test_streams_sources import EVENTS, at, put, stream

PAIRS = "k long, v string"


def table_of(spark, group_rows=10):
    return VersionedTable(spark, shared_folder(spark, "versions"), ["k"], group_rows)


def frame(spark, pairs):
    return spark.createDataFrame(list(pairs), PAIRS)


def held(table, version=None):
    return dict(map(tuple, table.read(version).collect()))


def test_groups_split_and_stay_whole(spark):
    table, wanted = table_of(spark), {}
    pick = random.Random(1)
    for number in range(5):
        new = {pick.randrange(200): f"{number}" for _ in range(40)}
        table.upsert(frame(spark, new.items()), change=number)
        wanted.update(new)
        assert held(table) == wanted
    groups = table.current().groups
    assert len({g.depth for g in groups}) >= 1 and len(groups) >= 8
    # The groups' bits cover every hash once.
    assert sum(2.0**-g.depth for g in groups) == 1
    assert sum(g.rows for g in groups) == len(wanted)


def test_one_key_rewrites_one_group(spark):
    table = table_of(spark)
    table.upsert(frame(spark, [(k, "old") for k in range(100)]))
    before = table.current()
    after = table.upsert(frame(spark, [(7, "new")]))
    assert len(set(before.groups) - set(after.groups)) == 1
    assert held(table)[7] == "new" and len(held(table)) == 100
    assert held(table, before.number)[7] == "old"


def test_keys_are_read_from_their_groups(spark):
    table = table_of(spark)
    table.upsert(frame(spark, [(k, str(k)) for k in range(100)]))
    found = table.read_keys(frame(spark, [(3, ""), (3, ""), (500, "")]))
    assert [tuple(r) for r in found.collect()] == [(3, "3")]
    read = {os.path.dirname(f) for f in found.inputFiles()}
    assert 1 <= len(read) <= 2 < len(table.current().groups)


def test_a_failed_change_leaves_the_version_before(spark, monkeypatch):
    table = table_of(spark)
    table.upsert(frame(spark, [(1, "a"), (2, "b")]))

    def broken(old, new):
        return old.unionByName(new.withColumn("v", F.raise_error(F.lit("cut off")).cast("string")))

    with pytest.raises(Exception, match="cut off"):
        table.upsert(frame(spark, [(1, "x")]), broken)
    assert held(table) == {1: "a", 2: "b"} and table.versions() == [1]
    # Files are written, but not the manifest, or only half of it.
    monkeypatch.setattr(versions.Version, "lines", lambda self: '{"change": 0}\n[0, 0')
    table.upsert(frame(spark, [(1, "y")]))
    assert held(table) == {1: "a", 2: "b"} and table.versions() == [1]
    monkeypatch.undo()
    assert table.upsert(frame(spark, [(1, "z")])).number == 3
    assert held(table) == {1: "z", 2: "b"}


def test_many_groups_share_few_folders(spark):
    """Groups of many bits lie in folders of their leading bits; rewritten ones are passed over."""
    table = table_of(spark, group_rows=2)
    table.upsert(frame(spark, [(k, "old") for k in range(3000)]))
    first = table.current()
    folders = {g.path for g in first.groups if g.path}
    assert len(first.groups) > 1500 and len(folders) <= 256, (len(first.groups), len(folders))
    table.upsert(frame(spark, [(k, "new") for k in range(0, 3000, 100)]))
    wanted = {k: "old" if k % 100 else "new" for k in range(3000)}
    assert held(table) == wanted and held(table, first.number) == dict.fromkeys(range(3000), "old")
    assert [tuple(r) for r in table.read_keys(frame(spark, [(100, ""), (5000, "")])).collect()] == [(100, "new")]
    table.delete(frame(spark, [(k, "") for k in range(0, 3000, 2)]))
    table.expire(keep=1)
    assert held(table) == {k: v for k, v in wanted.items() if k % 2}
    assert sum(g.rows for g in table.current().groups) == 1500


def test_two_writers_cannot_make_one_version(spark):
    table = table_of(spark)
    first = table.upsert(frame(spark, [(1, "a")]))
    with pytest.raises(versions.Conflict):
        table._store(first)


def test_a_change_counts_once_and_old_versions_expire(spark):
    table = table_of(spark)
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.concat_ws("", F.sort_array(F.collect_list("v"))).alias("v"))
    for number in (0, 1, 1, 0, 2):
        table.upsert(frame(spark, [(1, "x")]), add, change=number)
    assert held(table) == {1: "xxx"}
    assert table.expire(keep=2) == 1 and table.versions() == [2, 3]
    assert held(table, 2) == {1: "xx"}


def test_deleted_keys_and_empty_groups(spark):
    table = table_of(spark)
    assert table.delete(frame(spark, [(1, "")])).number == 0
    table.upsert(frame(spark, [(k, "v") for k in range(60)]))
    table.delete(table.read())
    assert held(table) == {} and sum(2.0**-g.depth for g in table.current().groups) == 1
    table.upsert(frame(spark, [(9, "again"), (None, "no key")]))
    assert held(table) == {9: "again", None: "no key"}


# -- pages and searches


def test_pages_open_their_ranges_alone(spark):
    path, order = shared_folder(spark, "ranked"), [F.col("g").asc(), F.col("k").desc()]
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), F.lit("x").alias("v"))
    ranked.write_ranked(rows, path, order, ranges=8)
    wanted = [(r["g"], r["k"]) for r in rows.orderBy(*order).collect()]
    page = ranked.read_page(spark, path, order, limit=50, offset=3210)
    found = page.orderBy("rank").collect()
    assert [(r["g"], r["k"]) for r in found] == wanted[3210:3260]
    assert found[0]["rank"] == 3210 and found[0]["total"] == 5000
    plan = page._jdf.queryExecution().toString()
    opened = re.search(r"PartitionFilters: \[(.*?)\]", plan).group(1)
    assert "TakeOrdered" not in plan and "_range" in opened and opened.count(",") <= 2, opened
    some = ranked.read_page(spark, path, order, limit=7, offset=1000, where=F.col("g") == 2).orderBy("rank").collect()
    assert [(r["g"], r["k"]) for r in some] == [w for w in wanted if w[0] == 2][1000:1007]
    assert ranked.read_page(spark, path, order, limit=7, offset=9000).collect() == []


@pytest.mark.parametrize("needle", ["abc", "ABC D", "a", "%", "ab%yz", "zzz_", "", "nothing here", "É x", "aaa"])
def test_search_is_the_scan(spark, rows, needle):
    path = shared_folder(spark, "search")
    texts = ["abc def", "xABCx d", "ab then yz", "zzz", "zzzz", None, "", "é x", "aaaaa", "abcd abc d"]
    tm = spark.createDataFrame([(k, t, texts[-1 - k], k) for k, t in enumerate(texts)], "id long, source_text string, target_text string, use_count long")
    search.write_index(tm, path, 8, 3)
    columns = ["id", "source_text", "total"]
    assert rows(search.search_stored(spark, path, needle, 5, 1).select(*columns)) == rows(memory.search_tm(tm, needle, 5, 1).select(*columns))


def test_search_reads_its_postings_alone(spark):
    path = shared_folder(spark, "search")
    tm = spark.range(300).select("id", F.concat(F.lit("text "), F.col("id")).alias("source_text"), F.lit("t").alias("target_text"))
    search.write_index(tm, path, 32, 3)
    plan = search.candidates(spark, path, "299")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(posting_bucket" in plan and "PushedFilters: [IsNotNull(gram), EqualTo(gram,299)" in plan, plan
    assert [r["id"] for r in search.search_stored(spark, path, "299").collect()] == [299]


# -- streams




def state_sizes(spark, frame_, mode):
    sizes = []
    out = shared_folder(spark, "state")
    query = (
        frame_.writeStream.outputMode(mode).option("checkpointLocation", out).trigger(availableNow=True)
        .foreachBatch(lambda batch, number: batch.collect()).start()
    )
    query.awaitTermination()
    for progress in query.recentProgress:
        sizes += [sum(s["numRowsTotal"] for s in progress["stateOperators"])] if progress["stateOperators"] else []
    return sizes


def test_status_with_state(spark, rows):
    source, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    put(spark, source, [("j", 0, "translating", at(1), 1), ("j", 1, "failed", at(5), 2)], EVENTS)
    put(spark, source, [("j", 0, "completed", at(2), 3), ("j", 1, "pending", at(3), 4)], EVENTS)
    run = lambda: K.stream_status_with_state(stream(spark, source, EVENTS), "job_id", "chunk_index", out)
    assert rows(run().select("chunk_index", "status")) == [(0, "completed"), (1, "failed")]
    put(spark, source, [("j", 0, "failed", at(9), 5), ("j", 1, "translating", at(9), 6)], EVENTS)
    assert rows(run().select("chunk_index", "status", "updated_at")) == [(0, "completed", at(9)), (1, "translating", at(9))]


def test_state_expires_and_late_rows_change_nothing(spark, rows):
    source, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    run = lambda: K.stream_status_with_state(
        stream(spark, source, EVENTS), "job_id", "chunk_index", out, delay="1 hour", keep_hours=10
    )
    put(spark, source, [("j", k, "completed", at(1), k) for k in range(6)], EVENTS)
    put(spark, source, [("j", 9, "pending", at(100), 20)], EVENTS)
    put(spark, source, [("j", 9, "translating", at(101), 21)], EVENTS)
    put(spark, source, [("j", 0, "failed", at(2), 22), ("j", 9, "failed", at(102), 23)], EVENTS)
    found = rows(run().select("chunk_index", "status"))
    assert found == [*[(k, "completed") for k in range(6)], (9, "failed")]
    # Even a row in time, after the state has gone, leaves completed as it is.
    put(spark, source, [("j", 1, "failed", at(103), 24)], EVENTS)
    assert rows(run().select("chunk_index", "status"))[1] == (1, "completed")
    changes = K.status_changes(stream(spark, source, EVENTS), "job_id", "chunk_index", "1 hour", 10)
    sizes = state_sizes(spark, changes, "update")
    assert max(sizes) >= 6 and sizes[-1] < max(sizes), sizes


def test_results_once_within_the_delay(spark, rows):
    source, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    for number in range(3):
        put(spark, source, [("j", 0, "completed", at(number), number), ("j", number, "completed", at(1), 9)], EVENTS)
    put(spark, source, [("j", 5, "completed", at(200), 10)], EVENTS)
    put(spark, source, [("j", 6, "completed", at(201), 11)], EVENTS)
    found = K.stream_once_within(stream(spark, source, EVENTS), ["job_id", "chunk_index"], out, "1 day")
    assert rows(found.select("chunk_index")) == [(0,), (1,), (2,), (5,), (6,)]
    sizes = state_sizes(spark, K.once_within(stream(spark, source, EVENTS), ["job_id", "chunk_index"], "1 day"), "append")
    assert max(sizes) >= 3 and sizes[-1] == 2, sizes


def test_seconds_left_over_batches(spark, rows):
    source, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    totals = spark.createDataFrame([("j", 100), ("k", 5)], "job_id string, total_chunks long")
    for day in range(4):
        put(spark, source, [("j", day, "completed", at(24 * day + 1), day), ("j", 50 + day, "failed", at(24 * day + 2), day)], EVENTS)
    put(spark, source, [("k", 0, "completed", at(2), 9)], EVENTS)
    # An event of another job, long after, lets the period end.
    put(spark, source, [("other", 0, "beat", at(24 * 400), 10)], EVENTS)
    found = K.stream_seconds_left(stream(spark, source, EVENTS), totals, "job_id", out, period="365 days", delay="5 days")
    # Four of each in four days, 92 left.
    assert rows(found.where("job_id = 'j'").select("completed", "failed", "seconds_left")) == [(4, 4, 92 * 86400.0)]
    assert found.where("job_id = 'k'").first()["seconds_left"] is None


def test_a_sequence_of_both_fields_is_one_posting(spark, rows):
    """Fields are told apart by bits: a needle spread over both fields is not a match of either."""
    path = shared_folder(spark, "search")
    tm = spark.createDataFrame(
        [(1, "abcd", "xx abcd"), (2, "abc", "bcd"), (3, None, "ABCD")], "id long, source_text string, target_text string"
    )
    search.write_index(tm, path, 4, 2)
    postings = spark.read.parquet(f"{path}/postings")
    assert rows(postings.where("gram = 'bcd'").select("id", "fields")) == [(1, 3), (2, 2), (3, 2)]
    assert rows(search.candidates(spark, path, "abcd").select("id")) == [(1,), (3,)]
    assert rows(search.search_stored(spark, path, "abcd").select("id", "total")) == [(1, 2), (3, 2)]
    assert rows(search.search_stored(spark, path, "bc").select("id")) == [(1,), (2,), (3,)]


def test_status_by_state_runs_no_python_a_chunk(spark, rows):
    """State is held by Spark's own aggregate, and a row in time for its span counts without older state."""
    source, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    put(spark, source, [("j", k, "pending", at(100), k) for k in range(4)], EVENTS)
    put(spark, source, [("j", 7, "completed", at(95), 9), ("j", 1, "completed", at(95), 10), ("j", 2, None, at(101), 11)], EVENTS)
    found = K.stream_status_with_state(
        stream(spark, source, EVENTS), "job_id", "chunk_index", out, delay="1 hour", keep_hours=10
    )
    assert rows(found.select("chunk_index", "status", "updated_at")) == [
        (0, "pending", at(100)), (1, "completed", at(100)), (2, None, at(101)), (3, "pending", at(100)), (7, "completed", at(95))
    ]
    changes = K.status_changes(stream(spark, source, EVENTS), "job_id", "chunk_index", "1 hour", 10)
    plan = changes._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "Aggregate" in plan, plan
