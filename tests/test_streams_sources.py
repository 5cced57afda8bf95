"""Streams over several batches, files, dictionaries and the store."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import connect, difference, rows_of_sql
from glossaflow.functions.text import source_hash
from glossaflow.operators import memory
from glossaflow.session import shared_folder
from glossaflow.sources import file_heads, files, store, terms_csv
from glossaflow.sources.versions import VersionedTable
from glossaflow.streaming import status as S

EVENTS = "job_id string, chunk_index int, status string, ts timestamp, event_id long"


def at(hour):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    )


def test_status_over_batches(spark, rows):
    source, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    put(spark, source, [("j", 0, "translating", at(1), 1), ("j", 1, "failed", at(5), 2)], EVENTS)
    put(spark, source, [("j", 0, "completed", at(2), 3), ("j", 1, "pending", at(3), 4)], EVENTS)
    run = lambda: S.stream_latest_status(stream(spark, source, EVENTS), "job_id", "chunk_index", out)
    assert rows(run().select("chunk_index", "status")) == [(0, "completed"), (1, "failed")]
    # A later result for a finished chunk changes nothing; another chunk moves on.
    put(spark, source, [("j", 0, "failed", at(9), 5), ("j", 1, "translating", at(9), 6)], EVENTS)
    assert rows(run().select("chunk_index", "status")) == [(0, "completed"), (1, "translating")]


def test_progress_and_late_rows(spark, rows):
    source, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    put(spark, source, [("j", 0, "completed", at(1), 1), ("j", 1, "failed", at(2), 2)], EVENTS)
    put(spark, source, [("j", 2, "completed", at(100), 3)], EVENTS)
    # The mark that rows are late by is that of the batch before the last.
    put(spark, source, [("j", 2, "pending", at(101), 3)], EVENTS)
    put(spark, source, [("j", 3, "completed", at(3), 4)], EVENTS)
    found = S.stream_progress(stream(spark, source, EVENTS), "job_id", out, "1 day", "1 day")
    assert rows(found.select("window_start", "completed", "failed")) == [(at(0), 1, 1), (at(96), 1, 0)]


def test_repeated_results(spark, rows):
    source, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    for number in range(3):
        put(spark, source, [("j", 0, "completed", at(number), number), ("j", number, "completed", at(1), 9)], EVENTS)
    found = S.stream_dedup_results(stream(spark, source, EVENTS), ["job_id", "chunk_index"], out)
    assert rows(found.select("chunk_index", "event_id")) == [(0, 0), (1, 9), (2, 9)]


def test_a_batch_that_runs_again_counts_once(spark, rows):
    """Each merge starts from the versions before its own."""
    schema = "n long, source_text string, translation string"
    source, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    run = lambda: S.stream_tm_upsert(stream(spark, source, schema), ["n"], out)
    put(spark, source, [(1, "a", "x"), (2, "b", "y")], schema)
    run()
    put(spark, source, [(3, "a", "z")], schema)
    first = rows(run().select("source_text", "target_text", "use_count"))
    assert first == [("a", "x", 1), ("b", "y", 0)]
    # The last batch's commit is lost, as when the driver dies before it: it runs once more.
    for name in ("1", ".1.crc"):
        os.remove(f"{out.removeprefix('file:')}/checkpoint/commits/{name}")
    assert rows(run().select("source_text", "target_text", "use_count")) == first


def test_the_store_keeps_one_old_version(spark):
    schema = "job_id string, chunk_index int, status string, ts timestamp, event_id long"
    source, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    for number in range(5):
        put(spark, source, [("j", 0, "translating", at(number), number)], schema)
    found = S.stream_latest_status(stream(spark, source, schema), "job_id", "chunk_index", out)
    assert found.count() == 1
    assert VersionedTable(spark, f"{out}/data", ["job_id", "chunk_index"]).versions() == [4, 5]


def test_memory_stream_is_the_batch_result(spark, rows):
    schema = "n long, source_text string, translation string"
    source, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    batches = [[(1, "a", "x"), (2, "b", "y")], [(3, " A ", "z"), (4, "c", "w")], [(5, "a", "v"), (6, "B", "u")]]
    for batch in batches:
        put(spark, source, batch, schema)
    found = S.stream_tm_upsert(stream(spark, source, schema), ["n"], out)
    whole = memory.build_tm(spark.createDataFrame(sum(batches, []), schema), [F.col("n")])
    columns = ["source_hash", "source_text", "target_text", "use_count"]
    assert rows(found.select(*columns)) == rows(whole.select(*columns))


def test_memory_stream_writes_texts_once(spark, rows):
    """Merging a batch rewrites counts alone; texts stay where their batch put them, hits bring none."""
    schema = "n long, source_text string, translation string"
    source, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    put(spark, source, [(1, "a", "x"), (2, "b", "y")], schema)
    put(spark, source, [(3, "A", "z"), (4, "c", "w")], schema)
    found = S.stream_tm_upsert(stream(spark, source, schema), ["n"], out)
    assert rows(found.select("source_text", "target_text", "use_count")) == [("a", "x", 1), ("b", "y", 0), ("c", "w", 0)]
    held = VersionedTable(spark, f"{out}/data", ["source_hash", "target_language"]).read()
    assert "source_text" not in held.columns and "target_text" not in held.columns
    assert rows(spark.read.parquet(f"{out}/texts/batch=1").select("source_text")) == [("c",), (None,)]


def test_error_windows(spark, rows):
    schema = "ts timestamp, error_type string, severity string"
    source, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    put(spark, source, [(at(1), "api_error", "error"), (at(2), "api_error", "error"), (at(30), "consistency", "warning")], schema)
    found = S.stream_errors(stream(spark, source, schema), out)
    assert rows(found) == [(at(0), "api_error", "error", 2), (at(24), "consistency", "warning", 1)]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "utf8.txt").write_bytes("نص".encode())
    (tmp_path / "bom.txt").write_bytes(b"\xef\xbb\xbfabc")
    (tmp_path / "cp1256.txt").write_bytes("مرحبا".encode("cp1256"))
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.docx").write_bytes(b"PK\x03\x04zip")
    (tmp_path / "fake.pdf").write_bytes(b"PK\x03\x04zip")
    (tmp_path / "odd.pdf").write_bytes(b"plain")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "book.epub").write_bytes(b"x")
    (tmp_path / "with space+plus.exe").write_bytes(b"x")
    return str(tmp_path)


def test_text_files(spark, folder):
    found = {r["name"]: r.text for r in files.read_text_documents(spark, folder).where("name like '%.txt'").collect()}
    assert found == {"utf8.txt": "نص", "bom.txt": "abc", "cp1256.txt": "مرحبا"}


def test_large_files_are_rejected_not_dropped(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "MAX_FILE_BYTES", 5)
    found = {r["name"]: (r.text, r.verdict) for r in files.read_text_documents(spark, folder).collect()}
    assert found["utf8.txt"] == ("نص", "ok") and found["bom.txt"] == (None, "too_large")
    assert found["cp1256.txt"] == ("مرحبا", "ok")


def test_large_dictionaries_are_rejected(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(terms_csv, "MAX_FILE_BYTES", 20)
    monkeypatch.setattr(files, "MAX_FILE_BYTES", 20)
    (tmp_path / "small.csv").write_text("one,واحد\n", encoding="utf-8")
    (tmp_path / "large.csv").write_text("two,اثنان\n" * 5, encoding="utf-8")
    accepted, rejected, _ = terms_csv.read_terms_csv(spark, str(tmp_path))
    assert rows(accepted.select("english")) == [("one",)]
    assert rows(rejected.select("line", "reason")) == [(0, "file too large")]


def test_empty_files_of_deeper_folders(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "deep.txt").write_bytes(b"")
    (tmp_path / "a" / "full.txt").write_bytes(b"x")
    found = {r["name"]: r.verdict for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert found == {"deep.txt": "empty", "full.txt": "ok"}


def test_a_character_on_any_byte_is_valid(spark, tmp_path):
    (tmp_path / "long.txt").write_bytes(b"x" * (64 * 1024 - 1) + "é".encode())
    assert files.file_inventory(spark, str(tmp_path), check_text=True).first()["utf8"]


def test_inventory(spark, folder):
    found = {r["name"]: r.verdict for r in files.file_inventory(spark, folder).collect()}
    assert found == {
        "utf8.txt": "ok", "bom.txt": "ok", "cp1256.txt": "ok", "a.pdf": "ok", "b.docx": "ok",
        "fake.pdf": "content_mismatch", "odd.pdf": "unknown_content", "empty.txt": "empty",
        "book.epub": "planned", "with space+plus.exe": "unsupported",
    }


def test_inventory_reads_texts_to_their_end(spark, tmp_path, monkeypatch):
    """The last byte counts, far behind the first bytes and at the seam of two blocks."""
    start = b"x" * ((1 << 20) - 1)
    (tmp_path / "utf 8+.txt").write_bytes(start + "é".encode())
    (tmp_path / "other.txt").write_bytes(start + b"\xe9")
    (tmp_path / "cut.txt").write_bytes(start + "é".encode()[:1])
    (tmp_path / "a.pdf").write_bytes(b"%PDF" + b"\xe9")
    found = {r["name"]: (r.encoding, r.verdict) for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert found == {
        "utf 8+.txt": ("utf-8", "ok"), "other.txt": ("cp1256", "ok"), "cut.txt": ("cp1256", "ok"), "a.pdf": (None, "ok"),
    }
    monkeypatch.setattr(files, "FALLBACK_CODE_PAGES", ())
    found = {r["name"]: r.verdict for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert found == {"utf 8+.txt": "ok", "other.txt": "unknown_content", "cut.txt": "unknown_content", "a.pdf": "ok"}


def test_heads_read_first_bytes_alone(spark, tmp_path):
    """Folders of any depth; a large file costs no more than its first bytes."""
    for name in ("a", "b/c", "b/d/e/f", "_hidden", "b/.dot"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "x y.txt").write_bytes(b"%PDF" + b"0" * 1000)
    with open(tmp_path / "large.txt", "wb") as large:
        large.truncate(3 << 30)
    found = {r["path"]: (r["length"], len(r["head"])) for r in file_heads.read_heads(spark, str(tmp_path)).collect()}
    assert found == {
        f"file:{tmp_path}/large.txt": (3 << 30, 64),
        **{f"file:{tmp_path}/{n}/x y.txt": (1004, 64) for n in ("a", "b/c", "b/d/e/f")},
    }
    plan = files.file_inventory(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "binaryFile" not in plan and "InMemoryRelation" not in plan


def test_stale_files(spark, folder):
    os.utime(f"{folder}/a.pdf", (0, 0))
    assert [r["name"] for r in files.stale_files(spark, folder, 24).collect()] == ["a.pdf"]


CSV = (
    'Domain,English,Arabic,Alternatives\n"Law","contract, sale",عقد,"أ; ب;"\n\n,word,كلمة,\n'
    ',WORD,مكرر,\nLaw,short\nLaw,,empty\n"Law","multi\nline","say ""hi""",\n'
)


def test_terms_csv(spark, tmp_path, rows):
    (tmp_path / "one.csv").write_text(CSV, encoding="utf-8-sig")
    accepted, rejected, skipped = terms_csv.read_terms_csv(spark, str(tmp_path))
    assert rows(accepted.select("english", "preferred", "domain", "alternatives")) == [
        ("contract, sale", "عقد", "Law", ["أ", "ب"]), ("multi\nline", 'say "hi"', "Law", []), ("word", "كلمة", "General", []),
    ]
    assert rows(rejected.select("line", "reason")) == [(5, "missing column"), (6, "empty value")]
    assert rows(skipped.select("line", "english")) == [(4, "WORD")]
    assert terms_csv.import_report(accepted, rejected, skipped).first()[:2] == (3, 1)
    again, _, skipped = terms_csv.read_terms_csv(spark, str(tmp_path), accepted)
    assert (again.count(), skipped.count()) == (0, 4)


def test_terms_csv_without_header(spark, tmp_path, rows):
    (tmp_path / "one.csv").write_text("one,واحد\ntwo,اثنان,Law\n", encoding="utf-8")
    accepted, _, _ = terms_csv.read_terms_csv(spark, str(tmp_path))
    assert rows(accepted.select("line", "english", "domain")) == [(1, "one", "General"), (2, "two", "Law")]


def test_terms_csv_round_trip(spark, rows):
    terms = spark.createDataFrame(
        [('say "x", y', "ن", "Law", "d", ["a", "b"]), ("plain", "ب", "General", None, [])],
        "english string, preferred string, domain string, definition string, alternatives array<string>",
    )
    path = shared_folder(spark, "csv")
    terms_csv.write_terms_csv(terms, path)
    accepted, rejected, _ = terms_csv.read_terms_csv(spark, path)
    assert rows(accepted.select(*terms.columns)) == [
        ("plain", "ب", "General", "", []), ('say "x", y', "ن", "Law", "d", ["a", "b"]),
    ]
    assert rejected.count() == 0


def test_store(spark, rows):
    root = shared_folder(spark, "store")
    chunks = spark.createDataFrame([(f"j{i % 7}", i, "x") for i in range(50)], "job_id string, chunk_index int, status string")
    store.write_table(chunks, root, "chunks")
    assert rows(store.read_table(spark, root, "chunks")) == rows(chunks)
    one = store.read_job_chunks(spark, root, "j3")
    assert rows(one) == rows(chunks.where("job_id = 'j3'"))
    assert "PartitionFilters: [isnotnull(job_bucket" in one._jdf.queryExecution().toString()
    tm = spark.createDataFrame([("t",)], "source_text string").withColumn("source_hash", source_hash(F.col("source_text")))
    store.write_table(tm, root, "tm")
    assert rows(store.read_table(spark, root, "tm")) == rows(tm)


def test_assembled_order(spark):
    rendered = spark.createDataFrame(
        [("d", 10, 0, "paragraph", 0, "ten"), ("d", 2, 1, "paragraph", 0, "two b"), ("d", 2, 0, "heading", 1, "two a"), ("c", 0, 0, "paragraph", 0, "c")],
        "job_id string, chunk_index int, block_pos int, type string, output_level int, output_text string",
    )
    assert dict(store.assembled_texts(rendered, "job_id").collect()) == {"d": "two a\n\ntwo b\n\nten", "c": "c"}
    path = shared_folder(spark, "assembled")
    with pytest.raises(ValueError, match="completeness"):
        store.write_assembled(rendered, path)
    store.write_assembled(rendered, path, incomplete_too=True)
    assert spark.read.parquet(path).count() == 4


@pytest.mark.parametrize("name", ["file_inventory", "read_text_documents"])
def test_files_of_texts_keep_the_size_limit(spark, monkeypatch, name):
    """Whatever the table's partitions, its texts lie in files below the limit; all in one are above it."""
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(files, "MAX_FILE_BYTES", 200_000)
    frame = entry.queries()[name](spark, folder)
    found = [tuple(r) for r in frame.collect()]
    assert difference(frame.columns, found, *rows_of_sql(connect(folder), entry.oracle_sql()[name])) is None
