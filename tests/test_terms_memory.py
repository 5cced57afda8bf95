"""Dictionaries, translation memory and quality checks."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import difference, rows_of_sql
from glossaflow.functions.text import normalize_text
from glossaflow.operators import matching, memory, quality, terms
from glossaflow.operators.matching import find_patterns

TERMS = "id long, english string, preferred string, alternatives array<string>, domain string, priority string, active boolean"


def dictionary(spark, *entries):
    full = [(i, e, p, a, d, "normal", on) for i, (e, p, a, d, on) in enumerate(entries, start=1)]
    return spark.createDataFrame(full, TERMS)


def texts_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, t string")


def test_short_terms_need_word_boundaries(spark, rows):
    words = dictionary(spark, ("AI", "ذ", [], "General", True), ("C+", "x", [], "General", True))
    found = terms.match_terms(texts_of(spark, "AIMS high", "use AI now", "(ai)", "C+x and C+", "said"), ["k"], "t", words)
    assert rows(found) == [(1, 1), (2, 1), (3, 2)]


def test_pattern_search_is_the_nested_loop(spark, rows):
    pick = random.Random(1)
    word = lambda: "".join(pick.choice("abc é") for _ in range(pick.randint(1, 6))).strip() or "a"
    phrases = sorted({" ".join(word().split()) for _ in range(80)} | {f"{word()} {word()}".strip() for _ in range(80)})
    phrases = [p for p in phrases if p.strip()]
    texts = [" ".join(word() for _ in range(30)) + pick.choice(["", "\n", "  x"]) for _ in range(25)]
    patterns = spark.createDataFrame(
        [(i, " ".join(p.split()), False) for i, p in enumerate(phrases)], "pid int, pattern string, whole_word boolean"
    )
    found = find_patterns(texts_of(spark, *texts), ["k"], F.col("t"), patterns, "pid")
    expected = [(k, i) for k, t in enumerate(texts) for i, p in enumerate(phrases) if " ".join(p.split()) in t]
    assert rows(found) == sorted(expected, key=str)


@pytest.mark.parametrize("most", [0, 50_000])
def test_patterns_inside_words_by_either_way(spark, rows, monkeypatch, most):
    monkeypatch.setattr(matching, "BROADCAST", most, raising=False)
    pick = random.Random(2)
    word = lambda least: "".join(pick.choice("abé") for _ in range(pick.randint(least, 9)))
    found = [(word(1), pick.random() < 0.3) for _ in range(150)] + [(f"{word(1)} {word(1)}", False) for _ in range(20)]
    texts = [pick.choice([" ", "\n", "\u2003"]).join(word(1) for _ in range(60)) for _ in range(20)] + ["", None]
    patterns = spark.createDataFrame(
        [(i % 100, p, w) for i, (p, w) in enumerate(found)], "pid int, pattern string, whole_word boolean"
    )
    holds = lambda t, p, w: re.search(rf"\b{p}\b", t) if w else p in t
    expected = {(k, i % 100) for k, t in enumerate(texts) if t for i, (p, w) in enumerate(found) if holds(t, p, w)}
    assert rows(find_patterns(texts_of(spark, *texts), ["k"], F.col("t"), patterns, "pid")) == sorted(expected, key=str)


def test_empty_dictionary(spark, rows):
    none = dictionary(spark, ("x", "y", [], "General", True)).where("id > 5")
    assert rows(terms.match_terms(texts_of(spark, "some text"), ["k"], "t", none)) == []


def test_relevant_terms(spark, rows):
    words = dictionary(
        spark,
        ("memory", "a", [], "General", True),
        ("Working memory", "b", [], "Psychology", True),
        ("working MEMORY", "c", [], "General", True),
        ("inactive", "d", [], "General", False),
        ("model", "e", [], "Custom", True),
    )
    texts = texts_of(spark, "Working memory models are inactive")
    found = terms.relevant_terms(texts, ["k"], "t", words, ["General", "Psychology"]).select("rank", "id")
    assert rows(found) == [(1, 2), (2, 1)]
    own = texts.withColumn("d", F.array(F.lit("Custom"), F.lit("General")))
    assert rows(terms.relevant_terms(own, ["k"], "t", words, "d", cap=2).select("rank", "id")) == [(1, 3), (2, 1)]


def test_domains(value):
    pick = lambda *a: value(terms.select_domains(*[F.lit(x) for x in a]))
    assert pick(True, "Law", True, True) == ["General", "Law", "Custom"]
    assert pick(True, "General", True, False) == ["General"]
    assert pick(False, "Law", False, False) == []


def test_term_changes(spark, rows):
    words = dictionary(spark, ("one", "a", [], "General", True), ("two", "b", [], "General", True), ("three", "c", [], "Law", True))
    columns = "change_id long, op string, " + TERMS
    change = lambda n, op, i, **f: (n, op, i, *[f.get(c) for c in ("english", "preferred", "alternatives", "domain", "priority", "active")])
    changes = spark.createDataFrame(
        [
            change(1, "update", 1, english="TWO"),
            change(2, "update", 3, preferred="z"),
            change(3, "create", None, english="Three", domain="law"),
            change(4, "create", None, english="three", domain="General", preferred="n"),
            change(5, "delete", 9),
            change(6, "create", None, english="THREE", domain="general"),
        ],
        columns,
    )
    after, refused = terms.apply_term_changes(words, changes)
    assert rows(after.select("english", "preferred", "domain")) == [
        ("one", "a", "General"), ("three", "n", "General"), ("three", "z", "Law"), ("two", "b", "General"),
    ]
    assert rows(refused) == [(1, "update", "duplicate"), (3, "create", "duplicate"), (5, "delete", "not_found"), (6, "create", "duplicate")]


def test_seed_is_idempotent(spark, rows):
    words = dictionary(spark, ("one", "a", [], "General", True))
    defaults = dictionary(spark, ("ONE", "x", [], "general", True), ("new", "y", [], "Law", True))
    once = terms.seed_terms(words, defaults)
    assert rows(once.select("english")) == [("new",), ("one",)]
    assert once.count() == terms.seed_terms(once, defaults).count()


def pairs_of(spark, *pairs):
    return spark.createDataFrame([(1, i, s, t) for i, (s, t) in pairs], "job_id int, chunk_index int, source_text string, translation string")


def stored(spark, *texts):
    built = memory.build_tm(pairs_of(spark, *[(i, (t, t.upper())) for i, t in enumerate(texts)]), [F.col("chunk_index")])
    return built.select("*", F.col("first_seen.chunk_index").cast("long").alias("id"), F.lit(True).alias("approved"))


def test_build_and_upsert(spark, rows):
    tm = stored(spark, "Same text", " same  TEXT ", "other", "  ")
    assert rows(tm.select("source_text", "target_text", "use_count")) == [("Same text", "SAME TEXT", 1), ("other", "OTHER", 0)]
    twice = memory.upsert_tm(tm, stored(spark, "other", "third", "third", "OTHER"))
    assert rows(twice.select("source_text", "use_count")) == [("Same text", 1), ("other", 2), ("third", 1)]


def test_exact_and_fuzzy(spark, rows):
    tm = stored(spark, "The cat sat on the mat today", "Nothing like the others at all")
    texts = texts_of(spark, " the CAT sat  on the mat today", "The cat sat on the mat tonight", "zzzz qqqq")
    assert rows(memory.tm_exact(texts, ["k"], "t", tm).select("k", "similarity")) == [(0, 1.0)]
    found = memory.lookup(texts, ["k"], "t", tm).select("k", "rank", "exact", "source").collect()
    assert sorted(map(tuple, found)) == [
        (0, 1, True, "The cat sat on the mat today"), (1, 1, False, "The cat sat on the mat today"),
    ]


def word_pairs(form):
    words = form.split(" ")
    return {tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, start=1):
        row, last = [i], row
        for j, y in enumerate(b, start=1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def closeness(a, b):
    return 1 - edits(a, b) / max(len(a), len(b), 1)


def overlap(a, b):
    return 2 * len(word_pairs(a) & word_pairs(b)) / (len(word_pairs(a)) + len(word_pairs(b)))


def ranked_plainly(known, asked, share, threshold, matches=None):
    expected = []
    for k, text in enumerate(asked):
        form = " ".join(text.split()).lower()
        if form in {e[1] for e in known}:
            continue
        best = sorted(((share(form, e), i) for i, e in known if share(form, e) >= threshold - 1e-9), key=lambda r: (-r[0], -r[1]))
        expected += [(k, n, i, round(r, 9)) for n, (r, i) in enumerate(best[:matches], start=1)]
    return sorted(expected, key=str)


def found_rows(frame):
    found = frame.select("k", "rank", "id", "similarity").collect()
    return sorted(((r.k, r.rank, r.id, round(r.similarity, 9)) for r in found), key=str)


@pytest.mark.parametrize("operator, share", [(memory.tm_fuzzy, closeness), (memory.tm_overlap, overlap)])
@pytest.mark.parametrize("matches", [None, 2])
def test_similar_is_brute_force_over_the_whole_memory(spark, operator, share, matches):
    pick = random.Random(3)
    sentence = lambda n: " ".join(pick.choice("abcdefghij") + pick.choice("xyz") for _ in range(n))
    base = [sentence(pick.randint(1, 40)) for _ in range(25)]
    vary = lambda t: " ".join(w if pick.random() > 0.06 else "changed" for w in t.split())
    known, asked = base + [vary(t) for t in base], [vary(t) for t in base] + ["", "short"]
    tm, texts = stored(spark, *known), texts_of(spark, *asked)
    entries = [(r.id, r.form) for r in tm.select("id", normalize_text(F.col("source_text")).alias("form")).collect()]
    expected = ranked_plainly(entries, asked, share, 0.72, matches)
    assert found_rows(operator(texts, ["k"], "t", tm, matches=matches)) == expected
    assert len(expected) > 5


@pytest.mark.parametrize("threshold", [0.55, 0.72, 0.9, 1.0])
def test_edits_of_every_kind_and_length(spark, threshold):
    """Short and long forms, letters beyond the first plane, repeats, edits dealt out evenly."""
    pick = random.Random(5)
    letters = "aaab é𝒳ñ."
    word = lambda n: "".join(pick.choice(letters) for _ in range(n)).strip() or "x"

    def edited(text, n):
        text = list(text)
        for _ in range(n):
            at = pick.randrange(len(text) + 1)
            kind = pick.choice("sid")
            text[at : at + (kind != "i")] = [] if kind == "d" else [pick.choice(letters)]
        return "".join(text) or "y"

    known = [word(n) for n in (1, 2, 3, 4, 5, 7, 9, 14, 25, 60, 120)] + ["aaaaaaaaaaaa", "".join("abcdefghij"[k % 10] for k in range(50))]
    asked = [edited(t, max(1, int(len(t) * share))) for t in known for share in (0.05, 0.15, 0.27)]
    asked += ["".join(c + ("x" if k % 4 == 0 else "") for k, c in enumerate(known[-1])), "a", ""]
    tm, texts = stored(spark, *known), texts_of(spark, *asked)
    entries = [(r.id, r.form) for r in tm.select("id", normalize_text(F.col("source_text")).alias("form")).collect()]
    expected = ranked_plainly(entries, asked, closeness, threshold)
    assert found_rows(memory.tm_fuzzy(texts, ["k"], "t", tm, threshold=threshold)) == expected


def test_one_word_changed_in_a_short_segment(spark):
    tm = stored(spark, "Press the red button to start.", "restart the server after the upgrade", "Quantum computing basics")
    texts = texts_of(spark, "Press the green button to start.", "restart the server before the upgrade", "The history of ancient Rome and its emperors.")
    found = memory.tm_fuzzy(texts, ["k"], "t", tm).select("k", "source").collect()
    assert sorted(map(tuple, found)) == [
        (0, "Press the red button to start."), (1, "restart the server after the upgrade"),
    ]


def test_issues_and_report(spark, rows):
    words = dictionary(spark, ("vision", "رؤية", ["بصر"], "General", True), ("unused", "غ", [], "General", True))
    pairs = pairs_of(
        spark,
        (1, ("the vision", "رؤية")),
        (2, ("Vision loss", "بصر ضعيف")),
        (3, ("a vision", "شيء")),
        (4, ("nothing", "شيء")),
        (47, ("vision again", "أي\nرؤية")),
    )
    issues = quality.check_terms(pairs, ["chunk_index"], words).select("chunk_index", "issue", "found")
    assert rows(issues) == [(2, "alternative_used", "بصر"), (3, "preferred_missing", None)]
    usage = quality.term_usage(pairs, ["chunk_index"], words)
    [row] = quality.consistency_report(usage, words, "chunk_index").collect()
    assert row.inconsistent and not row.consistent and row.chunk_count == 4
    assert {w.label: w.first_chunks for w in row.wordings} == {"رؤية": [1, 47], "alt: بصر": [2], "other": [3]}
    assert row.chunks_without_preferred == [3]
    other = quality.term_usage(pairs.where("chunk_index = 3"), ["chunk_index"], words)
    [row] = quality.consistency_report(other, words, "chunk_index").collect()
    assert not row.inconsistent and not row.consistent


LONG = "These are more than eight English words in one single source text here"
ARABIC = "هذا نص عربي طويل بما يكفي لكي يقبل في الفحص"


@pytest.mark.parametrize(
    "source, output, expected",
    [
        (LONG, ARABIC, None),
        (LONG, "  ", "empty"),
        ("word " * 80, ARABIC[:10], "short"),
        ("One two.\n\nThree four.\n\nFive six.", "فقرة واحدة طويلة بما يكفي", "paragraphs"),
        (LONG, LONG, "language"),
        ("a | b\nc | d\ne | f", "[1] أأأ | ب\n[2] ج | ددد", "markers"),
        ("a | b\nc | d\ne | f", "[1] أ | ب\n[2] ج | د\n[3] ه | و", None),
        ("a | b\nc | d\ne | f", "[1] أ | ب\n[2] ج | د\n[3] هههه", "cells"),
        ("a | b\nc | d", "[١] أأ | ب\n[٢] ج | دد", None),
        ("a | b\nc | d", "[1] أأ | ب\n[3] ج | دد", "markers"),
    ],
)
def test_validation(spark, source, output, expected):
    frame = spark.createDataFrame([(source, output)], "source_text string, translation string")
    assert quality.validate_translations(frame).first()["reason"] == expected


def chunk_rows(spark, *chunks):
    return spark.createDataFrame([("j", i, s, t) for i, s, t in chunks], "job_id string, chunk_index int, status string, translation string")


@pytest.mark.parametrize(
    "chunks, reason, missing, repeated",
    [
        ([(0, "completed", "a"), (1, "completed", "b")], None, [], []),
        ([(0, "completed", "a"), (2, "completed", "b")], "sequence", [1], []),
        ([(0, "completed", "a"), (0, "completed", "b")], "sequence", [1], [0]),
        ([(0, "completed", "a"), (1, "failed", None)], "failed", [], []),
        ([(0, "completed", "a"), (1, "pending", None)], "pending", [], []),
        ([(0, "completed", " "), (1, "completed", "b")], "empty", [], []),
    ],
)
def test_completeness(spark, chunks, reason, missing, repeated):
    [row] = quality.completeness(chunk_rows(spark, *chunks)).collect()
    assert (row.reason, row.missing_indexes, row.duplicate_indexes) == (reason, missing, repeated)


def test_gaps_over_buckets(spark):
    wide = [(i, "completed", "x") for i in range(3000) if i % 250 != 7]
    [row] = quality.completeness(chunk_rows(spark, *wide)).collect()
    assert row.missing_indexes == [7 + 250 * k for k in range(12)]
    [row] = quality.completeness(chunk_rows(spark, *wide), listed=2).collect()
    assert row.missing_indexes == [7, 257]


def test_a_job_gathers_runs_not_indexes(spark):
    chunks = chunk_rows(spark, (0, "completed", "x"), (0, "completed", "x"), (None, "completed", "x"), (-2, "completed", "x"), (2500, "completed", "x"))
    dense = spark.range(5000).selectExpr("'k' job_id", "cast(id AS int) chunk_index", "'completed' status", "'x' translation").where("chunk_index <> 7")
    runs = quality.index_runs(chunks.unionByName(dense), "job_id")
    found = [tuple(r) for row in runs.where("job_id = 'k'").collect() for r in row.runs]
    assert sorted(found) == [(0, 6), (8, 1023), (1024, 2047), (2048, 3071), (3072, 4095), (4096, 4999)]
    report = {r.job_id: r for r in quality.completeness(chunks.unionByName(dense)).collect()}
    assert (report["j"].missing_indexes, report["j"].duplicate_indexes, report["j"].total_chunks) == ([1, 2, 3, 4], [0], 5)
    assert (report["k"].missing_indexes, report["k"].reason) == ([7], "sequence")


def test_jobs_without_chunks(spark, rows):
    jobs = spark.createDataFrame([("j",), ("k",)], "id string")
    found = quality.completeness(chunk_rows(spark, (0, "completed", "a")), jobs=jobs)
    assert rows(found.select("job_id", "total_chunks", "reason", "missing_indexes")) == [("j", 1, None, []), ("k", 0, "none", [])]


def test_checks_look_at_active_terms_of_the_job(spark, rows):
    words = dictionary(
        spark, ("vision", "رؤية", [], "General", True), ("sight", "بصر", [], "Law", True), ("eye", "عين", [], "General", False)
    )
    pairs = pairs_of(spark, (1, ("vision sight eye", "x"))).withColumn("domains", F.array(F.lit("General")))
    issues = quality.check_terms(pairs, ["chunk_index"], words, domains="domains")
    assert rows(issues.select("english", "issue")) == [("vision", "preferred_missing")]
    assert quality.check_terms(pairs, ["chunk_index"], words).count() == 2


def test_short_phrases_match_whole_words_as_in_sql(spark, tmp_path):
    """A phrase of two letters is as short as a word of three, and is found between word ends only."""
    texts = ["la a a.", "a ab", "ba a", "A A", "a a a", "é a aé", "(a a)", "none"]
    for name, key, rows in (("documents", "doc_id", texts), ("benchmark", "item_id", ["a a", "ab. la la"])):
        spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    query = "match_phrases_and_short_words"
    frame = entry.queries()[query](spark, str(tmp_path))
    found = [tuple(r) for r in frame.collect()]
    assert sorted(d for d, t in found if t == "a a") == [0, 3, 4, 6]
    assert difference(frame.columns, found, *rows_of_sql(connection, entry.oracle_sql()[query])) is None


def test_a_wording_of_many_terms_is_looked_for_once(spark, monkeypatch, rows):
    """Terms that share an alternative: their translations hold it once, however many the terms are."""
    found = {}

    def recorded(texts, keys, text, patterns, pattern_id):
        hits = find_patterns(texts, keys, text, patterns, pattern_id)
        found[pattern_id] = hits.count()
        return hits

    monkeypatch.setattr(quality, "find_patterns", recorded)
    terms_ = dictionary(spark, *[(f"there{c}", f"there{c}", ["ther", " "], "General", True) for c in "abcd"], ("blank", " ", [], "General", True))
    pairs = spark.createDataFrame(
        [(1, "therea thereb therec", "other thereb"), (2, "thered blank", "none")], "k int, source_text string, translation string"
    )
    usage = quality.term_usage(pairs, ["k"], terms_)
    assert rows(usage.select("k", "id", "variant", "found")) == [
        (1, 1, "alternative", "ther"), (1, 2, "preferred", "thereb"), (1, 3, "alternative", "ther"),
        (2, 4, "other", None), (2, 5, "other", None),
    ]
    # "ther" and "thereb" in the first translation, not one row a term.
    assert sum(found.values()) == 5 + 2
