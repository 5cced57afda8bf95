"""Queries over dictionaries, memory, context and quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F


from glossaflow.operators import context, memory, quality, terms
from glossaflow.plans import views as V
from glossaflow.plans.views import _WS, with_views

#: Terms that go with a prompt.
PROMPT_TERMS = 60
# Our own default entries.
DEFAULTS = (
    ("glossary", "Education"),
    ("Syntax", "Linguistics"),
    ("that", "General"),
    ("THERE", "custom"),
    ("there", "Custom"),
)


def _match(spark, folder):
    return terms.match_terms(
        V.documents(spark, folder), ["doc_id"], "text", V.terms(spark, folder)
    )


def _phrase_terms(spark, folder):
    """Short words and two-word phrases of the benchmark as terms."""
    found = lambda pattern: V.table(spark, folder, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("english")
    )
    phrases = found("[a-z]+ [a-z]+").unionByName(found("[a-z]+").where(F.length("english") < 4))
    return phrases.distinct().select(F.col("english").alias("id"), "english")


def _match_phrases(spark, folder):
    return terms.match_terms(
        V.documents(spark, folder), ["doc_id"], "text", _phrase_terms(spark, folder)
    )


def _relevant(spark, folder):
    return terms.relevant_terms(
        V.documents(spark, folder), ["doc_id"], "text", V.terms(spark, folder), ["General", "Custom"]
    ).select("doc_id", "rank", "id", "english")


def _job_settings(rows, key):
    """Settings of a job by its number: which dictionaries it asks for."""
    k = F.col(key)
    domain = F.when(k % 3 == 0, "General").when(k % 3 == 1, "Custom").otherwise("")
    return rows.withColumn(
        "domains", terms.select_domains(k % 2 == 0, domain, k % 5 != 0, k % 7 == 0)
    )


def _domains(spark, folder):
    return _job_settings(V.jobs(spark, folder), "id").select(
        "id", F.array_join("domains", "|").alias("domains")
    )


def _relevant_by_job(spark, folder):
    texts = _job_settings(V.pairs(spark, folder), "job_id")
    return terms.relevant_terms(
        texts, ["job_id", "chunk_index"], "source_text", V.terms(spark, folder), "domains"
    ).select("job_id", "chunk_index", "rank", "id", "english", "domain")


def _term_list(spark, folder):
    return terms.list_terms(V.terms(spark, folder), search=" TH", domain="General", active=True, limit=20, offset=5).select(
        "id", "english", "total"
    )


def _seed(spark, folder):
    defaults = spark.createDataFrame(
        [(i, e, e, [], d, "", "normal", True) for i, (e, d) in enumerate(DEFAULTS, start=1)],
        V.terms(spark, folder).select(
            "id", "english", "preferred", "alternatives", "domain", "definition", "priority", "active"
        ).schema,
    )
    return terms.seed_terms(V.terms(spark, folder), defaults).select("id", "english", "domain")


def _changes(spark, folder):
    """Every term is changed in some way: deleted, moved, renamed, or created anew."""
    kind = F.length("english") % 4
    op = F.when(kind == 0, "delete").when(kind == 3, "create").otherwise("update")
    return V.terms(spark, folder).select(
        F.col("id").alias("change_id"),
        op.alias("op"),
        "id",
        F.when(kind == 1, F.upper("english"))
        .when(kind == 3, F.concat("english", F.lit(" new")))
        .alias("english"),
        F.lit(None).cast("string").alias("preferred"),
        F.lit(None).cast("array<string>").alias("alternatives"),
        F.when(kind == 2, "Moved").when(kind == 3, "General").alias("domain"),
        F.lit(None).cast("string").alias("definition"),
        F.lit("high").alias("priority"),
        F.lit(None).cast("boolean").alias("active"),
    )


def _changed(spark, folder):
    after, _ = terms.apply_term_changes(V.terms(spark, folder), _changes(spark, folder))
    return after.select("id", "english", "domain", "priority")


def _refused(spark, folder):
    """Creating every term again in the other case is refused."""
    again = V.terms(spark, folder).withColumns(
        {"change_id": F.col("id"), "op": F.lit("create"), "english": F.upper("english")}
    )
    _, refused = terms.apply_term_changes(V.terms(spark, folder), again)
    return refused


def _tm(spark, folder):
    return V.memory(spark, folder).select("id", "source_hash", "source_text", "target_text", "use_count")


def _upsert(spark, folder):
    """The memory of all documents, then all documents again together with all turns."""
    first = memory.build_tm(V.memory_pairs(spark, folder), [F.col("doc_id")])
    again = V.memory_pairs(spark, folder).select("doc_id", "source_text", "translation")
    turns = V.pairs(spark, folder).select(
        (F.col("job_id") * 1000 + F.col("chunk_index") + 1000000000).alias("doc_id"),
        "source_text",
        "translation",
    )
    batch = memory.build_tm(again.unionByName(turns), [F.col("doc_id")])
    return memory.upsert_tm(first, batch).select("source_hash", "target_text", "use_count")


def _exact(spark, folder):
    """Documents with doubled spaces are still found; every fourth is changed and is not."""
    spaced = F.replace("text", F.lit(" "), F.lit("  "))
    changed = F.concat("text", F.lit(" is changed"))
    texts = V.documents(spark, folder).select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, changed).otherwise(spaced).alias("text")
    )
    return memory.tm_exact(texts, ["doc_id"], "text", V.memory(spark, folder)).select(
        "doc_id", F.length("target").alias("target_chars"), "similarity"
    )


def _known_turns(spark, folder):
    return memory.build_tm(V.pairs(spark, folder), [F.col("job_id"), F.col("chunk_index")]).select(
        "*",
        (F.col("first_seen.job_id") * 1000 + F.col("first_seen.chunk_index")).alias("id"),
        F.lit(True).alias("approved"),
    )


def _changed_turns(spark, folder):
    """Users' turns with changed ends."""
    return V.pairs(spark, folder).select(
        "job_id",
        "chunk_index",
        F.concat(F.lit("again: "), "source_text", F.lit(" so it ends.")).alias("text"),
    )


def _similar(operator):
    """Changed turns against the memory of all turns."""
    return lambda spark, folder: operator(
        _changed_turns(spark, folder), ["job_id", "chunk_index"], "text", _known_turns(spark, folder)
    ).select("job_id", "chunk_index", "rank", "id", "similarity")


def _lookup(spark, folder):
    """The same, with every third turn only spaced anew, so that it has an exact entry."""
    k = F.col("job_id") + F.col("chunk_index")
    changed = F.concat(F.lit("again: "), "source_text", F.lit(" so it ends."))
    texts = V.pairs(spark, folder).select(
        "job_id", "chunk_index", F.when(k % 3 == 0, F.replace("source_text", F.lit(" "), F.lit("  "))).otherwise(changed).alias("text")
    )
    found = memory.lookup(texts, ["job_id", "chunk_index"], "text", _known_turns(spark, folder), matches=3)
    return found.select(
        "job_id", "chunk_index", "rank", "exact", "similarity", F.length("target").alias("target_chars")
    )


def _neighbours(spark, folder):
    return context.neighbour_context(V.pairs(spark, folder), budget=200).select(
        "job_id", "chunk_index", "previous_text", "previous_translation", "next_text"
    )


def _all_turns(spark, folder):
    """Every turn of a conversation as a chunk, so that neighbours exist."""
    return V.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("job_id"),
        F.col("turn").alias("chunk_index"),
        F.col("text").alias("source_text"),
        F.when(F.col("role") == "assistant", F.lower("text")).alias("translation"),
    )


def _context(spark, folder):
    return context.neighbour_context(_all_turns(spark, folder), budget=200).select(
        "job_id", "chunk_index", "previous_text", "previous_translation", "next_text"
    )


def _prompts(spark, folder):
    keys = ["job_id", "chunk_index"]
    chunks = context.neighbour_context(_all_turns(spark, folder), budget=200).withColumns(
        {
            "title": F.concat(F.lit("Talk "), F.col("job_id").cast("string")),
            "chapter": F.lit("One"),
            "section": F.lit(""),
            "domain": F.lit("General"),
            "style": F.lit("Plain"),
            "target_language": F.lit("Arabic"),
        }
    )
    found = terms.relevant_terms(
        chunks.select(*keys, "source_text"), keys, "source_text", V.terms(spark, folder), ["General"], cap=PROMPT_TERMS
    )
    remembered = memory.tm_exact(
        chunks.select(*keys, "source_text"), keys, "source_text",
        memory.build_tm(V.pairs(spark, folder), [F.col("job_id"), F.col("chunk_index")]).withColumn("approved", F.lit(True)),
    ).withColumn("rank", F.lit(1))
    return context.build_prompts(
        chunks, context.terms_section(found, keys), context.memory_section(remembered, keys), keys
    ).select(*keys, "prompt", F.length("system").alias("system_chars"), "prompt_version")


def _validate(spark, folder):
    """Answers as translations; source sides are repeated to reach the length and language checks."""
    checked = quality.validate_translations(_varied_pairs(spark, folder), script="[éèêçñóíäöüß]")
    return checked.drop("source_text", "translation")


def _varied_pairs(spark, folder):
    k = (F.col("job_id") + F.col("chunk_index")) % 6
    return V.pairs(spark, folder).withColumns(
        {
            "source_text": F.when(k == 3, F.replace("source_text", F.lit(" "), F.lit(" | ")))
            .when(k == 4, F.replace("source_text", F.lit(". "), F.lit(".\n\n")))
            .when(k == 5, F.lit("a | b\nc | d\ne | f"))
            .otherwise(F.col("source_text")),
            "translation": F.when(k == 0, " ")
            .when(k == 1, "short answer")
            .when(k == 5, F.concat(F.lit("[1] one | two\n[2] three | four\n[3] five "), "job_id"))
            .otherwise(F.col("translation")),
        }
    )


def _job_pairs(spark, folder):
    return _job_settings(V.pairs(spark, folder), "job_id")


def _check_terms(spark, folder):
    return quality.check_terms(
        _job_pairs(spark, folder), ["job_id", "chunk_index"], V.terms(spark, folder), domains="domains"
    ).drop("expected")


def _usage(spark, folder):
    return quality.term_usage(
        _job_pairs(spark, folder), ["job_id", "chunk_index"], V.terms(spark, folder), "domains"
    )


def _report(spark, folder):
    report = quality.consistency_report(_usage(spark, folder), V.terms(spark, folder), "chunk_index", "job_id")
    return report.select(
        "job_id",
        "id",
        "english",
        "variant_count",
        "chunk_count",
        "consistent",
        "inconsistent",
        F.array_join("chunks_without_preferred", ",").alias("without"),
        F.array_join(
            F.transform("wordings", lambda w: F.concat(w["label"], F.lit(":"), F.array_join(w["first_chunks"], ","))), ";"
        ).alias("wordings"),
    )


def _complete(rows, jobs=None):
    return quality.completeness(rows, jobs=jobs).withColumns(
        {
            "missing_indexes": F.array_join("missing_indexes", ","),
            "duplicate_indexes": F.array_join("duplicate_indexes", ","),
        }
    )


def _completeness(spark, folder):
    return _complete(V.order_chunks(spark, folder))


def _event_completeness(spark, folder):
    """Customers and users are jobs; some have no event."""
    users = V.table(spark, folder, "events").select(F.col("user_id").alias("id"))
    jobs = users.unionByName(V.job_documents(spark, folder).select("id"))
    chunks = V.event_chunks(spark, folder).withColumn("translation", F.col("chapter"))
    return _complete(chunks, jobs)


def _quality(spark, folder):
    """Conversations are jobs; those without a pair of turns have no chunk."""
    pairs = V.pairs(spark, folder).withColumn("status", F.lit("completed"))
    jobs = V.table(spark, folder, "conversations").select(F.col("conv_id").alias("id"))
    report = quality.consistency_report(_usage(spark, folder), V.terms(spark, folder), "chunk_index", "job_id")
    return quality.quality_report(
        quality.completeness(pairs, jobs=jobs), quality.consistency_totals(report, "job_id")
    ).select(
        "job_id", "total_chunks", "completed_chunks", "failed_chunks", "empty_translations", "terminology.*",
        F.array_join("missing_indexes", ",").alias("missing"),
    )


def _job_usage(spark, folder):
    chunks = V.order_chunks(spark, folder).withColumn("source_text", F.coalesce("error_message", F.lit("text")))
    return quality.usage_report(
        chunks.withColumn("translation", F.translate("translation", "13579", "ابتثج"))
    ).withColumn("avg_attempts", F.round("avg_attempts", 6)).withColumn("source_words", F.round("source_words", 6))


_USAGE_SQL = """usage AS (
    SELECT job_id, chunk_index, id, english,
           CASE WHEN contains(t, english) THEN 'preferred' WHEN contains(t, alternative) THEN 'alternative' ELSE 'other' END AS variant,
           CASE WHEN contains(t, english) THEN english WHEN contains(t, alternative) THEN alternative END AS found
    FROM (SELECT *, regexp_replace(translation, '[{ws}]+', ' ', 'g') AS t FROM v_pairs) p
    JOIN v_terms ON contains(lower(source_text), english) AND active AND
      ((domain = 'General' AND job_id % 2 = 0) OR
       (domain = 'Custom' AND (job_id % 7 = 0 OR (job_id % 3 = 1 AND job_id % 5 <> 0)))))""".replace("{ws}", _WS)

_REPORT_SQL = f"""{_USAGE_SQL},
    labelled AS (SELECT *, CASE variant WHEN 'preferred' THEN english WHEN 'alternative' THEN 'alt: ' || found ELSE 'other' END AS label FROM usage),
    variants AS (SELECT job_id, id, english, label, count(*) AS n,
                        string_agg(CAST(chunk_index AS VARCHAR), ',' ORDER BY chunk_index) AS firsts
                 FROM labelled GROUP BY ALL),
    report AS (SELECT job_id, id, english, count(*) AS variant_count, CAST(sum(n) AS BIGINT) AS chunk_count,
                      count(*) = 1 AND max(label) <> 'other' AS consistent, count(*) > 1 AS inconsistent,
                      max(CASE WHEN label = 'other' THEN firsts END) AS without,
                      string_agg(label || ':' || firsts, ';' ORDER BY label) AS wordings
               FROM variants GROUP BY job_id, id, english)"""


def _completeness_sql(chunks: str, jobs: str = "") -> str:
    """``jobs`` selects job_id of all jobs; without it, jobs are those of the chunks."""
    every = f"""
      UNION ALL SELECT job_id, 0, 0, 0, 0, 'none', '', ''
      FROM (SELECT DISTINCT job_id FROM ({jobs})) WHERE job_id NOT IN (SELECT job_id FROM c)""" if jobs else ""
    return f"""
    c AS (SELECT job_id, count(*) AS total_chunks, count(DISTINCT chunk_index) AS d, min(chunk_index) AS lo, max(chunk_index) AS hi,
                 count(*) FILTER (WHERE status = 'completed') AS completed_chunks,
                 count(*) FILTER (WHERE status = 'failed') AS failed_chunks,
                 count(*) FILTER (WHERE trim(coalesce(translation, ''), '{_WS}') = '') AS empty_translations
          FROM {chunks} GROUP BY job_id),
    m AS (SELECT c.job_id, i
          FROM c, unnest(range(total_chunks)) AS u(i)
          WHERE NOT EXISTS (SELECT 1 FROM {chunks} x WHERE x.job_id = c.job_id AND x.chunk_index = i)),
    r AS (SELECT job_id, chunk_index AS i
          FROM {chunks} GROUP BY job_id, chunk_index HAVING count(*) > 1),
    complete AS (
      SELECT job_id, total_chunks, completed_chunks, failed_chunks, empty_translations,
             CASE WHEN d <> total_chunks OR lo <> 0 OR hi <> total_chunks - 1 THEN 'sequence'
                  WHEN failed_chunks > 0 THEN 'failed' WHEN completed_chunks < total_chunks THEN 'pending'
                  WHEN empty_translations > 0 THEN 'empty' END AS reason,
             coalesce((SELECT string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FROM m WHERE m.job_id = c.job_id), '') AS missing_indexes,
             coalesce((SELECT string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FROM r WHERE r.job_id = c.job_id), '') AS duplicate_indexes
      FROM c{every})"""


#: The given texts' letters beyond ASCII, for an edit distance that counts bytes.
_LETTERS = "ßäçèéêíñóöü"


def _fuzzy_sql(text: str, overlap: bool = False) -> str:
    """All texts against all entries of the memory of turns, by edit distance or by shared word pairs."""
    form = f"lower(regexp_replace(trim({{}}, '{_WS}'), '[{_WS}]+', ' ', 'g'))"
    pairs = """list_distinct(list_transform(range(1, greatest(len({0}), 2)), lambda i: [{0}[i], {0}[i + 1]]))"""
    ascii_ = f"translate({{}}, '{_LETTERS}', '{''.join(chr(65 + k) for k in range(len(_LETTERS)))}')"
    shared = "2.0::DOUBLE * len(list_intersect(aw.p, ew.p)) / (len(aw.p) + len(ew.p))"
    edited = "1 - levenshtein(aw.a, ew.a)::DOUBLE / greatest(length(aw.a), length(ew.a))"
    return f"""
    e AS (SELECT sha256({form.format('source_text')}) AS h, {form.format('source_text')} AS f, job_id * 1000 + chunk_index AS o,
                 trim(translation, '{_WS}') AS t FROM v_pairs
          WHERE trim(source_text, '{_WS}') <> '' AND trim(translation, '{_WS}') <> ''),
    entries AS (SELECT h, min(o) AS id, arg_min(t, o) AS tgt, arg_min(f, o) AS f, string_split(any_value(f), ' ') AS w FROM e GROUP BY h),
    ew AS (SELECT *, {pairs.format('w')} AS p, {ascii_.format('f')} AS a FROM entries),
    asked AS (SELECT job_id, chunk_index, {form.format('x')} AS f, sha256({form.format('x')}) AS h
              FROM (SELECT job_id, chunk_index, {text} AS x FROM v_pairs)),
    aw AS (SELECT job_id, chunk_index, {pairs.format('w')} AS p, {ascii_.format('f')} AS a
           FROM (SELECT *, string_split(f, ' ') AS w FROM asked WHERE h NOT IN (SELECT h FROM entries))),
    scored AS (SELECT job_id, chunk_index, id, {shared if overlap else edited} AS similarity FROM aw CROSS JOIN ew),
    fuzzy AS (SELECT *, row_number() OVER (PARTITION BY job_id, chunk_index ORDER BY similarity DESC, id DESC) AS rank
              FROM scored WHERE similarity >= 0.72)"""


_TURNS_SQL = """turns AS (
    SELECT conv_id AS job_id, turn AS chunk_index, text AS source_text,
           CASE WHEN role = 'assistant' THEN lower(text) END AS translation FROM conversations)"""
_CONTEXT_SQL = f"""{_TURNS_SQL}, ctx AS (
    SELECT t.*, right(p.source_text, 200) AS previous_text, right(p.translation, 100) AS previous_translation,
           left(n.source_text, 100) AS next_text
    FROM turns t LEFT JOIN turns p ON p.job_id = t.job_id AND p.chunk_index = t.chunk_index - 1
                 LEFT JOIN turns n ON n.job_id = t.job_id AND n.chunk_index = t.chunk_index + 1)"""

_VALIDATE_SQL = f"""
    v AS (SELECT job_id, chunk_index,
             CASE (job_id + chunk_index) % 6 WHEN 3 THEN replace(source_text, ' ', ' | ')
               WHEN 4 THEN replace(source_text, '. ', '.' || chr(10) || chr(10))
               WHEN 5 THEN 'a | b' || chr(10) || 'c | d' || chr(10) || 'e | f' ELSE source_text END AS s,
             CASE (job_id + chunk_index) % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'short answer'
               WHEN 5 THEN '[1] one | two' || chr(10) || '[2] three | four' || chr(10) || '[3] five ' || job_id ELSE translation END AS o
          FROM v_pairs),
    f AS (SELECT job_id, chunk_index, trim(o, '{_WS}') = '' AS is_empty,
             length(trim(o, '{_WS}')) < greatest(10::DOUBLE, length(trim(s, '{_WS}')) * 0.25::DOUBLE) AS is_short,
             contains(s, ' | ') AND (job_id + chunk_index) % 6 <> 5 AS markers_differ,
             (job_id + chunk_index) % 6 = 5 AS cells_differ,
             len(list_filter(regexp_split_to_array(o, '\\n[{_WS}]*\\n'), lambda p: trim(p, '{_WS}') <> '')) AS po,
             len(list_filter(regexp_split_to_array(s, '\\n[{_WS}]*\\n'), lambda p: trim(p, '{_WS}') <> '')) AS ps,
             len(regexp_extract_all(s, '[A-Za-z]{{3,}}')) >= 8 AND NOT regexp_matches(o, '[éèêçñóíäöüß]') AS wrong_script
          FROM v),
    g AS (SELECT *, po > 0 AND ps > 0 AND po < greatest(1, ps - 1) AS paragraphs_lost FROM f)"""

_CHANGED_SQL = """
    SELECT id, CASE WHEN length(english) % 4 = 1 THEN upper(english) ELSE english END AS english,
           CASE WHEN length(english) % 4 = 2 THEN 'Moved' ELSE domain END AS domain,
           CASE WHEN length(english) % 4 = 3 THEN 'normal' ELSE 'high' END AS priority
    FROM v_terms WHERE length(english) % 4 <> 0
    UNION ALL
    SELECT (SELECT max(id) FROM v_terms) + id, english || ' new', 'General', 'high' FROM v_terms WHERE length(english) % 4 = 3"""

QUERIES = {
    "match_terms": (
        _match,
        with_views("SELECT doc_id, id FROM documents JOIN v_terms ON contains(lower(text), english)", "v_terms"),
    ),
    "match_phrases_and_short_words": (
        _match_phrases,
        f"""WITH b AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+ [a-z]+')) AS id FROM benchmark UNION
                      SELECT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) WHERE length(w) < 4),
            d AS (SELECT doc_id, lower(text) AS t FROM documents),
            w AS (SELECT doc_id, list_distinct(string_split_regex(t, '[^\\p{{L}}\\p{{N}}_]+')) AS words, t FROM d)
            SELECT doc_id, id FROM w JOIN b ON CASE WHEN length(id) >= 4 THEN contains(t, id)
                 WHEN NOT contains(id, ' ') THEN list_contains(words, id)
                 WHEN contains(t, id) THEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])' || id || '($|[^\\p{{L}}\\p{{N}}_])')
                 ELSE false END""",
    ),
    "relevant_terms": (
        _relevant,
        with_views(
            """SELECT doc_id, rank, id, english FROM (
                 SELECT doc_id, id, english, row_number() OVER (PARTITION BY doc_id ORDER BY length(english) DESC, id) AS rank
                 FROM documents JOIN v_terms ON contains(lower(text), english) WHERE active)""",
            "v_terms",
        ),
    ),
    "select_domains": (
        _domains,
        with_views(
            """SELECT id, concat_ws('|', CASE WHEN id % 2 = 0 THEN 'General' END,
                      CASE WHEN id % 5 <> 0 AND id % 3 = 1 THEN 'Custom' END, CASE WHEN id % 7 = 0 THEN 'Custom' END) AS domains
               FROM v_jobs""",
            "v_jobs",
        ),
    ),
    "relevant_terms_by_job": (
        _relevant_by_job,
        with_views(
            """SELECT job_id, chunk_index, rank, id, english, domain FROM (
                 SELECT *, row_number() OVER (PARTITION BY job_id, chunk_index ORDER BY length(english) DESC, id) AS rank
                 FROM v_pairs JOIN v_terms ON contains(lower(source_text), english)
                 WHERE active AND ((job_id % 2 = 0 AND domain = 'General') OR
                   (domain = 'Custom' AND (job_id % 7 = 0 OR (job_id % 3 = 1 AND job_id % 5 <> 0)))))""",
            "v_pairs",
            "v_terms",
        ),
    ),
    "list_terms": (
        _term_list,
        with_views(
            """SELECT id, english, (SELECT count(*) FROM v_terms WHERE english ILIKE '%TH%' AND domain = 'General' AND active) AS total
               FROM v_terms WHERE english ILIKE '%TH%' AND domain = 'General' AND active ORDER BY english, id LIMIT 20 OFFSET 5""",
            "v_terms",
        ),
    ),
    "term_domains": (
        lambda s, f: terms.term_domains(V.terms(s, f)),
        with_views("SELECT DISTINCT domain FROM v_terms", "v_terms"),
    ),
    "terms_for_domains": (
        lambda s, f: terms.terms_for_domains(V.terms(s, f), ["Custom"]).select("id", "english"),
        with_views("SELECT id, english FROM v_terms WHERE active AND domain = 'Custom'", "v_terms"),
    ),
    "seed_terms": (
        _seed,
        with_views(
            """d(i, e, dom) AS (VALUES (1, 'glossary', 'Education'), (2, 'Syntax', 'Linguistics'), (3, 'that', 'General'),
                                      (4, 'THERE', 'custom'), (5, 'there', 'Custom'))
               SELECT id, english, domain FROM v_terms UNION ALL
               SELECT (SELECT max(id) FROM v_terms) + i, e, dom FROM d
               WHERE NOT EXISTS (SELECT 1 FROM v_terms WHERE lower(english) = lower(e) AND lower(domain) = lower(dom))
                 AND NOT EXISTS (SELECT 1 FROM d x WHERE x.i < d.i AND lower(x.e) = lower(d.e) AND lower(x.dom) = lower(d.dom))""",
            "v_terms",
        ),
    ),
    "apply_term_changes": (_changed, with_views(_CHANGED_SQL, "v_terms")),
    "refused_term_changes": (
        _refused,
        with_views("SELECT id AS change_id, 'create' AS op, 'duplicate' AS reason FROM v_terms", "v_terms"),
    ),
    "build_tm": (
        _tm,
        with_views("SELECT id, source_hash, source_text, target_text, use_count FROM v_tm", "v_tm"),
    ),
    "upsert_tm": (
        _upsert,
        with_views(
            f"""n AS (SELECT sha256(lower(regexp_replace(trim(source_text, '{_WS}'), '[{_WS}]+', ' ', 'g'))) AS source_hash,
                            job_id * 1000 + chunk_index AS o, trim(translation, '{_WS}') AS t FROM v_pairs
                     WHERE trim(source_text, '{_WS}') <> '' AND trim(translation, '{_WS}') <> ''),
                p AS (SELECT source_hash, arg_min(t, o) AS t, count(*) AS n FROM n GROUP BY source_hash)
               SELECT coalesce(v.source_hash, p.source_hash) AS source_hash, coalesce(target_text, t) AS target_text,
                      CASE WHEN target_text IS NULL THEN p.n - 1 ELSE use_count + use_count + 1 + coalesce(p.n, 0) END AS use_count
               FROM v_tm v FULL JOIN p ON v.source_hash = p.source_hash""",
            "v_tm",
            "v_pairs",
        ),
    ),
    "search_tm": (
        lambda s, f: memory.search_tm(V.memory(s, f), "TION", limit=15, offset=3).select("id", "use_count", "total"),
        with_views(
            """SELECT id, use_count, (SELECT count(*) FROM v_tm WHERE source_text ILIKE '%tion%' OR target_text ILIKE '%tion%') AS total
               FROM v_tm WHERE source_text ILIKE '%tion%' OR target_text ILIKE '%tion%' ORDER BY id DESC LIMIT 15 OFFSET 3""",
            "v_tm",
        ),
    ),
    "tm_stats": (
        lambda s, f: memory.tm_stats(V.memory(s, f)),
        with_views("SELECT count(*) AS total_entries FROM v_tm", "v_tm"),
    ),
    "delete_tm": (
        lambda s, f: memory.delete_tm(
            V.memory(s, f), V.table(s, f, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
        ).select("id", "source_hash"),
        with_views(
            "SELECT id, source_hash FROM v_tm WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", "v_tm"
        ),
    ),
    "tm_exact": (
        _exact,
        with_views(
            """SELECT doc_id, length(target_text) AS target_chars, 1.0 AS similarity
               FROM v_hash JOIN v_tm USING (source_hash) WHERE doc_id % 4 <> 0""",
            "v_hash",
            "v_tm",
        ),
    ),
    "tm_fuzzy": (
        _similar(memory.tm_fuzzy),
        with_views(
            f"""{_fuzzy_sql("'again: ' || source_text || ' so it ends.'")}
            SELECT job_id, chunk_index, rank, id, similarity FROM fuzzy""",
            "v_pairs",
        ),
    ),
    "tm_overlap": (
        _similar(memory.tm_overlap),
        with_views(
            f"""{_fuzzy_sql("'again: ' || source_text || ' so it ends.'", overlap=True)}
            SELECT job_id, chunk_index, rank, id, similarity FROM fuzzy""",
            "v_pairs",
        ),
    ),
    "tm_lookup": (
        _lookup,
        with_views(
            f"""{_fuzzy_sql("CASE WHEN (job_id + chunk_index) % 3 = 0 THEN replace(source_text, ' ', '  ') ELSE 'again: ' || source_text || ' so it ends.' END")}
            SELECT job_id, chunk_index, 1 AS rank, true AS exact, 1.0 AS similarity, length(tgt) AS target_chars
            FROM asked JOIN entries USING (h)
            UNION ALL
            SELECT job_id, chunk_index, rank, false, similarity, length(tgt) FROM fuzzy JOIN entries USING (id) WHERE rank <= 3""",
            "v_pairs",
        ),
    ),
    "neighbour_context": (
        _context,
        f"WITH {_CONTEXT_SQL} SELECT job_id, chunk_index, previous_text, previous_translation, next_text FROM ctx",
    ),
    "neighbour_context_with_gaps": (
        _neighbours,
        with_views(
            """SELECT t.job_id, t.chunk_index, right(p.source_text, 200) AS previous_text,
                      right(p.translation, 100) AS previous_translation, left(n.source_text, 100) AS next_text
               FROM v_pairs t LEFT JOIN v_pairs p ON p.job_id = t.job_id AND p.chunk_index = t.chunk_index - 1
                              LEFT JOIN v_pairs n ON n.job_id = t.job_id AND n.chunk_index = t.chunk_index + 1""",
            "v_pairs",
        ),
    ),
    "build_prompts": (
        _prompts,
        with_views(
            f"""{_CONTEXT_SQL},
            rel AS (SELECT job_id, chunk_index, string_agg('- ' || english || ' = ' || english || ' (also: ' || alternative || ')', chr(10) ORDER BY k) AS terms_text
                    FROM (SELECT job_id, chunk_index, english, alternative,
                                 row_number() OVER (PARTITION BY job_id, chunk_index ORDER BY length(english) DESC, id) AS k
                          FROM turns JOIN v_terms ON contains(lower(source_text), english) WHERE active AND domain = 'General')
                    WHERE k <= 60 GROUP BY job_id, chunk_index),
            hp AS (SELECT *, sha256(lower(regexp_replace(trim(source_text, '{_WS}'), '[{_WS}]+', ' ', 'g'))) AS h FROM v_pairs
                   WHERE trim(source_text, '{_WS}') <> '' AND trim(translation, '{_WS}') <> ''),
            mem AS (SELECT h, trim(arg_min(source_text, (job_id, chunk_index)), '{_WS}') AS src,
                           trim(arg_min(translation, (job_id, chunk_index)), '{_WS}') AS tgt FROM hp GROUP BY h),
            m AS (SELECT job_id, chunk_index, '- ' || src || chr(10) || '  -> ' || tgt AS memory_text
                  FROM turns JOIN mem ON h = sha256(lower(regexp_replace(trim(source_text, '{_WS}'), '[{_WS}]+', ' ', 'g'))))
            SELECT job_id, chunk_index, '1' AS prompt_version,
              360 AS system_chars,
              concat_ws(chr(10) || chr(10),
                '== DOCUMENT ==' || chr(10) || concat_ws(chr(10), 'Title: Talk ' || job_id, 'Chapter: One', 'Field: General', 'Style: Plain'),
                '== TERMS ==' || chr(10) || terms_text,
                '== EARLIER TRANSLATIONS ==' || chr(10) || memory_text,
                '== TEXT BEFORE (do not translate) ==' || chr(10) || nullif(previous_text, ''),
                '== YOUR TRANSLATION BEFORE ==' || chr(10) || nullif(previous_translation, ''),
                '== TEXT AFTER (do not translate) ==' || chr(10) || nullif(next_text, ''),
                '== TEXT ==' || chr(10) || source_text) AS prompt
            FROM ctx LEFT JOIN rel USING (job_id, chunk_index) LEFT JOIN m USING (job_id, chunk_index)""",
            "v_pairs",
            "v_terms",
        ),
    ),
    "validate_translations": (
        _validate,
        with_views(
            f"""{_VALIDATE_SQL}
            SELECT job_id, chunk_index, is_empty, is_short, markers_differ, cells_differ, paragraphs_lost, wrong_script,
                   CASE WHEN is_empty THEN 'empty' WHEN is_short THEN 'short' WHEN markers_differ THEN 'markers'
                        WHEN cells_differ THEN 'cells' WHEN paragraphs_lost THEN 'paragraphs' WHEN wrong_script THEN 'language' END AS reason
            FROM g""",
            "v_pairs",
        ),
    ),
    "term_usage": (
        _usage,
        with_views(f"{_USAGE_SQL} SELECT job_id, chunk_index, id, variant, found FROM usage", "v_pairs", "v_terms"),
    ),
    "check_terms": (
        _check_terms,
        with_views(
            f"""{_USAGE_SQL}
            SELECT job_id, chunk_index, id, CASE variant WHEN 'alternative' THEN 'alternative_used' ELSE 'preferred_missing' END AS issue,
                   english, found
            FROM usage WHERE variant <> 'preferred'""",
            "v_pairs",
            "v_terms",
        ),
    ),
    "consistency_report": (
        _report,
        with_views(f"{_REPORT_SQL} SELECT * FROM report", "v_pairs", "v_terms"),
    ),
    "completeness": (
        _completeness,
        with_views(f"{_completeness_sql('v_order_chunks')} SELECT * FROM complete", "v_order_chunks"),
    ),
    "completeness_of_event_jobs": (
        _event_completeness,
        with_views(
            f"""e AS (SELECT job_id, chunk_index, status, chapter AS translation FROM v_event_chunks),
            {_completeness_sql('e', 'SELECT user_id AS job_id FROM events UNION ALL SELECT c_custkey FROM customer')}
            SELECT * FROM complete""",
            "v_event_chunks",
        ),
    ),
    "quality_report": (
        _quality,
        with_views(
            f"""{_REPORT_SQL}, p AS (SELECT *, 'completed' AS status FROM v_pairs),
            {_completeness_sql('p', 'SELECT conv_id AS job_id FROM conversations')},
            t AS (SELECT job_id, count(*) AS terms_used, count(*) FILTER (WHERE consistent) AS consistent_terms,
                         count(*) FILTER (WHERE inconsistent) AS inconsistent_terms FROM report GROUP BY job_id)
            SELECT job_id, total_chunks, completed_chunks, failed_chunks, empty_translations,
                   coalesce(terms_used, 0) AS terms_used, coalesce(consistent_terms, 0) AS consistent_terms,
                   coalesce(inconsistent_terms, 0) AS inconsistent_terms, missing_indexes AS missing
            FROM complete LEFT JOIN t USING (job_id)""",
            "v_pairs",
            "v_terms",
        ),
    ),
    "preferred_presence": (
        lambda s, f: quality.preferred_presence(V.pairs(s, f), V.terms(s, f)),
        with_views(
            "SELECT DISTINCT job_id, id FROM v_pairs JOIN v_terms ON contains(translation, english)",
            "v_pairs",
            "v_terms",
        ),
    ),
    "usage_report": (
        _job_usage,
        with_views(
            """SELECT job_id, CAST(sum(prompt_tokens_used) AS BIGINT) AS prompt_tokens,
                      CAST(sum(completion_tokens_used) AS BIGINT) AS completion_tokens,
                      round(avg(attempts), 6) AS avg_attempts,
                      count(*) FILTER (WHERE regexp_matches(translation, '[13579]')) AS target_words,
                      round(sum(length(coalesce(error_message, 'text'))) / 6.0::DOUBLE, 6) AS source_words
               FROM v_order_chunks GROUP BY job_id""",
            "v_order_chunks",
        ),
    ),
}
