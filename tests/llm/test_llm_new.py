"""Cuts by repeated captures, MinHash postings and whitening: cases and plain versions."""

import hashlib
import math

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from glossaflow.llm import fill_middle, minhash, queries, whitening
from glossaflow.llm.common import prepare

FOLDER = "/root/testdata/sf0.001"
TEXTS = "doc_id bigint, text string"


# Fill in the middle ---------------------------------------------------------------------------------


def cut_plainly(number, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if number is None else number}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_middle_cases(spark):
    prepare(spark)
    texts = [None, "", "a", "héllo wörld", "<P>x", "a<S>", "\n\n", "𝒳𝒴" * 40, "<P", "P>", "<<P>", "x " * 300_000, "same", "same"]
    given = [(k if k != 5 else None, texts[k % len(texts)], k) for k in range(20 * len(texts))]
    docs = spark.createDataFrame(given, "doc_id bigint, text string, n int")
    rows = fill_middle.transform(docs).withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(given) and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    texts_of = {number: text for number, text, _ in given}
    for r in rows:
        wanted = cut_plainly(r["doc_id"], texts_of[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == wanted
        assert r["again"] == (texts_of[r["doc_id"]] or "")


def test_fill_middle_other_units(spark):
    docs = spark.createDataFrame([(k, f"  one two\tthree {k} ") for k in range(60)], TEXTS)
    for unit in (fill_middle.WORD, fill_middle.CLUSTER):
        for r in fill_middle.transform(docs, unit=unit, fim_percent=100).collect():
            ends = [0] + [m.end() for m in regex.finditer(unit, r["text"])]
            assert r["n"] == len(ends) - 1
            assert r["prefix_chars"] in ends and r["prefix_chars"] + r["middle_chars"] in ends
    gaps = fill_middle.transform(docs, unit="[a-z]").first()
    assert (gaps["n"], gaps["form"]) == (0, "plain")


def test_empty_tables(spark):
    prepare(spark)
    docs = spark.createDataFrame([], TEXTS)
    assert fill_middle.transform(docs).collect() == []
    assert minhash.near_duplicates(docs).collect() == []
    assert whitening.whiten(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []


# MinHash --------------------------------------------------------------------------------------------


def components_plainly(given, words=2, percent=80):
    def of(text):
        found = (text or "").lower().split()
        if not found:
            return frozenset()
        n = min(words, len(found))
        return frozenset(" ".join(found[k : k + n]) for k in range(len(found) - n + 1))

    sets = [of(text) for _, text in given]
    root = list(range(len(given)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for k, (number, _) in enumerate(given):
        if number is not None:
            least[find(k)] = min(number, least.get(find(k), number))
    rows = []
    for k, (number, _) in enumerate(given):
        component = least.get(find(k)) if sets[k] else number
        rows.append((number, len(sets[k]), component, number == component))
    return sorted(rows, key=str)


def test_minhash_groups_and_chains(spark, rows):
    """A large group around one text, texts outside it that share its values, chains, copies."""
    prepare(spark)
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = rng.choice(vocabulary, 150).tolist()

    def changed(words, n):
        words = list(words)
        for at in rng.choice(len(words), n, replace=False):
            words[at] = str(rng.choice(vocabulary))
        return words

    texts = [changed(base, int(n)) for n in rng.integers(1, 14, 150)]
    texts += [base] * 40
    chain = rng.choice(vocabulary, 120).tolist()
    for _ in range(25):
        chain = changed(chain, 4)
        texts.append(chain)
    texts += [rng.choice(vocabulary, int(n)).tolist() for n in rng.integers(1, 60, 60)]
    given = [(k + 10, " ".join(words)) for k, words in enumerate(texts)]
    given += [(3, None), (4, ""), (5, " \n"), (None, " ".join(base)), (None, "only this"), (7, "Only  THIS"), (8, "one"), (9, "ONE"), (9, "one")]
    docs = spark.createDataFrame(given, TEXTS).withColumn("row", F.lit(1)).repartition(5)
    assert rows(minhash.near_duplicates(docs)) == components_plainly(given)
    # Another length and threshold.
    assert rows(minhash.near_duplicates(docs, words=3, percent=90)) == components_plainly(given, 3, 90)


def test_minhash_long_text(spark, rows):
    text = " ".join(f"w{k}" for k in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, text[:200_000])], TEXTS)
    assert rows(minhash.near_duplicates(docs)) == [(1, 59_999, 1, True), (2, 60_000, 1, False), (3, len(text[:200_000].split()) - 1, 3, True)]


def test_near_copies_make_few_pairs(spark, monkeypatch):
    """Of a group of near copies each is compared with the leader, not with all others."""
    met = []
    confirmed = minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *rest: met.append(pairs.count()) or confirmed(pairs, *rest))
    words = [f"w{k}" for k in range(300)]
    given = [(k, " ".join([*words[:k], "changed", *words[k + 1 :]])) for k in range(200)]
    found = minhash.near_duplicates(spark.createDataFrame(given, TEXTS)).collect()
    assert {r["component_id"] for r in found} == {0}
    assert sum(met) < 3 * len(given)


def test_texts_without_candidates_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Of many texts few are read for their sets; the join drops the others before it moves texts."""
    moved = []
    cut = minhash.cut

    def watched(frame, name):
        if name == "sets":
            moved.append(frame._jdf.queryExecution().executedPlan().toString())
        return cut(frame, name)

    monkeypatch.setattr(minhash, "cut", watched)
    pick = np.random.default_rng(3)
    given = [(i, pick.bytes(2_000).hex()) for i in range(600)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(given, "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    keyed = docs.select(F.col("doc_id").alias("row"), *minhash._text_key(F.col("text")))
    few = keyed.where("row % 50 = 0").select("row")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = minhash.whole_sets(few, keyed, docs, 2).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(x["row"] for x in sets) == list(range(0, 600, 50))
    assert all([h % (1 << 64) for h in x["hashes"]] == minhash.shingles(given[x["row"]][1].encode(), 2).tolist() for x in sets)
    assert len(moved) == 1 and "might_contain" in moved[0]
    # Texts are shuffled once, by their keys.
    assert moved[0].count("Exchange hashpartitioning(t1") == moved[0].count("Exchange hashpartitioning") == 2


# Whitening ------------------------------------------------------------------------------------------


def test_texts_half_like_a_group_make_few_pairs(spark, rows, monkeypatch):
    """Texts that share values with a long list and are linked with none of it meet few of it."""
    met = []
    confirmed = minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *rest: met.append(pairs.count()) or confirmed(pairs, *rest))
    base = [f"w{k}" for k in range(60)]
    near = [(i, " ".join(base[:i] + [f"n{i}"] + base[i + 1 :])) for i in range(60)]
    half = [
        (100 + i, " ".join(f"h{i}x{k}" if (k * 7 + i) % 60 < 9 else w for k, w in enumerate(base))) for i in range(60)
    ]
    # Two that are linked with each other alone.
    linked = (200, half[0][1] + " more")
    given = [*near, *half, linked]
    found = rows(minhash.near_duplicates(spark.createDataFrame(given, TEXTS)))
    assert found == components_plainly(given)
    assert sum(met) < 16 * len(given)


def whitened_plainly(vectors, components=32):
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    apart = (n * x - sums).astype(np.float64) / n
    values, axes = np.linalg.eigh(apart.T @ apart / n)
    values, axes = values[::-1], axes[:, ::-1]
    kept = min(components, int((values > 1e-10 * values[0]).sum()))
    return (
        [sum(int(v) ** 2 for v in row) for row in (n * x - sums).tolist()],
        apart @ axes[:, :kept] / np.sqrt(values[:kept]),
        values[:kept] / values.sum(),
    )


def agrees(found, ids, vectors, components=32):
    deviation, white, explained = whitened_plainly(vectors, components)
    width = white.shape[1]
    assert len(found) == len(ids) * width
    order = {number: k for k, number in enumerate(ids)}
    got = np.full(white.shape, np.nan)
    for r in found:
        k, c = order[r["vec_id"]], r["component"] - 1
        got[k, c] = r["whitened"]
        assert r["n"] == len(ids) and int(r["deviation"]) == deviation[k]
        assert math.isclose(r["explained"], explained[c], rel_tol=1e-9)
        assert r["identity_error"] < 1e-9
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-7


def test_whitening_query(spark):
    given = [r for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect() if r["embedding"]]
    agrees(queries.QUERIES["op13_whitened_embeddings"](spark, FOLDER).collect(), [r["vec_id"] for r in given], [r["embedding"] for r in given])


def test_whitening_cases(spark):
    rng = np.random.default_rng(8)
    good = [rng.normal(size=5).tolist() for _ in range(70)]
    good += [good[0]] * 60  # a hot vector
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0], [1.0, float("nan"), 0.0, 0.0, 0.0], [float("inf")] * 5, [1e300] * 5, [1.0, 2.0]]
    given = [(k, v, "x") for k, v in enumerate(good)] + [(1000 + k, v, "x") for k, v in enumerate(bad)]
    frame = spark.createDataFrame(given, "vec_id bigint, embedding array<double>, component string").repartition(40)
    agrees(whitening.whiten(frame).collect(), list(range(len(good))), good)
    assert {r["component"] for r in whitening.whiten(frame, components=2).collect()} == {1, 2}


def test_whitening_without_full_rank(spark):
    """More dimensions than vectors, a constant dimension, equal vectors, one vector."""
    rng = np.random.default_rng(9)
    few = [[*rng.normal(size=6).tolist(), 2.5] for _ in range(4)]
    shape = "vec_id bigint, embedding array<double>"
    found = whitening.whiten(spark.createDataFrame(list(enumerate(few)), shape)).collect()
    assert {r["component"] for r in found} == {1, 2, 3}
    agrees(found, list(range(4)), few)
    for rows in ([[1.0, 2.0]] * 9, [[1.0, 2.0]]):
        assert whitening.whiten(spark.createDataFrame(list(enumerate(rows)), shape)).collect() == []


def test_whitening_exact_beyond_long(spark):
    big = [[1e9 * k, float(k % 3)] for k in range(60)]
    agrees(whitening.whiten(spark.createDataFrame(list(enumerate(big)), "vec_id bigint, embedding array<double>")).collect(), list(range(60)), big)


@pytest.mark.parametrize("equal", (0, 30))
def test_rank_one_updates(equal):
    """Incremental and merged spectra equal the eigenvalues of the whole, with equal vectors and zeros."""
    rng = np.random.default_rng(equal)
    x = np.floor(rng.normal(size=(200, 12)) * 64 * rng.uniform(0.01, 2, 12))
    x[:equal] = x[0]
    x[:, 3] = 7
    one, parts = whitening.Spectrum.empty(12), [whitening.Spectrum.empty(12) for _ in range(3)]
    for k, row in enumerate(x):
        one.add(row)
        parts[k % 3].add(row)
    three = parts[0].merged(parts[1]).merged(parts[2]).merged(whitening.Spectrum.empty(12))
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    for found in (one, three):
        assert found.n == 200 and np.allclose(found.mean, x.mean(axis=0))
        assert np.allclose(found.values, np.linalg.eigvalsh(scatter), atol=1e-8 * found.values[-1])
        assert np.allclose(found.vectors.T @ found.vectors, np.eye(12), atol=1e-12)
        assert np.allclose(scatter @ found.vectors, found.vectors * found.values, atol=1e-8 * found.values[-1])
