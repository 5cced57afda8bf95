"""Every query over small tables: against its SQL, or against a plain version in Python."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash

from compare import connect, difference, rows_of_sql
from glossaflow.llm import pii, quality, queries

FOLDER = "/root/testdata/sf0.01"  # the smallest with personal data and secrets
BLANK = r"[^\x20\x09-\x0D]+"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def result(spark):
    made = {}

    def run(name):
        if name not in made:
            made[name] = queries.QUERIES[name](spark, FOLDER).collect()
        return made[name]

    return run


@pytest.fixture(scope="module")
def given(spark):
    return lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(result, name):
    rows = result(name)
    found = [tuple(r) for r in rows]
    assert difference(list(rows[0].__fields__), found, *rows_of_sql(connect(FOLDER), queries.ORACLES[name])) is None


def fingerprint(text):
    words = re.findall(BLANK, (text or "").translate(FOLD))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    bits = [int(((hashes >> np.uint64(i)) & np.uint64(1)).sum()) for i in range(64)]
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(hashes))


def components(prints):
    """Smallest number reachable over all pairs at two bits or fewer."""
    value = np.array([p for _, p in prints], np.uint64)
    label = np.array([i for i, _ in prints])
    near = np.bitwise_count(value[:, None] ^ value[None, :]) <= 2
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label.tolist()
        label = new


def test_near_duplicates(result, given):
    docs = given("documents")
    prints = [(d["doc_id"], fingerprint(d["text"])) for d in docs]
    wanted = {(i, f"{p:016x}", c) for (i, p), c in zip(prints, components(prints))}
    assert {tuple(r) for r in result("op3_simhash_pivots")} == wanted


def test_secrets(result, given):
    either = lambda w: "".join(f"[{c}{c.upper()}]" for c in w)
    names = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    assign = re.compile(rf"({names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found = {r["doc_id"]: r for r in result("op4_assignment_secrets")}
    some = 0
    for d in given("documents"):
        text = d["text"] or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        row = found[d["doc_id"]]
        assert row["base_sha256"] == sha(said)
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert set(filter(None, said.split(","))) <= set(row["spans"].split(","))
        some += bool(spans)
    assert some and len(found) == len(given("documents"))


def test_shards(result, given):
    rows, docs = result("op5_hypergeometric_shards"), {d["doc_id"]: d["text"] or "" for d in given("documents")}
    slots = collections.defaultdict(list)
    for r in rows:
        text = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 8, zlib.crc32(text), "rows")
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24)) and sum(map(len, slots.values())) == len(docs)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert len({r["doc_id"] for r in rows}) == len(docs)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += int(c) * (1 + i % 2) - 9 * (i % 2 and int(c) > 4)
    return total % 10 == 0


PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
)


def base_personal(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in PERSONAL for m in re.finditer(p, text or "") if ok(m.group())]


def test_personal_data(result, given):
    found, some = {r["doc_id"]: r for r in result("op6_boosted_pii")}, 0
    for d in given("documents"):
        row, spans = found[d["doc_id"]], base_personal(d["text"])
        assert row["base_sha256"] == sha(",".join(spans))
        assert set(spans) <= set(row["spans"].split(",")) or not spans
        some += bool(spans)
    assert some and len(found) == len(given("documents"))


def test_personal_patterns_find_what_the_plain_ones_find(spark):
    parts = ["a@b.c", "x.y_z+1@a-b.c.d", "@", "..", "@a.b", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "4111 1111-1111 1111",
             "4111111111111111", "5 -3 4 5", "+1 (555) 123-4567", "+", "++1.2.3", "é", "日本", "\n", " ", "a@b@c.d_e@f.g", "_", "1" * 30,
             "+12345678", "+123456789012345", "a.b@c", "000255.1.1.0001", "b.com_x@d.e", "-", "😀"]
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(parts, rng.integers(0, 9))) for _ in range(400)] + ["a" * 20000 + "@", "a@" + "b." * 9000 + "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from pyspark.sql import functions as F

    rows = pii.spans(docs).select("doc_id", pii.said(F.filter("spans", lambda s: s["kind"] < 4)).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in rows} == {i: ",".join(base_personal(t)) for i, t in enumerate(texts)}


def plain_counts(text):
    words, text = re.findall(BLANK, text or ""), text or ""
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(BLANK, line):
            again += line in seen
            seen.add(line)
    triples = list(zip(words, words[1:], words[2:]))
    often = collections.Counter(triples)
    inside = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)]


def test_quality(result, given):
    found = {r["doc_id"]: r for r in result("op8_robust_quality")}
    for d in given("documents"):
        row, counts = found[d["doc_id"]], plain_counts(d["text"])
        assert [row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == counts
        assert row["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (row["base_failed"] and row["kept"])
    labels = {r["doc_id"]: r["quality"] for r in given("labels")}
    judged = [(labels[i], r["kept"]) for i, r in found.items() if i in labels and not r["base_failed"]]
    assert all(kept for good, kept in judged if good)


def plain_estimates(rows):
    """Concentration steps in numpy; rows: {group: array of measures}.  Returns {group: (centre, precision)}."""
    floor = np.diag([(s * quality.SCALE) ** 2 for s in quality.LEAST_SPREAD])
    inner = quality.chi_square_quantile(quality.KEPT_SHARE)
    factor = quality.KEPT_SHARE / (1 - np.exp(-inner / 2) * (1 + inner / 2 + inner**2 / 8))

    def median(x):
        return np.array([np.sort(x[:, i])[-(-len(x) // 2) - 1] for i in range(4)])

    found = {g: (median(x), np.linalg.inv(floor)) for g, x in rows.items()}
    for _ in range(quality.STEPS):
        kept = {}
        for g, x in rows.items():
            level = np.floor(16 * np.log2(distances(x, *found[g]) + 2.0**-10))
            kept[g] = x[level <= np.sort(level)[-(-3 * len(x) // 4) - 1]]
        every = np.concatenate(list(kept.values()))
        for g, x in kept.items():
            share = quality.POOLED_ROWS / (len(x) + quality.POOLED_ROWS)
            centre = (1 - share) * x.mean(axis=0) + share * every.mean(axis=0)
            spread = (1 - share) * np.cov(x.T, bias=True) + share * np.cov(every.T, bias=True)
            found[g] = (centre, np.linalg.inv(factor * spread + floor))
    return found


def distances(x, centre, precision):
    return np.maximum(np.einsum("ni,ij,nj->n", x - centre, precision, x - centre), 0)


def test_outliers_are_those_of_a_plain_version(result, given):
    found = {r["doc_id"]: r for r in result("op8_robust_quality")}
    groups = collections.defaultdict(list)
    for d in given("documents"):
        words, chars, symbols, again, repeats = plain_counts(d["text"])
        if found[d["doc_id"]]["base_failed"]:
            continue
        lines, n = (d["text"] or "").count("\n") + 1, words + quality.PRIOR_WORDS
        exact = [np.log2((chars + 250) / n), np.log2(1 + 20 * symbols / n), np.log2(1 + 8 * again / (lines + 8)), np.log2(1 + 8 * repeats / n)]
        groups[d["lang"], d["source"]].append((d["doc_id"], [np.floor(v * 256 + 0.5) for v in exact]))
    measures = {g: np.array([x for _, x in rows]) for g, rows in groups.items()}
    estimates, limit, near = plain_estimates(measures), quality.chi_square_quantile(quality.QUANTILE), 0
    for g, rows in groups.items():
        for (doc, _), d in zip(rows, distances(measures[g], *estimates[g])):
            if abs(d - limit) < 1e-6:
                near += 1
                continue
            assert found[doc]["kept"] == (d <= limit), (g, doc, d)
    assert near < 3 and sum(not r["kept"] and not r["base_failed"] for r in found.values()) > 20


def test_copies_are_those_of_a_plain_version(result, given):
    rows = {r["doc_id"]: r for r in result("op10_source_mixing")}
    start = xxhash.xxh64_intdigest(struct.pack("<i", 10), 42)
    for d in given("documents"):
        row = rows[d["doc_id"]]
        rate = row["target"] / row["source_size"]
        unit = (xxhash.xxh64_intdigest(str(d["doc_id"]).encode(), start) >> 11) / 2**53
        assert row["taken"] == row["size"] * (int(rate) + (unit < rate - int(rate)))


def test_mixing_targets(result, given):
    sizes, rows = collections.Counter(), {r["doc_id"]: r for r in result("op10_source_mixing")}
    for d in given("documents"):
        n = len(re.findall(BLANK, d["text"] or ""))
        assert rows[d["doc_id"]]["size"] == n and rows[d["doc_id"]]["taken"] in (0, n, 2 * n)
        sizes[d["source"]] += n
    assert len(rows) == len(given("documents"))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    capped, target = set(), {}
    while True:
        open_ = [s for s in sizes if s not in capped]
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        target = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_} | {s: 2.0 * sizes[s] for s in capped}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    for d in given("documents"):
        assert rows[d["doc_id"]]["source_size"] == sizes[d["source"]]
        assert rows[d["doc_id"]]["target"] == pytest.approx(target[d["source"]], rel=1e-12)
