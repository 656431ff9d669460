import itertools
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import text_audit as t


def tokens(text):
    return {w for w in re.findall(r"[a-z0-9]+(?:-[a-z0-9]+)*", text.lower()) if len(w) > 1 and w not in t.STOPWORDS}


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["the", "cool-roof", "Under"]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 40))) for _ in range(60)]
    for base in list(texts[:20]):
        texts.append(base + " extra")
    texts += [texts[0]] * 15 + ["the of", "a"]
    return list(enumerate(texts))


def jaccard(a, b):
    a, b = tokens(a), tokens(b)
    return round(len(a & b) / len(a | b), 6) if a | b else 0.0


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "id long, text string").cache()


def test_token_rule(spark):
    df = spark.createDataFrame([("The cool-roof, under A x9 grid-2-b at 5",)], "s string")
    assert sorted(df.select(t.token_set(F.col("s")).alias("k")).collect()[0].k) == ["cool-roof", "grid-2-b", "x9"]


@pytest.mark.parametrize("threshold", [0.9, 0.75])
def test_pairs_match_brute_force(spark, docs, threshold):
    data = corpus()
    expected = {(a[0], b[0]): jaccard(a[1], b[1]) for a, b in itertools.combinations(data, 2)}
    high = {k: v for k, v in expected.items() if v >= threshold}
    total = t.similarity_totals(docs, "id", ["text"], threshold).collect()[0]
    assert total.high_similarity_pairs == len(high) and total.maximum_similarity == max(expected.values())
    best = sorted(expected.items(), key=lambda kv: (-kv[1], kv[0]))[:20]
    got = [((r.id_a, r.id_b), r.similarity) for r in t.closest_pairs(docs, "id", ["text"], 20).collect()]
    assert got == best
    pairs = t.similar_pairs(docs, "id", ["text"], threshold).collect()
    assert sum(p.row_pairs for p in pairs) == sum(1 for k, v in high.items() if tokens(data[k[0]][1]) != tokens(data[k[1]][1]))


@pytest.mark.parametrize("k", [400])
def test_closest_pairs_have_no_floor(spark, docs, k):
    data = corpus()
    expected = {(a[0], b[0]): jaccard(a[1], b[1]) for a, b in itertools.combinations(data, 2)}
    best = sorted(expected.items(), key=lambda kv: (-kv[1], kv[0]))[:k]
    assert best[-1][1] < 0.4
    got = [((r.id_a, r.id_b), r.similarity) for r in t.closest_pairs(docs, "id", ["text"], k).collect()]
    assert got == best
    firsts = {}
    for i, text in data:
        firsts.setdefault(frozenset(tokens(text)), i)
    sets = {(a, b): jaccard(data[a][1], data[b][1]) for a, b in itertools.combinations(sorted(firsts.values()), 2)}
    best = sorted((-v, a, b) for (a, b), v in sets.items() if v)[:k]
    assert [(-r.similarity, r.first_a, r.first_b) for r in t.closest_sets(docs, "id", ["text"], k).collect()] == best


def test_closest_pairs_of_few_and_unlike_texts(spark):
    def run(texts, k):
        frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        total = t.similarity_totals(frame, "id", ["text"]).collect()[0]
        return [tuple(r) for r in t.closest_pairs(frame, "id", ["text"], k).collect()], total.maximum_similarity

    texts = ["red green", "blue", None, "green black white grey", "", "teal", "teal pink grey"]
    data = list(enumerate(x or "" for x in texts))
    ranked = sorted((-jaccard(a[1], b[1]), a[0], b[0]) for a, b in itertools.combinations(data, 2))
    for k in (5, 99):
        assert run(texts, k) == ([(a, b, -s) for s, a, b in ranked[:k]], -ranked[0][0])
    assert run(["x1", "x2"], 5) == ([(0, 1, 0.0)], 0.0)
    assert run([], 5) == ([], 0.0)


def test_frequency_sketch_never_counts_too_low(spark, docs):
    rows = t.token_rows(docs, "id", ["text"])
    sketch = t.frequency_sketch(rows)
    true = {r.h: r.n for r in rows.select(F.explode("tokens").alias("t")).groupBy(F.xxhash64("t").alias("h")).agg(F.count("*").alias("n")).collect()}
    keys = np.array(list(true), np.int64)
    estimate = np.min([line[at] for line, at in zip(sketch, t._counters(keys))], axis=0)
    assert (estimate >= list(true.values())).all() and sketch.sum(axis=1).tolist() == [sum(true.values())] * 2


def test_pairs_do_not_depend_on_the_sketch(spark, docs):
    rows = t.token_rows(docs, "id", ["text"])
    rng = np.random.default_rng(1)
    found = [
        sorted((bytes(r.class_a), bytes(r.class_b), r.similarity) for r in t.class_pairs(rows, 0.6, sketch).collect())
        for sketch in (None, rng.integers(0, 9, (2, t.COUNTERS)))
    ]
    assert found[0] == found[1] and found[0]


def test_duplicates(spark, docs):
    group = [g for g in t.duplicate_groups(docs, "id", "text").collect() if g.first_id == 0][0]
    assert group.members == 16
    assert t.duplicate_members(docs, "id", "text").filter("first_id = 0").count() == 16
    df = spark.createDataFrame([(1, "A  b"), (2, "a B "), (3, "ab")], "id int, text string")
    assert [(g.first_id, g.members) for g in t.duplicate_groups(df, "id", "text").collect()] == [(1, 2)]


def test_audit_verdict(spark):
    good = spark.createDataFrame(
        [(1, "alpha beta", "x", ["a", "b", "c"]), (2, "gamma delta", "y", ["a", "b", "c"])],
        "id int, title string, axis string, alternatives array<string>")
    rules = {"alternatives": F.size("alternatives") >= 3}
    assert t.audit_library(good, "id", ["axis"], ["title"], ["title"], rules).collect()[0].audit_passed
    bad = good.withColumn("axis", F.lit("x")).withColumn("title", F.lit("same words"))
    row = t.audit_library(bad, "id", ["axis"], ["title"], ["title"], rules).collect()[0]
    assert row.failures == ["duplicate-title=1", "high-similarity-pairs=1", "signature-collisions=1"]


def test_scans(spark):
    docs = spark.createDataFrame([("a.md", "no claims here"), ("b.md", "guaranteed impact")], "doc string, text string")
    rows = {r.rule_id: r for r in t.scan_forbidden(docs, "doc", "text", {"x": "guaranteed", "y": "proven"}).collect()}
    assert not rows["x"].passed and rows["x"].first_document == "b.md" and rows["y"].passed
    rules = spark.createDataFrame([("r1", "a.md", "no claims"), ("r2", "a.md", "impact"), ("r3", "c.md", "z")],
                                  "rule_id string, document string, phrase string")
    assert {r.rule_id: r.passed for r in t.scan_required(docs, "doc", "text", rules).collect()} == {
        "r1": True, "r2": False, "r3": False}


def test_whole_numbers_of_claims_are_exact(spark):
    doc = {"a": 9007199254740993, "b": 9007199254740995, "c": 123456789012345678901234567890, "d": 3000000000, "e": 3000000001, "z": 0}
    evidence = spark.createDataFrame([("e.json", json.dumps(doc))], "document string, content string")
    cases = [
        ("sum", "ab", doc["a"] + doc["b"]), ("sum", "ac", doc["a"] + doc["c"]), ("subtract", "ba", 2), ("subtract", "ca", doc["c"] - doc["a"]),
        ("choose-two", "d", doc["d"] * (doc["d"] - 1) // 2), ("choose-two", "e", doc["e"] * doc["d"] // 2), ("choose-two", "z", 0),
        ("choose-two", "a", doc["a"] * (doc["a"] - 1) // 2),
    ]
    rows = [(f"c{n}", op, i, "e.json", f"/{key}", str(value)) for n, (op, keys, value) in enumerate(cases) for i, key in enumerate(keys)]
    claims = spark.createDataFrame(rows, "claim_id string, operation string, source_order int, document string, pointer string, expected string")
    got = {r.claim_id: (r.value, r.passed) for r in t.evaluate_claims(claims, evidence).collect()}
    assert got == {f"c{n}": (str(value), True) for n, (_, _, value) in enumerate(cases)}


def test_claims(spark):
    doc = {"a": {"n": 12, "x": 1.5, "flag": True, "name": "boston"}, "rows": [1, 2, 3], "m/k": {"~t": 7}}
    evidence = spark.createDataFrame([("e.json", json.dumps(doc))], "document string, content string")
    cases = [
        ("c1", "single", [("/a/n",)], "12", True), ("c2", "single", [("/a/n",)], "12.0", False),
        ("c3", "count", [("/rows",)], "3", True), ("c4", "sum", [("/a/n",), ("/rows/1",)], "14", True),
        ("c5", "subtract", [("/a/n",), ("/rows/2",)], "9", True), ("c6", "choose-two", [("/a/n",)], "66", True),
        ("c7", "single", [("/a/none",)], "1", False), ("c8", "single", [("/a/name",)], '"boston"', True),
        ("c9", "single", [("/a/flag",)], "true", True), ("c10", "sum", [("/a/name",)], "1", False),
        ("c11", "count", [("/a",)], "4", True), ("c12", "single", [("/m~1k/~0t",)], "7", True),
        ("c13", "power", [("/a/n",)], "144", False), ("c14", "single", [("/rows",)], "[1,2,3]", False),
    ]
    rows = [(c, op, i, "e.json", p[0], exp) for c, op, ps, exp, _ in cases for i, p in enumerate(ps)]
    claims = spark.createDataFrame(rows, "claim_id string, operation string, source_order int, document string, pointer string, expected string")
    got = {r.claim_id: r for r in t.evaluate_claims(claims, evidence).collect()}
    assert {c: got[c].passed for c, *_ in cases} == {c: ok for c, _, _, _, ok in cases}
    assert all(r.reason for r in got.values() if not r.passed)
    big = spark.createDataFrame([("c1", "4148633"), ("c2", '"x"')], "claim_id string, value string")
    rend = spark.createDataFrame([("c1", 1, "d", "{value:,} requests"), ("c1", 2, "d", "{value} raw"), ("c2", 1, "d", "kind {value}")],
                                 "claim_id string, ordinal int, document string, template string")
    docs = spark.createDataFrame([("d", "There are 4,148,633 requests of kind x")], "document string, text string")
    out = {r.check: r.passed for r in t.check_renderings(rend, big, docs).collect()}
    assert out == {"c1:rendering-1": True, "c1:rendering-2": False, "c2:rendering-1": True}
    s = t.audit_summary(t.check_renderings(rend, big, docs)).collect()[0]
    assert (s.checks_total, s.checks_passed, s.checks_failed) == (3, 2, 1)


def near_copies():
    """Sets of 1 to 150 tokens with copies that lack, add or exchange some, around and across the bands of sizes."""
    rng, words = random.Random(8), [f"t{i}" for i in range(900)]
    texts = []
    for size in [*range(1, 30), 37, 55, 80, 110, 150]:
        base = rng.sample(words, size)
        texts.append(" ".join(base))
        for change in {1, size // 20, size // 12, size // 9, size // 6}:
            texts += [" ".join(base[change:]), " ".join([*base, *rng.sample(words, change)]), " ".join([*base[change:], *rng.sample(words, change)])]
    return list(enumerate(texts))


@pytest.mark.parametrize("threshold", [0.8, 0.9, 0.97])
def test_sets_cut_into_parts_lose_no_pair(spark, threshold):
    data = near_copies()
    firsts = {}
    for i, text in data:
        firsts.setdefault(frozenset(tokens(text)), i)
    sets = {(a, b): jaccard(data[a][1], data[b][1]) for a, b in itertools.combinations(sorted(firsts.values()), 2)}
    frame = spark.createDataFrame(data, "id long, text string")
    got = {(r.first_a, r.first_b): r.similarity for r in t.similar_pairs(frame, "id", ["text"], threshold).collect()}
    assert got == pytest.approx({k: v for k, v in sets.items() if v >= threshold}, abs=1e-6) and got  # ties round up here


def test_sets_of_few_words_meet_only_where_they_are_alike(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.sample([f"v{i}" for i in range(300)], 100)) for _ in range(400)]
    texts += [x.rsplit(" ", 4)[0] for x in texts[:20]]
    rows = t.token_rows(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", ["text"])
    assert 20 <= t._part_candidates(rows, 0.9).count() < 60  # of 88,000 pairs, nearly all of which share a prefix token
    assert t.class_pairs(rows, 0.9).count() == 20


def test_scan_finds_the_tokens_of_the_rule(spark):
    texts = ["The cool-roof, under A x9 grid-2-b at 5", "--a-b- -cc- dd--ee x-y_z-w", "İstanbul Kelvin naïve-co ÄRGER-1", "", None, "b a-- zz zz"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = {r.id: (r.size, r.tokens) for r in t.token_rows(frame, "id", ["text"]).collect()}
    rule = frame.select("id", F.sort_array(t.token_set(F.col("text"))).alias("tokens")).collect()
    assert rows == {r.id: (len(r.tokens), r.tokens) for r in rule}


def test_large_neighbourhoods_are_dealt_into_places(spark, monkeypatch):
    monkeypatch.setattr(t, "PLACE_SETS", 4)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join([*base, f"x{i}"]) for i in range(60)] + [f"y{i} z{i}" for i in range(9)]
    rows = t.token_rows(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", ["text"])
    assert t.class_pairs(rows, 0.9).count() == 60 * 59 // 2
