import collections
import random

import brute
import pytest

from tessera.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def corpus(seed=3):
    rnd = random.Random(seed)
    rows = []
    for k in range(1500):
        source = "hot" if k % 3 == 0 else rnd.choice(["a", "B", "é", "z", None, "tiny"] if k % 50 == 0 else ["a", "B", "é", "z"])
        size = 40 if k % 6 == 0 else rnd.choice((0, 1, 7, rnd.randint(1, 300)))
        rows.append((k, "w " * size, source))
    return rows


def test_mix_meets_targets(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    expected, taken = brute.targets(sizes), collections.Counter()
    by_id = {r[0]: r for r in rows}
    for r in got:
        assert r["size"] == len(by_id[r["doc_id"]][1].split()) and r["source"] == by_id[r["doc_id"]][2]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]])
        assert r["copies"] in (0, 1, 2)
        taken[r["source"]] += r["copies"] * r["size"]
    for source, target in expected.items():
        least = min(len(t.split()) for _, t, s in rows if s == source and t)
        assert abs(taken[source] - target) <= least, source
    again = mixing.mix(frame.repartition(7)).collect()
    assert {(r["doc_id"], r["copies"]) for r in got} == {(r["doc_id"], r["copies"]) for r in again}


def test_equal_sizes_of_one_source(spark):
    rows = [(k, "one two three", "s" if k % 3 else "t") for k in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), mixing.MixConfig(group_rows=50)).collect()
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"]
    for r in got:
        assert abs(taken[r["source"]] - r["target"]) <= 3


def test_nulls_repeats_extra_columns_and_empty(spark):
    rows = [(1, "a b c", None, 1), (1, "a b c", None, 1), (None, None, "x", 2), (None, "d", "x", 3), (3, "", "empty", 4)]
    frame = spark.createDataFrame(rows, SCHEMA + ", copies int").withColumnRenamed("copies", "weight")
    got = mixing.mix(frame).collect()
    assert len(got) == 5 and {r["source"] for r in got} == {None, "x", "empty"}
    assert all(r["target"] == 0 and r["copies"] * r["size"] == 0 for r in got if r["source"] == "empty")
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    words = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert words == sum(r["copies"] * r["size"] for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
    only = spark.createDataFrame([(1, "", "a"), (2, None, "b")], SCHEMA)
    assert {(r["target"], r["size"]) for r in mixing.mix(only).collect()} == {(0.0, 0)}


@pytest.mark.parametrize("copies, words", [(101, 100), (1000, 7)])
def test_a_source_of_one_repeated_row_is_split(spark, copies, words):
    rows = [(1, "w " * words, "s", 5)] * copies + [(2, "a b c", "t", 6)]
    frame = spark.createDataFrame(rows, SCHEMA + ", rank long").repartition(5)
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    own = [r for r in got if r["source"] == "s"]
    taken = sum(r["copies"] * r["size"] for r in own)
    assert abs(taken - own[0]["target"]) <= words and {r["copies"] for r in own} <= {0, 1, 2}
    mixed = mixing.mixed_documents(frame).collect()
    assert sum(len(r["text"].split()) for r in mixed if r["source"] == "s") == taken
    assert {tuple(r) for r in mixed} <= set(rows)


def test_newton_finds_the_rates(spark):
    groups = spark.createDataFrame([("a", 10, 5), ("a", 3, 10), ("b", 7, 100)], "source string, weight long, units long")
    aims = spark.createDataFrame([("a", 80, 8.0), ("b", 700, 1390.0)], "source string, source_size long, target double")
    import math
    got = {r["source"]: math.exp(r["multiplier"]) for r in mixing.multipliers(groups, aims).collect()}
    assert got["a"] == pytest.approx(0.1) and got["b"] == pytest.approx(1390 / 700)


@pytest.mark.parametrize("long, first, last, share", [(20_000, 50, 349, 0.5), (20_000, 50, 349, 1.5), (100_000, 100, 1099, 0.5)])
def test_remainder_of_distinct_sizes_is_settled(spark, long, first, last, share):
    rows = [(k, "w " * size, "s") for k, size in enumerate([long, *range(first, last + 1)])]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), mixing.MixConfig(share=share)).collect()
    assert {r["copies"] for r in got} <= {0, 1, 2}
    assert abs(sum(r["copies"] * r["size"] for r in got) - got[0]["target"]) <= 5
