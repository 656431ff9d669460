import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import dedup
from tessera.llm import words as W

SCHEMA = "doc_id long, text string"


def corpus():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    texts = {}
    for family in range(6):
        base = [word() for _ in range(rnd.choice((30, 120, 400)))]
        chain = base
        for k in range(14):
            copy = list(base)
            for _ in range(rnd.choice((0, 1, 1, 2, 3))):
                copy[rnd.randrange(len(copy))] = word()
            chain = list(chain)
            chain[rnd.randrange(len(chain))] = word()
            texts[family * 100 + 2 * k] = " ".join(copy)
            texts[family * 100 + 2 * k + 1] = " ".join(chain).upper() if k % 3 == 0 else "\n".join(chain)
    for k in range(30):
        texts[1000 + k] = "the hot copy of a text that many rows share by rote and more"
    texts |= {2000: "", 2001: None, 2002: " \n", 2003: "", 2004: "two words", 2005: "Two  Words", 2006: "two", 2007: "w " * 3000}
    return texts


def test_components_agree_with_brute_force(spark):
    texts = corpus()
    got = dedup.near_duplicates(spark.createDataFrame(list(texts.items()), SCHEMA).repartition(5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({r["component_id"] for r in got}) < len(texts) - 60


def test_null_ids_repeated_rows_and_extra_columns(spark):
    same = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"x{i}" for i in range(30))
    rows = [(5, same, "a"), (5, same, "a"), (None, same, "b"), (None, other, "c"), (9, None, "d"), (None, "", "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumnRenamed("node", "row_key")
    got = dedup.near_duplicates(frame)
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got.collect())
    assert found == sorted([
        ("5", 26, "5", True), ("5", 26, "5", True), ("None", 26, "5", False), ("None", 26, "None", True),
        ("9", 0, "9", True), ("None", 0, "None", True),
    ])
    kept = dedup.representatives(frame)
    assert kept.columns == frame.columns
    assert sorted(r["row_key"] for r in kept.collect()) == ["a", "c", "d", "e"]
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup.near_duplicates(empty).collect() == [] and dedup.representatives(empty).collect() == []


def test_sketches_never_rule_out_a_link():
    rnd = random.Random(2)
    for _ in range(40):
        base = [f"{rnd.random():.6f}" for _ in range(rnd.choice((12, 60, 600)))]
        copy = [w if rnd.random() > 0.02 else "new" for w in base]
        (chunk,) = W.chunks(pa.array([" ".join(base), " ".join(copy)]))
        sets = dedup.shingle_sets(chunk, 5)
        sketch = dedup._sketch_sets(sets, dedup.DedupConfig())["parity"].view(np.uint64)
        odd = sum(int(x).bit_count() for x in sketch[0] ^ sketch[1])
        assert odd <= len(np.setxor1d(*sets))


@pytest.mark.parametrize("links", [[], [(1, 2)], [(k, k + 1) for k in range(1, 40)], [(1, k) for k in range(2, 30)] + [(50, 51), (52, 51)]])
def test_components_of_paths_and_stars(spark, links):
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in dedup.components(frame).collect()}
    expected = {}
    for _ in range(50):
        for a, b in links:
            low = min(expected.get(a, a), expected.get(b, b))
            expected[a] = expected[b] = low
    assert got == expected
