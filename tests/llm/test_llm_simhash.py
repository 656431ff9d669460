import random

import brute
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    words = brute.SPACE_WORD.findall(brute.lower(text))
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + size]).encode(), 42) for i in range(len(words) - size + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=2):
    """Smallest id reachable by id, of {id: fingerprint}."""
    out = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if out[b] < out[a] and (fps[a] ^ fps[b]).bit_count() <= distance:
                    out[a] = out[b]
                    changed = True
    return out


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdé漢Z", k=4))
    out = {0: None, 1: "", 2: " \n\t", 3: "One", 4: "one", 5: "two  Words", 6: "two words", 7: "nul\x00 and \x1f here", 8: "w " * 70_000}
    for family in range(8):
        base = [word() for _ in range(rnd.choice((40, 300)))]
        for k in range(12):
            copy = list(base)
            for _ in range(k % 4):
                copy[rnd.randrange(len(copy))] = word()
            out[100 * (family + 1) + k] = rnd.choice((" ", "\n", " \t")).join(copy)
    return out


def test_agrees_with_plain_version(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), SCHEMA).repartition(5)
    got = simhash.near_duplicates(docs).select("*", simhash.hexadecimal(F.col("fp")).alias("hex")).collect()
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["hex"] for r in got} == {i: f"{v:016x}" for i, v in fps.items()}
    expected = plain_components(fps)
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert expected[2] == 0 and len(set(expected.values())) < len(texts) - 20


@pytest.mark.parametrize("distance,list_rows", [(2, 64), (2, 3), (1, 64), (1, 3)])
def test_links_connect_what_brute_force_connects(spark, distance, list_rows):
    rnd = random.Random(distance * 100 + list_rows)
    fps = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(rnd.choice((2, 9, 40))):
            own = centre
            for b in rnd.sample(range(64), rnd.randrange(0, 5)):
                own ^= 1 << b
            fps.add(own)
    # many that share four bytes, in chains and apart
    fps |= {0x0102030400000000 | rnd.getrandbits(10) << 7 for _ in range(120)} | {0, (1 << 64) - 1, 1 << 63}
    ids = {i: v for i, v in enumerate(sorted(fps))}
    config = simhash.SimhashConfig(distance=distance, list_rows=list_rows)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in fps], "fp long")
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(frame, config).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    parent = {v: v for v in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    expected = plain_components(ids, distance)
    assert {i: root(v) for i, v in ids.items()} == {i: ids[k] for i, k in expected.items()}


def test_null_ids_repeats_hot_copies_and_empty_table(spark):
    rows = [(5, "a b c d", 1), (5, "a b c d", 1), (None, "a b c d", 2), (None, "x y z", 3)] + [(1000 + k, "same old text of many rows", 0) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fp", "component_id"] and got.count() == len(rows)
    by_text = {(r["doc_id"], r["component_id"]) for r in got.collect()}
    assert by_text == {(5, 5), (None, 5), (None, None)} | {(1000 + k, 1000) for k in range(300)}
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        simhash.links(docs, simhash.SimhashConfig(distance=3))
