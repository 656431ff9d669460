import collections
import hashlib

import pytest

from tessera.llm import sharding as S


def test_table_is_even_and_steady():
    names = tuple(f"n{k}" for k in range(12))
    table = S.lookup_table(names, 1009)
    counts = collections.Counter(table)
    assert set(counts) == set(range(12)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = S.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 11)
    assert moved < 0.15 * 1009
    for bad in ((names, 1008), ((), 1009), (names, 11)):
        with pytest.raises(ValueError):
            S.lookup_table(*bad)


def test_places_agree_with_the_table(spark):
    config = S.ShardConfig(shards=5, slots=101)
    rows = [(k, f"t{k}", "x", 7) for k in range(200)] + [(3, "t3", "x", 7), (None, "lone", None, None), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    got = S.place(frame, config)
    assert got.columns == ["doc_id", "text", "slot", "shard"]
    table = S.lookup_table(S.shard_names(config), 101)
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        key = str(r["doc_id"]) if r["doc_id"] is not None else "text:" + (r["text"] or "")
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    assert S.place(frame.limit(0), config).collect() == []


def test_written_shards(spark, tmp_path):
    config = S.ShardConfig(shards=3, slots=101)
    placed = S.place(spark.range(50).selectExpr("id AS doc_id", "'t' AS text"), config)
    S.write_shards(placed, str(tmp_path / "out"))
    read = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["doc_id"], r["shard"]) for r in read.collect()} == {(r["doc_id"], r["shard"]) for r in placed.collect()}
