import collections
import random

import brute
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import queries, rules, sharding


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small set of tables with rows for every stage to act on."""
    rnd = random.Random(11)
    fresh = lambda n: [f"w{rnd.randint(0, 5000)}" for _ in range(n)]
    items = [(k, " ".join(fresh(14))) for k in range(6)]
    rows = []
    for k in range(160):
        words = fresh(rnd.randint(20, 90))
        if k % 10 == 3:
            words = words[:5] + items[k % 6][1].split() + words[5:]
        text = " ".join(words)
        if k % 9 == 4:
            text = " ".join(fresh(4) * 10)
        if k % 8 == 5:
            text = rows[k - 5][1].replace("w1", "v1", 1) if rnd.random() < 0.7 else rows[k - 1][1]
        rows.append((k, text, "en", rnd.choice(["s1", "s2", "s3", None]), len(text)))
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0), rows[20], rows[20]]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_run_agrees_with_plain_stages(spark, folder):
    path, rows, items = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "shard"]
    kept = {r[0]: r for r in rows if brute.rules(r[1], rules.RuleConfig())[-1]}
    roots = brute.components({k: r[1] for k, r in kept.items()})
    kept = {k: r for k, r in kept.items() if roots[k][1] == k}
    found = brute.windows(items)
    kept = {k: r for k, r in kept.items() if not brute.contamination(r[1], found)[-1]}
    sizes = collections.Counter()
    for _, text, _, source, _ in kept.values():
        sizes[source] += len(text.split())
    taken, copies = collections.Counter(), collections.Counter()
    table = sharding.lookup_table(sharding.shard_names(sharding.ShardConfig()), sharding.ShardConfig().slots)
    for r in got.collect():
        assert tuple(r)[:5] == kept[r["doc_id"]] and table[r["slot"]] == r["shard"]
        copies[r["doc_id"]] += 1
        taken[r["source"]] += len(r["text"].split())
    assert max(copies.values()) <= 2 and 10 < len(kept) < len(rows)
    for source, target in brute.targets(sizes).items():
        assert abs(taken[source] - target) <= 60, source
    assert set(copies) == {k for k in kept if copies[k]}


def test_stages_pass_empty_tables_and_extra_columns(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = docs.selectExpr("*", "1 AS kept", "'x' AS row_key", "2 AS size", "3 AS hits", "'r' AS rules", "5L AS _key", "6L AS _row", "7L AS _hit")
    for table in (docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, path)
            assert out.columns == table.columns, name
            if not table.take(1):
                assert out.collect() == []
            else:
                found = out.select("kept", "row_key", "size", "hits", "rules", "_key", "_row", "_hit").distinct().collect()
                assert [tuple(r) for r in found] == [(1, "x", 2, 3, "r", 5, 6, 7)]


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op") and k[2].isdigit()}
    assert "pipeline" in names and set(queries.ORACLES) <= set(names)
