from tessera.llm import graph


def test_components_with_hubs(spark):
    links = [(0, k) for k in range(1, 400)] + [(500, k) for k in range(300, 700)] + [(k, k + 1) for k in range(1000, 1030)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(700)} | {k: 1000 for k in range(1000, 1031)}


def test_spread_join_keeps_all_rows(spark):
    left = spark.createDataFrame([(k % 3 if k < 600 else k, k) for k in range(900)] + [(None, -1)], "key long, n long").repartition(5)
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 700)], "key long, v string")
    for how in ("inner", "left"):
        got = sorted((str(r["key"]), r["n"], r["v"]) for r in graph.spread_join(left, right, "key", how).collect())
        assert got == sorted((str(r["key"]), r["n"], r["v"]) for r in left.join(right, "key", how).collect())
