import random

from pyspark.sql import functions as F

from tessera.operators import catalog, postings, select

COLUMNS = ("title", "place")


def rows_of(spark, n=200):
    rng = random.Random(1)
    words = ["Cool", "roof", "tree-shade", "Bus", "stop", "été", "日本語", "aaa", "aa", "", "x"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 4))), rng.choice(["Kyiv", "Lyon", None, "aaaa"])) for i in range(n)]
    rows.append((n, "rare needle here", None))
    return spark.createDataFrame(rows, "id int, title string, place string")


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rows = rows_of(spark)
    index = catalog.index_any(rows, "id", COLUMNS, f"{tmp_path}/any")
    folded = catalog.index_normalised(rows, "id", COLUMNS, f"{tmp_path}/folded")
    for term in ("cool roof", "ROOF", "aaa", "aaaa", "日本語", "needle", "absent term", "aa", "x", "lyon", "roof lyon", "tree-shade", "Shade  bus"):
        for search, used in ((catalog.text_any, index), (catalog.text_normalised, folded)):
            plain = {r.id for r in search(rows, COLUMNS, term).collect()}
            assert {r.id for r in search(rows, COLUMNS, term, used).collect()} == plain, term
    assert catalog.text_any(rows, COLUMNS, "rare needle", index).count() == 1
    assert catalog.text_any(rows, ("place",), "kyiv", index).count() == catalog.text_any(rows, ("place",), "kyiv").count()


def test_short_terms_scan_and_impossible_ones_read_nothing(spark, tmp_path):
    rows = rows_of(spark, 20)
    index = catalog.index_any(rows, "id", COLUMNS, f"{tmp_path}/i")
    assert index.candidates(spark, COLUMNS, "aa") is None
    assert index.candidates(spark, COLUMNS, "zzzz").count() == 0


def test_search_reads_only_lists_of_its_grams(spark, tmp_path):
    joining = "spark.sql.adaptive.coalescePartitions.enabled"  # would make one file of so few rows
    spark.conf.set(joining, False)
    try:
        index = catalog.index_any(rows_of(spark), "id", COLUMNS, f"{tmp_path}/i")
    finally:
        spark.conf.unset(joining)
    plan = index.candidates(spark, COLUMNS, "needle")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "In(gram, [" in plan
    firsts = spark.read.parquet(f"{tmp_path}/i/postings").groupBy(F.input_file_name().alias("f")).agg(
        F.min("gram").alias("low"), F.max("gram").alias("high")).orderBy("low").collect()
    assert len(firsts) > 1 and all(a.high <= b.low for a, b in zip(firsts, firsts[1:]))


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "alpha", None), (1, "alpha", None), (None, "alpha", None), (2, None, None)], "id int, title string, place string")
    index = catalog.index_any(rows, "id", COLUMNS, f"{tmp_path}/i")
    assert [r.id for r in catalog.text_any(rows, COLUMNS, "alph", index).collect()] == [1, 1]
    empty = catalog.index_any(rows.limit(0), "id", COLUMNS, f"{tmp_path}/e")
    assert catalog.text_any(rows, COLUMNS, "alph", empty).count() == 0


def test_ranges_grow_with_the_table(spark, tmp_path, monkeypatch):
    """The number of ranges follows the grams, not the session, and no row of the table is read by one task alone."""
    monkeypatch.setattr(postings, "RANGE_ROWS", 50)
    rows = rows_of(spark)
    catalog.index_any(rows, "id", COLUMNS, f"{tmp_path}/i")
    files = spark.read.parquet(f"{tmp_path}/i/postings").groupBy(F.input_file_name()).count().collect()
    assert len(files) > spark.sparkContext.defaultParallelism and max(f["count"] for f in files) < 400


def test_grams_bind_their_text_once(spark):
    plan = spark.range(1).select(postings.grams(F.lower(F.col("id").cast("string"))).alias("g"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_grams(spark):
    got = spark.createDataFrame([("abcab",), ("ab",), ("",), (None,), ("日本語x",)], "t string").select(postings.grams(F.col("t")).alias("g")).collect()
    assert [sorted(r.g) for r in got] == [["abc", "bca", "cab"], [], [], [], ["日本語", "本語x"]]


def test_source_catalog_and_canonical_order(spark):
    listed = [r.source_id for r in catalog.source_catalog(spark).collect()]
    assert len(listed) == len(set(listed)) and {r.category for r in catalog.source_catalog(spark, "hazard").collect()} == {"hazard"}
    df = spark.createDataFrame([("b",), ("A",), ("a",), (None,), ("B",)], "k string")
    assert [r.k for r in select.canonical_order(df, "k").collect()] == [None, "A", "a", "B", "b"]
