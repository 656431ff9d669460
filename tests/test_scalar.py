import math
import random

from pyspark.sql import functions as F

from tessera.functions import scalar as s


def test_portable_equals_decimal_text(spark):
    rng = random.Random(11)
    values = [0.0, -0.0, 0.1 + 0.2, 1e-15, 1e15, 999.9999999999999, 1000.0, 2.5e-11, -7.0, 123456789012.0, 1e11, 3.0000000000005]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-14, 16) for _ in range(20000)]
    values += [rng.randint(1, 10**12) / 10**rng.randint(0, 12) for _ in range(5000)]
    values += [(rng.randint(10**11, 10**12) + 0.5) / 10**rng.randint(0, 8) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    text = F.format_string("%.11e", F.col("v")).cast("double") + 0.0
    rows = df.select("v", s.portable(F.col("v")).alias("p"), F.when(F.col("v").isNotNull(), text).alias("t")).collect()
    assert [r for r in rows if r.p != r.t] == []
    # Python rounds exact decimal ties to even, the engine up; nothing else may differ
    off = [r for r in rows if r.v is not None and r.p != float(f"{r.v:.12g}")]
    assert len(off) <= 2000
    assert str(df.limit(2).select(s.portable(F.col("v")).alias("p")).collect()[1].p) == "0.0"


def test_labels_and_codes(spark):
    row = spark.createDataFrame([("  Pothole ", " ", None, "us", "Cool-Roof, x!")], "a string, b string, c string, d string, e string").select(
        s.norm_dim(F.col("a")).alias("a"), s.norm_dim(F.col("b")).alias("b"), s.norm_dim(F.col("c")).alias("c"),
        s.norm_code(F.col("d"), "^[A-Z]{2}$").alias("d"), s.norm_code(F.col("e"), "^[A-Z]{2}$").alias("e"), s.search_key(F.col("e")).alias("k"),
        s.fmt_metric(F.lit(2.500000)).alias("m"), s.fmt_metric(F.lit(None).cast("double")).alias("n")).collect()[0]
    assert tuple(row) == ("Pothole", "(missing)", "(missing)", "US", None, "cool roof x", "2.5", "missing")


def test_boxes_and_time(spark):
    one = spark.range(1)
    box = s.bbox(F.lit(89.99), F.lit(179.99))
    row = one.select(box.alias("b"), s.centroid(box).alias("c"), s.bbox_error(box, F.lit(89.0)).alias("ok"), s.bbox_error(box, F.lit(0.0), F.lit(0.0)).alias("bad")).collect()[0]
    assert (row.b.north, row.b.east) == (90.0, 180.0) and row.ok is None and row.bad == "centre lies outside the box"
    day = F.lit("2024-07-01").cast("date")
    row = one.select(F.unix_seconds(s.local_midnight(day, F.lit("America/New_York"))).alias("a"), F.unix_micros(s.local_day_end(day, F.lit("UTC"))).alias("b"),
                     s.aware_timestamp(F.lit("2024-01-01T00:00:00")).alias("naive"), F.unix_seconds(s.aware_timestamp(F.lit("2024-01-01T00:00:00+02:00"))).alias("z"),
                     s.window_error(day, day, 5).alias("w"), s.clamp(F.lit(float("nan")), F.lit(0.0), F.lit(1.0)).alias("n")).collect()[0]
    assert row.a == 1719806400 and row.b == 1719878399999999 and row.naive is None and row.z == 1704060000 and row.w and row.n is None


def test_significant_digits_of_the_exact_value(spark):
    rng = random.Random(5)
    # shortest texts of 13 digits that end in five: the number itself lies above, below or exactly there
    values = [float(f"{rng.randint(10**11, 10**12)}5e{rng.randint(-18, 8)}") for _ in range(5000)]
    values += [rng.choice((-1, 1)) * rng.uniform(1, 10) * 10 ** rng.randint(-6, 20) for _ in range(5000)]
    values += [5844.4238867595 / 7, 1234567890.125, -1234567890.375, 1e11, 1e12, 9.9999999999996, 1e-5, 1e22, 1e-300, 0.0, -0.0]
    values += [f(10.0**e) for e in range(-6, 22) for f in (float, lambda v: math.nextafter(v, 0))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (12, 15):
        rows = df.select("v", s.significant(F.col("v"), digits).alias("p")).collect()
        assert [r for r in rows if r.p != float(f"{r.v:.{digits - 1}e}")] == []
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-0.0,)], "v double").select(s.significant(F.col("v")).alias("p"))
    assert [str(r.p) for r in odd.collect()] == ["None", "nan", "inf", "0.0"]


def test_halves_away_from_zero_on_the_scaled_number(spark):
    values = [1.005, 2.675, 0.125, -0.125, -0.001, -0.0, 0.0, 0.015, 5e17 + 64, -7.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(s.round_away(F.col("v"), 2).alias("p")).collect()
    away = lambda v: math.copysign(math.floor(abs(v) * 100) + (abs(v) * 100 % 1 >= 0.5), v) / 100
    assert [str(r.p) for r in rows] == [str(away(v)) for v in values]
