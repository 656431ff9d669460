import hashlib
import random

from pyspark.sql import functions as F

from tessera.functions import hashing, merkle, ranking


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(leaves, levels):
    """Root of {slot: hash}, level by level."""
    for _ in range(levels):
        up = {}
        for slot in sorted(leaves):
            up.setdefault(slot >> 6, []).append(f"{slot}:{leaves[slot]}")
        leaves = {s: sha(",".join(c)) for s, c in up.items()}
    return leaves


def test_set_roots_agree_with_plain_version_and_ignore_order(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(("a", "b", None)), rnd.randrange(60), rnd.choice("xyz")) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, id int, h string")
    got = {r.g: (r.artifacts, r.set_hash) for r in hashing.artifact_set_hash(df, ["g"], "id", "h").collect()}
    for g in ("a", "b", None):
        lines = {}
        for own, i, h in rows:
            if own == g:
                lines[f"{i}={h}"] = lines.get(f"{i}={h}", 0) + 1
        slots = {}
        for line, n in lines.items():
            slots.setdefault(int(sha(line)[:6], 16), []).append(f"{line} x{n}")
        root = plain_root({s: sha("\n".join(sorted(v))) for s, v in slots.items()}, merkle.SET_LEVELS)
        assert got[g] == (sum(lines.values()), "sha256:" + root[0])
    again = hashing.artifact_set_hash(df.repartition(7, "id"), ["g"], "id", "h")
    assert {r.g: (r.artifacts, r.set_hash) for r in again.collect()} == got
    assert hashing.artifact_set_hash(df.limit(0), ["g"], "id", "h").collect() == []


def test_sets_with_equal_sums_differ(spark):
    """Swapping hashes between ids keeps every sum over ids and over hashes, not the root."""
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, h string")
    b = spark.createDataFrame([("1", "y"), ("2", "x")], "id string, h string")
    c = spark.createDataFrame([("1", "x"), ("1", "x"), ("2", "y")], "id string, h string")
    hashes = [hashing.artifact_set_hash(d, [], "id", "h").collect()[0].set_hash for d in (a, b, c)]
    assert len(set(hashes)) == 3


def test_walk_finds_exactly_the_changed_leaves(spark):
    n = 300_000
    base = spark.range(n).select((F.col("id") * 3).alias("k"), F.lit("g").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    changed, gone = 3 * 77_777, 3 * 123_456
    other = base.filter(F.col("k") != gone).withColumn("v", F.when(F.col("k") == changed, "new").otherwise(F.col("v"))).unionByName(
        spark.createDataFrame([(9_000_000, "g", "late")], "k long, g string, v string"))
    a, b = (merkle.ordered_leaves(d, ["g"], F.col("k"), ["k"], F.col("v"), 256) for d in (base, other))
    found = {r.slot: (r.left_rows, r.right_rows) for r in merkle.differing_slots(a, b, ["g"], merkle.ORDERED_LEVELS).collect()}
    assert set(found) == {changed // 256, gone // 256, 9_000_000 // 256}
    assert found[9_000_000 // 256] == (0, 1) and found[gone // 256][0] == found[gone // 256][1] + 1
    assert merkle.differing_slots(a, a, ["g"], merkle.ORDERED_LEVELS).collect() == []


def test_fingerprint_of_named_inputs(spark):
    one = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    two = one.limit(0)
    base = hashing.fingerprint({"x": one, "y": two}).collect()[0]
    assert (base.inputs, base["rows"]) == (2, 2)
    assert hashing.fingerprint({"y": two, "x": one.select("t", "n")}).collect()[0] == base
    assert hashing.fingerprint({"x": two, "y": one}).collect()[0].fingerprint != base.fingerprint


def test_running_max_equals_a_window(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("aab"), rnd.randrange(500), i, rnd.choice((None, rnd.random()))) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, i int, v double")
    got = {r.i: r.running for r in ranking.running_max(df, ["g"], ["k", "i"], "v").collect()}
    tops = {}
    for g, _, i, v in sorted(rows, key=lambda r: r[:3]):
        if v is not None:
            tops[g] = max(tops.get(g, v), v)
        assert got[i] == tops.get(g)
