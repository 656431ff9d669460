import hashlib
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tessera.sources import integrity as i
from tessera.sources import readers as r
from tessera.sources import sinks
from tessera.streaming import ingest


def texts(spark, *docs):
    return spark.createDataFrame([(f"a{n}", d if isinstance(d, str) else json.dumps(d)) for n, d in enumerate(docs)], "artifact string, content string")


def test_param_series(spark):
    good = {"header": {"fill_value": -999.0}, "geometry": {"coordinates": [10.0, 20.0, 5.0]},
            "properties": {"parameter": {"T2M": {"20240101": 1.5, "20240102": -999.0}, "RH2M": {"20240101": 3}}}}
    bad = {"header": {"fill_value": -999.0}, "properties": {"parameter": {"T2M": {"2024-01": 1, "20240101": "x"}}}}
    rows, broken = r.split_issues(r.parse_param_series(texts(spark, good, bad, "nope"), ["T2M", "RH2M"]))
    assert rows.count() == 3 and rows.filter("is_fill").count() == 1
    assert sorted(x.issue for x in broken.collect()) == [
        "day key is not a date", "parameter series is missing", "parameter series is missing",
        "parameter series is missing", "value is not a finite number"]
    counts = {x.artifact: x for x in r.fill_counts(rows).collect()}
    assert (counts["a0"]["values"], counts["a0"].fill_values) == (3, 1)


def test_indicator_pages_last_row_wins(spark):
    row = lambda c, v: {"indicator": {"id": "SP.POP.TOTL"}, "country": {"id": c, "value": c}, "date": "2023", "value": v}
    page = [{"page": 1}, [row("US", 1.0), row("FR", None), row("US", 2.5), {"country": None, "value": 3}]]
    got = r.parse_indicator_pages(texts(spark, page)).collect()
    assert [(x.country_code, x.value) for x in got] == [("US", 2.5)]
    ret = spark.createDataFrame([("p", 5, 1), ("q", 50, 2)], "artifact string, rows int, page int")
    dec = spark.createDataFrame([("p", 4, 1), ("q", 100, 1)], "artifact string, row_limit int, page int")
    assert {x.artifact: len(x.issues) for x in r.check_page(ret, dec).collect()} == {"p": 1, "q": 1}


def test_requests(spark):
    lines = [{"unique_key": str(k), "created_date": f"2024-01-0{k}T10:00:00", "agency": " nypd", "borough": "Queens"} for k in range(1, 6)]
    lines += [{"unique_key": "9"}, {"created_date": "2024-01-01T00:00:00"}]
    rows, bad = r.split_issues(r.parse_requests(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")))
    assert bad.count() == 2
    page = r.select_requests(rows, "2024-01-02", "2024-01-05", agency="nypd", borough="queens", limit=2, offset=1)
    assert [x.unique_key for x in page.collect()] == ["3", "4"]


def test_tracts(spark):
    base = {"stateabbr": "ma", "countyfips": "25025", "tractfips": "25025000100", "totalpopulation": "1000",
            "geolocation": {"type": "Point", "coordinates": [-71.0, 42.0]}, **{p: 10.5 for p in r.PREVALENCE}}
    rows = r.parse_tracts(texts(spark, [base, {**base, "tractfips": "1", "copd_crudeprev": 120}])).collect()
    assert rows[0].issues == [] and rows[0].longitude == -71.0
    assert rows[1].issues == ["tract id is not 11 digits", "copd_crudeprev outside 0..100"]
    pts = r.demand_points(r.parse_tracts(texts(spark, [base])), F.lit("x")).collect()
    assert pts[0].need == 105.0


def test_hazards(spark):
    fc = {"type": "FeatureCollection", "metadata": {"generated": 1704067200000}, "features": [
        {"id": "q1", "properties": {"mag": 5.1, "time": 1704067200000}, "geometry": {"coordinates": [1, 2, 3]}},
        {"id": "q2", "properties": {"mag": 3.0, "time": 1704153600000}, "geometry": {"coordinates": [1, 2, 3]}}]}
    rows = r.parse_geojson_features(texts(spark, fc, {"type": "Other"}))
    assert rows.filter("issue is not null").count() == 1
    assert [x.event_id for x in r.select_quakes(rows, "2024-01-01", "2024-02-01", 4.0).collect()] == ["q1"]
    doc = {"DisasterDeclarationsSummaries": [
        {"disasterNumber": 1, "state": "tx", "incidentType": "Flood", "declarationDate": "2024-01-05T00:00:00.000Z", "lastRefresh": "2024-02-01T00:00:00Z"},
        {"disasterNumber": 2, "state": "TX", "incidentType": "Fire", "declarationDate": "2024-01-05T00:00:00", "lastRefresh": "2024-03-01T00:00:00Z"}]}
    decl = r.parse_declarations(texts(spark, doc))
    assert decl.filter("issue is not null").count() == 1  # no zone
    assert r.select_declarations(decl, "2024-01-01", "2024-02-01", "tx", ["Flood"]).count() == 1
    assert r.upstream_time(decl).collect()[0].upstream_updated_at == datetime(2024, 3, 1)


def test_jsonstat(spark):
    good = {"class": "dataset", "id": ["geo", "time"], "size": [2, 3], "value": {"0": 1.0, "5": 7.5, "4": None}}
    rows = r.parse_jsonstat(texts(spark, good, {**good, "size": [2]}, {**good, "size": [1000, 1000]})).collect()
    cells = {x.flat: (x.positions, x.value) for x in rows if x.artifact == "a0"}
    assert cells[5] == ([1, 2], 7.5) and cells[4] == ([1, 1], None) and cells[0] == ([0, 0], 1.0)
    assert [x.issue for x in rows if x.artifact == "a1"] == ["id and size differ in length"]
    assert [x.issue for x in rows if x.artifact == "a2"] == ["more cells than the declared limit"]


def test_gazetteer_and_population(spark, tmp_path):
    line = lambda gid, cls="P", name="Foo", pop="10", tz="Europe/Paris": "\t".join(
        [gid, name, "", "", "48.1", "2.2", cls, "PPL", "fr", "", "", "", "", "", pop, "", "", tz, "2024-01-01"])
    path = tmp_path / "g.txt"
    path.write_text("\n".join([line("1"), line("2", name='Quo"te', pop=""), line("3", cls="A"), line("1"), line("4", tz="Mars")]) + "\n", encoding="utf-8")
    rows = {(x.geonameid, tuple(x.issues)): x for x in r.read_gazetteer(spark, str(path)).collect()}
    assert rows[(2, ())].ascii_name == 'Quo"te' and rows[(2, ())].population == 0 and rows[(1, ())].admin1 is None
    assert (3, ("feature class is not P",)) in rows and (4, ("time zone is invalid",)) in rows
    rep = r.gazetteer_report(r.read_gazetteer(spark, str(path)), 6).collect()[0]
    assert rep.rows == 5 and rep.repeated_ids == 1 and len(rep.issues) == 2
    pop = tmp_path / "p.txt"
    pop.write_text("GEO_ID|B01003_E001|B01003_M001\n1600000US01|100|5\n1600000US02|200|-555555555\n0400000US03|9|1\n1600000US05|7|-1\n1600000US06|1|1\n1600000US06|1|1\n")
    want = spark.createDataFrame([(g,) for g in ("01", "02", "04", "05", "06")], "geoid string")
    got = {x.geoid: x for x in r.read_population(spark, str(pop), want).collect()}
    assert (got["02"].margin, got["02"].margin_status) == (0, "controlled") and got["01"].issue is None
    assert got["04"].issue == "requested place has no row" and got["06"].issue == "requested place repeats"
    assert got["05"].issue == "unsupported special margin"


def test_boundaries(spark):
    def doc(geoid, kind, coords, n=1):
        return json.dumps({"type": "FeatureCollection", "features": [{"properties": {"GEOID": geoid}, "geometry": {"type": kind, "coordinates": coords}}] * n})
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    rows = spark.createDataFrame([
        ("ok", "1", doc("1", "Polygon", [ring])), ("multi", "1", doc("1", "MultiPolygon", [[ring], [ring]])),
        ("id", "2", doc("1", "Polygon", [ring])), ("few", "1", doc("1", "Polygon", [ring[:3]])),
        ("far", "1", doc("1", "Polygon", [[[0, 0], [200, 0], [1, 1], [0, 0]]])), ("two", "1", doc("1", "Polygon", [ring], 2)),
        ("point", "1", doc("1", "Point", [0, 0]))], "artifact string, geoid string, content string")
    got = {x.artifact: x for x in r.parse_boundaries(rows).collect()}
    assert got["ok"].issue is None and got["ok"].vertices == 4 and got["ok"].east == 1.0 and got["multi"].vertices == 8
    assert {k: bool(v.issue) for k, v in got.items()} == {"ok": False, "multi": False, "id": True, "few": True, "far": True, "two": True, "point": True}


def test_unwrap_and_fingerprint(spark):
    rows = spark.createDataFrame([
        ("s", "socrata", '[{"a":1},{"a":2}]'), ("c", "ckan", '{"success":true,"result":{"records":[{"a":1}]}}'),
        ("f", "ckan", '{"success":false,"result":{"records":[{"a":1}]}}'), ("k", "carto", '{"rows":[{"a":3}]}'),
        ("x", "carto", '{"data":[]}')], "artifact string, platform string, content string")
    got = r.unwrap(rows).collect()
    assert sorted(x.artifact for x in got if x.issue is None) == ["c", "k", "s", "s"]
    assert sorted(x.artifact for x in got if x.issue) == ["f", "x"]
    recs = spark.createDataFrame([("g", '{"b":1,"a":"x"}'), ("g", '{"a":null,"b":2}'), ("h", '{"a":"y","b":7}'), ("h", '{"a":null,"b":1}')], "g string, j string")
    out = {x.g: x.fingerprint for x in r.schema_fingerprint(recs, ["g"], "j").collect()}
    assert out["g"] == out["h"]
    drift = recs.withColumn("j", F.when(F.col("g") == "h", '{"a":1.5}').otherwise(F.col("j")))
    out = {x.g: x.fingerprint for x in r.schema_fingerprint(drift, ["g"], "j").collect()}
    assert out["g"] != out["h"]


def landed(tmp_path):
    root = tmp_path / "land"
    root.mkdir()
    out = {}
    for n in ("a.json", "b.json"):
        (root / n).write_text(f'{{"n": "{n}"}}')
        out[n] = "sha256:" + hashlib.sha256((root / n).read_bytes()).hexdigest()
    return root, out


def test_verification_checksums_and_manifest(spark, tmp_path):
    root, hashes = landed(tmp_path)
    files = i.hashed_files(spark, f"file:{root}")
    m = spark.createDataFrame([("1", "a.json", hashes["a.json"]), ("2", "b.json", "sha256:0"), ("3", "c.json", "x"), ("4", "../a.json", "x")],
                              "artifact_id string, artifact_path string, content_hash string")
    assert {x.artifact_id: x.status for x in i.verify_artifacts(files, m).collect()} == {
        "1": "verified", "2": "hash-mismatch", "3": "missing", "4": "unsafe-path"}
    lines = spark.createDataFrame([(hashes["a.json"][7:] + "  a.json",), ("0  c.json",)], "value string")
    assert {x.name: x.issue for x in i.verify_checksums(files, lines).collect()} == {
        "b.json": "file is not listed", "c.json": "listed file is missing"}
    man = i.artifact_manifest(files)
    assert {x.media_type for x in man.collect()} == {"application/json"}
    assert i.manifest_issues(man, 2).collect()[0].issues == [] and len(i.manifest_issues(man, 3).collect()[0].issues) == 1


def test_new_artifacts(spark):
    cols = "source_id string, window_start date, window_end date, content_hash string"
    d = date(2024, 1, 1)
    land = spark.createDataFrame([("s", d, d, "h1"), ("s", d, d, "h2")], cols)
    done = spark.createDataFrame([("s", d, d, "h1", "verified"), ("s", d, d, "h2", "hash-mismatch")], cols + ", status string")
    assert [x.content_hash for x in i.new_artifacts(land, done).collect()] == ["h2"]


def test_streaming_ingest_takes_each_file_once(spark, tmp_path):
    root, hashes = landed(tmp_path)
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    m = spark.createDataFrame([(n, n, h if n == "a.json" else "sha256:0") for n, h in hashes.items()], "artifact_id string, artifact_path string, content_hash string")
    ingest.ingest_new(spark, f"file:{root}", m, out, chk).awaitTermination(120)
    assert [x.name for x in spark.read.parquet(out).collect()] == ["a.json"]
    (root / "c.json").write_text("{}")
    m2 = m.unionByName(spark.createDataFrame([("c", "c.json", "sha256:" + hashlib.sha256(b"{}").hexdigest())], m.schema))
    ingest.ingest_new(spark, f"file:{root}", m2, out, chk).awaitTermination(120)
    assert sorted(x.name for x in spark.read.parquet(out).collect()) == ["a.json", "c.json"]


def test_a_killed_batch_is_neither_lost_nor_repeated(spark, tmp_path):
    land, out, chk = (str(tmp_path / n) for n in ("land", "out", "chk"))
    hexed = lambda s: "sha256:" + hashlib.sha256(s.encode()).hexdigest()
    rows = [(f"d{k}", f"text {k}") for k in range(40)] + [("bad", "forged"), ("none", None), ("d1", "text 1")]
    manifests = spark.createDataFrame([(n, n, hexed(t or "")) for n, t in rows[:-1] if n != "bad"] + [("bad", "bad", hexed("true"))],
                                      "artifact_id string, artifact_path string, content_hash string")
    schema = "name string, content string"
    spark.createDataFrame(rows[:20], schema).write.mode("append").parquet(land)
    done = []

    def run(written):
        ingest.ingest_stream(ingest.landed_records(spark, land), manifests, out, chk, written).awaitTermination(120)

    def killed(number):
        raise RuntimeError("lost after the write, before the commit")

    with pytest.raises(Exception, match="lost after the write"):
        run(killed)
    assert spark.read.parquet(out).count() == 20  # written, not committed
    run(done.append)
    spark.createDataFrame(rows[20:], schema).write.mode("append").parquet(land)
    with pytest.raises(Exception, match="lost after the write"):
        run(killed)
    run(done.append)
    run(done.append)
    names = sorted(x.name for x in spark.read.parquet(out).collect())
    assert names == sorted([f"d{k}" for k in range(40)] + ["d1"]) and done == [0, 1]


def test_streamed_days_equal_batch(spark, tmp_path):
    src = str(tmp_path / "req")
    rows = [("x", datetime(2024, 1, d, h), " Pothole " if h % 2 else "") for d in range(1, 8) for h in range(24)]
    df = spark.createDataFrame(rows, "city string, created timestamp, category string")
    df.write.parquet(src)
    stream = ingest.daily_category_stream(spark.readStream.schema(df.schema).parquet(src))
    ingest.run_available(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(120)
    got = {(x.service_day, x.category): x.request_count for x in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert len(got) >= 8 and set(got.values()) == {12} and {k[1] for k in got} == {"Pothole", "(missing)"}
    assert max(k[0] for k in got) < date(2024, 1, 7)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.5), ("a", 1.0)], "id string, v double")
    sinks.write_csv(df, str(tmp_path / "csv"), ["id"])
    assert [x.id for x in spark.read.csv(str(tmp_path / "csv"), header=True).collect()] == ["a", "b"]
    packs = spark.createDataFrame([("p", "T", "c", "completed", 4148633, "plan", None, ["one"], ["two"]), ("q", "U", "c", "negative", 1, None, "too few", ["l"], ["n"])],
        "pack_id string, title string, city_id string, status string, observed_requests long, selected_option_id string, failure_reason string, limitations array<string>, next_evidence array<string>")
    briefs = {x.pack_id: x.text for x in sinks.render_brief(packs).collect()}
    assert "4,148,633" in briefs["p"] and "Selected option: plan" in briefs["p"] and "No recommendation: too few" in briefs["q"]
    sinks.write_text(sinks.render_brief(packs), str(tmp_path / "txt"))
    assert sinks.render_table(df, ["id", "v"], "id").filter("id = 'b'").collect()[0].text == "| b | 2.5 |"
    sinks.write_json(df, str(tmp_path / "json"), ["id"])
    sinks.write_parquet(df, str(tmp_path / "pq"), ["id"])
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_drift_between_versions(spark):
    rows = [("s", 1, '{"a": 1, "b": {"c": 1}}'), ("s", 1, '{"a": 2}'), ("s", 2, '{"a": 1.5, "b": {"c": "x"}, "d": null}'), ("s", 5, '{"a": 1.5}'),
            (None, 1, '{"x": 1}'), (None, 2, '{"y": 1}'), ("one", 1, '{"x": 1}'), ("s", None, '{"z": 1}'), ("bad", 1, '{"x": 1}'), ("bad", 2, "no json"),
            ("same", 1, '{"x": 1, "y": "a"}'), ("same", 2, '{"y": "b", "x": 3}')]
    got = r.drift_report(spark.createDataFrame(rows, "series string, version int, j string"), ["series"], "version", "j").collect()
    assert {(x.series, x.version, x.previous, x.field, x.change) for x in got} == {
        ("s", 2, 1, "a", "retyped"), ("s", 2, 1, "b", "retyped"), ("s", 2, 1, "d", "added"), ("s", 5, 2, "b", "lost"), ("s", 5, 2, "d", "lost"),
        (None, 2, 1, "x", "lost"), (None, 2, 1, "y", "added"), ("bad", 2, 1, "x", "lost")}
    assert {(x.before, x.after) for x in got if x.field == "b" and x.version == 2} == {("OBJECT<c: BIGINT>", "OBJECT<c: STRING>")}
    assert r.drift_report(spark.createDataFrame([], "series string, version int, j string"), ["series"], "version", "j").collect() == []


def test_layout_replaces_partitions_and_keeps_ranges_apart(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.range(5000).selectExpr("id", "id % 2 AS part", "id * 3 AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one file
    try:
        sinks.write_layout(rows, path, ["part"], ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sinks.write_layout(rows.filter("part = 1 AND id < 100").selectExpr("id", "part", "-id AS v"), path, ["part"], ["id"])
    back = spark.read.parquet(path)
    expected = {(i, 0, i * 3) for i in range(0, 5000, 2)} | {(i, 1, -i) for i in range(1, 100, 2)}
    assert sorted((x.id, x.part, x.v) for x in back.collect()) == sorted(expected)
    files = sorted(sinks.layout_manifest(back, ["part"], "id").collect(), key=lambda f: (f.part, f.first))
    assert sum(f.record_count for f in files) == len(expected) and len(files) > 2
    assert all(a.part != b.part or a.last < b.first for a, b in zip(files, files[1:]))


def test_zones_are_those_of_the_database(spark):
    row = dict.fromkeys(r.GAZETTEER, "")
    row |= {"geonameid": "1", "name": "n", "feature_class": "P", "latitude": "1", "longitude": "1", "country_code": "DE"}
    rows = [{**row, "timezone": zone} for zone in ("Europe/Berlin", "UTC", "Foo/Bar", "")]
    got = [x.issues for x in r.parse_gazetteer(spark.createDataFrame(rows)).orderBy("timezone").collect()]
    assert got == [["time zone is invalid"], [], ["time zone is invalid"], []]

