"""Readers, writers, coordinates, catalogs, profile, records and streams on small hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F

from tidelane.operators import catalog, coords, extract_lines, extract_words, station_table, normalise, profile, publish, segments
from tidelane.sources import publication, readers, writers
from tidelane.streaming import instants

DAY = "month int, day int, readings array<struct<time:string,metres:double>>"
DOCUMENT = f"station_id string, year int, utc_offset int, days array<struct<{DAY.replace(' int', ':int').replace('readings array', 'readings:array')}>>"


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"stations": [{"station_id": "x", "year": 2026, "utc_offset": -8, "days": [{"month": 1, "day": 2, "readings": [{"time": "01:05", "metres": 2.5}, {"time": "01:05", "metres": 1.5}]}]}]}))
    docs = readers.stations(spark, str(tmp_path / "a.json"), DOCUMENT)
    got = normalise.tide_extremes(docs).orderBy("ord").collect()
    assert [(r.station_id, r.ord, r.v) for r in got] == [("x", 0, 2.5), ("x", 1, 1.5)] and got[0].t_us == 1767344700000000
    assert readers.stations(spark, str(tmp_path / "none.json"), DOCUMENT).count() == 0

    (tmp_path / "inv.csv").write_text("﻿STATION_NUMBER,LATITUDE,LONGITUDE\r\n7,48.123,-123.1\r\nx,1,2\r\n7,48.5,-123.25\r\n8,,3\r\n")
    assert [tuple(r) for r in readers.inventory(spark, str(tmp_path / "inv.csv")).select("index_no", "lat", "lon", "decimals").collect()] == [(7, 48.5, -123.25, 1)]

    (tmp_path / "over.json").write_text('{"_note": "x", "_suppress_index_nos": [3, "4", "z", 3], "5": [-123.5, 48.25], "6": null, "seven": [1, 2], "8": [1]}')
    assert sorted(tuple(r) for r in readers.overrides(spark, str(tmp_path / "over.json")).collect()) == [(5, 48.25, -123.5), (6, None, None)]
    assert sorted(r.index_no for r in readers.suppressed(spark, str(tmp_path / "over.json")).collect()) == [3, 4]

    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/tide_9447130.json").write_text(json.dumps({"predictions": [{"t": "2026-01-01 00:10", "v": "1.5"}]}))
    (tmp_path / "raw/current_PUG1515_bin12.json").write_text(json.dumps({"current_predictions": {"cp": [{"Time": "2026-01-01 00:10", "Type": "slack", "Velocity_Major": 0.1}]}}))
    (tmp_path / "raw/tide_1.json").write_text(json.dumps({"error": {"message": "no"}}))
    good, bad = readers.split_errors(readers.payloads(spark, str(tmp_path / "raw")))
    assert sorted((r.kind, r.id, r.bin) for r in good.collect()) == [("current", "PUG1515", 12), ("tide", "9447130", None)]
    assert [(r.id, r.message) for r in bad.collect()] == [("1", "no")]
    assert [r.metres for r in normalise.tide_rows(good.where("kind = 'tide'")).collect()] == [1.5]


def test_publish_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(2025, "a", 1, "x"), (2025, "b", 2, "y"), (2026, "a", 3, "z")], "year int, kind string, n int, s string")
    path = str(tmp_path / "out")
    first = {tuple(r) for r in publication.publish(df, path).collect()}
    stamp = sorted(p.stat().st_mtime_ns for p in (tmp_path / "out/data").rglob("*.parquet"))
    assert {tuple(r) for r in publication.publish(df.repartition(3), path).collect()} == first
    assert sorted(p.stat().st_mtime_ns for p in (tmp_path / "out/data").rglob("*.parquet")) == stamp
    changed = {tuple(r) for r in publication.publish(df.withColumn("s", F.when(F.col("n") == 3, "w").otherwise(F.col("s"))), path, grace_s=0).collect()}
    assert len(first & changed) == 2 and spark.read.parquet(f"{path}/data").count() == 3
    assert sorted(map(tuple, publication.read_published(spark, path).select("year", "kind", "n", "s").collect())) == [(2025, "a", 1, "x"), (2025, "b", 2, "y"), (2026, "a", 3, "w")]
    assert {tuple(r) for r in publication.publish(df.where("n = 1"), path).collect()} == changed
    assert {r.kind for r in publication.publish(df.where("n = 1"), path, whole=True, grace_s=0).collect()} == {"a"} and spark.read.parquet(f"{path}/data").count() == 1
    with pytest.raises(FileNotFoundError):
        publication.publish(df.limit(0), str(tmp_path / "none"))
    writers.write_report(spark.createDataFrame([("1", "missing", "p")], "id string, kind string, placename string"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).first().detail == '{"placename":"p"}'


def test_strip(spark):
    doc = spark.createDataFrame([("x", 1, "note", [(1, 2, "Mo", [("01:00", "max", 0.0, True), ("02:00", "slack", 0.0, False)])])], "station_id string, index_no int, note string, days array<struct<month:int,day:int,weekday:string,events:array<struct<time:string,kind:string,knots:double,weak_variable:boolean>>>>")
    out = publish.strip(doc, "current_primary")
    assert out.columns == ["station_id", "index_no", "days"]
    assert out.select(F.to_json("days")).first()[0] == '[{"month":1,"day":2,"events":[{"time":"01:00","kind":"max","knots":0.0,"weak_variable":true},{"time":"02:00","kind":"slack","knots":0.0}]}]'
    assert publish.strip(doc, "other").columns == doc.columns
    assert publish.strip(doc, "noaa_current_primary").columns == ["station_id", "days"] and publish.strip(doc, "tidal_secondary").columns == ["station_id", "index_no"]
    same = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, n int")
    marks = [{r.k: r.fingerprint for r in publish.fingerprint(x, ["k"], "n").collect()} for x in (same, same.repartition(3), same.distinct())]
    assert marks[0] == marks[1] and marks[0]["a"] != marks[2]["a"] and marks[0]["b"] == marks[2]["b"]


def test_texts_headers_and_empty_curves(spark):
    from tidelane.functions import text
    from tidelane.operators import derive, interpolate

    row = spark.range(1).select(text.height_text(F.lit(1.44)).alias("a"), text.height_text(F.lit(1.4), True).alias("b"), text.speed_text(F.lit(-2.61)).alias("c"), text.speed_value(F.lit(-2.61)).alias("d")).first()
    assert tuple(row) == ("1.4 m", "4.6 ft", "-2.6 kt", "2.6")
    lines = spark.createDataFrame([(["2026", "ACTIVE PASS", "PST (UTC-8h) more"],), (["2026", "x", "(UTC-8)"],), (["20", "A", "(UTC-8)"],), (["2026", "A"],)], "x array<string>")
    got = [r.h for r in lines.select(extract_lines.current_header(F.col("x")).alias("h")).collect()]
    assert tuple(got[0]) == ("ACTIVE PASS", -8, 2026) and got[1:] == [None] * 3
    curves = spark.createDataFrame([("a", None), ("a", None), ("b", None), ("b", 1.0)], "station_id string, value double")
    assert {r.station_id: r.empty for r in interpolate.empty_curves(curves).collect()} == {"a": True, "b": False}
    axis = spark.createDataFrame([(0.0, 2.0), (2.0, 2.0), (-9.0, 2.0), (0.25, 0.1)], "v double, b double").select(interpolate.current_axis(F.col("v"), F.col("b")).alias("y")).collect()
    assert [round(r.y, 6) for r in axis] == [55.0, 22.0, 88.0, 38.5]
    names = spark.createDataFrame([(2026, "JOHNSTONE STR. CEN.", "j")], "year int, ref_name string, ref_id string")
    found, lost = derive.resolve(spark.createDataFrame([(1, 2026, "JOHNSTONE STRAIT-CENTRAL"), (2, 2026, "NONE")], "sec_id int, year int, reference string"), names, derive.CURRENT_ALIASES)
    assert [(r.sec_id, r.ref_id) for r in found.collect()] == [(1, "j")] and [r.sec_id for r in lost.collect()] == [2]


def test_contents_pages(spark):
    rows = [("Introduction (Tables 1, 2 and 3) 7", 50.0), ("Tide Tables", 50.0), ("Point A .... 12", 90.0), ("Point B 16", 90.0), ("Current Tables", 50.0), ("Pass C..20", 90.0), ("Notes", 50.0), ("Lost 30", 90.0), ("Table of all (Table 4) 40", 50.0), ("Lost too 41", 90.0)]
    toc = spark.createDataFrame([("v", i, t, x) for i, (t, x) in enumerate(rows)], "doc string, row int, text string, x0 double")
    got = extract_lines.contents(toc).orderBy("row").collect()
    assert [(r.section, r.title, r.printed_page, r.tables) for r in got if not r.tables] == [("Tide Tables", "Point A", 12, []), ("Tide Tables", "Point B", 16, []), ("Current Tables", "Pass C", 20, [])]
    assert [(r.printed_page, r.tables) for r in got if r.tables] == [(7, [1, 2, 3]), (40, [4])]
    words = spark.createDataFrame([("v", 5, "Contents", 10.0), ("v", 5, "3", 700.0), ("w", 2, "none", 1.0)], "doc string, page int, text string, top double")
    assert {r.doc: r.offset for r in extract_lines.page_offset(words).collect()} == {"v": 2, "w": None}


def test_coordinates(spark):
    s = spark.createDataFrame([(1, 48.0, -123.0), (2, 48.0, -123.0), (3, 48.0, -123.0), (4, 48.0, -123.0), (5, 48.0, -123.0), (None, 48.0, -123.0), (6, None, None)], "index_no int, lat double, lon double").withColumn("kind", F.lit("k"))
    inv = spark.createDataFrame([(1, 48.001, -123.0, 3), (2, 48.001, -123.0, 2), (3, 48.03, -123.0, 3), (4, 48.06, -123.0, 2), (5, 48.9, -123.0, 4)], "index_no int, lat double, lon double, decimals int")
    over = spark.createDataFrame([(5, None, None), (3, 50.0, -120.0)], "index_no int, lat double, lon double")
    got = {r.index_no: (r.coord_source, r.lat, r.flagged) for r in coords.resolve(s, inv, over).collect()}
    assert got == {1: ("csv", 48.001, False), 2: ("kept", 48.0, False), 3: ("override", 50.0, False), 4: ("kept", 48.0, True), 5: ("verified", 48.0, False), None: ("kept", 48.0, False), 6: ("kept", None, False)}
    assert coords.suppress(s, spark.createDataFrame([(1,)], "index_no int")).count() == 6
    up = spark.createDataFrame([("12", 1.0, 2.0), ("12a", 1.0, 2.0), ("13", None, 2.0)], "code string, lat double, lon double")
    assert [r.index_no for r in coords.upstream_stations(up).collect()] == [12]


def test_gate_and_direct_lookup(spark):
    picks = spark.createDataFrame([("1", 0, "A ", "p", "R", ""), ("2", 1, "B", "q", None, "")], "id string, pos int, name string, placename string, type string, reference_id string")
    cat = spark.createDataFrame([("1", 0, "a", "R", "")], "id string, pos int, name string, type string, reference_id string")
    drift = catalog.tide_drift(picks, cat)
    assert [(r.id, r.kind) for r in drift.collect()] == [("2", "missing")]
    assert catalog.tide_drift(picks, cat, cat.withColumn("id", F.lit("2")).withColumn("name", F.lit("b")).drop("pos")).count() == 0
    with pytest.raises(RuntimeError):
        catalog.gate(drift)
    assert catalog.gate(drift, force=True) == 1


def test_profile_counts_absent_fields_in_the_whole(spark):
    values = spark.createDataFrame([("s", "f", v) for v in ["a", "a", "b", "null"]] + [("s", "g", "x")], "level string, field string, value string")
    totals = spark.createDataFrame([("s", 5)], "level string, objects long")
    got = {r.field: (r.share, r.n_values, r.top3, r.tag) for r in profile.profile(values, totals).collect()}
    assert got == {"f": (0.4, 3, "a=2|b=1|null=1", ""), "g": (0.2, 1, "x=1", "")}


def test_nesting_is_undone_by_flattening(spark):
    rows = spark.createDataFrame([("a", "2026-01-02", 1, "03:00", 2.0), ("a", "2026-01-01", 0, "02:00", 1.0), ("a", "2026-01-02", 2, "03:00", 5.0)], "station_id string, date string, pos int, time string, metres double")
    docs = normalise.nest_days(rows, ["station_id"], ["time", "metres"]).withColumn("year", F.lit(2026)).withColumn("utc_offset", F.lit(0))
    assert [r.weekday for r in docs.select(F.explode("days").alias("d")).select("d.*").collect()] == ["Thu", "Fri"]
    assert [r.v for r in normalise.tide_extremes(docs).orderBy("t_us", "ord").collect()] == [1.0, 2.0, 5.0]


def test_headers_and_merges(spark):
    line = "POINT ATKINSON PST-HNP (UTC-8) 2026 TIDE TABLES"
    h = spark.createDataFrame([(line,), ("other",)], "x string").select(extract_lines.tide_header(F.col("x")).alias("h")).collect()
    assert tuple(h[0].h) == ("POINT ATKINSON", "PST-HNP", -8, 2026) and h[1].h is None
    d = spark.createDataFrame([("Flood/flot direction 045 True/vraie - Ebb/jusant direction 225 True/vraie",)], "x string").select(extract_lines.flow_directions(F.col("x")).alias("d")).first().d
    assert tuple(d) == (45, 225)
    toc = spark.createDataFrame([("v", 0, "Tide Tables", 50.0), ("v", 1, "Point A .... 12", 90.0), ("v", 2, "Point B 16", 90.0), ("v", 3, "Current Tables", 50.0), ("v", 4, "Pass C..20", 90.0)], "doc string, row int, text string, x0 double")
    got = extract_lines.page_ranges(extract_lines.contents(toc), F.lit(24)).orderBy("row").collect()
    assert [(r.section, r.title, r.first_page, r.end_page) for r in got] == [("Tide Tables", "Point A", 12, 16), ("Tide Tables", "Point B", 16, 20), ("Current Tables", "Pass C", 20, 24)]
    st = spark.createDataFrame([("v", 0, "ALPHA BAY", -8), ("v", 1, "BETA", -8), ("v", 2, "GAMMA", -8)], "doc string, pos int, name string, utc_offset int")
    t = spark.createDataFrame([("v", 0, "ALPHA", -8, 1.5), ("v", 1, "BETA", -7, 2.5)], "doc string, pos int, name string, utc_offset int, mean double")
    good, bad = extract_lines.merge_by_position(st, t)
    assert [(r.name, r.mean) for r in good.collect()] == [("ALPHA BAY", 1.5)] and sorted((r.pos, r.problem) for r in bad.collect()) == [(1, "offset"), (2, "count")]
    by_name = spark.createDataFrame([("v", "alpha-bay", 1), ("v", "delta", 2)], "doc string, name string, n int")
    good, bad = extract_lines.merge_by_name(st, by_name)
    assert [(r.name, r.n) for r in good.collect()] == [("ALPHA BAY", 1)] and [r.problem for r in bad.collect()] == ["unmatched"]


def test_current_station_table(spark):
    def row(top, *words):
        return [("d", 1, w, float(x), float(top)) for w, x in words]

    words = (
        row(10, ("REFERENCE", 50), ("AND", 90), ("SECONDARY", 120)) + row(20, ("7000", 42), ("RACE", 72), ("ROCKS", 100), ("075", 182), ("48", 206), ("18", 222), ("123", 236), ("32", 254), ("6.0", 450), ("5.5", 485))
        + row(30, ("on/sur", 70), ("RACE", 100), ("ROCKS,", 130), ("pages", 160), ("80-83", 190)) + row(40, ("HARO", 72), ("ZONE", 100))
        + row(50, ("7245", 42), ("HARO", 72), ("STRAIT", 100), ("001", 182), ("48", 206), ("35", 222), ("123", 236), ("15", 254), ("+1", 280), ("25(a)", 295), ("+1", 320), ("35", 335), ("+2", 360), ("30", 375), ("+1", 410), ("40", 425), ("45", 515), ("45", 550))
        + row(60, ("(NORTH)", 72)) + row(70, ("LW", 300), ("HW", 380)) + row(80, ("PRINCESS", 72), ("INLET", 130)) + row(90, ("7863", 42), ("MALIBU", 72), ("+0", 280), ("35", 295), ("+0", 360), ("25", 375), ("9.0", 450))
    )
    got = station_table.current_stations(spark.createDataFrame(words, "doc string, page int, text string, x0 double, top double")).orderBy("index_no").collect()
    assert [(r.index_no, r.name, r.role, r.reference_primary, r.geographic_zone, r.name_annotation, r.offsets_from_tides, r.has_footnote) for r in got] == [
        (7000, "RACE ROCKS", "reference", None, None, None, False, False),
        (7245, "HARO STRAIT", "secondary", "RACE ROCKS", "HARO ZONE", "(NORTH)", False, True),
        (7863, "PRINCESS INLET MALIBU", "secondary", "RACE ROCKS", None, None, True, False),
    ]
    assert (got[1].turn_to_flood_diff, got[1].flood_max_diff, got[1].turn_to_ebb_diff, got[1].ebb_max_diff, got[1].pct_ref_flood) == ("+01:25", "+01:35", "+02:30", "+01:40", 45)
    assert (got[2].turn_to_flood_diff, got[2].flood_max_diff, got[2].max_flood_knots) == ("+00:35", None, 9.0) and got[0].max_ebb_knots == 5.5


def test_rows_are_anchored_at_their_first_word(spark):
    words = [("d", 1, t, float(x), float(y)) for t, x, y in [("a", 0, 0), ("b", 5, 1.5), ("c", 9, 3.0), ("d", 1, 3.5)]]
    got = extract_words.word_rows(spark.createDataFrame(words, "doc string, page int, text string, x0 double, top double")).orderBy("row").collect()
    assert [r.text for r in got] == ["a b", "d c"]


def test_streams_give_the_batch_result(spark, tmp_path):
    e = spark.createDataFrame([("a", t * 5 * 3_600_000_000, t, float(t % 3 - 1), False) for t in range(30)], "station_id string, t_us long, ord long, v double, weak boolean")
    q = spark.createDataFrame([("a", t * 7 * 3_600_000_000 + 1) for t in range(-2, 25)] + [("z", 1)], "station_id string, t_us long")
    q.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    instants.run_available(instants.stream_snapshot(stream, segments.bucketed_segments(e)), str(tmp_path / "out"), str(tmp_path / "cp"))
    from tidelane.operators import interpolate

    want = segments.as_of(e, q).where("t1 is not null").select("station_id", "t_us", interpolate.current_value().alias("value"), interpolate.current_state().alias("state"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))

    rows = spark.sql("select 'k' key, timestamp'2026-01-01 00:00:10' ts, 1 value union all select 'k', timestamp'2026-01-01 00:00:50', 2 union all select 'k', timestamp'2026-01-01 01:00:00', 3")
    rows.coalesce(1).write.parquet(str(tmp_path / "in2"))
    instants.run_available(instants.conflate(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in2"))), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    assert [(r.key, r.value) for r in spark.read.parquet(str(tmp_path / "out2")).collect()] == [("k", 2)]


def test_one_decimal_goes_by_the_exact_value(spark):
    import random
    from decimal import ROUND_HALF_UP, Decimal

    from tidelane.functions import text

    rng = random.Random(2)
    values = [0.0, -0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.75, -0.25, -0.04, 1.005, 2.675, 2.0**47 + 0.25, 99.95, 1234567.85] + [rng.randrange(-4000, 4000) / 20 for _ in range(3000)] + [rng.uniform(-50, 50) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.one_decimal(F.col("v")).alias("t")).collect()
    for v, t in rows:
        size = Decimal(abs(v)).quantize(Decimal("0.1"), ROUND_HALF_UP)
        assert t == f"{'-' if v < 0 else ''}{size}", v
