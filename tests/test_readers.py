"""Readers of station files and payloads: cut into stations, with what cannot be read set aside."""

import json

from tidelane.sources import readers

SCHEMA = "station_id string, year int, days array<struct<month:int,readings:array<struct<time:string,metres:double>>>>"


def station(i):
    return {"station_id": f"s{i} {{ }} ] \n", "year": 2026, "days": [{"month": m, "readings": [{"time": "01:05", "metres": m / 2}] * 20} for m in range(1, 13)]}


def test_a_big_file_is_many_tasks(spark, tmp_path):
    doc = {"made": {"stations": 1}, "stations": [station(i) for i in range(400)], "after": [{"x": 1}]}
    (tmp_path / "pretty.json").write_text(json.dumps(doc, indent=2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = readers.stations(spark, f"file://{tmp_path}", SCHEMA)
        used = readers.station_records(spark, f"file://{tmp_path}", SCHEMA).where("reason is null").selectExpr("spark_partition_id() as p").distinct().count()
        got = sorted(tuple(r) for r in rows.selectExpr("station_id", "year", "size(days)", "days[11].readings[19].metres").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert used > 10
    assert got == sorted((station(i)["station_id"], 2026, 12, 6.0) for i in range(400))
    assert [r.reason for r in readers.rejected_stations(spark, f"file://{tmp_path}", SCHEMA).collect()] == ["empty"]  # of the list behind


def test_spoiled_stations_spoil_themselves_alone(spark, tmp_path):
    doc = {"stations": [station(i) for i in range(30)]}
    text = json.dumps(doc, indent=2)
    (tmp_path / "a.json").write_text(text.replace('"s7 ', 's7 ', 1))
    (tmp_path / "b.json").write_text(text[: text.index('"s29 ') + 300])
    (tmp_path / "c.json").write_text(json.dumps({"stations": [station(50)]}))
    (tmp_path / "d.json").write_text('{"stations": [')
    (tmp_path / "e.json").write_text('{"other": 1}')
    (tmp_path / "f.json").write_text(json.dumps({"stations": []}, indent=2))
    (tmp_path / "g.json").write_text("nonsense")
    (tmp_path / "h.json").write_text(json.dumps({"stations": [{"station_id": "x"}, {}, {"station_id": None, "year": None}]}, indent=2))
    good = readers.stations(spark, f"file://{tmp_path}", SCHEMA)
    bad = readers.rejected_stations(spark, f"file://{tmp_path}", SCHEMA).collect()
    assert good.count() == 29 + 29 + 1 + 1
    assert sorted((r.file[-6:], r.reason) for r in bad if r.file[-6] != "d") == [("a.json", "malformed"), ("b.json", "cut short"), ("e.json", "no stations"), ("g.json", "malformed"), ("h.json", "empty")]
    assert "s7" in next(r.text for r in bad if r.file.endswith("a.json"))
    assert readers.stations(spark, f"file://{tmp_path}/none", SCHEMA).collect() == []


def test_payloads_with_reasons(spark, tmp_path):
    files = {
        "tide_1.json": {"predictions": [{"t": "2026-01-01 00:10", "v": "1.5"}]}, "tide_2.json": {"error": {"message": "no data"}}, "current_P_1_bin3.json": {"current_predictions": {"cp": []}},
        "tide_4.json": {}, "other.json": {"predictions": []},
    }
    for name, x in files.items():
        (tmp_path / name).write_text(json.dumps(x, indent=1))
    (tmp_path / "tide_9.json").write_text('{"predictions": [{"t": "2026')
    good, bad = readers.split_errors(readers.payloads(spark, f"file://{tmp_path}"))
    assert sorted((r.kind, r.id, r.bin) for r in good.collect()) == [("current", "P_1", 3), ("tide", "1", None)]
    assert sorted((r.id or "", r.reason, r.message) for r in bad.collect()) == [("", "no name", None), ("2", "error", "no data"), ("4", "no predictions", None), ("9", "malformed", None)]
    assert "2026" in next(r.text for r in bad.collect() if r.reason == "malformed")
