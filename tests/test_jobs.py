"""The second and third workload on hand-made rows."""

import pytest

from tidelane.operators import stations
from tidelane.plans import jobs


def test_payloads_become_documents(spark):
    picks = spark.createDataFrame([("1", 0, "A", "p", "R", ""), ("1", 1, "dup", "p", "R", ""), ("2", 2, "B", "q", "S", "")], "id string, pos int, name string, placename string, type string, reference_id string")
    cat = spark.createDataFrame([("1", 0, "a", 48.0, -123.0, "R", ""), ("2", 1, "b, 0.6 mi. NE of", 49.0, -123.0, "S", "")], "id string, pos int, name string, lat double, lng double, type string, reference_id string")
    pay = spark.createDataFrame([("1", [("2026-01-02 01:00", "1.5"), ("2026-01-02 07:00", "x"), ("2026-01-01 01:00", "2")])], "id string, predictions array<struct<t:string,v:string>>")
    with pytest.raises(RuntimeError):
        jobs.conform_payloads(pay, picks, cat)
    docs, lost = jobs.conform_payloads(pay, picks, cat, force=True)
    r = docs.collect()
    assert [(x.station_id, x.name, x.lat, [d.date for d in x.days]) for x in r] == [("noaa:1", "a", 48.0, ["2026-01-01", "2026-01-02"])]
    assert [d.readings[1].metres for d in r[0].days if len(d.readings) > 1] == [None]
    assert [x.id for x in lost.collect()] == ["2"]


def test_conform_and_publish(spark):
    docs = spark.createDataFrame([(1, "A", 48.0, -123.0, "x"), (2, "B", 48.0, -123.0, "x"), (3, "C", 48.0, -123.0, "x")], "index_no int, name string, latitude double, longitude double, note string")
    inv = spark.createDataFrame([(1, 48.001, -123.0, 3), (3, 49.0, -123.0, 4)], "index_no int, lat double, lon double, decimals int")
    none = spark.createDataFrame([], "index_no int, lat double, lon double")
    out, flagged = jobs.conform_and_publish(docs, inv, none, spark.createDataFrame([(2,)], "index_no int"), "tidal_primary")
    assert out.columns == ["index_no", "name", "latitude", "longitude"] or set(out.columns) == {"index_no", "name", "latitude", "longitude"}
    assert sorted((r.index_no, r.latitude) for r in out.collect()) == [(1, 48.001), (3, 48.0)]
    assert [r.index_no for r in flagged.collect()] == [3]


def test_station_rules(spark):
    s = spark.createDataFrame([(1, "tide-secondary", None, 1.0, 2.0), (2, "tide-primary", True, 1.0, None), (3, "current-secondary", False, 1.0, 2.0), (4, "tide-primary", None, 1.0, 2.0)], "id int, kind string, us_secondary boolean, lat double, lon double")
    assert sorted(r.id for r in stations.visible(s, 8).collect()) == [3, 4] and sorted(r.id for r in stations.visible(s, 9).collect()) == [1, 2, 3, 4]
    assert [r.id for r in stations.split_located(s)[1].collect()] == [2]
    f = spark.createDataFrame([(0.0, None), (None, -3.0), (2.0, 1.0)], "a double, b double")
    assert [r[0] for r in f.select(stations.service_current_bound(f.a, f.b)).collect()] == [None, 3.0, 2.0]
