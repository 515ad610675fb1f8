"""Written expectations of lookup, interpolation, derivation and merging."""

import math

import pytest
from pyspark.sql import functions as F

from tidelane.functions import text, timeutil
from tidelane.operators import classify, derive, interpolate, merge, segments

MINUTE = 60_000_000
EVENTS = "station_id string, t_us long, ord long, v double, weak boolean"


def at(spark, events, times, current=False):
    e = spark.createDataFrame([("a", int(t), i, float(v), w) for i, (t, v, w) in enumerate(events)], EVENTS)
    q = spark.createDataFrame([("a", int(t)) for t in times], "station_id string, t_us long")
    f = (interpolate.current_value, interpolate.current_state, interpolate.current_weak) if current else (interpolate.tide_value, interpolate.tide_state, lambda: F.lit(False))
    rows = segments.as_of(e, q).select("t_us", *(x().alias(n) for n, x in zip(("v", "s", "w"), f))).collect()
    return {r.t_us: (None if r.v is None else round(r.v, 9), r.s, r.w) for r in rows}


def test_tide_lookup(spark):
    hour = 60 * MINUTE
    got = at(spark, [(0, 1.0, False), (6 * hour, 4.0, False), (12 * hour, 2.0, False)], [-1, 0, 3 * hour, 6 * hour, 4 * MINUTE, 12 * hour, 12 * hour + 1, 9 * hour])
    assert got[-1] == (None, None, False) and got[12 * hour + 1] == (None, None, False)
    assert got[0] == (1.0, "slack", False) and got[3 * hour] == (2.5, "flood", False)
    assert got[6 * hour][:2] == (4.0, "slack") and got[9 * hour][:2] == (3.0, "ebb")
    assert got[4 * MINUTE][1] == "slack" and got[12 * hour] == (2.0, "slack", False)


def test_current_lookup(spark):
    got = at(spark, [(0, 0.0, False), (300, -5.0, False), (600, 0.0, False), (900, 0.0, True), (1200, 0.0, False), (1500, 3.0, False), (1800, 2.0, False)], [100, 200, 300, 600, 700, 850, 1000, 1100, 1650], True)
    assert got[100][:2] == (-2.5, "ebb") and got[200][0] == round(-5 * math.sin(math.pi / 3), 9)
    assert got[300][0] == -5.0 and got[600][:2] == (0.0, "slack")
    assert got[700] == (0.0, "slack", False) and got[850] == (0.0, "slack", True) and got[1000] == (0.0, "slack", True) and got[1100] == (0.0, "slack", False)
    assert got[1650][:2] == (2.5, "flood")


def test_equal_instants(spark):
    """The later of equal events decides, but at the very end the one before the last."""
    got = at(spark, [(0, 1.0, False), (10, 2.0, False), (10, 5.0, False), (20, 3.0, False), (20, 7.0, False)], [10, 20, 5])
    assert got[10][0] == 5.0 and got[20] == (3.0, "slack", False) and got[5][0] == 1.5
    e = spark.createDataFrame([("a", t, i, float(v), False) for i, (t, v) in enumerate([(0, 1), (10, 2), (10, 5), (20, 3), (20, 7)])], EVENTS)
    q = spark.createDataFrame([("a", t) for t in (-1, 0, 10, 20, 21)] + [("b", 1)], "station_id string, t_us long")
    both = [sorted(map(repr, map(tuple, f.select("station_id", "t_us", *segments.SEGMENT).collect()))) for f in (segments.as_of(e, q), segments.as_of_bucketed(e, q, 7))]
    assert both[0] == both[1]
    assert at(spark, [(0, 1.0, False)], [0]) == {0: (None, None, False)}


def test_grid_and_snapshot_agree_with_lookup(spark):
    e = spark.createDataFrame([("a", t * 7 * MINUTE, t, float(t % 5 - 2), False) for t in range(20)] + [("b", 0, 0, 1.0, False)], EVENTS)
    grid = interpolate.grid(segments.segments(e), 3 * MINUTE)
    want = {(r.station_id, r.t_us): r.v for r in grid.select("station_id", "t_us", interpolate.tide_value().alias("v")).collect()}
    assert len(want) == 45
    times = grid.select("t_us").distinct()
    for found in (segments.as_of(e, grid.select("station_id", "t_us")), segments.snapshot(e, times), segments.snapshot(e, times, limit=3), segments.as_of_bucketed(e, grid.select("station_id", "t_us"), 60 * MINUTE)):
        got = {(r.station_id, r.t_us): r.v for r in found.where("t1 is not null").select("station_id", "t_us", interpolate.tide_value().alias("v")).collect()}
        assert got == want


def test_station_time(spark):
    rows = spark.createDataFrame([(2026, 6, 15, "06:00", -8), (2026, 12, 31, "23:59", -8)], "y int, m int, d int, t string, o int")
    got = [r.x for r in rows.select(timeutil.iso_minutes(timeutil.station_time_us(*(F.col(c) for c in "ymdto"))).alias("x")).collect()]
    assert got == ["2026-06-15T14:00:00Z", "2027-01-01T07:59:00Z"]


def test_local_days_follow_the_zone(spark):
    t = spark.sql("select unix_micros(timestamp'2024-03-11 05:00:00Z') t, unix_micros(timestamp'2024-03-09 20:00:00Z') u")
    r = t.select(timeutil.local_midnight_us(F.col("t"), "America/Vancouver").alias("a"), timeutil.local_midnight_us(F.col("u"), "America/Vancouver").alias("b")).first()
    assert r.a - r.b == 24 * 60 * MINUTE  # from midnight to midnight, before the clock change
    assert spark.range(1).select(timeutil.signed_minutes(F.lit("-00:50")), timeutil.signed_minutes(F.lit("01:30"))).first()[:] == (-50, 90)


def test_high_low_takes_ends_and_ties(spark):
    e = spark.createDataFrame([("a", i, i, v, False) for i, v in enumerate([2.0, 1.0, 3.0, 3.0, 0.0])], EVENTS)
    assert [r.is_high for r in classify.high_low(e).orderBy("t_us").collect()] == [True, False, True, True, False]
    assert classify.high_low(e.limit(1)).first().is_high


def roles(spark, events):
    e = spark.createDataFrame([("a", 2026, i, i, v, w, k) for i, (v, w, k) in enumerate(events)], "station_id string, year int, t_us long, ord long, v double, weak boolean, kind string")
    return [r.role for r in classify.current_roles(e).orderBy("t_us").collect()]


def test_current_roles(spark):
    assert roles(spark, [(0.0, False, "slack"), (2.0, False, "max"), (0.0, False, "slack"), (0.0, True, "max"), (0.0, False, "slack"), (-1.0, False, "max"), (0.0, False, "slack"), (0.0, True, "max")]) == [
        "slack-to-flood", "max-flood", "slack-to-ebb", "max-ebb", "slack-to-ebb", "max-ebb", "slack-to-flood", "max-ebb",
    ]
    assert roles(spark, [(0.0, False, "slack"), (0.0, True, "max")]) == ["slack-to-flood", "max-flood"]


SEC = "sec_id long, year int, ref_id string, turn_to_flood string, turn_to_ebb string, flood_diff string, ebb_diff string, pct_flood int, pct_ebb int, max_flood_knots double, max_ebb_knots double"
REF = "station_id string, year int, t_us long, ord long, v double, weak boolean, role string"


@pytest.fixture(scope="module")
def reference(spark):
    m = MINUTE
    rows = [(420, 0.0, False, "slack-to-flood"), (600, 3.5, False, "max-flood"), (780, 0.0, False, "slack-to-ebb"), (960, 0.0, True, "max-ebb"), (1140, 0.0, False, "slack-to-flood")]
    return spark.createDataFrame([("r", 2026, t * m, i, v, w, k) for i, (t, v, w, k) in enumerate(rows)], REF)


def derived(spark, reference, *sec):
    rows = derive.secondary_currents(spark.createDataFrame([(1, 2026, "r", *sec)], SEC), reference).orderBy("t_us").collect()
    return [(r.t_us // MINUTE, round(r.v, 6), r.weak) for r in rows]


def test_secondary_currents(spark, reference):
    assert derived(spark, reference, "-00:50", "-00:15", "-00:30", "-00:25", 70, 70, None, None) == [(370, 0.0, False), (570, 2.45, False), (765, 0.0, False), (935, 0.0, True), (1090, 0.0, False)]
    assert derived(spark, reference, "+00:00", "+00:00", "+00:00", "+00:00", None, None, 4.0, 2.0)[1] == (600, 4.0, False)
    assert derived(spark, reference, "+00:10", "+00:10", None, None, None, None, 9.0, 3.0) == [(430, 0.0, False), (610, 9.0, False), (790, 0.0, False), (970, -3.0, False), (1150, 0.0, False)]
    assert derived(spark, reference, "+00:10", "+00:10", None, None, None, None, 9.0, 0.0) == [(430, 0.0, False), (610, 9.0, False), (790, 0.0, False), (1150, 0.0, False)]
    assert derived(spark, reference, "+00:10", "+00:10", None, None, None, None, None, None) == []


def test_secondary_tides_meet_the_large_tide(spark):
    ref = spark.createDataFrame([("r", 2026, 0, 0, 5.0, True), ("r", 2026, 600 * MINUTE, 1, 1.0, False)], "station_id string, year int, t_us long, ord long, v double, is_high boolean")
    sec = spark.createDataFrame([(1, 2026, "r", "+00:30", "-01:00", 0.2, 0.5, 0.1, -0.4)], "sec_id long, year int, ref_id string, hw_diff string, lw_diff string, hw_dh_mean double, hw_dh_large double, lw_dh_mean double, lw_dh_large double")
    heights = spark.createDataFrame([("r", 4.0, 5.0, 1.5, 1.5)], "ref_id string, hw_mean double, hw_large double, lw_mean double, lw_large double")
    got = [(r.t_us // MINUTE, round(r.v, 9)) for r in derive.secondary_tides(sec, ref, heights).orderBy("t_us").collect()]
    assert got == [(30, 5.5), (540, 1.1)]


def test_reference_names(spark):
    p = spark.createDataFrame([(2026, "POINT BAY", "1", 0), (2026, "POINT", "2", 1), (2026, "POINT INLET", "3", 2), (2026, "SOUND HARBOUR", "4", 3), (2026, "SOUND BAY", "5", 4), (2026, "TWIN", "6", 5), (2026, "TWIN", "7", 6)], "year int, name string, station_id string, pos int")
    got = {r.ref_name: r.ref_id for r in derive.reference_names(p).collect()}
    assert got["POINT"] == "2" and got["SOUND"] == "4" and got["TWIN"] == "7" and got["POINT BAY"] == "1"
    s = spark.createDataFrame([(1, 2026, "POINT"), (2, 2026, "OLD"), (3, 2026, "LOST")], "sec_id long, year int, reference string")
    found, lost = derive.resolve(s, derive.reference_names(p), {"OLD": "TWIN"})
    assert {(r.sec_id, r.ref_id) for r in found.collect()} == {(1, "2"), (2, "7")} and [r.sec_id for r in lost.collect()] == [3]


def test_latest_year_wins(spark):
    m = spark.createDataFrame([("chs:1", 2025, 3, "old"), ("chs:1", 2026, 0, "new"), ("chs:1", 2026, 2, "newer"), ("chs:2", 2024, 1, "only")], "station_id string, year int, r int, name string")
    assert {r.station_id: r.name for r in merge.latest(m, F.col("r")).collect()} == {"chs:1": "newer", "chs:2": "only"}


def test_tide_phase(spark):
    rows = spark.createDataFrame([(13 * 60, 8 * 60 + 20, 15 * 60 + 50, 1.1, 4.1), (17 * 60, 15 * 60 + 50, 20 * 60 + 20, 4.1, 3.3)], "t int, a int, b int, v1 double, v2 double")
    rows = rows.select((F.col("t").cast("long") * MINUTE).alias("t_us"), (F.col("a").cast("long") * MINUTE).alias("t1"), (F.col("b").cast("long") * MINUTE).alias("t2"), "v1", "v2")
    got = [(round(r.range_m, 6), r.tendency, r.hours, r.curve_m) for r in interpolate.phase(rows).collect()]
    assert got == [(3.0, "rising", 5, 3.0), (0.8, "falling", 1, 1.2)]


def test_text(spark):
    def one(f, *values):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x"))).collect()]

    assert one(text.station_name, "Point Wilson, 0.6 mi. NE of", "The Narrows, 0.3 mi N of Bridge", "A, 2 miles off ,", "Plain") == ["Point Wilson", "The Narrows", "A", "Plain"]
    assert one(text.close_gaps, "4 .8", "4. 8", "x - 0.1") == ["4.8", "4.8", "x -0.1"]
    assert one(text.split_joined_diff, "+013") == ["+0 13"] and one(text.recover_dotted_diff, "+0.05 x") == ["+0 05 x"]
    assert one(text.time_diff, "-0 22", "+1 36*", "0 00", "junk") == ["-00:22", "+01:36", "+00:00", None]
    assert one(text.decimals, "49.123", " 49 ", "1.2.3") == [3, 0, 3]
    assert one(text.upper_key, "Haro-Strait  (n)") == ["HARO STRAIT N"]


def test_spread_lookups_are_the_plain_ones(spark):
    """Whatever the width of a bucket: with gaps, equal instants, single events and stations without any."""
    import random

    rng = random.Random(3)
    rows = [(rng.choice("aaab"), rng.choice([rng.randrange(200), rng.randrange(1000, 1100)]), i, float(rng.randrange(-3, 4)), rng.random() < 0.2) for i in range(120)] + [("c", 7, 500, 1.0, False)]
    e = spark.createDataFrame(rows, "station_id string, t_us long, ord long, v double, weak boolean")
    q = spark.createDataFrame([(s, t, t % 5) for s in "abcd" for t in range(-20, 1150, 3)], "station_id string, t_us long, n long")
    canon = lambda df: sorted(map(repr, map(tuple, df.collect())))
    want, seg = canon(segments.as_of(e, q)), canon(segments.segments(e))
    for width in (5, 90, 10_000):
        assert canon(segments.spread_segments(e, width).drop("bucket")) == seg
        assert canon(segments.as_of_spread(e, q, width).select("station_id", "t_us", "n", *segments.SEGMENT)) == canon(segments.as_of(e, q).select("station_id", "t_us", "n", *segments.SEGMENT))
    assert want


def test_many_secondaries_do_not_broadcast_the_events(spark, monkeypatch):
    events = spark.createDataFrame([("1", 2024, 10 * i, i, float(i % 5), i % 2 == 0) for i in range(20)], "station_id string, year int, t_us long, ord long, v double, is_high boolean")
    columns = "ref_id string, year int, sec_id long, hw_diff string, lw_diff string, hw_dh_mean double, hw_dh_large double, lw_dh_mean double, lw_dh_large double"
    resolved = spark.createDataFrame([("1", 2024, k, "+00:10", "-00:10", 0.1, 0.2, 0.0, 0.1) for k in range(50)], columns)
    heights = spark.createDataFrame([("1", 3.0, 4.0, 1.0, 0.5)], "ref_id string, hw_mean double, hw_large double, lw_mean double, lw_large double")
    few = derive.secondary_tides(resolved, events, heights)
    monkeypatch.setattr(derive, "BROADCAST_BYTES", 0)
    many = derive.secondary_tides(resolved, events, heights)
    assert sorted(few.collect()) == sorted(many.collect()) and many.count() == 1000
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()


def test_lookup_takes_known_sizes(spark):
    events = spark.createDataFrame([("a", 10 * i, i, float(i), False) for i in range(9)] + [("b", 5, 0, 1.0, False), ("b", 50, 1, 2.0, False)], "station_id string, t_us long, ord long, v double, weak boolean")
    asked = spark.createDataFrame([(s, t) for s in "ab" for t in (0, 7, 33, 99)], "station_id string, t_us long")
    sizes = spark.createDataFrame([("a", 4), ("a", 5), ("b", 2)], "station_id string, n long")
    plain = sorted(map(str, segments.lookup(events, asked).collect()))
    assert sorted(map(str, segments.lookup(events, asked, sizes=sizes).collect())) == plain
    assert sorted(map(str, segments.lookup(events, asked, sizes=sizes, limit=12).collect())) == plain
    assert sorted(map(str, segments.lookup(events, asked, sizes=sizes, limit=13).collect())) == plain
