"""Stored tables: lookups without moving segments, boxes without opening the files of other tiles."""

import random

from pyspark.sql import functions as F

from tidelane.operators import segments
from tidelane.sources import stored

HOUR = 3_600_000_000


def series(spark, seed=3):
    rng = random.Random(seed)
    rows = [(f"s{s}", (7 * i + s) * HOUR + rng.randrange(HOUR), i, rng.uniform(-2, 2), False) for s in range(5) for i in range(60 if s else 400)]
    rows += [("s1", rows[-1][1], 900, 1.0, True), ("s2", rows[-1][1], 901, 1.0, True), ("s2", rows[-1][1], 902, 2.0, False)]
    return spark.createDataFrame(rows, "station_id string, t_us long, ord long, v double, weak boolean")


def test_stored_segments_stay_where_they_are(spark, tmp_path):
    e = series(spark)
    asked = e.select("station_id", F.explode(F.array(F.col("t_us"), F.col("t_us") - 1, F.col("t_us") + 5 * HOUR)).alias("t_us"), F.col("ord").alias("mine")).unionByName(spark.createDataFrame([("none", 5, 1), ("s1", None, 2)], "station_id string, t_us long, mine long"))
    stored.store_segments(e, "stored_segments", f"file://{tmp_path}/seg", buckets=6)
    try:
        got = stored.as_of_stored(spark, "stored_segments", asked)
        rows = got.collect()
        want = segments.as_of(e, asked).select(got.columns).collect()
        assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, want), key=repr)
        plan = stored.as_of_stored(spark, "stored_segments", asked)._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Bucketed: true" in plan
        assert plan.count("Exchange hashpartitioning") == 1 and "Sort " not in plan  # that of the instants
    finally:
        spark.sql("DROP TABLE stored_segments")


def test_lookup_takes_the_way_that_fits(spark):
    e = series(spark)
    asked = e.select("station_id", (F.col("t_us") + HOUR).alias("t_us"))
    one, other = (sorted(map(tuple, segments.lookup(e, asked, limit=n).collect()), key=repr) for n in (10, 10_000))
    assert one == other and len(one) == e.count()
    assert segments.lookup(e.limit(0), asked.limit(0)).count() == 0


def test_boxes_open_the_files_of_their_tiles_alone(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(3000)]
    rows += [(4000, 10.0, 180.0), (4001, 10.0, -180.0), (4002, 90.0, 0.0), (4003, -90.0, 179.9), (4004, None, 1.0), (4005, 10.0, 10.0)]
    df, path = spark.createDataFrame(rows, "id int, lat double, lon double"), f"file://{tmp_path}/t"
    stored.store_by_tile(df, path, 20.0)
    for box in ((5.0, 30.0, -20.0, 15.0), (-10.0, 40.0, 170.0, -170.0), (80.0, 90.0, -180.0, 180.0), (10.0, 10.0, 10.0, 10.0), (-90.0, -80.0, 170.0, 180.0), (9.0, 11.0, 150.0, 180.0), (9.0, 11.0, -180.0, -150.0)):
        south, north, west, east = box
        inside = {i for i, lat, lon in rows if lat is not None and south <= lat <= north and (west <= lon <= east if west <= east else lon >= west or lon <= east)}
        got = stored.read_box(spark, path, box, 20.0)
        assert {r.id for r in got.collect()} == inside
    some = stored.read_box(spark, path, (5.0, 15.0, 5.0, 15.0), 20.0)
    some.collect()
    metrics = some._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    assert metrics.apply("numFiles").value() < 0.1 * len(spark.read.parquet(path).inputFiles())


def test_runs_go_on_over_days(spark):
    from tidelane.operators import interpolate

    rng = random.Random(2)
    for sizes in ((1, 3), (1, 400)):
        rows, t = [], 0
        while t < 3000:
            state, n = rng.choice([1.0, -2.0, 0.0, None]), rng.randrange(*sizes)
            rows += [("a", (t + i) * HOUR // 4, state) for i in range(n)]
            t += n
        want, last = [], None
        for _, at, v in rows:
            sign = 0 if not v else 1 if v > 0 else -1
            if sign and sign == last:
                want[-1][2:] = [at, want[-1][3] + 1]
            elif sign:
                want.append([sign, at, at, 1])
            last = sign
        got = interpolate.runs(spark.createDataFrame(rows, "station_id string, t_us long, value double").repartition(3), signed=True).orderBy("start_us").collect()
        assert [[r.sign, r.start_us, r.end_us, r.points] for r in got] == want


def test_lookup_deals_stations_out_by_their_rows(spark):
    """Tasks grow in number with the rows, not in size, and partitions are not merged again."""
    e = spark.range(4_000).selectExpr("cast(id % 200 as string) as station_id", "id * 1000000 as t_us", "id as ord", "cast(id % 7 as double) as v", "false as weak")
    asked = e.select("station_id", (F.col("t_us") + 1).alias("t_us"))
    few, many = segments.lookup(e, asked), segments.lookup(e, asked, task_rows=400)
    assert many.rdd.getNumPartitions() == 20 and few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    want = sorted(map(tuple, segments.as_of(e, asked).collect()), key=repr)
    assert sorted(map(tuple, many.collect()), key=repr) == want and len(want) == 4_000
    assert max(many.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 1_000
