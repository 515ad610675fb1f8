"""The stateful tick against a batch run of lags over states, across a restart."""

import random

from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from tidelane.operators import segments
from tidelane.streaming import ticks

HOUR = 3_600_000_000


def batch(rows, last_tick):
    """Changes by lag over the states of all ticks, and the ends of segments with a tick that are past."""
    by = Window.partitionBy("station_id").orderBy("t_us")
    changed = rows.withColumn("before", F.lag("state").over(by)).where("before is null or before <> state").selectExpr("station_id", "t_us", "'change' as kind", "state", "value")
    ends = rows.where(F.col("t2") <= last_tick).selectExpr("station_id", "t2 as t_us", "'extreme' as kind", "end_state as state", "end_value as value").distinct()
    return changed.unionByName(ends)


def test_changes_equal_the_batch_run_across_restarts(spark, tmp_path):
    rng = random.Random(4)
    events = [(f"s{s}", (s + 5 * i) * HOUR + rng.randrange(HOUR), i, float(rng.choice([-1, 0, 1]) * rng.random()), False) for s in range(6) for i in range(30)]
    e = spark.createDataFrame(events, "station_id string, t_us long, ord long, v double, weak boolean")
    at = [k * HOUR // 3 + 1 for k in range(-3, 500)]
    seg = segments.bucketed_segments(e).cache()
    for current in (True, False):
        folder = tmp_path / str(current)
        for a, b in ((0, 200), (200, 201), (201, 503)):
            spark.createDataFrame([(t,) for t in at[a:b]], "t_us long").coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema("t_us long").parquet(f"{folder}/in")
            ticks.run_available(stream, seg, f"{folder}/out", f"{folder}/checkpoint", current)
        got = spark.read.parquet(f"{folder}/out")
        states = ticks.states_at(spark.createDataFrame([(t,) for t in at], "t_us long"), seg, current)
        want = batch(states, at[-1]).collect()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want), key=repr)
        assert {r.kind for r in want} == {"change", "extreme"} and len(want) > 200


class Store:
    """A handle that counts the calls which a station costs."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, set()

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)


def test_calls_of_the_store_do_not_grow_with_ticks(spark):
    store = Store()
    changes = ticks.Changes()
    changes.init(store)
    tick = lambda i: Row(t_us=i * HOUR, state="flood" if i % 2 else "ebb", value=1.0, t2=i * HOUR + 1000, end_state="slack", end_value=0.0)
    assert len(list(changes.handleInputRows(("s",), map(tick, range(500)), None))) == 500
    assert store.calls == 3 and store.timers == {1} and len(store.value[2]) == 500
    assert len(list(changes.handleInputRows(("s",), map(tick, range(400, 600)), None))) == 100
    assert store.calls == 5 and len(store.value[2]) == 600
