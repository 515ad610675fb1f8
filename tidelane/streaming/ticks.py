"""States of all stations at ticks of a clock, of which only the changes go on.

A tick is an instant; it is held against the segments of its day, which gives every station's state there. The last state of
each station lies in the state store, so a tick that changes nothing gives no row. The end of the segment that holds a tick is
kept, with a timer for the first: when event time passes it, the station's extreme is told, whether or not a tick falls on it. Restarted from its checkpoint a
stream goes on where it was. Ticks should come in order; one that is not later than a station's last is ignored by it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import interpolate
from ..operators.segments import BUCKET_US, holds
from . import instants

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE, EXTREME = "change", "extreme"


def states_at(ticks: DataFrame, segments: DataFrame, current: bool = True, bucket_us: int = BUCKET_US, late: str | None = None) -> DataFrame:
    """station_id, t_us, ts, state and value of all stations at each tick (t_us), from ``bucketed_segments``; with the end of the
    segment (t2) and the state and value there. A station gives no row outside its events."""
    value, state = (interpolate.current_value(), interpolate.current_state()) if current else (interpolate.tide_value(), interpolate.tide_state())
    asked = ticks.select("t_us", F.timestamp_micros("t_us").alias("ts"), F.floor(F.col("t_us") / bucket_us).cast("long").alias("bucket"))
    if late is not None:  # event time is that of the ticks, whether or not a station has a state there
        asked = asked.withWatermark("ts", late)
    found = asked.join(segments, "bucket").where(holds())
    rows = found.withColumns({"state": state, "value": value}).withColumn("t_us_", F.col("t_us")).withColumn("t_us", F.col("t2"))
    rows = rows.withColumns({"end_state": state, "end_value": value})
    return rows.select("station_id", F.col("t_us_").alias("t_us"), "ts", "state", "value", "t2", "end_state", "end_value")


class Changes(StatefulProcessor):
    """Keeps a station's last state and the ends that are still to come as one value, and one timer, for the first of these
    ends: a station costs a few calls of the state store a batch, however many ticks and ends it has there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "t_us long, state string, ends array<struct<t_us:long,state:string,value:double>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.kept.get()
        at, state, ends = (known[0], known[1], [tuple(x) for x in known[2]]) if known else (None, None, [])
        first = ends[0][0] // 1000 if ends else None
        told = {x[0] // 1000 for x in ends}
        for x in sorted(rows, key=lambda x: x.t_us):
            if at is not None and x.t_us <= at:
                continue
            if x.state != state:
                yield Row(station_id=key[0], t_us=x.t_us, kind=CHANGE, state=x.state, value=x.value)
            at, state = x.t_us, x.state
            if x.t2 // 1000 not in told:
                told.add(x.t2 // 1000)
                ends.append((x.t2, x.end_state, x.end_value))
        if at is not None:
            self._keep(at, state, sorted(ends), first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, state, ends = self.kept.get()
        ms, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        due = [x for x in ends if x[0] // 1000 <= ms or x[0] // 1000 < passed]
        self._keep(at, state, [tuple(x) for x in ends[len(due) :]], None)
        for t_us, end_state, value in due:
            yield Row(station_id=key[0], t_us=t_us, kind=EXTREME, state=end_state, value=value)

    def _keep(self, at: int, state: str, ends: list[tuple], first: int | None) -> None:
        """``first``: the time of the timer that is running, if one is."""
        self.kept.update((at, state, ends))
        if ends and ends[0][0] // 1000 != first:
            if first is not None:
                self.handle.deleteTimer(first)
            self.handle.registerTimer(ends[0][0] // 1000)

    def close(self) -> None:
        pass


def changes(ticks: DataFrame, segments: DataFrame, current: bool = True, late: str = "0 seconds") -> DataFrame:
    """station_id, t_us, kind, state and value: a ``change`` where a tick finds a station in another state than the tick before,
    an ``extreme`` at the end of a segment that a tick fell into, once event time is past it. Needs the RocksDB state store."""
    rows = states_at(ticks, segments, current, late=late)
    return rows.groupBy("station_id").transformWithState(Changes(), "station_id string, t_us long, kind string, state string, value double", "Append", "EventTime")


def run_available(ticks: DataFrame, segments: DataFrame, path: str, checkpoint: str, current: bool = True) -> None:
    """Write the changes of all ticks that have arrived to Parquet and stop."""
    conf = ticks.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        instants.run_available(changes(ticks, segments, current), path, checkpoint)
    finally:
        conf.set(PROVIDER, before)
