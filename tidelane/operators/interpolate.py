"""Values, states, curves, labels and phases inside segments (t1, v1, w1, t2, v2, w2) at t_us."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import MINUTE_US
from .segments import BUCKET_US

SLACK_US, SLACK_KNOTS, LABEL_KNOTS = 5 * MINUTE_US, 0.1, 0.05


def _c():
    return [F.col(c) for c in ("t_us", "t1", "t2", "v1", "v2")]


def _tau() -> Column:
    t, t1, t2, _, _ = _c()
    return F.try_divide((t - t1).cast("double"), (t2 - t1).cast("double"))


def _half_cosine() -> Column:
    *_, v1, v2 = _c()
    return (v1 + v2) / 2 + (v1 - v2) / 2 * F.cos(math.pi * _tau())


def tide_value() -> Column:
    _, t1, t2, v1, _ = _c()
    return F.when(t1 == t2, v1).otherwise(_half_cosine())


def tide_state() -> Column:
    t, t1, t2, v1, v2 = _c()
    near = (t1 == t2) | (t - t1 < SLACK_US) | (t2 - t < SLACK_US)
    return F.when(t1.isNull(), None).when(near, "slack").when(v2 > v1, "flood").otherwise("ebb")


def current_value() -> Column:
    _, t1, t2, v1, v2 = _c()
    quarter = math.pi * _tau() / 2
    return F.when(t1 == t2, v1).when((v1 == 0) & (v2 == 0), F.lit(0.0)).when(v1 == 0, v2 * F.sin(quarter)).when(v2 == 0, v1 * F.cos(quarter)).otherwise(_half_cosine())


def current_state() -> Column:
    _, t1, t2, _, _ = _c()
    v = current_value()
    return F.when(t1.isNull(), None).when((t1 == t2) | (F.abs(v) < SLACK_KNOTS), "slack").when(v > 0, "flood").otherwise("ebb")


def current_weak() -> Column:
    _, t1, t2, _, _ = _c()
    w1, w2, tau = F.col("w1"), F.col("w2"), _tau()
    return F.coalesce(F.when(t1 == t2, w1 | w2).otherwise((w1 & (tau < 0.5)) | (w2 & (tau >= 0.5))), F.lit(False))


def bearing(state: Column, flood_dir: Column, ebb_dir: Column) -> Column:
    return F.when(state == "flood", F.coalesce(flood_dir, F.lit(0))).otherwise(F.coalesce(ebb_dir, F.lit(0)))


def arrow_strength(value: Column) -> Column:
    return 0.45 + 0.55 * F.least(F.abs(value) / 8, F.lit(1.0))


def grid(segments: DataFrame, step_us: int, key: str = "station_id") -> DataFrame:
    """Every multiple of ``step_us`` inside the events with its segment: each segment makes its own points, no join."""
    first = F.ceil(F.col("t1") / step_us).cast("long") * step_us
    end = F.when(F.col("is_last"), F.col("t2")).otherwise(F.col("t2") - 1)
    points = F.when(first <= end, F.sequence(first, end, F.lit(step_us).cast("long")))
    return segments.withColumn("t_us", F.explode(points))


def window_grid(instants: DataFrame, hours: int = 15, step_us: int = 3 * MINUTE_US) -> DataFrame:
    """A row for every step from ``start_us`` over ``hours``, both ends included."""
    return instants.withColumn("t_us", F.explode(F.sequence(F.col("start_us"), F.col("start_us") + hours * 60 * MINUTE_US, F.lit(step_us).cast("long"))))


def empty_curves(samples: DataFrame, value: str = "value", key: str = "station_id") -> DataFrame:
    """``empty`` for each station: true where not one sample of its curve has a value, so that nothing can be drawn."""
    return samples.groupBy(key).agg((F.count(value) == 0).alias("empty"))


def runs(points: DataFrame, value: str = "value", signed: bool = False, key: str = "station_id", within: tuple[str, ...] = ()) -> DataFrame:
    """Maximal runs of non-null values, or of one sign (zero and null break): start, end and length of each.

    Points are first gathered into the runs of each day, so that a busy station is many short sorts, and only those few rows are
    sorted by station. Where ``within`` names columns of a segment inside which a state never comes back, as on a curve
    between two extremes, they are gathered by segment and state instead, in place."""
    state = F.when(F.col(value) > 0, 1).when(F.col(value) < 0, -1).otherwise(0) if signed else F.col(value).isNotNull().cast("int")
    marked = points.withColumn("_state", F.coalesce(state, F.lit(0)))
    if within:
        short = marked.groupBy(key, *within, "_state").agg(F.min("t_us").alias("_a"), F.max("t_us").alias("_b"), F.count("*").alias("_n"))
    else:
        day = Window.partitionBy(key, "_day").orderBy("t_us")
        rows = marked.withColumn("_day", F.floor(F.col("t_us") / BUCKET_US)).withColumn("_new", F.when(F.col("_state") == F.lag("_state").over(day), 0).otherwise(1))
        rows = rows.withColumn("_run", F.sum("_new").over(day))
        short = rows.groupBy(key, "_day", "_run", "_state").agg(F.min("t_us").alias("_a"), F.max("t_us").alias("_b"), F.count("*").alias("_n"))
    by = Window.partitionBy(key).orderBy("_a")
    change = F.when(F.col("_state") == F.lag("_state").over(by), 0).otherwise(1)
    numbered = short.withColumn("_change", change).withColumn("run", F.sum("_change").over(by))
    kept = numbered.where("_state <> 0").groupBy(key, "run", "_state")
    return kept.agg(F.min("_a").alias("start_us"), F.max("_b").alias("end_us"), F.sum("_n").alias("points")).select(key, F.col("_state").alias("sign"), "start_us", "end_us", "points")


def tide_axis(value: Column, low: Column, high: Column) -> Column:
    """Place on a 100-high chart; a range below 0.6 m is widened evenly to that."""
    pad = F.greatest(F.lit(0.0), (0.6 - (high - low)) / 2)
    lo, hi = low - pad, high + pad
    return 22 + (hi - value) / (hi - lo) * 66


def current_axis(value: Column, bound: Column) -> Column:
    hi = F.greatest(bound, F.lit(0.5))
    return 55 - F.least(F.greatest(value, -hi), hi) / hi * 33


def current_label(v: Column, weak: Column) -> Column:
    """Label of an event; its limit for slack is not the state's."""
    return F.when(weak | (F.abs(v) < LABEL_KNOTS), "slack").when(v > 0, "flood").otherwise("ebb")


def ticks(start_us: Column, hours: int = 15) -> Column:
    """Array of (t_us, kind) every quarter of an hour, by what the epoch minute divides."""
    quarter = 15 * MINUTE_US
    first = F.ceil(start_us / quarter).cast("long") * quarter
    points = F.sequence(first, start_us + hours * 60 * MINUTE_US, F.lit(quarter).cast("long"))
    kind = lambda t: F.when(F.pmod(t, F.lit(4 * quarter)) == 0, "hour").when(F.pmod(t, F.lit(2 * quarter)) == 0, "half").otherwise("quarter")
    return F.transform(points, lambda t: F.struct(t.alias("t_us"), kind(t).alias("kind")))


#: Labelled ranges of the tidal charts, in metres (fixed values; the charts themselves are the caller's table).
CURVES = {"rising": (3.0, 1.8, 0.6), "falling": (3.0, 1.8, 1.2)}


def phase(rows: DataFrame) -> DataFrame:
    """Range, tendency, whole hours since the event before and the nearest labelled curve of each looked-up instant."""
    rise = F.col("v2") > F.col("v1")
    size = F.abs(F.col("v2") - F.col("v1"))
    pick = lambda labels: F.array_min(F.transform(F.array(*map(F.lit, labels)), lambda x: F.struct(F.round(F.abs(size - x), 9).alias("d"), (-x).alias("label"))))["label"] * -1
    return rows.select(
        "*", size.alias("range_m"), F.when(F.col("t1").isNull(), None).when(rise, "rising").otherwise("falling").alias("tendency"),
        F.round((F.col("t_us") - F.col("t1")) / (60 * MINUTE_US)).cast("long").alias("hours"),
        F.when(F.col("t1").isNull(), None).when(rise, pick(CURVES["rising"])).otherwise(pick(CURVES["falling"])).alias("curve_m"),
    )


def clamp(t: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(t, low), high)
