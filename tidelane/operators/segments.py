"""Segments between events, and the lookup of instants in them.

Events have station_id, t_us, ord, v and weak. A segment is [t1, t2) to the next event; a station's last one holds its
end too. Lookups never go beyond the first or last event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = ("t1", "v1", "w1", "t2", "v2", "w2")
BROADCAST_INSTANTS = 5_000
RUN_ROWS = 20_000_000  # rows of a station that one task sorts
TASK_ROWS = 500_000  # events and instants of all stations that one task sorts
BUCKET_US = 24 * 3_600_000_000


def segments(events: DataFrame, key: str = "station_id") -> DataFrame:
    by = Window.partitionBy(key).orderBy("t_us", "ord")
    ahead = lambda c, n=1: F.lead(c, n).over(by)
    out = events.select(
        key, F.col("t_us").alias("t1"), F.col("v").alias("v1"), F.col("weak").alias("w1"),
        ahead("t_us").alias("t2"), ahead("v").alias("v2"), ahead("weak").alias("w2"), ahead("t_us", 2).isNull().alias("is_last"), "ord",
    )
    return out.where("t2 is not null")


def as_of(events: DataFrame, instants: DataFrame, key: str = "station_id", tasks: int | None = None) -> DataFrame:
    """Columns of ``instants`` (key, t_us, any more) with the segment that holds each, or nulls outside the events.

    Segments and instants are sorted together by station and time, and the last segment before an instant is carried
    forward: each side is shuffled once, by station, and the union keeps that partitioning. A station's events and instants
    are one sorted run of a task, which spills; ``as_of_spread`` is the one for series where a station holds most rows.
    ``tasks``: how many the stations are dealt out to, so that memory does not grow with the tables; else as the session has it."""
    dealt = lambda df: df.repartition(tasks, key) if tasks else df.repartition(key)
    seg = segments(dealt(events) if tasks else events, key)
    extra = [c for c in instants.columns if c not in (key, "t_us")]
    left = seg.select(key, F.col("t1").alias("t_us"), F.lit(0).alias("_tag"), "ord", F.struct(*SEGMENT).alias("_seg"))
    right = instants.select(key, "t_us", F.lit(1).alias("_tag"), F.lit(None).cast("long").alias("ord"), F.struct(*extra, F.lit(True).alias("_")).alias("_extra"))
    both = left.unionByName(dealt(right), allowMissingColumns=True)
    by = Window.partitionBy(key).orderBy("t_us", "_tag", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_seg", F.last("_seg", ignorenulls=True).over(by)).where("_tag = 1")
    inside = F.col("t_us") <= F.col("_seg.t2")
    return found.select(key, "t_us", *(F.col(f"_extra.{c}") for c in extra), *(F.when(inside, F.col(f"_seg.{c}")).alias(c) for c in SEGMENT))


def bucketed_segments(events: DataFrame, bucket_us: int = BUCKET_US, key: str = "station_id") -> DataFrame:
    """Segments with a row for each time bucket that they touch, so that a lookup is an equi-join on station and bucket."""
    first, last = (F.floor(F.col(c) / bucket_us).cast("long") for c in ("t1", "t2"))
    return segments(events, key).withColumn("bucket", F.explode(F.sequence(first, last)))


def holds() -> Column:
    """Whether a segment holds ``t_us``; at most one of a station does."""
    return (F.col("t_us") >= F.col("t1")) & ((F.col("t_us") < F.col("t2")) | (F.col("is_last") & (F.col("t_us") == F.col("t2"))))


def as_of_bucketed(events: DataFrame, instants: DataFrame, bucket_us: int = BUCKET_US, key: str = "station_id") -> DataFrame:
    """The same as ``as_of`` by an equi-join on station and time bucket, which spreads a station that most instants ask
    for over many tasks. The bucket should hold a few events; a segment costs a row for each bucket that it touches."""
    asked = instants.withColumn("bucket", F.floor(F.col("t_us") / bucket_us).cast("long")).alias("q")
    seg = bucketed_segments(events, bucket_us, key).alias("s")
    rows = asked.join(seg, (F.col(f"q.{key}") == F.col(f"s.{key}")) & (F.col("q.bucket") == F.col("s.bucket")) & holds(), "left")
    return rows.select(*(F.col(f"q.{c}") for c in instants.columns), *SEGMENT)


def spread_segments(events: DataFrame, bucket_us: int = BUCKET_US, key: str = "station_id") -> DataFrame:
    """The same as ``segments`` with the ``bucket`` of t1: sorted within time buckets, so that a station that holds most
    rows is many short runs. A bucket's last event takes the first one of the next bucket that has any; only one row a
    station and bucket is sorted for that."""
    rows = events.withColumn("bucket", F.floor(F.col("t_us") / bucket_us).cast("long"))
    by = Window.partitionBy(key, "bucket").orderBy("t_us", "ord")
    event = F.struct("t_us", "ord", "v", "weak")
    own = rows.select(key, "bucket", F.col("t_us").alias("t1"), F.col("v").alias("v1"), F.col("weak").alias("w1"), "ord", F.lead(event).over(by).alias("_next"), F.lead("t_us", 2).over(by).isNull().alias("_end"))
    along = Window.partitionBy(key).orderBy("bucket")
    edges = rows.groupBy(key, "bucket").agg(F.min(event).alias("_first"), F.count("*").alias("_n"))
    edges = edges.select(key, "bucket", F.lead("_first").over(along).alias("_after"), ((F.lead("_n").over(along) == 1) & F.lead("bucket", 2).over(along).isNull()).alias("_last"))
    found = own.join(edges, [key, "bucket"]).withColumn("_to", F.coalesce("_next", "_after")).where("_to is not null")
    is_last = F.when(F.col("_next").isNotNull(), F.col("_end") & F.col("_after").isNull()).otherwise(F.col("_last"))
    return found.select(key, "t1", "v1", "w1", F.col("_to.t_us").alias("t2"), F.col("_to.v").alias("v2"), F.col("_to.weak").alias("w2"), is_last.alias("is_last"), "ord", "bucket")


def as_of_spread(events: DataFrame, instants: DataFrame, bucket_us: int = BUCKET_US, key: str = "station_id") -> DataFrame:
    """The same as ``as_of`` for series in which one station may hold most rows: everything is sorted by station and time
    bucket. Instants before a bucket's first event take the last segment of an earlier bucket, which is carried along one
    row a station and bucket. Costs one more shuffle of small rows than ``as_of``."""
    seg = spread_segments(events, bucket_us, key)
    extra = [c for c in instants.columns if c not in (key, "t_us")]
    left = seg.select(key, "bucket", F.col("t1").alias("t_us"), F.lit(0).alias("_tag"), "ord", F.struct(*SEGMENT).alias("_seg"))
    right = instants.select(key, F.floor(F.col("t_us") / bucket_us).cast("long").alias("bucket"), "t_us", F.lit(1).alias("_tag"), F.lit(None).cast("long").alias("ord"), F.struct(*extra, F.lit(True).alias("_")).alias("_extra"))
    both = left.unionByName(right, allowMissingColumns=True)
    by = Window.partitionBy(key, "bucket").orderBy("t_us", "_tag", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_seg", F.last("_seg", ignorenulls=True).over(by)).where("_tag = 1")
    ends = both.groupBy(key, "bucket").agg(F.max_by("_seg", F.when(F.col("_tag") == 0, F.struct("t_us", "ord"))).alias("_s"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "bucket", F.last("_s", ignorenulls=True).over(before).alias("_carried"))
    found = found.join(carried, [key, "bucket"]).withColumn("_seg", F.coalesce("_seg", "_carried"))
    inside = F.col("t_us") <= F.col("_seg.t2")
    return found.select(key, "t_us", *(F.col(f"_extra.{c}") for c in extra), *(F.when(inside, F.col(f"_seg.{c}")).alias(c) for c in SEGMENT))


def tasks_for(rows: int | None, spark: SparkSession, task_rows: int = TASK_ROWS) -> int:
    """A task for each ``task_rows``, and one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-(rows or 0) // task_rows))


def lookup(events: DataFrame, instants: DataFrame, key: str = "station_id", limit: int = RUN_ROWS, task_rows: int = TASK_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """``as_of``, or ``as_of_spread`` where a station has more than ``limit`` events and instants, by a count of both that reads
    nothing but the stations' names. ``as_of`` gets a task for each ``task_rows`` of them, which bounds the memory of a task.
    ``sizes``: the events of each station (key, n; several rows of one add up), where they are known more cheaply than by a count."""
    held = events.select(key, F.lit(1).alias("n")) if sizes is None else sizes.select(key, "n")
    rows = held.unionByName(instants.select(key, F.lit(1).alias("n"))).groupBy(key).agg(F.sum("n").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if (rows["most"] or 0) > limit:
        return as_of_spread(events, instants, key=key)
    return as_of(events, instants, key=key, tasks=tasks_for(rows["all"], events.sparkSession, task_rows))


def snapshot(events: DataFrame, instants: DataFrame, key: str = "station_id", limit: int = BROADCAST_INSTANTS) -> DataFrame:
    """Every station at every one of a few instants (t_us), in one scan of the segments; no row outside the events.

    The instants are broadcast when there are at most ``limit``; beyond, each station's instants go through ``as_of``."""
    few = instants.select("t_us").distinct()
    if few.limit(limit + 1).count() > limit:
        return lookup(events, events.select(key).distinct().crossJoin(few), key).where("t1 is not null")
    seg = segments(events, key).alias("s")
    return seg.join(F.broadcast(few), holds()).select(key, "t_us", *SEGMENT)
