"""High and low waters, and the roles of current events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_FLOOD, MAX_EBB, TO_FLOOD, TO_EBB = "max-flood", "max-ebb", "slack-to-flood", "slack-to-ebb"


def high_low(events: DataFrame, *keys: str) -> DataFrame:
    """``is_high``: not below either neighbour. An end has no neighbour there and ties are high.

    Derivation classes each year of a station by itself (keys station_id, year), labels the whole series."""
    by = Window.partitionBy(*(keys or ("station_id",))).orderBy("t_us", "ord")
    none = F.lit(float("-inf"))
    near = lambda f: F.coalesce(f("v").over(by), none)
    return events.withColumn("is_high", (F.col("v") >= near(F.lag)) & (F.col("v") >= near(F.lead)))


def tide_as_current(events: DataFrame) -> DataFrame:
    """High water turns to ebb and low water to flood; needs ``is_high``."""
    return events.withColumn("role", F.when(F.col("is_high"), TO_EBB).otherwise(TO_FLOOD)).withColumn("weak", F.lit(False))


def current_roles(events: DataFrame, *keys: str) -> DataFrame:
    """``role`` of each event (kind slack or max, v, weak). A zero takes its direction from the next non-zero event: a
    slack turns towards it, a weak max belongs to it; at the end the last one before decides (a slack turns away)."""
    keys = keys or ("station_id", "year")
    ahead = Window.partitionBy(*keys).orderBy(F.desc("t_us"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy(*keys).orderBy("t_us", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sign = F.when(F.col("v") != 0, F.signum("v"))
    rows = events.withColumn("_next", F.last(sign, ignorenulls=True).over(ahead)).withColumn("_prev", F.last(sign, ignorenulls=True).over(behind))
    weak_way = F.coalesce("_next", "_prev", F.lit(0.0))
    slack_way = F.coalesce("_next", -F.col("_prev"), F.lit(0.0))
    role = (
        F.when(F.col("v") > 0, MAX_FLOOD).when(F.col("v") < 0, MAX_EBB)
        .when(F.col("kind") == "max", F.when(weak_way >= 0, MAX_FLOOD).otherwise(MAX_EBB))
        .otherwise(F.when(slack_way >= 0, TO_FLOOD).otherwise(TO_EBB))
    )
    return rows.withColumn("role", role).drop("_next", "_prev")
