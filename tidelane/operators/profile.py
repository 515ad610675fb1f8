"""How often each field of nested documents has its most frequent values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRONG, FAIR = 0.95, 0.80
TRACKED = 10_000


def text_of(field: T.StructField) -> Column:
    """A field's value as JSON would write it, without quotes around a text; a null is ``null``."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        c = F.to_json(c, {"ignoreNullFields": "false"})
    elif isinstance(field.dataType, (T.StringType, T.NumericType, T.BooleanType)):
        c = c.cast("string")
    else:  # dates and the like: as JSON has them
        c = F.get_json_object(F.to_json(F.struct(c.alias("x"))), "$.x")
    return F.coalesce(c, F.lit("null"))


def fields_of(rows: DataFrame, level: str) -> DataFrame:
    """(level, field, value) with a row for each field of each row; values as text, objects as JSON."""
    entries = F.array(*(F.struct(F.lit(f.name).alias("field"), text_of(f).alias("value")) for f in rows.schema.fields))
    return rows.select(F.explode(entries).alias("e")).select(F.lit(level).alias("level"), "e.field", "e.value")


def levels(documents: DataFrame, entries: str = "events") -> tuple[DataFrame, DataFrame]:
    """Fields of stations, days and events, and the number of objects of each level."""
    stations = documents.drop("days")
    days = documents.select(F.explode("days").alias("d"))
    day = days.select("d.*").drop(entries)
    event = days.select(F.explode(f"d.{entries}").alias("e")).select("e.*")
    parts = (("station", stations), ("day", day), ("event", event))
    totals = [df.agg(F.lit(name).alias("level"), F.count("*").alias("objects")) for name, df in parts]
    union = lambda xs: xs[0].unionByName(xs[1]).unionByName(xs[2])
    return union([fields_of(df, name) for name, df in parts]), union(totals)


def profile(values: DataFrame, totals: DataFrame) -> DataFrame:
    """share of the top value among all objects of the level, number of values, the three most frequent, tag.

    Values are counted before they are ranked; equal counts go by value, so the result does not depend on order."""
    counts = values.groupBy("level", "field", "value").agg(F.count("*").alias("n"))
    distinct = counts.groupBy("level", "field").agg(F.count("*").alias("n_values"))
    by = Window.partitionBy("level", "field").orderBy(F.desc("n"), "value")
    best = counts.withColumn("_r", F.row_number().over(by)).where("_r <= 3")
    top = best.groupBy("level", "field").agg(F.max("n").alias("top"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value", "n"))), lambda x: F.concat_ws("=", x["value"], x["n"].cast("string"))), "|").alias("top3"))
    share = F.col("top") / F.col("objects")
    rows = top.join(distinct, ["level", "field"]).join(F.broadcast(totals), "level")  # three rows
    return rows.select("level", "field", share.alias("share"), "n_values", "top3", F.when(share >= STRONG, "★").when(share >= FAIR, "○").otherwise("").alias("tag"))


# Sketches: the frequent values of fields with very many, by file or year, merged without reading anything again


def sketches(values: DataFrame, by: list[str], tracked: int = TRACKED) -> DataFrame:
    """``by``, level, field, objects present, and a sketch of the frequent values of each: at most about ``tracked`` of them are
    held, however many there are. ``values`` has level, field, value and the columns ``by``."""
    top = F.expr(f"approx_top_k_accumulate(value, {tracked})")
    return values.groupBy(*by, "level", "field").agg(F.count("*").alias("present"), top.alias("frequent"), F.hll_sketch_agg("value").alias("distinct_values"))


def merged_sketches(parts: DataFrame, by: list[str], tracked: int = TRACKED) -> DataFrame:
    """Sketches of parts put together; what was counted in one is not read again."""
    top = F.expr(f"approx_top_k_combine(frequent, {tracked})")
    return parts.groupBy(*by, "level", "field").agg(F.sum("present").alias("present"), top.alias("frequent"), F.hll_union_agg("distinct_values").alias("distinct_values"))


def error_share(tracked: int = TRACKED) -> float:
    """By how much of all objects a count of a sketch may be off, at most: 3.5 over the size of its table, which is the power
    of two that holds ``tracked`` values at three quarters full."""
    return 3.5 / 2 ** math.ceil(math.log2(tracked / 0.75))


def sketched_profile(parts: DataFrame, by: list[str], k: int = 3, tracked: int = TRACKED) -> DataFrame:
    """``by``, level, field, present, the ``k`` most frequent values (array of item and count; fewer where others are too rare to be
    told apart), the error of their counts at most, and the number of values, about. Counts are exact while a part has no
    more than ``tracked`` values."""
    found = F.expr(f"approx_top_k_estimate(frequent, {k})")
    return parts.select(*by, "level", "field", "present", found.alias("top"), F.floor(F.col("present") * error_share(tracked)).alias("error"), F.hll_sketch_estimate("distinct_values").alias("n_values"))
