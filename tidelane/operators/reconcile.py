"""Field-by-field comparison of an expected and an actual extract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABSOLUTE, RELATIVE = 1e-6, 1e-9


def close(a: Column, b: Column) -> Column:
    """Both null, or equal within the tolerances."""
    near = F.abs(a - b) <= F.greatest(F.lit(ABSOLUTE), RELATIVE * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(near, a.isNull() & b.isNull())


def differences(expected: DataFrame, actual: DataFrame, key: str, exact: list[str] = (), floats: list[str] = (), prefixes: list[str] = (), conditional: list[str] = ()) -> DataFrame:
    """key, field, expected, actual for each field that differs; a key without a row is one difference ``*``.

    A prefix field must begin with the expected text; a conditional one counts only where a value is expected."""
    a = actual.select(F.col(key), F.struct(*[c for c in actual.columns if c != key]).alias("_a"))
    rows = expected.join(a, key, "left")
    got = lambda c: F.col(f"_a.{c}")
    here = F.col("_a").isNotNull()
    tests = [(c, ~F.col(c).eqNullSafe(got(c))) for c in exact] + [(c, ~close(F.col(c), got(c))) for c in floats]
    tests += [(c, ~F.coalesce(F.startswith(got(c), F.col(c)), F.lit(False))) for c in prefixes] + [(c, F.col(c).isNotNull() & ~F.col(c).eqNullSafe(got(c))) for c in conditional]
    item = lambda name, old, new: F.struct(F.lit(name).alias("field"), old.cast("string").alias("expected"), new.cast("string").alias("actual"))
    found = F.array(F.when(~here, item("*", F.col(key), F.lit(None))), *(F.when(here & t, item(c, F.col(c), got(c))) for c, t in tests))
    return rows.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_d")).select(key, "_d.*")


def summary(table: str, expected: DataFrame, diffs: DataFrame, key: str) -> DataFrame:
    """Rows without a difference and all rows of a table."""
    rows = expected.select(key).join(diffs.select(key).distinct().withColumn("_bad", F.lit(True)), key, "left")
    return rows.agg(F.lit(table).alias("table_name"), F.count_if(F.col("_bad").isNull()).alias("ok"), F.count("*").alias("total"))
