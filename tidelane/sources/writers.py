"""Writers: station tables by year and kind, anomaly reports. Publication by content is in ``publication``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stations(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "kind").format(form).save(path)


def write_report(anomalies: DataFrame, path: str) -> None:
    """One row an anomaly, its detail as JSON."""
    detail = F.to_json(F.struct(*[c for c in anomalies.columns if c not in ("id", "kind")]))
    anomalies.select("id", "kind", detail.alias("detail")).write.mode("overwrite").parquet(path)
