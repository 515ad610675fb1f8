"""Readers: station documents, raw payloads, inventory, overrides. All schemas are explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.text import decimals

CORRUPT = "_corrupt"
PAYLOAD = "predictions array<struct<t:string,v:string>>, current_predictions struct<cp:array<struct<Time:string,Velocity_Major:double,Type:string,meanFloodDir:double,meanEbbDir:double>>>, error struct<message:string>"


def station_records(spark: SparkSession, path: str, schema: str | T.StructType, indent: int = 4) -> DataFrame:
    """Every station of ``{"stations": [...]}`` files: file, station (a struct of the schema), and for what cannot be read its
    text and the reason.

    Files are laid out with a station's braces ``indent`` spaces in, on lines of their own, as JSON writers with two spaces
    do; no line break can be inside a JSON string, so such a line begins a station wherever it is. Spark's text source cuts
    files there, a big file in many tasks. A file on one line is read too, by one task. A station that is no JSON spoils
    itself alone, and one with none of the schema's fields is empty (so are objects of another list at that depth). A path
    without files is an empty frame."""
    inner = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    try:
        raw = spark.read.option("lineSep", "\n" + " " * indent + "{\n").text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        empty = T.StructType([T.StructField("file", T.StringType()), T.StructField("station", inner), T.StructField("text", T.StringType()), T.StructField("reason", T.StringType())])
        return spark.createDataFrame([], empty)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"), F.col("value").rlike(r"^[\s\ufeff]*[^\s\"}]").alias("head"))
    ends = "\n" + " " * indent + "}"
    corrupt = T.StructField(CORRUPT, T.StringType())
    options = {"columnNameOfCorruptRecord": CORRUPT}
    body = rows.where("not head").withColumn("s", F.from_json(F.concat(F.lit("{\n"), F.split_part("text", F.lit(ends), F.lit(1)), F.lit("\n}")), T.StructType([*inner.fields, corrupt]), options))
    cut = ~F.contains(F.concat(F.lit("\n"), F.col("text")), F.lit(ends))
    reason = F.when(cut, "cut short").when(F.col("s").isNull() | F.col(f"s.{CORRUPT}").isNotNull(), "malformed")
    reason = reason.when(~F.greatest(F.lit(False), *(F.col(f"s.`{f}`").isNotNull() for f in inner.fieldNames())), "empty")
    found = body.select("file", F.when(reason.isNull(), F.struct(*(F.col(f"s.`{f}`").alias(f) for f in inner.fieldNames()))).alias("station"), F.when(reason.isNotNull(), F.col("text")).alias("text"), reason.alias("reason"))
    opening = F.col("text").rlike(r'"stations"\s*:\s*\[\s*$')  # the beginning of a file that is cut into stations
    outer = T.StructType([T.StructField("stations", T.ArrayType(inner)), corrupt])
    whole = rows.where("head").where(~opening).withColumn("d", F.from_json("text", outer, options))
    wrong = F.when(F.col("d").isNull() | F.col(f"d.{CORRUPT}").isNotNull(), "malformed").when(F.col("d.stations").isNull(), "no stations")
    lost = whole.where(wrong.isNotNull()).select("file", F.lit(None).cast(inner).alias("station"), "text", wrong.alias("reason"))
    one = whole.where(wrong.isNull()).select("file", F.explode("d.stations").alias("station"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("reason"))
    return found.unionByName(one).unionByName(lost)


def stations(spark: SparkSession, path: str, schema: str | T.StructType, indent: int = 4) -> DataFrame:
    """One row a station that can be read."""
    return station_records(spark, path, schema, indent).where("reason is null").select("station.*")


def rejected_stations(spark: SparkSession, path: str, schema: str | T.StructType, indent: int = 4) -> DataFrame:
    """file, reason and text of what cannot: ``malformed``, ``cut short`` or ``empty`` stations, files without any."""
    return station_records(spark, path, schema, indent).where("reason is not null").select("file", "reason", "text")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Raw prediction files with kind, id and bin from their names, ``tide_<id>.json`` or ``current_<id>_bin<n>.json``, which may
    also be those of folders that Spark wrote. ``corrupt`` has the text of a file that is no JSON. A file is a station's
    predictions of some months, so one row."""
    schema = f"{PAYLOAD}, {CORRUPT} string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(path, multiLine=True).withColumn("_file", F.col("_metadata.file_path"))
    part = lambda i: F.nullif(F.regexp_extract("_file", r"[/=](tide|current)_([^/]+?)(?:_bin(\d+))?\.json(?:/part-[^/]*)?$", i), F.lit(""))
    return rows.select(part(1).alias("kind"), part(2).alias("id"), part(3).cast("int").alias("bin"), "predictions", F.col("current_predictions.cp").alias("cp"), "error", F.col(CORRUPT).alias("corrupt"), F.col("_file").alias("file"))


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payloads that can be used, and the others with a reason: ``malformed``, ``error`` (with its message), ``no name`` or
    ``no predictions``."""
    reason = F.when(F.col("corrupt").isNotNull(), "malformed").when(F.col("error").isNotNull(), "error").when(F.col("kind").isNull(), "no name").when(F.col("predictions").isNull() & F.col("cp").isNull(), "no predictions")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("error", "corrupt", "reason", "file"), rows.where("reason is not null").select("kind", "id", "bin", "reason", "error.message", F.col("corrupt").alias("text"), "file")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """index_no, lat, lon and the fewer decimals of both, from text; rows that do not parse go, the last of an id stays (by
    file, place of its block in the file and row). Files are split like any other; all must have the same header."""
    raw = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
    names = [c.strip().lstrip("\ufeff") for c in raw.columns]
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r"))
    cells = raw.select(place.alias("_at"), *(F.col(f"`{c}`").alias(n) for c, n in zip(raw.columns, names)))
    rows = cells.select(
        "_at", F.trim("STATION_NUMBER").try_cast("int").alias("index_no"), F.col("LATITUDE").try_cast("double").alias("lat"), F.col("LONGITUDE").try_cast("double").alias("lon"),
        F.least(decimals(F.col("LATITUDE")), decimals(F.col("LONGITUDE"))).alias("decimals"),
    ).where("index_no is not null and lat is not null and lon is not null")
    return rows.groupBy("index_no").agg(F.max_by(F.struct("lat", "lon", "decimals"), "_at").alias("_r")).select("index_no", "_r.*")


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """index_no, lat and lon of each numeric key; [lon, lat] or null; other keys and malformed values are skipped."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    rows = whole.where(~F.col("k").startswith("_")).select(F.col("k").try_cast("int").alias("index_no"), "v", F.from_json("v", "array<double>").alias("p")).where("index_no is not null")
    fine = F.col("v").isNull() | ((F.size("p") == 2) & F.forall("p", lambda x: x.isNotNull()))
    return rows.where(fine).select("index_no", F.get("p", F.lit(1)).alias("lat"), F.get("p", F.lit(0)).alias("lon"))


def suppressed(spark: SparkSession, path: str) -> DataFrame:
    listed = F.from_json(F.get_json_object("value", "$._suppress_index_nos"), "array<string>")
    return spark.read.text(path, wholetext=True).select(F.explode(listed).alias("n")).select(F.col("n").try_cast("int").alias("index_no")).where("index_no is not null").distinct()
