"""The file of coordinate overrides as a table of lines: the block that each key is in, and the file written anew.

Such a file is one JSON object, an entry a station (``"7120": [-123.4, 48.4]`` or null) or a remark (keys that begin with an
underscore), laid out with two spaces of indent. Some remarks open blocks that say where the entries below come from.
Everything here works on lines (file, line, text) with windows by file, so many files are read and written side by side,
and the lines of entries that do not change are copied as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Words that open a block, and keys that say nothing of one (fixed values).
BLOCKS = {
    "_block_pdf_wrong_replaced_with_chs_official": "manual",
    "_block_pdf_correct_csv_wrong": "csv_wrong",
    "_block_us_cross_border": "us",
    "_block_iwls_seeded": "iwls",
}
SILENT = ('"_format', '"_source_url', '"_block_suppressed', '"_suppress_index_nos')
FIRST_BLOCK, SEEDED, SEEDED_KEY, BLOCK_KEY = "manual", "iwls", "_block_iwls_seeded", "_block_"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line and text of the files under ``path``; a file, some hundred lines, is one row until it is cut."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", r"\n$", ""), "\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("line", "text"))


def _so_far() -> Window:
    return Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _opened(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for words, block in reversed(BLOCKS.items()):
        out = F.when(F.contains(text, F.lit(words)), block).otherwise(out)
    return out


def _silent(text: Column) -> Column:
    out = F.lit(False)
    for words in SILENT:
        out = out | F.contains(text, F.lit(words))
    return out


def provenance(lines: DataFrame) -> DataFrame:
    """file, index_no and block (manual, csv_wrong, us or iwls) of each key that is a number. Keys above the first block are
    manual."""
    opened, key = _opened(F.col("text")), F.regexp_extract("text", r'^\s*"(\d+)"[^:]*:', 1)
    rows = lines.withColumn("block", F.coalesce(F.last(opened, ignorenulls=True).over(_so_far()), F.lit(FIRST_BLOCK)))
    rows = rows.where(opened.isNull() & ~_silent(F.col("text")) & (key != ""))
    return rows.select("file", key.try_cast("int").alias("index_no"), "block")


def entries(lines: DataFrame) -> DataFrame:
    """file, nth, key and body (the entry's lines, without the comma behind it) of each entry, in the order of the file."""
    key = F.regexp_extract("text", r'^  "((?:[^"\\]|\\.)*)"\s*:', 1)
    begins = F.col("text").rlike(r'^  "(?:[^"\\]|\\.)*"\s*:')
    rows = lines.withColumn("nth", F.count_if(begins).over(_so_far())).where("nth > 0").where(~F.col("text").rlike(r"^\}\s*$"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("file", "nth").agg(F.max(F.when(begins, key)).alias("key"), F.regexp_replace(body, r",\s*$", "").alias("body"))


def current(lines: DataFrame) -> DataFrame:
    """file, index_no, lat, lon and block of each override; a null override has null coordinates."""
    place = F.from_json(F.regexp_replace("body", r'^\s*"\d+"\s*:', ""), "array<double>")
    rows = entries(lines).where(F.col("key").rlike(r"^\d+$")).select("file", F.col("key").try_cast("int").alias("index_no"), place.alias("p"))
    return rows.select("file", "index_no", F.get("p", F.lit(1)).alias("lat"), F.get("p", F.lit(0)).alias("lon")).join(provenance(lines), ["file", "index_no"])


def number_text(x: Column) -> Column:
    """A coordinate of up to six decimals, at least one of them written."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", ".0")


def rewritten(lines: DataFrame, synced: DataFrame, remark: str) -> DataFrame:
    """The lines (file, line, text) of the files after a sync: ``synced`` has index_no, action, lat and lon for all files, or
    with a column ``file`` for each.

    Seeded entries stand at the end of their block, before the next one, in the order of their numbers; those that went are
    gone, and the block's own key carries ``remark``. A file without the block gets it at its end. Other entries stay where
    they are, as they are. A file without any entry is not written."""
    found = entries(lines).withColumn("_number", F.when(F.col("key").rlike(r"^\d+$"), F.col("key").try_cast("int")))
    blocks = provenance(lines).withColumnRenamed("index_no", "_number")
    found = found.join(blocks, ["file", "_number"], "left")
    by_file = Window.partitionBy("file")
    start = F.max(F.when(F.col("key") == SEEDED_KEY, F.col("nth"))).over(by_file)
    found = found.withColumn("_start", start).withColumn("_next", F.min(F.when(F.col("key").startswith(BLOCK_KEY) & (F.col("nth") > F.col("_start")), F.col("nth"))).over(by_file))
    quoted = F.concat(F.lit(f'  "{SEEDED_KEY}": '), F.regexp_extract(F.to_json(F.array(F.lit(remark))), r"^\[(.*)\]$", 1))
    kept = found.where("block is null or block <> 'iwls'").select("file", F.col("nth").cast("double").alias("at"), F.lit(0).alias("then"), F.when(F.col("key") == SEEDED_KEY, quoted).otherwise(F.col("body")).alias("body"))
    ends = found.groupBy("file").agg(F.max("_start").alias("_start"), F.min("_next").alias("_next"), F.max("nth").alias("_last"))
    at = F.coalesce(F.col("_next") - 0.5, F.col("_last") + 2.0)
    headed = ends.where("_start is null").select("file", (F.col("_last") + 1.0).alias("at"), F.lit(0).alias("then"), quoted.alias("body"))
    values = synced.where(F.col("action").isin("added", "refreshed", "no_change"))
    values = values.join(ends, "file") if "file" in synced.columns else values.crossJoin(F.broadcast(ends))  # the files are few: a row each
    entry = F.concat(F.lit('  "'), F.col("index_no").cast("string"), F.lit('": [\n    '), number_text(F.col("lon")), F.lit(",\n    "), number_text(F.col("lat")), F.lit("\n  ]"))
    made = values.select("file", at.alias("at"), F.col("index_no").alias("then"), entry.alias("body"))
    rows = kept.unionByName(headed).unionByName(made)
    order = Window.partitionBy("file").orderBy("at", "then")
    rows = rows.select("file", F.row_number().over(order).alias("n"), F.when(F.lead("at").over(order).isNotNull(), F.concat("body", F.lit(","))).otherwise(F.col("body")).alias("body"), F.count("*").over(by_file).alias("_all"))
    cut = F.split("body", "\n")
    text = F.when(F.col("n") == 1, F.concat(F.array(F.lit("{")), cut)).otherwise(cut)
    text = F.when(F.col("n") == F.col("_all"), F.concat(text, F.array(F.lit("}")))).otherwise(text)
    out = rows.select("file", "n", F.posexplode(text).alias("i", "text"))
    return out.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("n", "i")) - 1).alias("line"), "text")
