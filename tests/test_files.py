"""Files that the queries write: one a volume, however Spark cuts and merges partitions."""

import glob

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelane.plans import file_queries

SMALL = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "2k"}


def test_a_volume_is_one_file_where_a_union_is_dealt_out_already(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(20_000).select(F.floor(F.col("id") / 50).alias("volume"), F.col("id").alias("n"))
        last = F.lead("n").over(Window.partitionBy("volume").orderBy("n")).isNull()
        lines = rows.withColumn("text", F.concat(F.col("n").cast("string"), F.when(last, "").otherwise(",")))
        ends = rows.select("volume").distinct().select("volume", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("n"), F.lit("[").alias("text")), F.struct(F.lit(2**62).alias("n"), F.lit("]").alias("text")))).alias("e")).select("volume", "e.*")
        file_queries.write_texts(lines.unionByName(ends), f"{tmp_path}/texts")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for volume in range(400):
        (file,) = glob.glob(f"{tmp_path}/texts/volume={volume}/part-*")
        with open(file) as f:
            assert f.read().split("\n") == ["[", *(f"{n}," for n in range(50 * volume, 50 * volume + 49)), str(50 * volume + 49), "]", ""]


def test_pages_are_dealt_out_by_the_number_of_events(spark):
    """Tasks grow in number with the table, and partitions are not merged again."""
    from tidelane.plans import adapters, text_queries

    folder = "/root/testdata/sf0.001"
    events = adapters.table(spark, folder, "events").count()
    words = spark.range(1_000).selectExpr("cast(id % 90 as string) as doc", "cast(id % 7 as int) as page", "id")
    many = text_queries._dealt_pages(spark, folder, words, events=-(-events // 10))
    assert many.rdd.getNumPartitions() == 10 and many.count() == 1_000


def test_volumes_are_written_by_more_tasks_than_their_bytes_ask_for(spark, tmp_path):
    """A file costs more than its bytes: partitions that adaptive execution merged were two tasks for any number of files."""
    from tidelane.plans import file_queries

    rows = spark.range(40).selectExpr("id AS volume", "0 AS n", "'text' AS text")
    file_queries.write_texts(rows, str(tmp_path / "texts"))
    names = [p.name for p in (tmp_path / "texts").rglob("part-*")]
    assert len(names) == 40 and len({n.split("-")[1] for n in names}) > 1
