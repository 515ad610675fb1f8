"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_folder
from .chunk_encoder import slices

SLICE = 1_000_000  # bytes of text that a worker turns into strings, numbers and answers at once


def smallest(rows: DataFrame, content: list[str], size: int) -> DataFrame:
    """At most ``size`` rows of distinct ``content``, with ``_hash``: those with the smallest hashes, so that the sample is
    the same however the rows lie, never empty while there are rows, and holds a text once however often it occurs."""
    hashed = rows.select(F.xxhash64(*content).alias("_hash"), *content)
    top = hashed.select("_hash").distinct().orderBy("_hash").limit(size).agg(F.max("_hash")).first()[0]
    found = hashed.where(F.col("_hash") <= F.lit(top)).groupBy("_hash").agg(F.first(F.struct(*content)).alias("_row"))
    return found.select("_hash", "_row.*")


def distinct_sample(rows: DataFrame, content: list[str], size: int) -> list:
    """The rows of ``smallest`` on the driver, in the order of their hashes."""
    return smallest(rows, content, size).orderBy("_hash").select(*content).collect()


def fresh(columns: list[str], name: str) -> str:
    """``name``, or the first of it with underscores behind that none of ``columns`` has (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back: lineage ends there, and a lost executor loses nothing."""
    path = scratch_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; a null id is in fold 0, so that it never trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def pieces(batches: Iterator[pa.RecordBatch], text: Callable[[pa.RecordBatch], pa.Array], size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of at most ``size`` bytes (``SLICE``) of ``text`` each, a longer text alone, so that a
    worker's memory does not grow with the rows of a batch; behind each batch freed memory goes back."""
    for batch in batches:
        for a, b in slices(text(batch), size or SLICE):
            yield batch.slice(a, b - a)
        del batch
        give_back()


def give_back() -> None:
    """Return what this Python worker has freed to the system. Arrow's pool and the C library keep it else, and a worker that
    waits or serves the next stage holds it beside what that needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)
