"""Token ids in Parquet list columns (operator 7).

File format: one row per document in ascending doc_id order, columns ``doc_id``, ``part`` and ``part_start`` (the ids
before the document in its part), ``n_tokens`` and ``ids`` (list of int). Ids are dictionary encoded, with plain or
delta pages of the format's second version where a dictionary grows too large; row groups and pages are kept small and
carry page indexes, so that a reader can take the metadata columns alone, or the ids of a few documents, without
reading the rest.

Documents are range partitioned by doc_id into parts of about ``PART_BYTES`` of text, so that part numbers ascend with
doc_id. Texts are shuffled for that once; ids are never. One small row a part (some 800,000 at 100 TB) is summed up to
turn ``part_start`` into the place in the whole corpus, and handed to the readers of the files.

Defined cases: a null or empty text is the end id alone; repeated doc_ids keep all their rows, in an order by text
hash; null doc_ids come first; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_folder
from .chunk_encoder import encoder, slices
from .shared import read_table

END_ID = 1
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2_000
PART_BYTES, LEAST_PARTS = 128 << 20, 24


def encode_sorted(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Documents in doc_id order with their ids; part and part_start as in the file format."""
    arrow = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        encode = encoder(vocabulary, False).encode
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                ids, bounds = encode(texts.slice(a, b - a), end_id)
                n = np.diff(bounds)
                listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(at + bounds[:-1]), pa.array(n), listed], schema=arrow)
                at += len(ids)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-size // PART_BYTES))
    return rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(run, SCHEMA)


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID) -> None:
    """Write the token files of ``docs`` to ``path``."""
    options = {
        "compression": "zstd",
        "parquet.enable.dictionary": "true",
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
    }
    encode_sorted(docs, vocabulary, end_id).write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before; columns that are not selected are not read.

    The broadcast side has one row a part, so it is bounded by the number of tasks that wrote the files."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    parts = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def ids_crc32(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_folder(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return ids_crc32(read_token_files(spark, path))
