"""Near copies by the exact similarity of their shingles (the pipeline's near-duplicate stage).

Two texts link when the Jaccard similarity of their sets of five-word shingles is at least ``SIMILARITY``, and one row of
each component stays. Candidates come from two sides. SimHash fingerprints of the shingle sets within 3 bits are found by
operator 1's vantage-point trees; texts of 0.8 differ in some 10 to 15 of the 64 bits, and at such a radius no vantage
point cuts the space, so the rest share one of ``BANDS`` bands of ``ROWS`` minhash values: a pair of similarity s meets with
probability 1 - (1 - s**ROWS)**BANDS, which is 0.99997 at 0.8. Nothing is linked as a candidate alone: every link is
confirmed on the sets. Texts of equal sets are one class. Each class is first held against the smallest one of its bucket,
in joins that adaptive execution can split. Buckets that are not one component then are compared whole, in pairs of chunks
where they are large. A class is told by 128 bits of its set, and goes by the number of its first row.

Scale: classes, bands and candidate pairs are shuffled tables; sets are made for classes with a candidate only. Texts are
written once with a number for each row, and the rows that stay are picked by number: by a broadcast of the numbers up to
``BROADCAST_ROWS``, by a join beyond. A large bucket of unlike texts costs the square of its size.

Defined cases: null and empty texts have the empty set and are one class; texts of under five words have one shingle; a
null doc_id comes behind all others, so such a row stays only where its group has no other; rows that share a doc_id are
separate texts; of exact repeats of a row one stays; columns of any name and type pass through; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import pieces, written
from .simhash import Groups, majority, stars

SHINGLE, SIMILARITY, BANDS, ROWS, SEED, CHUNK = 5, 0.8, 20, 4, 42, 2_000
BROADCAST_ROWS = 4_000_000
_RNG = np.random.default_rng(11)
_FLIP, _ODD = _RNG.integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_ODD |= np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    grams = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)))


def bands(own: np.ndarray) -> list[int]:
    import xxhash

    if not len(own):
        return []
    least = np.concatenate([((own[a : a + 4096] ^ _FLIP) * _ODD).min(1, keepdims=True) for a in range(0, len(own), 4096)], 1).min(1)
    return [xxhash.xxh64_intdigest(x.tobytes(), i) - 2**63 for i, x in enumerate(least.reshape(BANDS, ROWS))]


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def with_classes(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``) with near_id (one a row), near_row (equal for equal rows), near_hash (128 bits, equal for
    equal sets), near_fp (fingerprint of the set) and near_bands."""
    import xxhash

    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("near_id"), F.xxhash64(*docs.columns).alias("near_row"))

    def run(batches):
        for batch in pieces(batches, lambda batch: batch.column(0).field("text")):
            own = [shingles(t) for t in batch.column(0).field("text").to_pylist()]
            hashes = pa.array([xxhash.xxh3_128_digest(x.tobytes(), SEED) for x in own], pa.binary())
            fps = pa.array(np.array([majority(x) if len(x) else 0 for x in own], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes, fps, pa.array([bands(x) for x in own], pa.list_(pa.int64()))], names=[*batch.schema.names, "near_hash", "near_fp", "near_bands"])

    more = [T.StructField("near_hash", T.BinaryType()), T.StructField("near_fp", T.LongType()), T.StructField("near_bands", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more]))


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """near_class and its set, of the one text of each class that ``wanted`` (near_class, a row's near_id) names."""
    texts = rows.select(F.col("near_id").alias("near_class"), F.col("row.text").alias("text")).join(wanted, "near_class", "left_semi")

    def run(batches):
        for batch in pieces(batches, lambda batch: batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["near_class", "own"])

    return texts.mapInArrow(run, "near_class long, own binary")


def _close_fingerprints(classes: DataFrame) -> DataFrame:
    """Candidates (a, b) from the vantage-point trees: classes of one fingerprint, and fingerprints within 3 bits."""
    first = written(classes.groupBy("near_fp").agg(F.min("near_class").alias("rep")), "near-fingerprints")
    same = classes.join(first, "near_fp").where("near_class <> rep").select(F.col("rep").alias("a"), F.col("near_class").alias("b"))
    links = stars(first.select(F.col("near_fp").alias("fp"))).select(F.col("a").alias("x"), F.col("b").alias("y"))
    near = links.join(first.select(F.col("near_fp").alias("x"), F.col("rep").alias("a")), "x").join(first.select(F.col("near_fp").alias("y"), F.col("rep").alias("b")), "y")
    return same.unionByName(near.select("a", "b"))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar."""
    left, right = sets.select(F.col("near_class").alias("a"), F.col("own").alias("x")), sets.select(F.col("near_class").alias("b"), F.col("own").alias("y"))

    def run(batches):
        for batch in batches:
            held = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(held, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def link(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between rows of different labels, enough to join up all that are similar."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, labels, sets = ids[order], labels[order], [sets[i] for i in order]
    size, groups, first, out = np.array([len(s) for s in sets]), Groups(ids), {}, []
    for i, x in enumerate(labels.tolist()):
        groups.join(first.setdefault(x, i), i)
    roots = np.array([groups.find(i) for i in range(len(ids))])
    for i in range(len(ids)):
        stop = np.searchsorted(size, size[i] / similarity + 1e-9, "right")
        for j in (i + 1 + np.flatnonzero(roots[i + 1 : stop] != roots[i])).tolist():
            if roots[i] != roots[j] and similar(sets[i], sets[j], similarity):
                out.append((int(ids[i]), int(ids[j])))
                roots[roots == roots[j]] = roots[i]
    return out


def links(rows: DataFrame, classes: DataFrame, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """near_class and its component, for classes that are not their own."""
    buckets = classes.select("near_class", F.explode("near_bands").alias("key"))
    found = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("near_class").alias("rep"), F.bit_xor(F.xxhash64("near_class")).alias("members")).where("n > 1")
    found = found.groupBy("n", "rep", "members").agg(F.min("key").alias("key"))  # of buckets with the same members, one
    members = written(buckets.join(found.select("key", "n", "rep"), "key"), "near-members")
    pairs = members.where("near_class <> rep").select(F.col("rep").alias("a"), F.col("near_class").alias("b"))
    pairs = written(pairs.unionByName(_close_fingerprints(classes)).distinct(), "near-candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("near_class")).distinct()
    sets = written(_sets(rows, classes.join(ends, "near_class", "left_semi").select("near_class")), "near-sets")
    edges = written(_confirmed(pairs, sets, similarity), "near-links")
    label = connected_components(edges).select(F.col("node").alias("near_class"), "component")
    own = members.where("n > 2").join(label, "near_class", "left").select("key", "n", "near_class", F.coalesce("component", "near_class").alias("label"))
    split = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    parts = F.ceil(F.col("n") / chunk)
    part = F.pmod(F.xxhash64("near_class", "key"), parts)
    meets = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda p: F.struct(F.least("part", p).alias("i"), F.greatest("part", p).alias("j"))))
    open_ = own.join(split, "key").withColumn("part", part).withColumn("m", meets).select("key", "m.i", "m.j", "near_class", "label").join(sets, "near_class")

    def within(table: pa.Table) -> pa.Table:
        more = link(table.column("near_class").to_numpy(), table.column("label").to_numpy(), [np.frombuffer(x, np.uint64) for x in table.column("own").to_pylist()], similarity)
        return pa.table({"a": pa.array([a for a, _ in more], pa.int64()), "b": pa.array([b for _, b in more], pa.int64())})

    more = written(open_.groupBy("key", "i", "j").applyInArrow(within, "a long, b long"), "near-links")
    return connected_components(edges.unionByName(more)).withColumnsRenamed({"node": "near_class"})


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The row with the smallest doc_id of each group, then by a hash of the row."""
    rows = written(with_classes(docs), "near-rows")
    key = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), "near_row", "near_id").alias("f")
    first = rows.select("near_hash", "near_fp", "near_bands", key).groupBy("near_hash")
    classes = written(first.agg(F.min("f").alias("f"), F.first("near_bands").alias("near_bands"), F.first("near_fp").alias("near_fp")).select(F.col("f.near_id").alias("near_class"), "near_fp", "f", "near_bands"), "near-classes")
    joined = classes.select("near_class", "f").join(links(rows, classes, similarity), "near_class", "left").withColumn("component", F.coalesce("component", "near_class"))
    chosen = written(joined.groupBy("component").agg(F.min("f").alias("f")).select("f.near_id"), "near-chosen")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    return rows.join(chosen, "near_id", "left_semi").select("row.*")
