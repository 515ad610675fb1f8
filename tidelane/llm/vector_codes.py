"""Vector compression to product codes, with codebooks by ball k-means (operator 11).

A vector becomes integers, floor(``SCALE`` * x), and is cut into ``PARTS`` equal parts. Each part position has a codebook
whose entries start as that part of the vectors with the smallest ids; ``ROUNDS`` times every part is put to its nearest
entry and each entry becomes the floored mean of its parts. All arithmetic is on integers and the sums are exact, so codes
depend on the rows alone, not on how they lie. All rows take part in every round.

Ball k-means: the rows that hold one entry form its ball, whose radius is the distance of the farthest. Entries nearer to
the ball's own than twice the radius are its neighbours, the only ones a row of it may go to. A row of the stable core,
nearer to its entry than half the way to the nearest neighbour, stays without another distance. The others lie in rings:
between half the distances to the t-th and the next neighbour only the nearest t are candidates. Half distances are compared
as 4 * d * d, so no root is rounded and nothing is pruned that could be as near. Any entry can be a row's ball in this, so
radii are taken inside each batch of rows, and balls come from the codes that the second round wrote; they are near the final
ones, as most of the way is gone in the first two rounds.

Scale: two rounds read the given table, the second writes integers and codes once (one time the input), and the rest read
that. A round moves one row an entry and task, pre-summed, and shuffles them by entry and position; the driver holds the
codebooks, PARTS * ENTRIES parts. Errors of equal labels are summed before they move and joined to the rows' own small
columns; a label of very many rows is one row of that join's small side.

Defined cases: rows take no part whose vector is null or empty, holds a null or non-finite component or one whose squares
would not fit a long (beyond 23,170 in absolute value for parts of 8, less for longer), or is not of the most common length
(the longer of equally common ones). A length that PARTS does not divide is filled up with zeros. Of repeated ids each row
is a vector of its own; ids go in order, then vectors, null ids last, in choosing the first entries; with fewer rows than
entries the codebooks are shorter. Ties go to the lower entry, so an entry that repeats an earlier one stays unused. Null
labels are one label. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def largest(width: int) -> int:
    """Integers up to this leave four times a squared distance over all parts within a long."""
    return math.isqrt((2**63 - 1) // (16 * PARTS * max(1, width)))


def part_width(length: int) -> int:
    return -(-length // PARTS)


def integers(rows: DataFrame, length: int, scale: int = SCALE) -> DataFrame:
    """vec_id, label and ``v``, the integers of every vector that takes part, filled up to PARTS equal parts."""
    width = part_width(length)
    total, limit = width * PARTS, largest(width)

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(lists), length), False))
            if not len(batch):
                continue
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)  # null becomes NaN
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.floor(flat * scale)
                good = (np.abs(scaled) <= limit).all(1)
            found = np.zeros((int(good.sum()), total), np.int32 if limit < 2**31 else np.int64)
            found[:, :length] = scaled[good]
            ids, labels = batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([ids, labels, list_column(found)], names=["vec_id", "label", "v"])

    kind = "int" if limit < 2**31 else "long"
    label = rows.schema["label"].dataType.simpleString()
    return rows.select(F.col("vec_id").cast("long"), "label", "embedding").mapInArrow(run, f"vec_id long, label {label}, v array<{kind}>")


def list_column(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.reshape(-1)))


def part_arrays(column: pa.Array, width: int, bound: int) -> list[np.ndarray]:
    """Each part position's rows. Doubles hold the integers exactly while they and ``bound`` are small, and are faster."""
    flat = column.flatten().to_numpy().reshape(-1, PARTS, width)
    most = max(bound, int(np.abs(flat).max(initial=0)))
    exact = 16 * PARTS * width * most * most < 2**53
    return [flat[:, p].astype(np.float64 if exact else np.int64) for p in range(PARTS)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row and the squared distance, by all entries."""
    best = ((x - entries[0]) ** 2).sum(1)
    code = np.zeros(len(x), np.int64)
    for j in range(1, len(entries)):
        d = ((x - entries[j]) ** 2).sum(1)
        better = d < best
        best[better], code[better] = d[better], j
    return code, best


def nearest_by_balls(x: np.ndarray, entries: np.ndarray, ball: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same from the entry ``ball`` that each row is taken to hold, and the number of distances that were needed."""
    k = len(entries)
    own = ((x - entries[ball]) ** 2).sum(1)
    gaps = ((entries[:, None] - entries[None]) ** 2).sum(2)
    radius = np.zeros(k, own.dtype)
    np.maximum.at(radius, ball, own)
    others = np.argsort(np.where(np.eye(k, dtype=bool), -1, gaps), axis=1, kind="stable")[:, 1:]
    gaps = np.take_along_axis(gaps, others, 1)
    neighbours = int((gaps <= 4 * radius[:, None]).sum(1).max(initial=0))
    best, code, reach, asked = own.copy(), ball.copy(), 4 * own, len(x)
    rows = np.arange(len(x))
    for t in range(neighbours):
        rows = rows[reach[rows] >= gaps[ball[rows], t]]  # first the stable core stays behind, then ring after ring
        if not len(rows):
            break
        j = others[ball[rows], t]
        d = ((x[rows] - entries[j]) ** 2).sum(1)
        asked += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (j < code[rows]))
        best[rows[better]], code[rows[better]] = d[better], j[better]
    return code, best, asked


def assign(column: pa.Array, balls: np.ndarray | None, books: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The rows' parts, their codes (a column a part) and errors."""
    parts = part_arrays(column, books[0].shape[1], max(int(np.abs(b).max(initial=0)) for b in books))
    codes, error = np.zeros((len(column), PARTS), np.uint8), np.zeros(len(column), np.int64)
    for p, x in enumerate(parts):
        entries = books[p].astype(x.dtype)
        found = nearest(x, entries) if balls is None else nearest_by_balls(x, entries, balls[:, p].astype(np.int64))
        codes[:, p] = found[0]
        error += found[1].astype(np.int64)
    return parts, codes, error


def ball_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PARTS)


def code_column(codes: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in codes], pa.binary())


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, v, code (PARTS bytes) and error; ``rows`` has a column ``code`` with balls, or none."""
    shared, known = rows.sparkSession.sparkContext.broadcast(books), "code" in rows.columns
    columns = ["vec_id", "label", "v"] + ["code"] * known

    def run(batches):
        for batch in batches:
            _, codes, error = assign(batch.column(2), ball_matrix(batch.column(3)) if known else None, shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], code_column(codes), pa.array(error)], names=["vec_id", "label", "v", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(columns).mapInArrow(run, f"vec_id long, label {types['label']}, v {types['v']}, code binary, error long")


def next_books(rows: DataFrame, books: list[np.ndarray], as_coded: bool = False) -> list[np.ndarray]:
    """The codebooks after one round; ``as_coded``: the rows' codes are this round's already."""
    shared, known, width = rows.sparkSession.sparkContext.broadcast(books), "code" in rows.columns, books[0].shape[1]

    def run(batches):
        k = len(books[0])
        sums, count = np.zeros((PARTS, k, width), np.int64), np.zeros((PARTS, k), np.int64)
        for batch in batches:
            balls = ball_matrix(batch.column(1)) if known else None
            if as_coded:
                parts, codes = part_arrays(batch.column(0), width, 0), balls
            else:
                parts, codes, _ = assign(batch.column(0), balls, shared.value)
            for p, x in enumerate(parts):
                np.add.at(sums[p], codes[:, p], x.astype(np.int64))
                count[p] += np.bincount(codes[:, p], minlength=k)
        part, entry = np.nonzero(count)
        found = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), list_column(sums[part, entry])]
        yield pa.RecordBatch.from_arrays(found, names=["part", "entry", "n", "sums"])

    made = rows.select(["v"] + ["code"] * known).mapInArrow(run, "part int, entry int, n long, sums array<long>")
    flat = made.select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    after = [b.copy() for b in books]
    for r in flat.groupBy("part", "entry", "at").agg(total("n"), total("s")).collect():
        after[r.part][r.entry, r["at"]] = int(r.s) // int(r.n)
    return after


def first_books(vectors: DataFrame, entries: int = ENTRIES) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids."""
    first = vectors.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    matrix = np.array([r.v for r in first], np.int64)
    return list(matrix.reshape(len(first), PARTS, -1).transpose(1, 0, 2)) if first else []


def common_length(rows: DataFrame) -> int:
    """The most common length of usable vectors; 0 where there is none."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    size = F.size("embedding").alias("size")
    top = rows.where((F.size("embedding") > 0) & usable).groupBy(size).count().orderBy(F.desc("count"), F.desc("size")).first()
    return top["size"] if top else 0


def compress(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, v, code and error of every vector of ``rows`` (vec_id, embedding, label), and the codebooks."""
    vectors = integers(rows, common_length(rows), scale)
    books = first_books(vectors, entries)
    if not books:
        return vectors.select("vec_id", "label", "v", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), books
    for i in range(rounds):
        if i == 1:
            vectors = written(encode(vectors, books).drop("error"), "vectors")
        books = next_books(vectors, books, as_coded=i == 1)
    return encode(vectors, books), books


def decode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``rows`` with ``approximation``, the integers of the entries that ``code`` names."""
    shared, columns = rows.sparkSession.sparkContext.broadcast(books), rows.columns

    def run(batches):
        for batch in batches:
            codes = ball_matrix(batch.column(columns.index("code")))
            found = np.concatenate([b[codes[:, p]] for p, b in enumerate(shared.value)], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, list_column(found.astype(np.int64))], names=[*columns, "approximation"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, approximation array<long>")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.reshape(-1).tolist()).encode()).hexdigest()


def op11_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(read_table(spark, sf_dir, "embeddings"))
    rows = written(coded.select("vec_id", "label", "code", "error"), "codes")
    labels = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    found = rows.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds written out, each an assignment of all parts to all entries of their position."""
    steps = [
        "k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS v FROM k, range({PARTS}) AS t(p))",
        f"e0 AS MATERIALIZED (SELECT p, r AS e, v FROM x WHERE r < {ENTRIES})",
    ]
    best = "min(list_sum(list_transform(list_zip(x.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + e.e)"
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT x.r, x.p, CAST({best} AS BIGINT) AS b FROM x JOIN e{i} AS e USING (p) GROUP BY ALL)")
        if i < ROUNDS:
            flat = f"SELECT a.p, a.b % 16 AS e, unnest(x.v) AS s, generate_subscripts(x.v, 1) AS i FROM a{i} AS a JOIN x USING (r, p)"
            mean = f"SELECT p, e, i, CAST((sum(s) - ((sum(s) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM ({flat}) GROUP BY ALL"
            steps.append(f"e{i + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(n.v, o.v) AS v FROM e{i} AS o LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS v FROM ({mean}) GROUP BY ALL) AS n USING (p, e))")
    steps.append(f"c AS (SELECT r, string_agg(format('{{:02x}}', b % 16), '' ORDER BY p) AS code, CAST(sum(b // 16) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(CAST(s AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(v) AS s, generate_subscripts(v, 1) AS i FROM e{ROUNDS}))")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN c USING (r), h"


OP11_SQL = _sql()
