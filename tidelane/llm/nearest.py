"""Approximate nearest neighbours with a hierarchical k-means tree (operator 4).

A tree of k-means cells is fitted on a bounded sample (the ``SAMPLE`` different vectors whose hashes are smallest). Every vector is then put into its leaf,
wherever it lies. A query walks the tree best bin first: a priority queue holds cells by the distance of their centre,
and the nearest open cell is split until enough leaves have been visited. How many are enough is calibrated: for
``CALIBRATION`` vectors the true neighbours over all rows are found by one linear pass, and visits widen until the
recall that the tree gives on them reaches ``RECALL``. A query also goes on until the leaves visited hold k others.

Scale: leaves are dealt to shards of about ``BLOCK`` rows. Candidates move once to their leaf's shard; a query moves once
to each shard that holds a leaf it visits, with the list of those leaves, and brings back k rows from there at most. A
leaf of more than ``BLOCK`` rows is salted over several shards, and queries go to all of them. The sample bounds the
number of leaves, so leaves grow with the table; inside a shard a leaf of more than ``INNER`` rows is cut by a tree of its
own, which is walked and calibrated in the same way, so that a query compares a few thousand rows there and not all. What
is left to grow with the table is the number of shards that hold a query's leaves. Of rows with exactly the same vector
only the k + 1 smallest ids can be among anyone's k nearest (ties go to smaller ids, and one may be the query itself), so
the others are set aside before anything is grouped, by a rank limit that Spark applies before the shuffle too. The tree,
the leaf counts and the calibration's neighbours are on the driver; all are bounded by parameters.

Defined cases: vectors that are null, empty or zero or hold a null or non-finite component take no part, nor do those
whose length is not the most common one, nor null ids. Exact repeats of a row are one row. Rows that share an id with
different vectors are each a candidate of other ids; as a query such an id is answered once, for its smallest vector, and
none of its own rows is a candidate then. An empty table gives no rows; fewer than k candidates are all returned; vectors of
doubles and of floats are compared in double precision; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import distinct_sample, read_table, written

SAMPLE, BRANCH, LEAF_ROWS, ROUNDS = 20_000, 8, 96, 12
CALIBRATION, RECALL, BLOCK, LEAST_SHARDS = 128, 0.95, 50_000, 16
INNER, INNER_LEAF, INNER_PROBES, INNER_RECALL = 4_000, 128, 24, 0.99
NEIGHBOURS = 10


def kmeans(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Cell of each row."""
    centres = x[rng.choice(len(x), k, replace=False)]
    cell = np.zeros(len(x), np.int64)
    for _ in range(ROUNDS):
        cell = (((centres**2).sum(1) - 2 * x @ centres.T)).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        count = np.bincount(cell, minlength=k)[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return cell


class Tree:
    """Cells with their centres; ``children`` of a leaf is None and ``leaf`` its number."""

    def __init__(self, x: np.ndarray, leaf_rows: int, branch: int = BRANCH, seed: int = 1):
        self.centres, self.children, self.leaf, self.leaves = [], [], [], 0
        rng = np.random.default_rng(seed)
        self._grow(x.astype(np.float64), max(2, leaf_rows), branch, rng)

    def _grow(self, x, leaf_rows, branch, rng) -> int:
        me = len(self.centres)
        self.centres.append(x.mean(0) if len(x) else None)
        self.children.append(None)
        self.leaf.append(-1)
        if len(x) > leaf_rows:
            cell = kmeans(x, min(branch, len(x)), rng)
            used = np.unique(cell)
            if len(used) > 1:
                kids = [self._grow(x[cell == c], leaf_rows, branch, rng) for c in used]
                self.children[me] = (np.array(kids), np.array([self.centres[k] for k in kids]))
                return me
        self.leaf[me], self.leaves = self.leaves, self.leaves + 1
        return me

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row, by the nearest centre at every level."""
        out, work = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if self.children[node] is None:
                out[rows] = self.leaf[node]
                continue
            kids, centres = self.children[node]
            near = ((centres**2).sum(1) - 2 * x[rows] @ centres.T).argmin(1)
            work += [(int(k), rows[near == i]) for i, k in enumerate(kids) if (near == i).any()]
        return out

    def visit(self, q: np.ndarray):
        """Leaves best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.children[node] is None:
                yield self.leaf[node]
                continue
            kids, centres = self.children[node]
            for d, k in zip(((centres - q) ** 2).sum(1).tolist(), kids.tolist()):
                heapq.heappush(queue, (d, k))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, repeats once."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).select(F.col("vec_id").cast("long"), v.cast(kind).alias("embedding")).where(fine)
    size = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (size.n if size else 0)).dropDuplicates(["vec_id", "embedding"])


def nearest_in(c: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int) -> list[tuple[int, float]]:
    """(place, distance) of the k rows of ``c`` nearest to ``q`` but its own, ties to smaller ids."""
    d = np.sqrt(((c - q) ** 2).sum(1))
    d[ids == own] = np.inf
    if len(d) > 4 * k:
        limit = np.partition(d, k - 1)[k - 1]
        keep = np.flatnonzero(d <= limit)
    else:
        keep = np.arange(len(d))
    order = keep[np.lexsort((ids[keep], d[keep]))][:k]
    return [(int(i), float(d[i])) for i in order if d[i] < np.inf]


class Inner:
    """One leaf's rows in a shard, behind a tree of their own where they are many."""

    def __init__(self, ids: np.ndarray, c: np.ndarray, k: int, limit: int):
        self.ids, self.c, self.k, self.tree = ids, c, k, None
        if len(ids) <= limit:
            return
        rng = np.random.default_rng(3)
        self.tree = Tree(c[np.sort(rng.choice(len(c), min(len(c), SAMPLE), replace=False))], INNER_LEAF)
        cell = self.tree.assign(c)
        order = np.argsort(cell, kind="stable")
        self.ids, self.c = ids[order], c[order]
        self.bounds = np.searchsorted(cell[order], np.arange(self.tree.leaves + 1))
        needed = []
        for i in rng.choice(len(c), INNER_PROBES, replace=False):
            q, own = self.c[i], int(self.ids[i])
            place = {leaf: n + 1 for n, leaf in enumerate(self.tree.visit(q))}
            needed += [place[int(np.searchsorted(self.bounds, j, "right")) - 1] for j, _ in nearest_in(self.c, self.ids, q, own, k)]
        self.visits = sorted(needed)[int(np.ceil(INNER_RECALL * len(needed))) - 1] if needed else 1

    def near(self, q: np.ndarray) -> np.ndarray:
        """Places of the rows to compare with ``q``."""
        if self.tree is None:
            return np.arange(len(self.ids))
        out, held = [], 0
        for n, leaf in enumerate(self.tree.visit(q)):
            if n >= self.visits and held > self.k:
                break
            out.append(np.arange(self.bounds[leaf], self.bounds[leaf + 1]))
            held += len(out[-1])
        return np.concatenate(out)


def top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrate(indexed: DataFrame, tree: Tree, k: int, wanted: int = CALIBRATION, recall: float = RECALL) -> int:
    """Leaves to visit so that the tree finds ``recall`` of the true neighbours of the calibration vectors."""
    rows = indexed.orderBy(F.xxhash64("vec_id", F.lit("calibration")), "vec_id", "leaf").limit(wanted).collect()
    rows = list({r.vec_id: r for r in rows}.values())
    if not rows:
        return 1
    queries, own = np.array([r.embedding for r in rows], np.float64), [r.vec_id for r in rows]

    def scan(batches):
        for batch in batches:
            ids, c, leaf = batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2).to_pylist()
            got = [(q, int(ids[i]), d, leaf[i]) for q in range(len(own)) for i, d in nearest_in(c, ids, queries[q], own[q], k)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*got)], names=["query_id", "vec_id", "score", "leaf"])

    found = indexed.mapInArrow(scan, "query_id long, vec_id long, score double, leaf long")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    true = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "leaf").collect()
    place = [{leaf: i + 1 for i, leaf in enumerate(tree.visit(q))} for q in queries]
    needed = sorted(place[r.query_id][r.leaf] for r in true)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def search(vectors: DataFrame, query_step: int = 100, k: int = NEIGHBOURS, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, recall: float = RECALL, block: int = BLOCK, inner: int = INNER) -> DataFrame:
    """query_id, rank, vec_id and score: neighbours of every id that ``query_step`` divides."""
    rows = written(usable(vectors), "vectors")
    kind = rows.schema["embedding"].dataType.simpleString()
    same = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id")
    candidates = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy")
    total = rows.count()
    fitted = np.array([r.embedding for r in distinct_sample(rows, ["embedding"], sample)], np.float64)
    tree = Tree(fitted, max(4, int(leaf_rows * min(1.0, sample / max(1, total))))) if len(fitted) else Tree(np.zeros((1, 1)), 4)

    def assign(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.assign(matrix(batch.column(1))))], names=["vec_id", "embedding", "leaf"])

    indexed = written(candidates.mapInArrow(assign, f"vec_id long, embedding {kind}, leaf long"), "leaves")
    visits = calibrate(indexed, tree, k, recall=recall)
    counts = {r.leaf: r.n for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row a leaf
    salts = {leaf: -(-n // block) for leaf, n in counts.items() if n > block}
    shards = max(LEAST_SHARDS, -(-sum(counts.values()) // block))

    def walk(batches):
        for batch in batches:
            out = []
            for at, q in enumerate(matrix(batch.column(1))):
                held, chosen = 0, {}
                for i, leaf in enumerate(tree.visit(q)):
                    if i >= visits and held > k:
                        break
                    held += counts.get(leaf, 0)
                    if leaf in counts:
                        for salt in range(salts.get(leaf, 1)):
                            chosen.setdefault((leaf + salt) % shards, []).append(leaf)
                out += [(shard, at, leaves) for shard, leaves in chosen.items()]
            if out:
                shard, at, leaves = zip(*out)
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(leaves, pa.list_(pa.int64()))], names=["shard", "query_id", "vector", "leaves"])

    asking = rows.where(F.col("vec_id") % query_step == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = asking.mapInArrow(walk, f"shard long, query_id long, vector {kind}, leaves array<long>")
    number = F.lit(1) if not salts else F.coalesce(F.create_map(*[F.lit(int(x)) for p in salts.items() for x in p])[F.col("leaf")], F.lit(1))
    shard = F.pmod(F.col("leaf") + F.pmod(F.xxhash64("vec_id"), number), F.lit(shards)).cast("long")
    members = indexed.select(shard.alias("shard"), "leaf", "vec_id", "embedding")

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        got = []
        if held.num_rows and asked.num_rows:
            held = held.sort_by("leaf")
            ids, leaf, c = held.column("vec_id").to_numpy(), held.column("leaf").to_numpy(), matrix(held.column("embedding").combine_chunks())
            first = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
            cells = {int(leaf[a]): Inner(ids[a:b], c[a:b], k, inner) for a, b in zip(first, [*first[1:], len(leaf)])}
            qs = matrix(asked.column("vector").combine_chunks())
            for own, q, leaves in zip(asked.column("query_id").to_pylist(), qs, asked.column("leaves").to_pylist()):
                near = [(cells[x], cells[x].near(q)) for x in leaves if x in cells]
                if near:
                    near_ids, near_c = np.concatenate([x.ids[at] for x, at in near]), np.concatenate([x.c[at] for x, at in near])
                    got += [(own, int(near_ids[i]), d) for i, d in nearest_in(near_c, near_ids, q, own, k)]
        columns = list(zip(*got)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    found = queries.groupBy("shard").cogroup(members.groupBy("shard")).applyInArrow(compare, "query_id long, vec_id long, score double")
    return top(found, k)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"))
