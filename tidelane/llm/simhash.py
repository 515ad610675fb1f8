"""SimHash near-duplicate groups with vantage-point trees (operator 1).

A text's fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of its word shingles. Two
fingerprints link when at most ``radius`` bits differ, and groups are the components of that graph.

Exact copies of a fingerprint are one class from the start. A vantage-point tree over a bounded sample of the classes
cuts the space into shards: at each node, fingerprints within ``mu`` of the vantage point go left and the others right,
and by the triangle inequality only left ones further than ``mu - radius`` can have a partner on the right. Those are
sent to both sides, so every linked pair meets in a shard. Each shard goes on with trees of its own down to small
leaves, which are compared exactly, and returns a star for every group that it finds: never all pairs, however dense
a group is. The stars are joined up by connected components.

Scale: fingerprints are computed where the texts lie; what moves is 16 bytes a class, times its copies. Copies near
boundaries grow with the tree's depth (2.8 at depth 4), so up to 2 ** ``DEPTH`` shards are cut by trees alone. Beyond,
classes are first dealt by the four 16-bit quarters of the fingerprint: of two within 3 bits at least one quarter is
equal, so each class goes to four shards, whatever the number of classes. A quarter value that very many classes share is
dealt again by equal blocks of its other bits: cut into six, three blocks must be equal, so such a class goes to twenty
shards for that quarter, of prints that agree in 40 bits. The same is done inside a shard with more than ``TREE`` prints
that agree in a quarter, until few agree; trees cut up what is left together. A shard holds about ``SHARD`` classes up to
2e9 classes; with more it grows as their number over 65,536, some 800,000 at 5e10. Only the sample (``SAMPLE`` fingerprints
at most), the tree and the hot values (of 262,144) are on the driver.

Defined cases: null and empty texts have fingerprint zero, linked like any other; a document whose doc_id is null has a
fingerprint and no component; rows that share a doc_id are separate texts, so an id does not join its texts' groups; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import read_table, written

SHINGLE, RADIUS, SEED = 3, 3, 42
SAMPLE, SHARD, DEPTH, LEAF = 8_192, 30_000, 4, 256
TREE = 10_000  # prints that one tree cuts up; more are dealt by blocks of bits first
QUARTERS = 4


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # on bytes both touch ASCII alone, as the word rule asks
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1))
    found = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())), np.uint64, len(starts))
    return majority(found)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint's bits as a long."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class Node:
    """A vantage point, its radius and the two sides; a leaf has a shard's number."""

    def __init__(self, shard=None, point=None, mu=None, left=None, right=None):
        self.shard, self.point, self.mu, self.left, self.right = shard, point, mu, left, right


def split(fps: np.ndarray, radius: int, rng) -> tuple | None:
    """Vantage point and mu whose larger side, copies included, is smallest; None if no cut takes a twelfth away."""
    best = None
    for point in fps[rng.integers(0, len(fps), 4)]:
        seen = np.bincount(np.bitwise_count(fps ^ point), minlength=65).cumsum()
        left, low = seen[:64], np.concatenate((np.zeros(radius, np.int64), seen))[:64]
        worst = np.maximum(left, len(fps) - low)
        mu = int(worst.argmin())
        if best is None or worst[mu] < best[0]:
            best = worst[mu], point, mu
    return best[1:] if best[0] * 12 <= len(fps) * 11 else None


def sides(fps: np.ndarray, point, mu: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.bitwise_count(fps ^ point).astype(np.int16)
    return np.flatnonzero(d <= mu), np.flatnonzero(d > mu - radius)


def build(fps: np.ndarray, depth: int, radius: int, shards: list, rng) -> Node:
    if depth > 0 and len(fps) > 16 and (cut := split(fps, radius, rng)):
        left, right = sides(fps, *cut, radius)
        return Node(None, *cut, build(fps[left], depth - 1, radius, shards, rng), build(fps[right], depth - 1, radius, shards, rng))
    shards.append(None)
    return Node(len(shards) - 1)


def route(node: Node, fps: np.ndarray, rows: np.ndarray, radius: int):
    """(shard, rows) for all shards that the rows belong to or overlap."""
    if node.shard is not None:
        if len(rows):
            yield node.shard, rows
        return
    left, right = sides(fps[rows], node.point, node.mu, radius)
    yield from route(node.left, fps, rows[left], radius)
    yield from route(node.right, fps, rows[right], radius)


class Groups:
    """Union-find whose roots are the members with the smallest id."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.up = ids.tolist(), list(range(len(ids)))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            if self.ids[j] < self.ids[i]:
                i, j = j, i
            self.up[j] = i


def deals(free: np.ndarray, radius: int) -> list[tuple[np.uint64, np.ndarray]]:
    """Masks of which two prints that agree outside the ``free`` bits and differ in ``radius`` bits at most share at least
    one: the free bits are cut into 2 * radius blocks, of which ``radius`` must be equal. With each mask, the bits left free."""
    blocks = np.array_split(free, 2 * radius)
    mask = lambda bits: np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64)) if len(bits) else np.uint64(0)
    found = []
    for kept in combinations(range(2 * radius), radius):
        found.append((mask(np.concatenate([blocks[i] for i in kept])), np.concatenate([blocks[i] for i in range(2 * radius) if i not in kept])))
    return found


def link(fps: np.ndarray, rows: np.ndarray, radius: int, groups: Groups, rng, free: np.ndarray | None = None) -> None:
    """Join all rows within ``radius`` of each other; they agree outside the ``free`` bits (all bits if None).

    A tree's copies near boundaries grow with its depth, so more than ``TREE`` rows are dealt by equal blocks of bits until
    few agree, or until under 2 * radius bits are left in which they could differ; trees cut up what is left together."""
    free = np.arange(64) if free is None else free
    if len(rows) <= TREE or radius < 1 or len(free) < 2 * radius:
        _link_tree(fps, rows, radius, groups, rng)
        return
    for mask, rest in deals(free, radius):
        key = fps[rows] & mask
        order = rows[np.argsort(key, kind="stable")]
        key = fps[order] & mask
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(first)
        few = np.repeat(size <= 8, size)
        for shift in range(1, 8):  # small buckets: each row against those up to seven places on
            near = few[:-shift] & (key[:-shift] == key[shift:]) & (np.bitwise_count(fps[order[:-shift]] ^ fps[order[shift:]]) <= radius)
            for i in np.flatnonzero(near).tolist():
                groups.join(int(order[i]), int(order[i + shift]))
        for x in np.flatnonzero(size > 8).tolist():
            own = order[first[x] : first[x + 1]]
            root = groups.find(int(own[0]))
            if any(groups.find(i) != root for i in own.tolist()):
                link(fps, own, radius, groups, rng, rest)


def _link_tree(fps: np.ndarray, rows: np.ndarray, radius: int, groups: Groups, rng) -> None:
    work = [rows]
    while work:
        rows = work.pop()
        own = fps[rows]
        if len(rows) <= LEAF:
            a, b = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own) <= radius, 1))
            for i, j in zip(rows[a].tolist(), rows[b].tolist()):
                groups.join(i, j)
        elif cut := split(own, radius, rng):
            work += [rows[x] for x in sides(own, *cut, radius)]
        else:
            _link_dense(own, rows, radius, groups)


def _link_dense(own: np.ndarray, rows: np.ndarray, radius: int, groups: Groups) -> None:
    """Rows too close to cut: grow each group from a member, taking every row out when it is first reached."""
    left = np.arange(len(rows))
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            near = np.bitwise_count(own[left] ^ own[i]) <= radius
            if near.any():
                for j in left[near].tolist():
                    groups.join(int(rows[i]), int(rows[j]))
                    front.append(j)
                left = left[~near]


def quarter(fps: np.ndarray, q: int) -> np.ndarray:
    return (fps >> np.uint64(16 * q)) & np.uint64(0xFFFF)


def hot_quarters(classes: DataFrame, least: int) -> list[dict[int, int]]:
    """For each quarter, its values that more than ``least`` classes have, with their number (of 65,536 values at most)."""
    value = lambda q: F.shiftrightunsigned("fp", 16 * q).bitwiseAND(0xFFFF).alias("v")
    each = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), value(q)) for q in range(QUARTERS)))).alias("x")
    found: list[dict[int, int]] = [{} for _ in range(QUARTERS)]
    for r in classes.select(each).groupBy("x.q", "x.v").count().where(F.col("count") > least).collect():
        found[r.q][r.v] = r["count"]
    return found


class Dealer:
    """Deals fingerprints to shards by quarters. A hot quarter value is dealt again, by the masks of its other 48 bits."""

    def __init__(self, per: int, hot: list[dict[int, int]], radius: int, shard_size: int):
        self.per, self.radius, self.hot = per, radius, []
        for q, values in enumerate(hot):
            rest = np.setdiff1d(np.arange(64), np.arange(16 * q, 16 * q + 16))
            known = np.array(sorted(values), np.uint64)
            self.hot.append((known, np.array([-(-values[int(v)] // shard_size) for v in known], np.uint64), deals(rest, radius)))
        self.parts = max([int(p.max()) for _, p, _ in self.hot if len(p)], default=1)

    def shards(self, fps: np.ndarray):
        """(shard, rows); hot shards are below zero."""
        for q, (known, parts, masks) in enumerate(self.hot):
            own = quarter(fps, q)
            at = np.searchsorted(known, own)
            is_hot = known[np.minimum(at, len(known) - 1)] == own if len(known) else np.zeros(len(fps), bool)
            yield from _runs(q * self.per + (own % np.uint64(self.per)).astype(np.int64), np.flatnonzero(~is_hot))
            rows = np.flatnonzero(is_hot)
            for c, (mask, _) in enumerate(masks if len(rows) else ()):
                mixed = (fps[rows] & mask) * np.uint64(0x9E3779B97F4A7C15)
                part = ((mixed ^ (mixed >> np.uint64(32))) % parts[at[rows]]).astype(np.int64)
                number = ((q * 65_536 + own[rows].astype(np.int64)) * len(masks) + c) * self.parts + part
                full = np.zeros(len(fps), np.int64)
                full[rows] = -1 - number
                yield from _runs(full, rows)

    def agreeing(self, shard: int, fps: np.ndarray):
        """Rows of a shard that share a quarter value, or a mask of a hot one, and the bits in which they may differ."""
        if shard >= 0:
            q = shard // self.per
            yield from ((rows, np.setdiff1d(np.arange(64), np.arange(16 * q, 16 * q + 16))) for _, rows in _runs(quarter(fps, q).astype(np.int64), np.arange(len(fps))))
            return
        q, c = divmod((-1 - shard) // self.parts, len(self.hot[0][2]))
        mask, rest = self.hot[q // 65_536][2][c]
        yield from ((rows, rest) for _, rows in _runs((fps & mask).view(np.int64), np.arange(len(fps))))


def _runs(keys: np.ndarray, rows: np.ndarray):
    """(key, rows) of equal keys among ``rows``."""
    order = rows[np.argsort(keys[rows], kind="stable")]
    found, first = np.unique(keys[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]) if len(order) else [])


def stars(classes: DataFrame, radius: int = RADIUS, shard_size: int = SHARD, most: int = DEPTH) -> DataFrame:
    """Edges (a, b) between the fingerprints ``fp`` of ``classes``, each there once, whose components are those of the link
    graph; ``radius`` is 3 at most where there are more than 2 ** ``most`` shards."""
    total = classes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, total) / shard_size))))
    by_quarter = depth > most and 0 < radius < QUARTERS
    sample = [r.fp for r in classes.orderBy(F.xxhash64("fp")).limit(SAMPLE).select("fp").collect()] if depth and not by_quarter else []
    leaves: list = []
    tree = build(np.array(sample, np.int64).view(np.uint64), depth, radius, leaves, np.random.default_rng(1))
    per = min(1 << 16, -(-total // shard_size))
    dealer = Dealer(per, hot_quarters(classes, max(shard_size, 2 * total // 65_536)), radius, shard_size) if by_quarter else None

    def spread(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            found = list(dealer.shards(fps) if dealer else route(tree, fps, np.arange(len(fps)), radius))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(rows), shard, np.int64) for shard, rows in found])), batch.column(0).take(pa.array(np.concatenate([rows for _, rows in found])))], names=["shard", "fp"])

    def within(table: pa.Table) -> pa.Table:
        ids, shard = np.sort(table.column("fp").to_numpy()), table.column("shard")[0].as_py()
        fps, groups, rng = ids.view(np.uint64), Groups(ids), np.random.default_rng(2)
        for rows, free in dealer.agreeing(shard, fps) if dealer else [(np.arange(len(ids)), None)]:
            if len(rows) > 1:
                link(fps, rows, radius, groups, rng, free)
        roots = np.array([groups.find(i) for i in range(len(ids))], np.int64)
        far = np.flatnonzero(roots != np.arange(len(ids)))
        return pa.table({"a": ids[far], "b": ids[roots[far]]})

    shards = classes.select("fp").mapInArrow(spread, "shard long, fp long")
    return shards.groupBy("shard").applyInArrow(within, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    classes = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "fingerprint-classes")
    label = connected_components(stars(classes, radius)).withColumnRenamed("node", "fp")
    joined = written(classes.join(label, "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("label")), "fingerprint-labels")
    least = joined.groupBy("label").agg(F.min("id").alias("component_id"))
    rows = prints.join(joined.join(least, "label").select("fp", "component_id"), "fp", "left")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.select("doc_id", hexed.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
