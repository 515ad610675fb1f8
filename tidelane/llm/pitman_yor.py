"""Language-model scores from a hierarchical Pitman-Yor model (operator 10).

Restaurants in three levels. The root serves words over an even base of all V training words and one unknown. Below it
stands a restaurant for every ending of a previous word (its last byte), and below its ending's one for every previous
word, however rare; the start of a text follows an end. A table of a restaurant is a customer of its parent. Seating is
sampled by Gibbs: in each sweep the number of tables at which a dish is served is drawn from its conditional given its
customers, the parent's predictive probability and the restaurant's other tables (see ``seating``). Pairs of a word
partition are drawn in ``GROUPS`` turns, with the tables of the turns before; other partitions' tables are those of the
sweep before. Predictive probabilities are averaged over the sweeps after the first ``BURN_IN``.

Flow. Scan tasks turn documents into blocks of word numbers. Word partitions (by hash) sum the blocks' counts and give
each word an id, which is the partition and a rank in it. Blocks then send distinct (previous word, word) pairs with
training counts to pair partitions, by previous word; a previous word with many training tokens is split over partitions
by the word behind it, according to its exact count, so a hot one is no hot task. In a sweep, a pair partition tells the
word partitions how many tables its contexts have opened for each (word, ending), and gets the parent's probabilities of
the dishes that it has to draw; a pair met once sits at one table and needs nothing. The word partitions hold the endings'
and the root's restaurants. At the end both kinds of partition answer the blocks in the order of their requests.

Scale: what moves is a few bytes for each distinct word or pair of a block, never more rows than pairs, and the seating of
each sweep is kept as a table, so no sweep is repeated. Nothing is broadcast but one number a (sweep, ending). All counts
cover every training document, and do not depend on how the table is partitioned.

Defined cases: a null or empty text is one end token; repeated rows get equal results and train as often as they occur;
a null doc_id is held out; other columns are ignored; an empty table gives no rows; with no training token every word
has the unknown's probability 1.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_folder
from .seating import draw_tables
from .shared import fold_of, read_table, written

FOLDS, SWEEPS, BURN_IN, GROUPS, STRENGTH = 10, 4, 1, 4, 1.0
BLOCK_TOKENS, PART_BYTES, SPLIT, ENDINGS = 1_500_000, 12 << 20, 1_000_000, 256
END = b"\n"  # no word holds white space
ROWS = "part int, kind string, source long, payload binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


# Arrays as bytes


def small(x: np.ndarray) -> np.ndarray:
    """Numbers from zero on, in the narrowest type."""
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def steps(x: np.ndarray) -> np.ndarray:
    """An ascending array by its differences."""
    return small(np.diff(x, prepend=0))


def climb(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.int64)


def apart(x: np.ndarray, first: np.ndarray | None) -> np.ndarray:
    """``x`` by its differences from ``first`` (mostly none between sweeps), small numbers of either sign from zero on."""
    if first is None:
        return small(x)
    d = x.astype(np.int64) - first.astype(np.int64)
    return small((d << 1) ^ (d >> 63))


def together(x: np.ndarray, first: np.ndarray | None) -> np.ndarray:
    x = x.astype(np.int64)
    return x if first is None else ((x >> 1) ^ -(x & 1)) + first


_CODEC = pa.Codec("zstd", compression_level=7)
_KINDS = [np.dtype(t) for t in (np.uint8, np.uint16, np.uint32, np.uint64, np.int64, np.float32, np.bool_)]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob, bytes of equal weight together, which compresses the upper ones away."""
    head = np.array([len(arrays), *(x for a in arrays for x in (_KINDS.index(a.dtype), len(a)))], np.int64).tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays]
    body = head + b"".join(planes)
    return len(body).to_bytes(8, "little") + _CODEC.compress(body, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    head = np.frombuffer(body, np.int64, 2 * n, 8).tolist()
    out, at = [], 8 * (1 + 2 * n)
    for kind, length in zip(head[::2], head[1::2]):
        size = _KINDS[kind].itemsize
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, length * size, at).reshape(size, length).T).view(_KINDS[kind]).ravel())
        at += length * size
    return out


def table(rows: list[tuple], part: int | None = None) -> pa.Table:
    """Rows (part, kind, source, payload); ``part`` stands for all where it is given."""
    rows = [(part, *r) for r in rows] if part is not None else rows
    columns = list(zip(*rows)) or [()] * 4
    return pa.table({"part": pa.array(columns[0], pa.int32()), "kind": pa.array(columns[1], pa.string()), "source": pa.array(columns[2], pa.int64()), "payload": pa.array(columns[3], pa.binary())})


def held(rows: pa.Table) -> dict[str, list]:
    """Unpacked payloads of a partition's rows by kind, in the order of their sources, with the sources."""
    out: dict[str, list] = {}
    for kind, source, payload in sorted(zip(rows.column("kind").to_pylist(), rows.column("source").to_pylist(), rows.column("payload").to_pylist()), key=lambda r: r[:2]):
        out.setdefault(kind, []).append((source, unpack(payload)))
    return out


def joined(arrays: list, dtype=np.int64) -> np.ndarray:
    return np.concatenate([np.asarray(a, dtype) for a in arrays]) if len(arrays) else np.zeros(0, dtype)


def cuts(sizes) -> list[tuple[int, int]]:
    ends = np.cumsum(sizes).tolist()
    return list(zip([0, *ends[:-1]], ends))


# Blocks


class Block:
    """Documents of one scan task as numbers of words."""

    def __init__(self, parts: int):
        self.parts = parts
        self.clear()

    def clear(self):
        self.words: dict[bytes, int] = {END: 0}
        self.docs, self.keys, self.size = [], [], 0

    def add(self, key, train: bool, text) -> None:
        number, words = self.words, tokens(text)
        row = [number.setdefault(w, len(number)) for w in words]
        row.append(0)
        self.docs.append(np.array(row, np.int32))
        self.keys.append((key, train))
        self.size += len(row)

    def rows(self):
        """(part, payload): the documents with part -1, and requests to word partitions. Words are numbered anew by
        partition and hash; a request also lists the endings that a word follows."""
        import xxhash

        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        part = (hashes % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort((hashes, part))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        last = np.fromiter((w[-1] for w in self.words), np.uint8, len(self.words))[order]
        lengths = np.array([len(d) for d in self.docs], np.int64)
        word = place[np.concatenate(self.docs)]
        train = np.array([t for _, t in self.keys], bool)
        count = np.bincount(word[np.repeat(train, lengths)], minlength=len(order))
        behind = np.unique(word * ENDINGS + last[before(word, lengths, place[0])])
        bounds = np.searchsorted(part[order], np.arange(self.parts + 1))
        asked = np.searchsorted(behind, bounds * ENDINGS)
        for p in np.unique(part).tolist():
            a, b, c, d = bounds[p], bounds[p + 1], asked[p], asked[p + 1]
            yield p, pack(hashes[order[a:b]], small(count[a:b]), steps(behind[c:d] // ENDINGS - a), small(behind[c:d] % ENDINGS))
        ids = np.array([k if k is not None else 0 for k, _ in self.keys], np.int64)
        null = np.array([k is None for k, _ in self.keys], bool)
        yield -1, pack(ids, null, train, small(lengths), small(word), last, np.array([place[0]], np.int64))


def before(word: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The word before each token; an end before the first of a text."""
    prev = np.concatenate(([end], word[:-1]))
    prev[np.cumsum(lengths)[:-1]] = end
    return prev


def blocks(docs: DataFrame, parts: int, limit: int) -> DataFrame:
    """block, part and payload: requests for words, and with part -1 the documents."""

    def run(batches):
        from pyspark import TaskContext

        made, block = TaskContext.get().partitionId() << 24, Block(parts)

        def out():
            nonlocal made
            part, payload = zip(*block.rows())
            yield pa.RecordBatch.from_arrays([pa.array([made] * len(part), pa.int64()), pa.array(part, pa.int32()), pa.array(payload, pa.binary())], names=["block", "part", "payload"])
            block.clear()
            made += 1

        for batch in batches:
            for key, train, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                block.add(key, train, text)
                if block.size >= limit:
                    yield from out()
        if block.size:
            yield from out()

    return docs.select("doc_id", "train", "text").mapInArrow(run, "block long, part int, payload binary")


# Word partitions: counts and ids


def count_words(rows: pa.Table) -> pa.Table:
    """Counts of one word partition, each block's places in them, and its requests for (word, ending)."""
    asked = sorted(zip(rows.column("block").to_pylist(), rows.column("payload").to_pylist()))
    found = [unpack(x) for _, x in asked]
    hashes, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    count = np.bincount(place, joined([f[1] for f in found]), len(hashes)).astype(np.int64)
    size = [len(f[0]) for f in found]
    payload = pack(
        np.array([b for b, _ in asked], np.int64), np.array(size, np.int64), np.array([len(f[2]) for f in found], np.int64), small(count),
        small(joined([steps(place[a:b]) for a, b in cuts(size)])), small(joined([f[2] for f in found])), small(joined([f[3] for f in found])),
    )
    return table([("counts", 0, payload)], rows.column("part")[0].as_py())


def per_block(counts: list):
    """(block, its words' places, its words asked with an ending as places, the endings) of a word partition."""
    block, size, asked, _, place, word, ending = counts
    for b, (s, t), (u, v) in zip(block.tolist(), cuts(size), cuts(asked)):
        own = climb(place[s:t])
        yield b, own, own[climb(word[u:v])], ending[u:v].astype(np.int64)


def numbers(counts: DataFrame) -> DataFrame:
    """block, part and payload: the places and counts of a block's words, which make their ids."""

    def run(batches):
        for batch in batches:
            for part, payload in zip(*(batch.column(i).to_pylist() for i in (0, 3))):
                found = unpack(payload)
                for b, own, _, _ in per_block(found):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([part], pa.int32()), pa.array([pack(steps(own), found[3][own])], pa.binary())], names=["block", "part", "payload"])

    return counts.mapInArrow(run, "block long, part int, payload binary")


def summed(frame: DataFrame, kind: str) -> np.ndarray:
    """The sum of all payloads of a kind, each an array of equal length; zeros where there is none."""

    def run(batches):
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                x = unpack(payload)[0]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(x)), pa.int32()), pa.array(x, pa.int64())], names=["key", "n"])

    rows = frame.where(F.col("kind") == kind).select("payload").mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(2 * ENDINGS + 8)
    out[[r.key for r in rows]] = [r.n for r in rows]
    return out


def totals_of(counts: DataFrame) -> tuple[int, int]:
    """Training tokens, and distinct words among them."""

    def run(batches):
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                count = unpack(payload)[3]
                yield pa.RecordBatch.from_arrays([pa.array([int(count.sum())], pa.int64()), pa.array([int((count > 0).sum())], pa.int64())], names=["n", "v"])

    row = counts.select("payload").mapInArrow(run, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return row[0] or 0, row[1] or 0


# Pairs


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _ODD
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


class Asked:
    """A block's tokens with the ids and counts of its words, and its distinct pairs by pair partition."""

    def __init__(self, docs: bytes, got: list[tuple[int, list]], parts: int, split: int):
        self.ids, self.null, self.train, lengths, word, self.last, end = unpack(docs)
        self.lengths, self.word = lengths.astype(np.int64), word.astype(np.int64)
        self.id = joined([(p << 32) + climb(f[0]) for p, f in got])
        self.count = joined([f[1] for _, f in got])
        if len(self.id) != len(self.last):
            raise ValueError(f"{len(self.id)} words answered, {len(self.last)} asked")
        n = len(self.id)
        code = before(self.word, self.lengths, int(end[0])) * n + self.word
        pairs, self.pair = np.unique(code, return_inverse=True)
        self.n = np.bincount(self.pair[np.repeat(self.train, self.lengths)], minlength=len(pairs))
        self.u, self.w = pairs // n, pairs % n
        self.many = self.count > split
        own = np.where(self.many[self.u], mix(self.id[self.w]) % (1 + self.count[self.u] // split).astype(np.uint64), np.uint64(0))
        self.part = (mix(self.id[self.u] * 1_000_003 + own.astype(np.int64)) % np.uint64(parts)).astype(np.int64)

    def by_part(self):
        """(part, places of its pairs)."""
        order = np.argsort(self.part, kind="stable")
        found, first = np.unique(self.part[order], return_index=True)
        for p, a, b in zip(found.tolist(), first, [*first[1:], len(order)]):
            yield p, order[a:b]

    def requests(self):
        for p, at in self.by_part():
            u, first = np.unique(self.u[at], return_index=True)
            runs = np.diff(np.append(first, len(at)))
            yield p, pack(steps(self.id[u]), small(runs), self.last[u], self.many[u], small(self.id[self.w[at]]), small(self.n[at]))


def answers_of(rows: pa.Table, kind: str) -> list[tuple[int, list]]:
    found = zip(rows.column("part").to_pylist(), rows.column("kind").to_pylist(), rows.column("payload").to_pylist())
    return [(p, unpack(x)) for p, k, x in sorted(r for r in found if r[1] == kind)]


def ask_pairs(parts: int, split: int):
    def run(own: pa.Table, got: pa.Table) -> pa.Table:
        block = Asked(own.column("payload")[0].as_py(), [(p, unpack(x)) for p, x in sorted(zip(got.column("part").to_pylist(), got.column("payload").to_pylist()))], parts, split)
        source = own.column("block")[0].as_py()
        return table([(p, "asked", source, payload) for p, payload in block.requests()])

    return run


def by_home(ids: np.ndarray):
    """(word partition, from, to) of ascending ids."""
    found, first = np.unique(ids >> 32, return_index=True)
    return zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(ids)])


def merge_pairs(rows: pa.Table) -> pa.Table:
    """A pair partition's counts, its first seating (one table a pair), and what it has to tell the word partitions."""
    part = rows.column("part")[0].as_py()
    asked = held(rows)["asked"]
    runs = [f[1].astype(np.int64) for _, f in asked]
    ids = [climb(f[0]) for _, f in asked]
    u, u_place = np.unique(joined(ids), return_inverse=True)
    w, w_place = np.unique(joined([f[4] for _, f in asked]), return_inverse=True)
    ending, many = np.zeros(len(u), np.int64), np.zeros(len(u), bool)
    ending[u_place], many[u_place] = joined([f[2] for _, f in asked]), joined([f[3] for _, f in asked], bool)
    codes, place = np.unique(np.repeat(u_place, joined(runs)) * len(w) + w_place, return_inverse=True)
    n = np.bincount(place, joined([f[5] for _, f in asked]), len(codes)).astype(np.int64)
    sizes, u_sizes = [len(f[5]) for _, f in asked], [len(x) for x in ids]
    pairs = pack(
        np.array([b for b, _ in asked], np.int64), np.array(sizes, np.int64), np.array(u_sizes, np.int64), small(n),
        small(joined([steps(place[a:b]) for a, b in cuts(sizes)])), small(joined([steps(u_place[a:b]) for a, b in cuts(u_sizes)])),
    )
    # Dishes of the endings' restaurants, by word and ending.
    in_u, in_w = codes // len(w), codes % len(w)
    trained = n > 0
    dish, of = np.unique(in_w[trained] * ENDINGS + ending[in_u[trained]], return_inverse=True)
    once, more = n[trained] == 1, n[trained] > 1
    still, first = np.bincount(of[once], minlength=len(dish)), np.bincount(of[more], minlength=len(dish))
    rank = np.cumsum(first > 0) - 1
    mine = np.bincount(in_u[n == 1], minlength=len(u))
    mu = in_u[n > 1]
    out = [("pairs", 0, pairs), ("seats", 0, pack(steps(mu), small(rank[of[more]]), small(n[n > 1]), small(mine), many)), ("pair ones", 0, pack(np.array([(n == 1).sum(), (n == 2).sum()], np.int64)))]
    out = [(part, *r) for r in out]
    tables_now = mine + np.bincount(mu, minlength=len(u))
    told, said = {}, {}
    for q, a, b in by_home(w[dish // ENDINGS]):
        told[q] = [steps(w[dish[a:b] // ENDINGS] & 0xFFFFFFFF), small(dish[a:b] % ENDINGS), small(still[a:b]), first[a:b] > 0]
        said[q] = [small(first[a:b][first[a:b] > 0])]
    own = np.flatnonzero(many & (tables_now > 0))
    for q, a, b in by_home(u[own]):
        told.setdefault(q, [np.zeros(0, np.uint8)] * 3 + [np.zeros(0, bool)]).append(steps(u[own[a:b]] & 0xFFFFFFFF))
        said.setdefault(q, [np.zeros(0, np.uint8)]).append(small(tables_now[own[a:b]]))
    none = np.zeros(0, np.uint8)
    out += [(q, "told", part, pack(*x, *[none] * (5 - len(x)))) for q, x in told.items()]
    out += [(q, "said", part, pack(*x, *[none] * (2 - len(x)))) for q, x in said.items()]
    return table(out)


# Sweeps


def discount(ones: float, twos: float) -> float:
    return float(min(0.95, max(0.05, ones / (ones + 2 * twos)))) if ones + twos else 0.5


def open_words(rows: pa.Table) -> pa.Table:
    """A word partition's dishes: the union of what it has been told, and each teller's places in it."""
    part = rows.column("part")[0].as_py()
    got = held(rows)
    told, said = got["told"], dict(got["said"])
    keys = [climb(f[0]) * ENDINGS + f[1] for _, f in told]
    dish, place = np.unique(joined(keys), return_inverse=True)
    still = np.bincount(place, joined([f[2] for _, f in told]), len(dish)).astype(np.int64)
    drawn = joined([f[3] for _, f in told], bool)
    size = [int(f[3].sum()) for _, f in told]
    hot, hot_place = np.unique(joined([climb(f[4]) for _, f in told]), return_inverse=True)
    hot_size = [len(f[4]) for _, f in told]
    source = np.array([p for p, _ in told], np.int64)
    where = place[drawn]
    customers = still + np.bincount(where, joined([said[p][0] for p in source.tolist()]), len(dish)).astype(np.int64)
    per_word = np.unique(dish // ENDINGS, return_counts=True)[1]
    kept = pack(steps(dish), small(still), source, np.array(size, np.int64), small(joined([steps(where[a:b]) for a, b in cuts(size)])), small(hot), np.array(hot_size, np.int64), small(hot_place))
    ones = np.array([(customers == 1).sum(), (customers == 2).sum(), (per_word == 1).sum(), (per_word == 2).sum()], np.int64)
    return table([("words", 0, kept), ("word ones", 0, pack(ones)), ("totals", 0, pack(restaurant_totals(dish, customers, np.ones_like(dish), np.ones_like(per_word))))], part)


def restaurant_totals(dish, customers, tables, root_tables) -> np.ndarray:
    """Customers and tables of every ending's restaurant and of the root."""
    k = dish % ENDINGS
    return np.concatenate((np.bincount(k, customers, ENDINGS), np.bincount(k, tables, ENDINGS), [tables.sum(), root_tables.sum()])).astype(np.int64)


class Words:
    """The endings' and the root's share of one word partition."""

    def __init__(self, kept: list):
        dish, self.still, self.source, self.size, where, self.hot, self.hot_size, self.hot_place = kept
        self.dish = climb(dish)
        self.where = [climb(where[a:b]) for a, b in cuts(self.size)]
        self.word, self.of = np.unique(self.dish // ENDINGS, return_inverse=True)
        self.k = self.dish % ENDINGS

    def customers(self, said: dict) -> np.ndarray:
        n = self.still.astype(np.int64)
        for p, where in zip(self.source.tolist(), self.where):
            n[where] += said[p][0].astype(np.int64)
        return n

    def hot_tables(self, said: dict) -> np.ndarray:
        return np.bincount(self.hot_place.astype(np.int64), joined([said[p][1] for p in self.source.tolist()]), len(self.hot)).astype(np.int64)


def root_probability(customers, tables, fixed, totals) -> np.ndarray:
    d, (n, t) = fixed["root"], totals[2 * ENDINGS : 2 * ENDINGS + 2]
    return (customers - d * tables + (STRENGTH + d * t) / (fixed["v"] + 1)) / (STRENGTH + n)


def ending_probability(customers, tables, k, root, fixed, totals) -> np.ndarray:
    d = fixed["ending"]
    return (customers - d * tables + (STRENGTH + d * totals[ENDINGS + k]) * root) / (STRENGTH + totals[k])


def sweep_words(sweep: int, fixed: dict, totals: np.ndarray):
    """Seat the endings' restaurants and the root; reply to the pair partitions."""

    def run(rows: pa.Table) -> pa.Table:
        part, got = rows.column("part")[0].as_py(), held(rows)
        words, said, rng = Words(got["words"][0][1]), dict(got["said"]), np.random.default_rng([part, sweep, 0])
        n = words.customers(said)
        tables, root_tables = (x.astype(np.int64) for x in got["seated"][0][1][1:]) if "seated" in got else (np.ones(len(n), np.int64), np.ones(len(words.word), np.int64))
        root_n = np.bincount(words.of, tables, len(words.word)).astype(np.int64)
        root = root_probability(root_n, root_tables, fixed, totals)
        tables = draw_tables(n, root[words.of], np.maximum(0, totals[ENDINGS + words.k] - tables), fixed["ending"], STRENGTH, rng)
        root_n = np.bincount(words.of, tables, len(words.word)).astype(np.int64)
        even = np.full(len(root_n), 1 / (fixed["v"] + 1))
        root_tables = draw_tables(root_n, even, np.maximum(0, totals[2 * ENDINGS + 1] - root_tables), fixed["root"], STRENGTH, rng)
        root = root_probability(root_n, root_tables, fixed, totals)
        chance = ending_probability(n, tables, words.k, root[words.of], fixed, totals).astype(np.float32)
        hot = words.hot_tables(said)
        out = [(part, "seated", sweep, pack(small(n), small(tables), small(root_tables))), (part, "totals", 0, pack(restaurant_totals(words.dish, n, tables, root_tables)))]
        for p, where, (a, b) in zip(words.source.tolist(), words.where, cuts(words.hot_size)):
            out.append((p, "reply", part, pack(chance[where], small(hot[words.hot_place[a:b].astype(np.int64)]), small(words.hot[words.hot_place[a:b].astype(np.int64)]))))
        return table(out)

    return run


def sweep_pairs(sweep: int, fixed: dict):
    """Seat the previous words' restaurants; tell the word partitions."""

    def run(rows: pa.Table) -> pa.Table:
        part, got = rows.column("part")[0].as_py(), held(rows)
        if "reply" not in got:  # no training pair here
            return table([])
        mu, dish, n, mine, many = got["seats"][0][1]
        mu, dish, n, replies = climb(mu), dish.astype(np.int64), n.astype(np.int64), got["reply"]
        chance = joined([f[0] for _, f in replies], np.float64)
        t = got["tables"][0][1][0].astype(np.int64) if "tables" in got else np.ones(len(n), np.int64)
        rng = np.random.default_rng([part, sweep, 1])
        own = mine + np.bincount(mu, t, len(mine)).astype(np.int64)  # this partition's tables of each context
        hot = np.flatnonzero(many & (own > 0))
        elsewhere = np.zeros(len(own), np.int64)
        elsewhere[hot] = np.maximum(0, joined([f[1] for _, f in replies]) - own[hot])
        turn = rng.integers(0, GROUPS, len(n))
        for g in range(GROUPS):
            at = np.flatnonzero(turn == g)
            new = draw_tables(n[at], chance[dish[at]], np.maximum(0, (own + elsewhere)[mu[at]] - t[at]), fixed["pair"], STRENGTH, rng)
            own += np.bincount(mu[at], new - t[at], len(own)).astype(np.int64)
            t[at] = new
        opened = np.bincount(dish, t, len(chance)).astype(np.int64)
        out = [(part, "tables", sweep, pack(small(t)))]
        for (q, f), (a, b), (c, d) in zip(replies, cuts([len(f[0]) for _, f in replies]), cuts([len(f[1]) for _, f in replies])):
            out.append((q, "said", part, pack(small(opened[a:b]), small(own[hot[c:d]]))))
        return table(out)

    return run


# Answers


def answer_words(rows: pa.Table) -> pa.Table:
    part, got = rows.column("part")[0].as_py(), held(rows)
    counts = got["counts"][0][1]
    words = Words(got["words"][0][1]) if "words" in got else None
    seated = [[x.astype(np.int64) for x in f] for _, f in got.get("seated", [])]
    hot, out = [], []
    if words and len(words.hot):
        # A kept sweep's messages stand together: ``said`` of each sweep is numbered by sweep and source.
        by_sweep: dict[int, dict] = {}
        for source, f in got["said"]:
            by_sweep.setdefault(source >> 32, {})[source & 0xFFFFFFFF] = f
        hot = [words.hot_tables(by_sweep[s]) for s in sorted(by_sweep)]
    for b, own, asked, ending in per_block(counts):
        reply = [steps(own), counts[3][own]]
        if words:
            at = np.searchsorted(words.word, own)
            at[at == len(words.word)] = 0
            known = words.word[at] == own
            key = asked * ENDINGS + ending
            dish = np.searchsorted(words.dish, key)
            dish[dish == len(words.dish)] = 0
            found = words.dish[dish] == key
            here = np.flatnonzero(np.isin(own, words.hot))
            place = np.searchsorted(words.hot, own[here])
            reply.append(small(here))
            first = [None] * 5
            for i, (n, tables, root_tables) in enumerate(seated):
                root_n = np.bincount(words.of, tables, len(words.word)).astype(np.int64)
                own_hot = hot[i][place] if len(here) else np.zeros(0, np.int64)
                now = [np.where(known, root_n[at], 0), np.where(known, root_tables[at], 0), np.where(found, n[dish], 0), np.where(found, tables[dish], 0), own_hot]
                reply += [apart(x, y) for x, y in zip(now, first)]
                first = now if i == 0 else first
        reply += [steps(np.searchsorted(own, asked)), small(ending)]
        out.append((part, "words", b, pack(*reply)))
    return table(out)


def answer_pairs(rows: pa.Table) -> pa.Table:
    part, got = rows.column("part")[0].as_py(), held(rows)
    block, sizes, u_sizes, n, place, u_place = got["pairs"][0][1]
    mu, _, _, mine, _ = got["seats"][0][1]
    mu, n, tables, out = climb(mu), n.astype(np.int64), [], []
    for _, (t,) in got.get("tables", []):
        all_tables = np.minimum(n, 1)
        all_tables[n > 1] = t
        tables.append((all_tables, mine + np.bincount(mu, t, len(mine)).astype(np.int64)))
    for b, (s, t), (x, y) in zip(block.tolist(), cuts(sizes), cuts(u_sizes)):
        at, u_at = climb(place[s:t]), climb(u_place[x:y])
        now = [(all_tables[at], own[u_at]) for all_tables, own in tables]
        out.append((part, "pairs", b, pack(small(n[at]), *(apart(x, now[0][j] if i else None) for i, sample in enumerate(now) for j, x in enumerate(sample)))))
    return table(out)


def add_up(parts: int, split: int, fixed: dict, totals: list[np.ndarray], train_tokens: int):
    """Score a block's documents from the answers."""

    def run(own: pa.Table, got: pa.Table) -> pa.Table:
        words, samples = answers_of(got, "words"), len(totals)
        block = Asked(own.column("payload")[0].as_py(), words, parts, split)
        ending = block.last.astype(np.int64)[block.u]
        pairs = {p: [f[0], *(together(x, together(f[1 + i % 2], None) if i > 1 else None) for i, x in enumerate(f[1:]))] for p, f in answers_of(got, "pairs")}
        for _, f in words:
            if len(f) > 4:  # a sample's five arrays go by those of the first
                for s in range(samples):
                    for j in range(5):
                        f[3 + 5 * s + j] = together(f[3 + 5 * s + j], f[3 + j] if s else None)
        where = list(block.by_part())
        asked, k = [], []
        for (a, _), (_, f) in zip(cuts([len(f[0]) for _, f in words]), words):
            asked.append(a + climb(f[-2]))
            k.append(f[-1].astype(np.int64))
        key = joined(asked) * ENDINGS + joined(k)
        at = np.searchsorted(key, block.w * ENDINGS + ending)  # every (word, ending) of a pair was asked for
        n = np.zeros(len(block.u), np.int64)
        for p, place in where:
            n[place] = pairs[p][0]
        served, mean = block.count[block.u], np.zeros(len(block.u))
        for s in range(samples):
            def word_answers(j, size):
                return joined([f[3 + 5 * s + j] if len(f) > 4 else np.zeros(size(f), np.int64) for _, f in words])

            root = root_probability(word_answers(0, lambda f: len(f[0])), word_answers(1, lambda f: len(f[0])), fixed, totals[s])
            dish_n, dish_t = word_answers(2, lambda f: len(f[-1])), word_answers(3, lambda f: len(f[-1]))
            parent = ending_probability(dish_n[at], dish_t[at], ending, root[block.w], fixed, totals[s])
            hot = np.zeros(len(block.count), np.int64)
            for (a, _), (_, f) in zip(cuts([len(f[0]) for _, f in words]), words):
                if len(f) > 4:
                    hot[a + f[2].astype(np.int64)] = f[3 + 5 * s + 4]
            t, own_t = np.zeros(len(n), np.int64), hot[block.u]
            for p, place in where:
                if len(pairs[p]) > 1:
                    t[place] = pairs[p][1 + 2 * s]
                    u, of = np.unique(block.u[place], return_inverse=True)
                    alone = ~block.many[block.u[place]]
                    own_t[place[alone]] = pairs[p][2 + 2 * s].astype(np.int64)[of[alone]]
            d = fixed["pair"]
            mean += (n - d * t + (STRENGTH + d * own_t) * parent) / (STRENGTH + served)
        log = np.log10(mean / samples)[block.pair]
        seen = block.count[block.word]
        base = np.log10((seen + 0.1) / (train_tokens + 0.1 * (fixed["v"] + 1)))
        starts = np.cumsum(block.lengths) - block.lengths
        add = lambda x: np.add.reduceat(x, starts)
        score = add(log)
        return pa.table({
            "doc_id": pa.array(block.ids, mask=block.null), "held_out": ~block.train, "n_tokens": block.lengths, "n_known": add((seen > 0).astype(np.int64)),
            "train_tokens": np.full(len(block.ids), train_tokens, np.int64), "base_score": add(base), "score": score, "perplexity": 10 ** (-score / block.lengths),
        })

    return run


def score(docs: DataFrame, folds: int = FOLDS, sweeps: int = SWEEPS, burn_in: int = BURN_IN, part_bytes: int = PART_BYTES, block_tokens: int = BLOCK_TOKENS, split: int = SPLIT) -> DataFrame:
    """The op10 columns of every document, learned from the folds but the first."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), (fold_of(F.col("doc_id"), folds) != 0).alias("train"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, -(-size // part_bytes))

    def kept(frame: DataFrame, name: str) -> DataFrame:
        path = scratch_folder(spark, name)
        frame.write.partitionBy("kind").parquet(path)
        return spark.read.schema("part int, source long, payload binary, kind string").parquet(path).select("part", "kind", "source", "payload")

    def of(frame: DataFrame, *kinds: str) -> DataFrame:
        return frame.where(F.col("kind").isin(*kinds))

    def per_part(step, *frames: DataFrame) -> DataFrame:
        every = frames[0]
        for f in frames[1:]:
            every = every.unionByName(f)
        return every.groupBy("part").applyInArrow(step, ROWS)

    path = scratch_folder(spark, "token-blocks")
    blocks(rows, parts, block_tokens).withColumn("documents", F.col("part") < 0).write.partitionBy("documents").parquet(path)
    made = spark.read.schema("block long, part int, payload binary, documents boolean").parquet(path)
    texts = made.where("documents").select("block", "payload")
    counts = written(made.where("not documents").select("block", "part", "payload").groupBy("part").applyInArrow(count_words, ROWS), "word-counts")
    train_tokens, v = totals_of(counts)
    asked = texts.groupBy("block").cogroup(numbers(counts).groupBy("block")).applyInArrow(ask_pairs(parts, split), ROWS)
    pairs = kept(asked.groupBy("part").applyInArrow(merge_pairs, ROWS), "pairs")
    words = kept(per_part(open_words, of(pairs, "told", "said")), "words")
    ones, more = summed(pairs, "pair ones"), summed(words, "word ones")
    fixed = {"v": v, "pair": discount(*ones[:2]), "ending": discount(*more[:2]), "root": discount(*more[2:4])}
    totals = summed(words, "totals")
    said, seated, tables, samples, last_said = of(pairs, "said"), None, None, [], []
    for s in range(sweeps):
        before_ = [seated] if seated is not None else []
        now = kept(per_part(sweep_words(s, fixed, totals), of(words, "words"), said, *before_), "word-seats")
        seated, totals = of(now, "seated"), summed(now, "totals")
        before_ = [tables] if tables is not None else []
        then = kept(per_part(sweep_pairs(s, fixed), of(pairs, "seats"), of(now, "reply"), *before_), "pair-seats")
        tables, said = of(then, "tables"), of(then, "said")
        if s >= burn_in:
            samples.append((seated, tables, totals))
            last_said.append(said.withColumn("source", F.col("source") + F.lit(s << 32)))
    replies = per_part(answer_words, counts, of(words, "words"), *(x for x, _, _ in samples), *last_said)
    replies = replies.unionByName(per_part(answer_pairs, of(pairs, "pairs", "seats"), *(x for _, x, _ in samples)))
    final = add_up(parts, split, fixed, [x for _, _, x in samples], train_tokens)
    return texts.groupBy("block").cogroup(replies.select(F.col("source").alias("block"), "part", "kind", "payload").groupBy("block")).applyInArrow(final, SCORES)


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
