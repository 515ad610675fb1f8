"""Packing documents into training sequences by minimum bin slack (operator 6).

A document is its token ids and an end id. Documents of at least a window are cut into full windows; what remains of
each is packed with others so that the window's slack is smallest. A window takes the longest remaining piece, and a
subset-sum dynamic program over a bitset of reachable fills picks the multiset of remaining lengths that comes nearest
to its capacity. The program is backtracked to a count for every length, and the same pattern is used for as many
windows as those counts allow.

Only a pool of remainders is held at a time, so memory is bounded for any partition size. There is no shuffle: each
partition packs its own rows, and a sequence id holds the partition's number. The price is one window a partition that
may be part empty.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as often as they occur; an empty
table gives no rows; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_encoder import encoder, forget
from .shared import give_back, pieces, read_table

WINDOW = 2048
END_ID = 1
POOL = 16_384
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of ``counts`` (length to number) with the largest sum up to ``capacity``."""
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], capacity // length) if length <= capacity else 0, 1
        while left > 0 and not reach >> capacity & 1:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> capacity & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def patterns(counts: dict[int, int], capacity: int, leave: int = 0):
    """(pattern, times) pairs that use up ``counts``, which is changed; stops when at most ``leave`` pieces remain."""
    total = sum(counts.values())
    while total > leave:
        longest = max(counts)
        counts[longest] -= 1
        if not counts[longest]:
            del counts[longest]
        pattern = best_fill(counts, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        counts[longest] = counts.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        total -= times * sum(pattern.values())
        yield pattern, times


class _Packer:
    def __init__(self, window: int, first_id: int):
        self.window, self.next_id, self.pool, self.held = window, first_id, {}, 0

    def add(self, doc_id, ids) -> list[tuple]:
        """Rows of the full windows of a document, whose ids are given as bytes; its rest goes to the pool."""
        n, out = len(ids) // 4, []
        for start in range(0, n, self.window):
            part = ids[4 * start : 4 * (start + self.window)]
            piece = (doc_id, start, len(part) // 4, zlib.crc32(part), n)
            if piece[2] == self.window:
                out.append((*piece, self.next_id, 0))
                self.next_id += 1
            else:
                self.pool.setdefault(piece[2], []).append(piece)
                self.held += 1
        return out

    def flush(self, leave: int) -> list[tuple]:
        out = []
        for pattern, times in patterns({n: len(p) for n, p in self.pool.items()}, self.window, leave):
            for _ in range(times):
                offset = 0
                for n, k in sorted(pattern.items(), reverse=True):
                    for _ in range(k):
                        out.append((*self.pool[n].pop(), self.next_id, offset))
                        offset += n
                        self.held -= 1
                self.next_id += 1
        self.pool = {n: p for n, p in self.pool.items() if p}
        return out


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, pool: int = POOL) -> DataFrame:
    """Pieces of all documents with their place in a sequence; see the module's text."""

    def run(batches):
        from pyspark import TaskContext

        packer = _Packer(window, TaskContext.get().partitionId() << 33)
        schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=schema)

        encode = encoder(vocabulary, True).encode
        try:
            for batch in pieces(batches, lambda batch: batch.column(1)):
                rows = []
                ids, bounds = encode(batch.column(1), end_id)
                ids, ends = memoryview(ids.astype("<u4", copy=False).tobytes()), (4 * bounds).tolist()
                for key, start, stop in zip(batch.column(0).to_pylist(), ends, ends[1:]):
                    rows += packer.add(key, ids[start:stop])
                del batch, ids
                if packer.held > pool:
                    rows += packer.flush(pool // 4)
                if rows:
                    yield table(rows)
            if rows := packer.flush(0):
                yield table(rows)
        finally:
            forget(vocabulary, True)
            give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
