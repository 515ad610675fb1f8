"""Byte-level BPE encoding and decoding with a vectorised pre-tokeniser (operator 8).

Pre-tokenisation uses no regular expression. Every code point maps to a class (letter, number, white space, ...), and
each class is a transition function on the states of a small automaton that reads the split rule from left to right.
Composition of such functions is associative, so the state before every character comes from a scan: all functions
that can arise form a small monoid, elements are numbered, and a table composes two of them. The scan runs over blocks
of characters side by side, then over the blocks' totals, and the states and classes give the piece boundaries.

The pieces feed pair merging by rank, behind a bounded cache. Their offsets come with the ids, so a decoder can return
the bytes and the character place of every token's piece.

Defined cases: a null text is empty and has no ids; repeated rows, ties and extra columns have no effect on one
another; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_encoder import slices
from .shared import read_table

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: White space of the split rule (fixed values).
SPACES = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SEPARATOR = "\ud800"  # a lone surrogate, which no text can hold
MAX_CACHED, LONGEST_CACHED = 800_000, 128

# States: inside letters, numbers, other characters; behind a space that joins the next piece; inside white space;
# one or two letters of a contraction to come; at a place where a piece must begin.
LETTERS, NUMBERS, OTHERS, JOINED, BLANK, SHORT1, SHORT2, FRESH = range(8)
# Classes. An apostrophe that a contraction of one or two letters follows is a class of its own, and so is white space
# by what follows it.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, INNER, LAST_SPACE, LAST_BLANK, BREAK = range(9)


def step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a piece begins at the character read."""
    if kind == BREAK:
        return FRESH, True
    if kind == INNER:
        return BLANK, state != BLANK
    if kind == LAST_SPACE:
        return JOINED, True
    if kind == LAST_BLANK:
        return FRESH, True
    if kind == LETTER:
        if state == SHORT2:
            return SHORT1, False
        if state == SHORT1:
            return FRESH, False
        return LETTERS, state not in (LETTERS, JOINED)
    if kind == NUMBER:
        return NUMBERS, state not in (NUMBERS, JOINED)
    if state in (OTHERS, JOINED):
        return OTHERS, False
    return {OTHER: OTHERS, QUOTE1: SHORT1, QUOTE2: SHORT2}[kind], True


class Scanner:
    """Class table, monoid of transition functions and boundary table of the split rule."""

    BLOCK = 64

    def __init__(self):
        self.kinds = np.full(0x110000, OTHER, np.uint8)
        for i in range(0x110000):
            c = unicodedata.category(chr(i))[0]
            if c in "LN":
                self.kinds[i] = LETTER if c == "L" else NUMBER
        self.kinds[list(SPACES)] = INNER
        self.kinds[ord(SEPARATOR)] = BREAK
        maps = [tuple(step(s, k)[0] for s in range(8)) for k in range(9)]
        number = {tuple(range(8)): 0}
        for m in maps:
            number.setdefault(m, len(number))
        known = list(number)
        for m in known:  # closure: the list grows while it is walked
            for g in maps:
                both = tuple(g[x] for x in m)
                if both not in number:
                    number[both] = len(number)
                    known.append(both)
        size = len(known)
        self.function = np.array([number[m] for m in maps], np.int32)
        self.compose = np.array([[number[tuple(b[x] for x in a)] for b in known] for a in known], np.int32)
        self.size, self.after = size, np.array([m[FRESH] for m in known], np.uint8)
        self.begins = np.array([[step(s, k)[1] for k in range(9)] for s in range(8)])

    def prefix(self, f: np.ndarray) -> np.ndarray:
        """Composition of all functions up to and with each place."""
        n = len(f)
        if n <= self.BLOCK:
            out, acc = np.empty(n, np.int32), 0
            for i, x in enumerate(f.tolist()):
                acc = int(self.compose[acc, x])
                out[i] = acc
            return out
        rows = -(-n // self.BLOCK)
        grid = np.zeros(rows * self.BLOCK, np.int32)
        grid[:n] = f
        grid = np.ascontiguousarray(grid.reshape(rows, self.BLOCK).T)
        flat = self.compose.ravel()
        for j in range(1, self.BLOCK):
            np.take(flat, grid[j - 1] * self.size + grid[j], out=grid[j])
        carried = np.concatenate(([0], self.prefix(grid[-1])[:-1])).astype(np.int32)
        return np.take(flat, carried * self.size + grid).T.ravel()[:n]

    def classes(self, code: np.ndarray) -> np.ndarray:
        kind = self.kinds[code]
        blank = kind == INNER
        follows = np.ones(len(kind), bool)  # white space, a break or the end follows
        follows[:-1] = (blank | (kind == BREAK))[1:]
        last = blank & ~follows
        kind[last] = LAST_BLANK
        kind[last & (code == 32)] = LAST_SPACE
        at = np.flatnonzero(code == 39)
        behind = np.append(code, [0, 0])
        a, b = behind[at + 1], behind[at + 2]
        kind[at[(a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))]] = QUOTE1
        kind[at[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = QUOTE2
        return kind

    def starts(self, text: str) -> np.ndarray:
        """Places in ``text`` at which pieces begin; separators are pieces of their own."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(code):
            return np.zeros(0, np.int64)
        kind = self.classes(code)
        state = self.after[self.prefix(self.function[kind])]
        before = np.concatenate(([FRESH], state[:-1]))
        return np.flatnonzero(self.begins[before, kind])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank merges first, leftmost among equals."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > 100:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + 1
    get = ranks.get
    pair = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pair and (low := min(pair)) < none:
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over a linked list, in n log n steps."""
    n = len(piece)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := prev[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ByteBpe:
    """Encoder and decoder over the ranks of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.scanner, self.cache = Scanner(), {}

    def pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """All texts' pieces in one list; the bounds of each text in that list; each piece's place in its text."""
        joined = SEPARATOR.join(texts)
        starts = self.scanner.starts(joined)
        at = starts.tolist()
        found = [joined[a:b] for a, b in zip(at, [*at[1:], len(joined)])]
        ends = np.cumsum([len(t) + 1 for t in texts])
        firsts = ends - np.asarray([len(t) + 1 for t in texts])
        bounds = np.stack([np.searchsorted(starts, firsts), np.searchsorted(starts, ends - 1)], 1)
        return found, bounds, starts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        return [b"".join(x) for x, _ in self.encode_with_offsets(texts)]

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[list[bytes], np.ndarray]]:
        """For every text its pieces' ids and the places of the pieces in the text."""
        if len(self.cache) > MAX_CACHED:
            self.cache = {}
        found, bounds, starts = self.pieces(texts)
        known, rare = self.cache, {}
        for piece in {p for p in found if p not in known}:
            if piece != SEPARATOR:
                ids = np.asarray(merge(piece.encode(), self.ranks), "<u4").tobytes()
                (known if len(piece) <= LONGEST_CACHED else rare)[piece] = ids
        look = known.__getitem__ if not rare else lambda p: known[p] if p in known else rare[p]
        out, first = [], 0
        for text, (a, b) in zip(texts, bounds.tolist()):
            out.append((list(map(look, found[a:b])), starts[a:b] - first))
            first += len(text) + 1
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    """This worker's coder for a vocabulary file."""
    if path not in _coders:
        _coders[path] = ByteBpe(path)
    return _coders[path]


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (array of int) with the character offset of each piece and the number of ids of each piece."""

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, 1_000_000):
                found = coder(vocabulary).encode_with_offsets(texts[a:b])
                ids = pa.array([np.frombuffer(b"".join(x), "<i4") for x, _ in found], pa.list_(pa.int32()))
                offsets = pa.array([o for _, o in found], pa.list_(pa.int32()))
                sizes = pa.array([[len(p) // 4 for p in x] for x, _ in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), ids, offsets, sizes], names=["doc_id", "ids", "piece_offsets", "piece_ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, piece_offsets array<int>, piece_ids array<int>")


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode every text; number of ids and digests of ids and decoded bytes."""

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, 1_000_000):
                code = coder(vocabulary)
                found = code.encode(texts[a:b])
                columns = [
                    keys.slice(a, b - a),
                    pa.array([len(x) // 4 for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(code.decode(x)).hexdigest() for x in found]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
