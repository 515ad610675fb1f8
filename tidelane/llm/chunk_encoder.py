"""Encoding with the tokenizers library, one library call per distinct white-space chunk.

Both vocabularies split texts so that no piece crosses from a non-space to a space character. A text's ids are
therefore the concatenation of the ids of its chunks (a run of white space and the word behind it), and chunks repeat
far more often than texts. Chunks are cut from the bytes of a whole slice of texts at once and dictionary encoded by
Arrow; each distinct one is looked up once in a bounded cache of this Python worker, and the ids are gathered by array.

New chunks go to the library. Words of letters alone go many to a call, and are told apart again by the vocabulary's own
marks of words; ASCII ones use the library's tokenizer without its normaliser and split rule, which change nothing there.
"""

from __future__ import annotations

import os
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_CACHED = 400_000
LONGEST_CACHED = 256
JOINED_WORDS = 1_000
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # marks behind a word are one piece (an apostrophe may begin another)

# Unicode White_Space, as the tokenizers' own patterns see it, in UTF-8 (fixed values).
BLANKS = (*range(0x09, 0x0E), 0x20)
LONG_BLANKS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_LEAD = np.zeros(256, bool)
_LEAD[[b[0] for b in LONG_BLANKS]] = True
_LONG = {size: np.array([int.from_bytes(b, "big") for b in LONG_BLANKS if len(b) == size]) for size in (2, 3)}

_encoders: dict[tuple[str, bool], "ChunkEncoder"] = {}


def blank_bytes(data: np.ndarray) -> np.ndarray:
    """True for the bytes of white-space characters in UTF-8 ``data``."""
    blank = _BLANK[data]
    lead = np.flatnonzero(_LEAD[data])
    for size, codes in _LONG.items():
        at = lead[(data[lead] >= 0xE0) == (size == 3)]
        code = np.zeros(len(at), np.int64)
        for i in range(size):
            code = code << 8 | data[at + i]
        at = at[np.isin(code, codes)]
        for i in range(size):
            blank[at + i] = True
    return blank


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string array, and len + 1 bounds of the texts in them; a null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


class ChunkEncoder:
    """Ids of whole texts. ``spaces``: white space is part of the vocabulary."""

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.spaces, self.tokenizer = spaces, Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # One vocabulary in memory: its normaliser and split rule give way to these while ASCII words are encoded.
        self.rules, self.plain_rules = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer), (None, pre_tokenizers.WhitespaceSplit())
        vocabulary = self.tokenizer.get_vocab()
        # A token with the mark of a space begins a word, or one with the mark of an end closes it.
        self.marks = np.zeros(max(vocabulary.values()) + 1, bool)
        self.marks[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if spaces else t.endswith("</w>"))]] = True
        # A chunk of an ASCII word (behind one space, with ``spaces``) and marks behind it.
        self.plain_chunk = ("^(?P<body> " if spaces else "^(?P<body>") + r"[A-Za-z]+)(?P<tail>[!-/:-@\[-`{-~]*)\z"
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {"": 0}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 1

    # The store: row r has ids[start[r] : start[r] + size[r]].

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Add rows; returns the first one's number."""
        first, n, m = self.count, len(sizes), len(ids)
        while self.used + m > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while first + n > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.ids[self.used : self.used + m] = ids
        self.size[first : first + n] = sizes
        self.start[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.used, self.count = self.used + m, first + n
        return first

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids one behind the other, and the rows' sizes."""
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.start[rows] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.ids[at], sizes

    # New chunks.

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes

    def _words(self, words: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters alone (each behind a space, with ``spaces``), many to a library call."""
        if plain:
            joint, made = " ", ["Ġ" + w[1:] for w in words] if self.spaces else words
        else:
            joint, made = "" if self.spaces else " ", words
        bounds = range(0, len(words), JOINED_WORDS)
        ids, sizes = [], []
        try:
            if plain:
                self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.plain_rules
            encoded = self.tokenizer.encode_batch_fast([joint.join(made[a : a + JOINED_WORDS]) for a in bounds], add_special_tokens=False)
        finally:
            if plain:
                self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.rules
        for a, found in zip(bounds, encoded):
            got = np.asarray(found.ids, np.uint32)
            cuts = np.flatnonzero(self.marks[got])
            cuts = np.append(cuts, len(got)) if self.spaces else np.append(0, cuts + 1)
            n = np.diff(cuts)
            if len(n) != len(made[a : a + JOINED_WORDS]) or cuts[0]:  # a letter that the library does not know as one
                got, n = self._library(words[a : a + JOINED_WORDS])
            ids.append(got)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def _parts(self, chunk: str) -> tuple[str, str, str] | None:
        """Line breaks, a word of letters and the marks behind it, which are pieces of their own; None for other chunks."""
        body = chunk.rstrip(TAIL)
        tail, lead = chunk[len(body) :], ""
        if not self.spaces:
            if body.isascii():
                return ("", body.lower(), tail) if body.isalpha() else None
            return ("", body, tail) if normalize("NFC", body.lower()).isalpha() else None  # no mark becomes loose at its end
        if body[:1] == " ":
            word = body[1:]
        else:
            word = body.lstrip("\n")
            lead, body = body[: len(body) - len(word)], word
        return (lead, body, tail) if word.isalpha() and len(lead) < 3 else None

    def _learn_plain(self, chunks: list[str]) -> list[str]:
        """Put chunks of an ASCII word and marks behind it into the store, by arrays; returns the other chunks."""
        known = self.rows
        parts = pc.extract_regex(pa.array(chunks, pa.large_string()), self.plain_chunk)
        at = np.flatnonzero(pc.is_valid(parts).to_numpy(zero_copy_only=False))
        if not len(at):
            return chunks
        parts = parts.take(pa.array(at))
        body, tail = parts.field(0), parts.field(1)
        columns = []
        for column, encode in ((body if self.spaces else pc.ascii_lower(body), lambda x: self._words(x, True)), (tail, self._library)):
            coded = column.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            new = [x for x in distinct if x not in known]
            if new:
                first = self._append(*encode(new))
                known.update(zip(new, range(first, first + len(new))))
            columns.append(np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()])
        made = np.flatnonzero(np.fromiter((chunks[i] not in known for i in at.tolist()), bool, len(at)))
        if len(made):
            ids, sizes = self._gather(np.stack([c[made] for c in columns], 1).ravel())
            first = self._append(ids, sizes.reshape(-1, 2).sum(1))
            known.update(zip([chunks[i] for i in at[made].tolist()], range(first, first + len(made))))
        other = np.ones(len(chunks), bool)
        other[at] = False
        return [chunks[i] for i in np.flatnonzero(other).tolist()]

    def _learn(self, chunks: list[str]) -> None:
        """Put the ids of chunks into the store and their rows into ``rows``."""
        chunks = self._learn_plain(chunks)
        known, split = self.rows, list(map(self._parts, chunks))
        ascii_words, words, whole = {}, {}, {c: None for c, p in zip(chunks, split) if p is None}
        for p in split:
            if p:
                lead, body, tail = p
                if body not in known:
                    joined = not self.spaces or body[0] == " "
                    (whole if not joined else ascii_words if body.isascii() else words)[body] = None
                for x in (lead[:1], tail):
                    if x not in known:
                        whole[x] = None
        for new, encode in ((ascii_words, lambda x: self._words(x, True)), (words, lambda x: self._words(x, False)), (whole, self._library)):
            if new:
                first = self._append(*encode(list(new)))
                known.update(zip(new, range(first, first + len(new))))
        made = [(c, p) for c, p in zip(chunks, split) if p and c not in known]
        if made:
            rows = np.array([[known[lead[:1]], known[lead[1:]], known[body], known[tail]] for _, (lead, body, tail) in made])
            ids, sizes = self._gather(rows.ravel())
            first = self._append(ids, sizes.reshape(-1, 4).sum(1))
            known.update(zip([c for c, _ in made], range(first, first + len(made))))

    # Texts.

    def _chunks(self, data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """All chunks, and the bounds of each text in them."""
        blank = blank_bytes(data)
        begins = np.zeros(len(data) + 1, bool)
        begins[bounds] = True  # the end of all too, which is cut off below
        begins = begins[:-1]
        after = np.concatenate(([False], blank[:-1])) if len(data) else blank
        if self.spaces:
            begins |= blank & ~after
            starts = np.flatnonzero(begins)
            places = np.append(starts, len(data))
        else:
            starts = np.flatnonzero(~blank & (begins | after))
            solid = np.cumsum(~blank)
            places = np.append(solid[starts] - 1, solid[-1] if len(solid) else 0)
            data = data[~blank]
        text = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        return text, np.searchsorted(starts, bounds)

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string array, ``end_id`` behind each, and len + 1 bounds of the texts in them."""
        if self.count > MAX_CACHED:
            self._clear()
        chunks, at = self._chunks(*utf8(column))
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.rows.get, distinct))
        new = [c for c, r in zip(distinct, found) if r is None]
        short = [c for c in new if len(c) <= LONGEST_CACHED]
        if short:
            self._learn(short)
        kept = self.count, self.used
        if len(short) < len(new):
            self._learn([c for c in new if len(c) > LONGEST_CACHED])
        rows = np.array([self.rows[c] if r is None else r for c, r in zip(distinct, found)], np.int64)
        end = self._append(np.array([end_id], np.uint32), np.ones(1, np.int64))
        rows = np.insert(rows[coded.indices.to_numpy()], at[1:], end)
        ids, sizes = self._gather(rows)
        bounds = np.concatenate(([0], np.cumsum(sizes)))[at + np.arange(len(at))]
        if len(short) < len(new):
            self.rows = {c: r for c, r in self.rows.items() if r < kept[0]}
        self.count, self.used = kept
        return ids, bounds


def encoder(path: str, spaces: bool) -> ChunkEncoder:
    """This worker's encoder for a vocabulary file."""
    if (path, spaces) not in _encoders:
        _encoders[path, spaces] = ChunkEncoder(path, spaces)
    return _encoders[path, spaces]


def forget(path: str, spaces: bool) -> None:
    """The end of a task: its chunks go, so that a worker that waits or serves another stage does not hold them; the loaded
    vocabulary stays."""
    if (path, spaces) in _encoders:
        _encoders[path, spaces]._clear()


def slices(texts, size: int = 4_000_000):
    """Index ranges of a list or string array of at most ``size`` characters (bytes of an array) each, a longer text alone,
    which bounds what is in memory at once."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist() if isinstance(texts, pa.Array) else [len(t) if t else 0 for t in texts]
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
