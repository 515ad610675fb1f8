"""Packing, token files and byte-level BPE against the libraries, and an exact round trip."""

import base64
import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers as P
from tidelane.llm import byte_bpe, packing, token_files
from tidelane.llm.chunk_encoder import ChunkEncoder

ODD = ["", " ", "  a", "a  b", "it's we'll they've 're x'", "''s 's'' ' s", "a\n\n b\t\tc  ", "x y  z", "é ê̂ ", "1 2²½ 3", "日本 語", "<|endoftext|> a", "!\x1c!\x1cb", " 's", "don't've'll", "\r\n\r\n", "a" * 300 + "!" * 150, "Σας ΣΑΣ", "<|startoftext|>Hi", "\x00\x00 a"]


def encoded(coder: ChunkEncoder, texts: list, end_id: int = 1) -> list[list[int]]:
    ids, bounds = coder.encode(pa.array(texts, pa.string()), end_id)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def random_texts(n=400):
    rng = random.Random(5)
    alphabet = "abstmdrvel'' \n\t1²é!?$.  日ß\x1c\x85"
    plain = [" ".join(rng.choice("The the J̌ab ǰ Straße, ÉTÉ. end. a,b word 漢字 Ǆ K ª ⅷ".split()) for _ in range(30)) for _ in range(40)]
    return ODD + plain + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t, "x") for i, t in enumerate(random_texts())] + [(9000, None, "x"), (9001, "word " * 5000, "y"), (9001, "word " * 5000, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_library_ids(name, spaces):
    own = ChunkEncoder(P.path(name), spaces)
    texts = random_texts()
    want = [e.ids + [1] for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoded(own, texts) == want == encoded(own, texts)
    few = ["b" * 300 + " a", None, "a\u00a0  b\u3000\u2003c", "LaİX. שׁ.", "", "\n\n\nab\n\ncd,\nef!!", None]
    assert encoded(own, few) == [own.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in few]
    assert encoded(own, []) == [] and encoded(own, [None, ""]) == [[1], [1]]
    part = pa.array(["x y", *few, "z"]).slice(1, len(few))
    assert own.encode(part, 7)[0].tolist() == own.encode(pa.array(few), 7)[0].tolist()


@lru_cache
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache
def rows_of(frame):
    return frame.collect()


def test_byte_bpe_is_tiktoken():
    lib, own, texts = tiktoken_encoding(), byte_bpe.coder(P.path("byte_bpe_50k.tiktoken")), random_texts(3000)
    found = own.encode_with_offsets(texts)
    for text, (ids, offsets) in zip(texts, found):
        flat = b"".join(ids)
        assert np.frombuffer(flat, "<u4").tolist() == lib.encode_ordinary(text), repr(text)
        assert own.decode(flat) == text.encode()
        bounds = [*offsets.tolist(), len(text)]
        assert [own.decode(x).decode() for x in ids] == [text[a:b] for a, b in zip(bounds, bounds[1:])]


def test_long_pieces_merge_like_short_ones():
    own, rng = byte_bpe.coder(P.path("byte_bpe_50k.tiktoken")), random.Random(1)
    for _ in range(200):
        piece = "".join(rng.choice("abcdest  ingo!") for _ in range(rng.randrange(2, 90))).encode()
        assert piece in own.ranks or byte_bpe._merge_long(piece, own.ranks) == byte_bpe.merge(piece, own.ranks)


def test_round_trip_query(frame):
    got = byte_bpe.round_trip_digests(frame, P.path("byte_bpe_50k.tiktoken")).collect()
    texts = {r.doc_id: r.text or "" for r in frame.collect()}
    assert len(got) == frame.count()
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
    lib = tiktoken_encoding()
    for r in got:
        ids = lib.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_encoded_documents_keep_their_pieces(frame):
    lib = tiktoken_encoding()
    for r, text in ((r, t) for r in byte_bpe.encode_documents(frame, P.path("byte_bpe_50k.tiktoken")).collect() for t in [next((x.text for x in rows_of(frame) if x.doc_id == r.doc_id), None) or ""]):
        assert r.ids == lib.encode_ordinary(text) and sum(r.piece_ids) == len(r.ids)
        bounds, at = [*r.piece_offsets, len(text)], 0
        for a, b, n in zip(bounds, bounds[1:], r.piece_ids):
            assert lib.decode(r.ids[at : at + n]) == text[a:b]
            at += n


def test_best_fill_is_the_best():
    rng = random.Random(3)
    for _ in range(200):
        items = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))]
        counts = {x: items.count(x) for x in items}
        capacity = rng.randrange(1, 90)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        chosen = packing.best_fill(counts, capacity)
        assert all(k <= counts[n] for n, k in chosen.items())
        assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= capacity)


def fewest(items, capacity):
    """Bins of the best packing, by trying every bin for every item."""
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity:
                place(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


def test_windows_are_about_as_few_as_can_be():
    rng, more = random.Random(4), 0
    for _ in range(150):
        items, capacity = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))], rng.randrange(30, 60)
        used, pieces = 0, []
        for pattern, times in packing.patterns({x: items.count(x) for x in items}, capacity):
            used += times
            pieces += [n for n, k in pattern.items() for _ in range(k * times)]
            assert sum(n * k for n, k in pattern.items()) <= capacity
        assert sorted(pieces) == sorted(items) and used <= fewest(items, capacity) + 1
        more += used > fewest(items, capacity)
    assert more <= 3


def test_little_padding_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(2)
    got = packing.pack(docs, P.path("byte_bpe_50k.json")).toPandas()
    assert got.sequence_id.nunique() <= 1.01 * got.length.sum() / packing.WINDOW + 2


def test_packing_is_whole(frame):
    got = packing.pack(frame, P.path("byte_bpe_50k.json"), pool=50).toPandas()
    coder = ChunkEncoder(P.path("byte_bpe_50k.json"), True)
    want = {r.doc_id: np.array(encoded(coder, [r.text])[0], "<u4") for r in frame.collect()}
    assert set(got.doc_id) == set(want)
    for (doc, start, length), n in got.groupby(["doc_id", "start", "length"]).size().items():
        assert n == (2 if doc == 9001 else 1)
        part = got[(got.doc_id == doc) & (got.start == start)].iloc[0]
        assert part.ids_crc32 == zlib.crc32(want[doc][start : start + length].tobytes()) and part.doc_tokens == len(want[doc])
    assert got.groupby("doc_id").length.sum().to_dict() == {d: len(x) * (2 if d == 9001 else 1) for d, x in want.items()}
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum()[:-1]] and seq.length.sum() <= 2048


def test_token_files(spark, frame, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_token_files(frame, P.path("word_bpe_49k.json"), path)
    got = token_files.ids_crc32(token_files.read_token_files(spark, path)).toPandas().sort_values(["doc_id", "start"])
    coder, at = ChunkEncoder(P.path("word_bpe_49k.json"), False), 0
    rows = sorted(frame.collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(got)
    for want, row in zip(rows, got.itertuples()):
        ids = np.array(encoded(coder, [want.text])[0], "<u4").tobytes()
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (want.doc_id, at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, P.path("byte_bpe_50k.json")).count() == 0
    assert byte_bpe.round_trip_digests(none, P.path("byte_bpe_50k.tiktoken")).count() == 0
    token_files.write_token_files(none, P.path("word_bpe_49k.json"), str(tmp_path / "none"))
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_ascii_words_are_learnt_by_arrays(monkeypatch):
    """Chunks of an ASCII word and marks are not split one by one; ids are the library's."""
    import re

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tidelane.llm.chunk_encoder import ChunkEncoder

    texts = ["The tide, at noon... (Rises) to 3.5m!", "Don't stop\n\nnaïve café; end-of_line\n", "A\nB  c,", ""]
    for name, spaces in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        path, split = public_tokenizers.path(name), []
        one = ChunkEncoder(path, spaces)
        parts = one._parts
        monkeypatch.setattr(one, "_parts", lambda c: split.append(c) or parts(c))  # noqa: B023
        ids, bounds = one.encode(pa.array(texts), 1)
        library = Tokenizer.from_file(path)
        want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
        assert split and not any(re.fullmatch((" " if spaces else "") + "[A-Za-z]+[,.!;]*", c) for c in split)


def test_a_worker_keeps_no_chunks_behind_its_packing(frame):
    path = P.path("byte_bpe_50k.json")
    assert packing.pack(frame, path).count() > 400

    def held(batches):
        from tidelane.llm import chunk_encoder

        list(batches)
        own = chunk_encoder._encoders.get((path, True))
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(own.rows)] if own else [], pa.int64())})

    found = [r.n for r in frame.sparkSession.range(16, numPartitions=16).mapInArrow(held, "n long").collect()]
    assert found and set(found) == {1}  # the empty chunk alone
