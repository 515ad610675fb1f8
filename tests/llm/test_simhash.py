import itertools
import random
import time

import numpy as np
import pytest
import xxhash

from tidelane.llm import simhash
from tidelane.llm.components import connected_components


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(1)
    for text in [None, "", " \n", "One", "one Two", "a b c", "É\x0bb\x0cC d É", *(" ".join(rng.choice("ab cd Ef É".split()) for _ in range(n)) for n in range(60))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def brute(fps, radius=3):
    label = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius and label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("shard,most", [(40, 8), (40, 1), (10_000, 4)])
def test_links_are_those_of_brute_force(spark, shard, most):
    rng = random.Random(7)
    fps = {0}
    while len(fps) < 500:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 9, 40])):
            fps.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
    fps = sorted(fps)
    rng.shuffle(fps)
    want = brute(fps)
    rows = [int(np.uint64(f).astype(np.int64)) for f in fps]
    found = connected_components(simhash.stars(spark.createDataFrame([(x,) for x in rows], "fp long"), 3, shard, most))
    got = {r.node: r.component for r in found.collect()}
    label = [got.get(x, x) for x in rows]
    assert [label.index(x) for x in label] == [want.index(x) for x in want]


def test_shards_of_ten_million_fingerprints_stay_small():
    """Four copies each, none in a shard of much more than its share; any two within three bits meet."""
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 2**64, 10_000_000, dtype=np.uint64)
    per = -(-len(fps) // simhash.SHARD)
    for q in range(simhash.QUARTERS):
        assert np.bincount((simhash.quarter(fps, q) % np.uint64(per)).astype(np.int64), minlength=per).max() < 1.3 * simhash.SHARD
    near = fps[:1000].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 1000, dtype=np.uint64)
    assert np.any([simhash.quarter(fps[:1000], q) == simhash.quarter(near, q) for q in range(4)], axis=0).all()


def test_an_id_of_two_texts_does_not_join_their_groups(spark):
    x, y = "one two three four five six", "seven eight nine ten eleven twelve"
    for low in (5, 1):
        docs = spark.createDataFrame([(5, x), (5, y), (2, y), (9, x), (low, "other words of a third text")], "doc_id long, text string")
        got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
        fx, fy = (f"{plain_fingerprint(t):016x}" for t in (x, y))
        assert {(d, c) for d, f, c in got if f == fx} == {(5, 5), (9, 5)} and {(d, c) for d, f, c in got if f == fy} == {(5, 2), (2, 2)}


def test_dense_groups_are_linked_whole():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1, dtype=np.uint64)
    flips = rng.integers(0, 64, (3000, 2), dtype=np.uint64)
    fps = np.unique(base ^ (np.uint64(1) << flips[:, 0]) ^ (np.uint64(1) << flips[:, 1]))
    groups = simhash.Groups(np.arange(len(fps)))
    simhash.link(fps, np.arange(len(fps)), 3, groups, rng)
    assert {groups.find(i) for i in range(len(fps))} == {0}


def test_documents(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "a b c d e"), (2, None), (3, ""), (5, "A B C d e"), (4, long), (9, long + " x"), (None, "a b c d e"), (5, "A B C d e")]
    docs = spark.createDataFrame([(*r, "u", 7) for r in rows], "doc_id long, text string, fp string, component int")
    got = sorted(((r.doc_id or 0), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    want = sorted((d or 0, f"{plain_fingerprint(t):016x}", {1: 1, 2: 2, 3: 2, 5: 1, 4: 4, 9: 4, None: None}[d]) for d, t in rows)
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def templated(rng, pages: int, centres: int, moving: int):
    """Prints of pages from a few templates: all of a template's agree but in some of its ``moving`` bits."""
    found = []
    for base in rng.integers(0, 2**63, centres, dtype=np.uint64):
        x = np.full(pages, base)
        for _ in range(6):
            x = x ^ (np.uint64(1) << rng.integers(0, moving, pages, dtype=np.uint64))
        found.append(x)
    return np.unique(np.concatenate(found))


@pytest.mark.parametrize("moving", [14, 40])
def test_blocks_join_what_brute_force_joins(monkeypatch, moving):
    monkeypatch.setattr(simhash, "TREE", 30)
    rng = np.random.default_rng(moving)
    fps = templated(rng, 300, 3, moving)
    groups = simhash.Groups(np.arange(len(fps)))
    simhash.link(fps, np.arange(len(fps)), 3, groups, rng)
    label, want = [groups.find(i) for i in range(len(fps))], brute(fps.tolist())
    assert [label.index(x) for x in label] == [want.index(x) for x in want]


def test_a_hot_quarter_value_is_dealt_again(spark):
    """All prints share one quarter; a part of them shares 40 bits."""
    rng = np.random.default_rng(12)
    fps = rng.integers(0, 2**48, 1500, dtype=np.uint64) << np.uint64(16)
    near = fps[:400].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(16, 64, 400, dtype=np.uint64)
    fps = np.unique(np.concatenate((fps, near, templated(rng, 300, 2, 16) & ~np.uint64(0xFFFF), fps[400:500] ^ np.uint64(5)))).tolist()
    want = brute(fps)
    rows = [int(np.uint64(f).astype(np.int64)) for f in fps]
    classes = spark.createDataFrame([(x,) for x in rows], "fp long").repartition(3)
    assert simhash.hot_quarters(classes, 200)[0][0] > 1500
    got = {r.node: r.component for r in connected_components(simhash.stars(classes, 3, 40, 0)).collect()}
    label = [got.get(x, x) for x in rows]
    assert [label.index(x) for x in label] == [want.index(x) for x in want]


def test_a_million_prints_of_one_quarter_value():
    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 2**48, 1_000_000, dtype=np.uint64) << np.uint64(16))
    first = fps[::1000].copy()
    near = first.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(16, 64, len(near), dtype=np.uint64)
    fps = np.unique(np.concatenate((fps, near)))
    groups, start = simhash.Groups(np.arange(len(fps))), time.time()
    simhash.link(fps, np.arange(len(fps)), 3, groups, rng, np.arange(16, 64))
    assert time.time() - start < 60
    place = {x: i for i, x in enumerate(fps.tolist())}
    for x, y in zip(first.tolist(), near.tolist()):
        assert groups.find(place[x]) == groups.find(place[y])
    sample = fps[::50_000]
    for x in sample:
        for i in np.flatnonzero(np.bitwise_count(fps ^ x) <= 3):
            assert groups.find(int(i)) == groups.find(place[int(x)])
