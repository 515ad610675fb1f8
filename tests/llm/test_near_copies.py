import random

import pytest

from pyspark.sql import functions as F

from tidelane.llm import near_copies


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def plain(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def planted():
    """Texts with one to eight words replaced, a dense group and a few short ones."""
    rng, out = random.Random(4), []
    for i in range(120):
        base = words(rng, 150)
        out.append(" ".join(base))
        for k in (1, 2, 3, 5, 8):
            copy = list(base)
            for at in rng.sample(range(150), k):
                copy[at] = f"new{rng.randrange(10**6)}"
            if i % 4 == k % 4:
                out.append(" ".join(copy))
    base = words(rng, 200)
    out += [" ".join(base[:j] + [f"one{j}"] + base[j:]) for j in range(60)] + ["a b", "A  b", "a b c", "", None]
    rng.shuffle(out)
    return out


def brute(texts):
    sets, label = [plain(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("chunk", [20, 2_000])
def test_groups_are_those_of_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(near_copies.links, "__defaults__", (near_copies.SIMILARITY, chunk))
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in near_copies.keep_one(docs).collect())
    assert got == sorted(set(brute(texts)))


def test_buckets_that_one_representative_does_not_join():
    """a is unlike b and c, which are alike."""
    import numpy as np

    sets = [np.arange(a, b).astype(np.uint64) for a, b in ((0, 100), (40, 140), (45, 145), (300, 400))]
    ids = np.arange(4)
    assert near_copies.link(ids, ids, sets, 0.8) == [(1, 2)]
    assert near_copies.link(ids, np.array([0, 1, 1, 3]), sets, 0.8) == []


def test_rows_that_share_an_id(spark):
    """Unlike texts of one id both stay, and do not join the groups of their copies; exact repeats are one."""
    rng = random.Random(6)
    a, b, c = (" ".join(words(rng, 80)) for _ in range(3))
    rows = [(7, a, "x"), (7, b, "x"), (7, a, "x"), (8, a + " end", "y"), (9, b + " end", "y"), (3, c, "p"), (3, c.upper(), "q"), (None, c, "r")]
    found = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(1 + seed)
        found.append(sorted(map(tuple, near_copies.keep_one(docs).collect()), key=repr))
    assert found[0] == found[1] == found[2]
    assert [r for r in found[0] if r[0] == 7] == sorted([(7, a, "x"), (7, b, "x")], key=repr)
    assert [r[0] for r in found[0]].count(3) == 1 and len(found[0]) == 3  # the null id goes with its group


def test_empty_tables_null_ids_and_columns_of_any_name(spark):
    rng = random.Random(1)
    t = " ".join(words(rng, 60))
    docs = spark.createDataFrame([(None, t, 1, 2), (None, t, 1, 2), (4, "x " + t, 3, 4), (None, "alone here", 5, 6), (None, None, 7, 8)], "doc_id long, text string, near_class int, row int")
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted([(4, "x " + t, 3, 4), (None, "alone here", 5, 6), (None, None, 7, 8)], key=repr)
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_trees_give_candidates_too(spark):
    """Without any band in common, texts of close fingerprints are still found."""
    rng = random.Random(3)
    t = words(rng, 400)
    docs = spark.createDataFrame([(1, " ".join(t)), (2, " ".join(t[:-1])), (3, " ".join(words(rng, 400)))], "doc_id long, text string")
    classes = near_copies.with_classes(docs).select(F.col("near_id").alias("near_class"), "near_fp")
    assert near_copies._close_fingerprints(classes).count() == 1
