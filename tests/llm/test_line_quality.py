"""Line labels against plain counts and enumeration; document quality on held-out documents."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidelane.llm import line_quality as lq

COLUMN = {name: i for i, (name, _) in enumerate(lq.OWN_ONLY + lq.SHARED)}
BEFORE = len(COLUMN)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(texts):
    return lq.features(*lq.text_bytes(pa.array(texts, pa.string())))


def random_texts(n=120):
    rng = random.Random(9)
    words = ["sea", "SEA", "É", "tide!", "a,b", "###", "|", "12", "x" * 40, "漢字", "\x07", "word."]
    line = lambda: rng.choice(["", " ", "\t"]).join([""] * rng.randrange(3)) + " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))
    made = ["\n".join(rng.choice([line(), "same line here", ""]) for _ in range(rng.randrange(0, 8))) for _ in range(n)]
    return ["", "\n\n", " ", "a", "\n a \n", "a\r\nb", "one\n" * 50, "word " * 3000] + made


def share(part, whole):
    s = part / max(whole, 1)
    return sum(s >= x for x in (1e-9, 0.01, 0.03, 0.08, 0.2, 0.5))


def digits(n, most):
    return min(int(n).bit_length(), most)


def test_features_equal_plain_counts():
    texts = random_texts()
    rows, weight, first = rows_of(texts)
    at = 0
    for number, text in enumerate(texts):
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert first[number] == at
        places = [i for i, x in enumerate(text.split("\n")) if WORD.search(x)]
        words = [w for x in lines for w in WORD.findall(x)]
        windows = Counter(zip(words, words[1:], words[2:]))
        seen, start = Counter(tuple(WORD.findall(x)) for x in lines), 0
        for i, x in enumerate(lines):
            own = rows[at + i] - lq.OFFSETS[:-1]
            bin_of = lambda name: own[COLUMN[name]]  # noqa: B023,E731
            w = WORD.findall(x)
            n = len("".join(w))
            assert weight[at + i] == n
            mine = list(zip(words, words[1:], words[2:]))[start : start + len(w)]
            start += len(w)
            assert bin_of("length") == digits(n, 15) and bin_of("words") == digits(len(w), 11)
            assert bin_of("word_length") == min(n // len(w), 9)
            assert bin_of("loud") == share(sum(c in "!?" for c in x), n)
            assert bin_of("symbols") == share(sum(c in "#$%&*+<>@[]`{}" for c in x), n)
            assert bin_of("rules") == share(sum(c in "|/\\_=~^" for c in x), n)
            assert bin_of("digits") == share(sum(c in "0123456789" for c in x), n)
            letters = [c for c in x if ord(c) > 127 or c.isalpha()]
            assert bin_of("capitals") == share(sum(c.isupper() for c in letters), len(letters))
            assert bin_of("windows") == share(sum(windows[g] > 1 for g in mine), len(mine))
            assert bin_of("repeats") == min(digits(seen[tuple(w)], 4) - 1, 3)
            assert bin_of("distinct") % 6 == min(digits(len(w), 10) // 2, 5)
            assert bin_of("distinct") // 6 == min(int(len(set(w)) / len(w) * 5.999), 5) or len(w) > 500  # a rounded sum of parts
            assert bin_of("place") == (0 if len(lines) == 1 else 1 if i == 0 else 2 if i == len(lines) - 1 else 3)
            assert bin_of("gap") == (i > 0 and places[i] - places[i - 1] > 1)
            for j, (name, size) in enumerate(lq.SHARED):
                for side, k in ((0, i - 1), (1, i + 1)):
                    there = rows[at + k][COLUMN[name]] - lq.OFFSETS[COLUMN[name]] if 0 <= k < len(lines) else size
                    assert own[BEFORE + side * len(lq.SHARED) + j] == there
        at += len(lines)
    assert at == len(rows)


def test_texts_do_not_touch_each_other():
    texts = random_texts(30)
    rows, weight, first = rows_of(texts)
    for i, t in enumerate(texts):
        alone = rows_of([t])
        assert (alone[0] == rows[first[i] : first[i + 1]]).all() and (alone[1] == weight[first[i] : first[i + 1]]).all()


def chain_with_weights(seed=2):
    chain, rng = lq.Chain(), np.random.default_rng(seed)
    chain.weights = rng.normal(0, 0.3, len(chain.weights))
    chain.next = rng.normal(0, 1, (2, 2)).tolist()
    return chain


def enumerated(chain, rows):
    s, t = chain.weights[rows].sum(1), chain.next
    paths = list(itertools.product((0, 1), repeat=len(rows)))
    return paths, [math.exp(sum(s[i] * y for i, y in enumerate(p)) + sum(t[a][b] for a, b in zip(p, p[1:]))) for p in paths]


def test_marginals_equal_enumeration():
    chain = chain_with_weights()
    for n in (1, 2, 7):
        rows = rows_of(["\n".join(["A bc, d.", "### ## !", "x | y", "the the the", "12 13", "É", "a\tb"][:n])])[0]
        paths, mass = enumerated(chain, rows)
        want = [sum(m for p, m in zip(paths, mass) if p[i]) / sum(mass) for i in range(n)]
        assert np.allclose(chain.marginals(rows), want)


@pytest.mark.parametrize("label", [0, 1])
def test_steps_follow_the_gradient(label):
    rows = rows_of(["A bc, d.\n### ## !\nx | y\nthe the the"])[0]
    chain, size = chain_with_weights(), 1e-6
    likelihood = lambda c: math.log(enumerated(c, rows)[1][-1 if label else 0] / sum(enumerated(c, rows)[1]))
    before = likelihood(chain)
    slopes = {}
    for key in [*rows[1][:5], (0, 0), (0, 1), (1, 1)]:
        moved = chain_with_weights()
        if isinstance(key, tuple):
            moved.next[key[0]][key[1]] += size
        else:
            moved.weights[key] += size
        slopes[key] = (likelihood(moved) - before) / size
    after = chain_with_weights()
    after.step(rows, label, size)
    for key, slope in slopes.items():
        change = after.next[key[0]][key[1]] - chain.next[key[0]][key[1]] if isinstance(key, tuple) else after.weights[key] - chain.weights[key]
        assert abs(change / size - slope) < 1e-3


def test_quality_weighs_lines_by_length():
    chain = chain_with_weights()
    text = "A long and decent line of words.\n###\n\nx | y | z"
    data, bounds = lq.text_bytes(pa.array([text, "", "\n"]))
    rows, weight, first = lq.features(data, bounds)
    p = chain.marginals(rows[:3])
    assert weight.tolist() == [26, 3, 5]
    assert np.allclose(chain.scores(data, bounds), [(p * weight).sum() / weight.sum(), 0.5, 0.5])


def test_long_documents_stay_finite():
    chain = chain_with_weights()
    chain.weights *= 100
    data, bounds = lq.text_bytes(pa.array(["!!! ###\n" * 200_000, "z" * 3_000_000]))
    found = chain.scores(data, bounds)
    assert all(0 <= x <= 1 for x in found)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "good words here.", 1), (3, "good words here.", 1), (None, "### $$$", 1), (5, "z" * 100_000, 1)], "doc_id long, text string, _label int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    chain = lq.fit(docs, none)
    found = {(r.doc_id, r.score) for r in lq.score(docs, chain).collect()}
    assert found == {(i, 0.5) for i in (1, 2, 3, None, 5)}
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 1), (3, 1), (5, 0), (6, None), (None, 1), (8, 7)], "doc_id long, quality int")
    chain = lq.fit(docs, labels)
    assert (chain.good, chain.bad) == (1, 0)  # 1 has no text, 2 two labels, 5 is too long
    assert lq.score(docs.limit(0), chain).collect() == []
    assert lq.score(docs, chain).count() == docs.count()


def test_held_out_documents(spark):
    """Accuracy and area under the curve over the held-out labelled documents of the largest given table."""
    folder = "/root/testdata/sf0.1"
    rows = lq.op13_line_quality(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = rows.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in found if r.quality], [r.score for r in found if not r.quality]
    assert len(bad) > 150 and len(good) > 1000
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.995
    assert np.mean([r.predicted == r.quality for r in found]) > 0.98
    assert rows.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
