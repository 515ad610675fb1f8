"""Product codes against plain k-means on Python integers, and their SQL."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.llm import vector_codes as vc


def plain(rows, entries=16, rounds=6):
    """(vec_id, code, error, label_error), sorted, and the codebooks."""
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    size = max(Counter(len(r[1]) for r in good).items(), key=lambda x: (x[1], x[0]))[0]
    width = -(-size // 8)
    limit = vc.largest(width)
    kept = []
    for i, v, label in good:
        whole = [math.floor(4096 * x) for x in v] + [0] * (8 * width - len(v))
        if len(v) == size and max(map(abs, whole)) <= limit:
            kept.append((i, [tuple(whole[p * width : (p + 1) * width]) for p in range(8)], label))
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p] for r in first] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            held = {}
            for r in kept:
                held.setdefault(near(r[1][p], books[p])[1], []).append(r[1][p])
            books[p] = [tuple(sum(c) // len(held[j]) for c in zip(*held[j])) if j in held else e for j, e in enumerate(books[p])]
    out, labels = [], Counter()
    for i, parts, label in kept:
        found = [near(x, books[p]) for p, x in enumerate(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
        labels[label] += out[-1][2]
    return sorted(((i, c, e, labels[label]) for i, c, e, label in out), key=repr), books


def saved(spark, tmp_path, rows, schema="vec_id long, embedding array<float>, label int, code string"):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(*r, "clash") for r in rows], schema).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def held(spark, folder, rows):
    got = vc.op11_ball_codes(spark, folder).collect()
    want, books = plain(rows)
    assert sorted((tuple(r)[:4] for r in got), key=repr) == want
    assert {r.codebooks_sha256 for r in got} == {vc.digest([np.array(b) for b in books])}
    return got


def clustered(n, size, seed, digits=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(12)]
    return [(i, [float(np.float32(round(c + rng.gauss(0, 0.2), digits))) for c in rng.choice(centres)], rng.choice([None, 1, 2, 3])) for i in range(n)]


def test_query_against_plain_rounds(spark, tmp_path):
    rows = clustered(700, 24, 1)
    odd = [(3, None, 1), (900, [], 2), (901, [1.0, None] * 12, 1), (902, [float("nan")] * 24, 1), (903, [float("inf")] + [0.0] * 23, None), (904, [1.0] * 8, 1), (905, [1e9] * 24, 1), (906, [0.0] * 24, 4)]
    repeats = [rows[5], rows[5], (5, rows[9][1], 7), (None, rows[3][1], None), (None, [-0.1] * 24, 2)]
    rows += odd + repeats
    held(spark, saved(spark, tmp_path, rows), rows)


def test_ties_and_repeated_entries(spark, tmp_path):
    """Coarse values: many equal distances, and first entries that repeat each other."""
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.001, 0.0, 0.001]) for _ in range(16)], i % 2) for i in range(400)]
    rows[3] = (3, rows[0][1], 0)
    held(spark, saved(spark, tmp_path, rows, "vec_id long, embedding array<double>, label long, code string"), rows)


@pytest.mark.parametrize("n,size", [(5, 8), (40, 13), (1, 3)])
def test_few_rows_and_uneven_lengths(spark, tmp_path, n, size):
    rows = clustered(n, size, 2)
    held(spark, saved(spark, tmp_path, rows), rows)


def test_no_rows(spark, tmp_path):
    folder = saved(spark, tmp_path, [(1, None, 1), (2, [float("nan")], None)])
    got = vc.op11_ball_codes(spark, folder)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.collect() == []


def test_balls_give_the_nearest_from_any_start_with_fewer_distances():
    rng = np.random.default_rng(5)
    for kind in (np.int64, np.float64):
        entries = rng.integers(-4000, 4000, (16, 8)).astype(kind)
        x = (entries[rng.integers(0, 16, 5000)] + rng.integers(-900, 900, (5000, 8))).astype(kind)
        entries[7] = entries[3]
        code, best = vc.nearest(x, entries)
        assert [tuple(v) for v in zip(best[:50], code[:50])] == [min((((r - e) ** 2).sum(), j) for j, e in enumerate(entries)) for r in x[:50]]
        for ball in (code, rng.integers(0, 16, 5000), np.zeros(5000, np.int64)):
            again, d, asked = vc.nearest_by_balls(x, entries, ball)
            assert (again == code).all() and (d == best).all()
        assert vc.nearest_by_balls(x, entries, code)[2] < 5000 * 16 / 2


def test_values_too_large_for_doubles_stay_exact():
    rng = np.random.default_rng(6)
    top = vc.largest(2)
    whole = rng.integers(-top, top + 1, (200, 16))
    books = [whole[:16, 2 * p : 2 * p + 2] for p in range(8)]
    parts, codes, error = vc.assign(vc.list_column(whole), None, books)
    assert parts[0].dtype == np.int64
    for i in (0, 50, 199):
        near = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(whole[i, 2 * p : 2 * p + 2], e)), j) for j, e in enumerate(books[p])) for p in range(8)]
        assert codes[i].tolist() == [j for _, j in near] and error[i] == sum(d for d, _ in near)


def test_codes_decode_to_their_entries_and_rounds_lower_the_error(spark):
    rows = spark.createDataFrame(clustered(300, 16, 8), "vec_id long, embedding array<float>, label int")
    coded, books = vc.compress(rows)
    gap = F.aggregate(F.zip_with("v", "approximation", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda a, b: a + b)
    back = vc.decode(coded, books).select("error", gap.alias("gap"))
    assert back.where("error <> gap").count() == 0
    assert back.agg(F.sum("gap")).first()[0] < vc.compress(rows, rounds=1)[0].agg(F.sum("error")).first()[0]


def test_query_matches_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.sql(vc.OP11_SQL)
    got = vc.op11_ball_codes(spark, folder)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
