"""Fill-in-middle against plain cuts, and its wavelet matrix against counting."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.llm import fill_middle as fm
from tidelane.llm.wavelet import WaveletMatrix

UNITS = {"word": re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"), "line": re.compile(r"[^\n]*\n|[^\n]+")}


def plain(doc_id, text, unit="word", percent=50):
    text = text or ""
    h = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNITS[unit].findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return doc_id, n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def odd_rows():
    rng = random.Random(3)
    fixed = [None, "", " ", "\n\n", "a", " a", "a ", "é 漢 \x85字\x1f \x0b𝒳", "<P> a b c", "a <<S b M> <P", "x <S><M>", "<", "a" * 5000, " \t" * 3000, "word  " * 40_000, "\x00 \x00", "ﬀ x﻿ y"]
    drawn = ["".join(rng.choice("ab é漢𝒳 \n\t\r\x0b\x0c<PS>") for _ in range(rng.randrange(50))) for _ in range(500)]
    rows = [(i, t) for i, t in enumerate(fixed + drawn)]
    return rows + [(7, fixed[7]), (None, "no id at all"), (None, None)]


@pytest.mark.parametrize("unit,percent", [("word", 50), ("word", 100), ("line", 100)])
def test_rows_equal_plain_cuts(spark, unit, percent):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, output string").repartition(3)
    got = fm.transform(docs, unit=unit, cut_percent=percent)
    back = got.select(*got.columns, fm.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted((tuple(r)[:6] for r in back), key=repr) == sorted((plain(i, t, unit, percent) for i, t in rows), key=repr)
    assert sorted((repr(r.doc_id), r.back) for r in back) == sorted((repr(i), t or "") for i, t in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_matrix_counts_and_locates():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, size).astype(np.uint8)
        matrix = WaveletMatrix(symbols, 3)
        at = np.arange(size + 1)
        for wanted in ((0,), (5,), (1, 3), (2, 6, 7)):
            hits = np.concatenate(([0], np.cumsum(np.isin(symbols, wanted))))
            assert (matrix.rank(wanted, at) == hits).all()
            for k in range(0, hits[-1] + 2):
                first = int(np.argmax(hits >= k)) if k <= hits[-1] else size
                assert matrix.locate(wanted, np.array([0]), np.array([size]), np.array([k]))[0] == first


def test_no_rows(spark):
    assert fm.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_cuts_lie_where_the_texts_lie(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    plan = fm.op12_fill_middle(spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "lang" not in plan


def test_query_matches_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(fm.OP12_SQL)
    got = fm.op12_fill_middle(spark, folder)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
