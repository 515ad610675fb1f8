"""Sketches of frequent values against exact counts, merged from parts."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tidelane.operators import profile


def test_merged_sketches_are_within_their_bound(spark):
    rng = random.Random(6)
    rows = [(y, "event", f, f"v{int(rng.paretovariate(0.6))}" if f == "wide" else f"n{rng.randrange(40)}") for y in (2025, 2026, 2027) for f in ("wide", "narrow") for _ in range(8000)]
    values = spark.createDataFrame(rows, "year int, level string, field string, value string").repartition(4)
    tracked = 96
    merged = profile.merged_sketches(profile.sketches(values, ["year"], tracked), [], tracked)
    got = {r.field: r for r in profile.sketched_profile(merged, [], 3, tracked).collect()}
    for field in ("wide", "narrow"):
        counts = Counter(v for _, _, f, v in rows if f == field)
        r = got[field]
        assert r.present == 24_000 and r.error == int(24_000 * profile.error_share(tracked)) and abs(r.n_values - len(counts)) < 0.1 * len(counts)
        exact = counts.most_common(3)
        assert len(r.top) >= 1 and all(abs(x["count"] - counts[x["item"]]) <= r.error for x in r.top)
        assert all(n <= x["count"] + 2 * r.error for (_, n), x in zip(exact, r.top))
        if field == "narrow":
            assert sorted(x["count"] for x in r.top) == sorted(n for _, n in exact)


def test_values_as_json_has_them(spark):
    rows = spark.sql("select 'a\"b' as s, 1.5D as d, 2 as i, true as b, null as n, array(1, null) as a, named_struct('x', null, 'y', 'z') as o, date'2026-01-02' as day")
    got = {r.field: r.value for r in profile.fields_of(rows, "l").collect()}
    assert got == {"s": 'a"b', "d": "1.5", "i": "2", "b": "true", "n": "null", "a": "[1,null]", "o": '{"x":null,"y":"z"}', "day": "2026-01-02"}
    assert "from_json" not in profile.fields_of(rows, "l")._jdf.queryExecution().optimizedPlan().toString()
    assert profile.fields_of(rows.select(F.lit(None).cast("void").alias("v")), "l").first().value == "null"
