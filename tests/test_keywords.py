"""Keyword rules against a plain loop, and the plan that finds them."""

import random

from pyspark.sql import functions as F

from tidelane.operators import catalog, keywords


def loop(names, rules):
    return sorted({(label, n) for label, groups in rules for n in names if n is not None and all(any(k is not None and k in n.lower() for k in g) for g in groups)})


def drawn(seed, n_names, n_rules):
    rng = random.Random(seed)
    syllables = ["an", "chor", "age", "port", "é", "bay", " ", "mi.", "0.6", "Sea", "x", "ab", "Å"]
    word = lambda a, b: "".join(rng.choice(syllables) for _ in range(rng.randrange(a, b)))
    names = [word(1, 12) for _ in range(n_names)] + [None, "", "a", "PORT PORT", "aaaa"]
    rules = [(f"r{i}", [[word(0, 4).lower() for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 4))]) for i in range(n_rules)]
    rules += [("all", []), ("empty", [[""]]), ("never", [[]]), ("null", [[None, "bay"]]), ("nothing", [[None]]), ("overlap", [["aa"], ["aaa"]]), ("r0", [["port"], ["bay"]])]
    return names, rules


def test_matches_equal_the_loop(spark):
    names, rules = drawn(1, 300, 200)
    rows = spark.createDataFrame([(n,) for n in names + names[:20]], "name string").repartition(3)
    table = spark.createDataFrame(rules + rules[:5], "label string, groups array<array<string>>")
    got = keywords.matches(rows, table).collect()
    assert sorted(map(tuple, set(got))) == loop(names, rules)


def test_many_rules_meet_no_name_in_a_loop(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnop"
    names = ["".join(rng.choice(letters) for _ in range(30)) for _ in range(2000)]
    rules = [(f"r{i}", [["".join(rng.choice(letters) for _ in range(3))], ["".join(rng.choice(letters) for _ in range(2)), "zz"]]) for i in range(10_000)]
    rows, table = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(rules, "label string, groups array<array<string>>")
    found = keywords.matches(rows, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    some = [r for r in rules if int(r[0][1:]) % 97 == 0]
    got = sorted((r.label, r.name) for r in found.where(F.expr("cast(substring(label, 2) as int) % 97 = 0")).collect())
    assert got == loop(names, some)


def test_labels_without_a_match_stay(spark):
    rows = spark.createDataFrame([("1", "Anchor Bay"), ("2", None)], "id string, name string")
    rules = spark.createDataFrame([("a", [["anchor"], ["bay", "sea"]]), ("b", [["zz"]])], "label string, groups array<array<string>>")
    assert sorted(map(tuple, catalog.keyword_match(rows, rules).select("label", "id").collect())) == [("a", "1"), ("b", None)]
