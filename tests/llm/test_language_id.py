import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tidelane.llm import language_id as lid

WORDS = {"en": "the and of water house tide river stone over".split(), "de": "der und die wasser haus gezeit fluss stein über".split(), "fr": "le et la eau maison marée rivière pierre sur".split()}


def rows(n=400):
    rng = random.Random(2)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(5, 40))), lang, "s", 1))
    return out


def test_held_out_accuracy_and_cases(spark):
    odd = [(1000, None, "en", "s", 1), (1001, "", "en", "s", 1), (1002, "123 !? 4", "fr", "s", 1), (1005, "\u0301 12", "en", "s", 1), (None, "der und", None, None, None), (1003, "Wasserhaus,", None, "s", 1), (1004, "the " * 40_000, None, "s", 1)]
    docs = spark.createDataFrame(rows() + odd, "doc_id long, text string, lang string, source string, score int")
    got = {r.doc_id: r for r in lid.identify(docs).collect()}
    assert len(got) == 407
    truth = {i: lang for i, _, lang, *_ in rows()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.99 * len(held)
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002, 1005)] == [("und", 0.0)] * 4
    assert got[1003].lang_pred == "de" and got[None].held_out and got[1004].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert lid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in lid.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null")).collect()} == {"und"}


def test_backoff_takes_the_longest_known_order():
    tables = [{"tide": {"a": 3}}, {"t": {"a": 1, "b": 1}}, {"ti": {"a": 4}, "zz": {"b": 9}}, {"tid": {"b": 5}}, {}, {}]
    model = lid.Model(["a", "b"], [(list(t), np.array([[c.get("a", 0), c.get("b", 0)] for c in t.values()], float).reshape(-1, 2)) for t in tables])
    assert np.array_equal(model.word_score("tide"), model.scores[0][0])
    assert np.array_equal(model.word_score("xtid"), model.scores[3][0])
    assert np.array_equal(model.word_score("tizz"), model.scores[2][[0, 1]].mean(0))
    assert np.array_equal(model.word_score("q"), np.zeros(2))


def plain(docs):
    """Predictions from all labelled texts of the training folds, counted and scored straight from the definition."""
    counts = [Counter() for _ in range(6)]
    for lang, text in sorted({(lang, t) for i, t, lang in docs if lang and t is not None and i is not None and zlib.crc32(str(i).encode()) % 5}):
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            counts[0][w, lang] += 1
            for n in range(1, 6):
                p = w if n == 1 else f"^{w}$"
                for i in range(len(p) - n + 1):
                    counts[n][p[i : i + n], lang] += 1
    langs = sorted({lang for c in counts for _, lang in c})
    known = [{x for x, _ in c} for c in counts]
    total = [{lang: sum(k for (_, x), k in c.items() if x == lang) for lang in langs} for c in counts]

    def log(order, item, lang):
        return math.log(counts[order][item, lang] + lid.SMOOTH) - math.log(total[order][lang] + lid.SMOOTH * (len(known[order]) + 1))

    def predict(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not words:
            return "und", 0.0
        sums = dict.fromkeys(langs, 0.0)
        for w in words:
            found, order = [w] if w in known[0] else [], 0
            for n in range(5, 0, -1):
                if not found:
                    p = w if n == 1 else f"^{w}$"
                    found, order = [x for x in (p[i : i + n] for i in range(len(p) - n + 1)) if x in known[n]], n
            for lang in langs:
                sums[lang] += sum(log(order, x, lang) for x in found) / max(1, len(found))
        best = max(langs, key=lambda lang: sums[lang])
        return best, 1 / sum(math.exp(s - sums[best]) for s in sums.values())

    return [(i, *predict(t)) for i, t, _ in docs]


def test_query_against_a_plain_version(spark):
    rng = random.Random(6)
    docs = [(i, t, lang) for i, t, lang, *_ in rows(150)]
    docs += [(200 + i, " ".join("".join(rng.choice("abcdeunthrüé1-. ") for _ in range(rng.randrange(1, 12))) for _ in range(6)), rng.choice([None, "en", "fr"])) for i in range(80)]
    docs += [(300, None, "en"), (301, "", None), (302, docs[0][1], docs[0][2]), (None, "tide", "en"), (303, "Ω ж", None)]
    got = lid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)).collect()
    want = {i: (lang, score) for i, lang, score in plain(docs)}
    assert len(got) == len(want)
    assert all(r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-6 for r in got)


def test_a_text_copied_many_times_leaves_the_sample_whole(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "'the sea' AS text", "'en' AS lang").unionByName(spark.createDataFrame([(i, t, lang) for i, t, lang, *_ in rows(60)], "doc_id long, text string, lang string"))
    assert set(lid.fit(docs, 40).langs) == set(WORDS)


def test_extra_columns_of_any_name_pass(spark):
    docs = spark.createDataFrame([(i, t, lang, "a", 0.5) for i, t, lang, *_ in rows(60)], "doc_id long, text string, lang string, _language string, _LANGUAGE_score double")
    kept = lid.keep_identified(docs)
    assert kept.columns == docs.columns and {(r[3], r[4]) for r in kept.collect()} == {("a", 0.5)} and kept.count() == 60


def test_few_texts_are_strings_at_once():
    calls = []

    def predict_all(texts):
        calls.append(sum(len(t or "") for t in texts))
        return [("en", 1.0)] * len(texts)

    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(["the " * 75_000] * 6 + [None, "the " * 400_000])], names=["doc_id", "text"])
    context = SimpleNamespace(broadcast=lambda model: SimpleNamespace(value=model))
    docs = SimpleNamespace(columns=["doc_id", "text"], schema=SimpleNamespace(fields=[]), sparkSession=SimpleNamespace(sparkContext=context), mapInArrow=lambda run, schema: list(run([batch])))
    (found,) = lid.predict(docs, SimpleNamespace(predict_all=predict_all))
    assert found.num_rows == 8 and sum(calls) == 6 * 300_000 + 1_600_000
    assert all(n <= 1_000_000 or n == 1_600_000 for n in calls)  # a longer text alone
