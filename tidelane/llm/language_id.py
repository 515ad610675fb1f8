"""Language identification by known words, backing off to character n-grams (operator 3).

The model holds, for each language, the log frequency of the words it knows and of character n-grams of one to five
characters. A word that it knows is scored by its own frequencies. Any other is scored by the mean over its n-grams of
the longest order of which at least one is known, so each order is tried only where the longer ones know nothing. A
text's language has the largest sum over its words; the score is that language's posterior under equal priors.

The classifier is fitted on a bounded sample: the ``max_docs`` different labelled texts of at most ``MAX_CHARS``
characters whose hashes are smallest. All their words and n-grams are learned. Every document is predicted, where it
lies, from its whole text; lang, source and doc_id are no inputs. Each worker keeps the scores of tokens it has met in a
bounded cache.

Defined cases: a null text or one without a letter is ``und`` with score 0 (combining marks are part of a word, but no
letters), and so is every text where nothing could be learned; ties go to the language first in the alphabet; a null doc_id counts as held out; repeated rows get equal
results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .chunk_encoder import slices
from .shared import fold_of, fresh, give_back, read_table, smallest

FOLDS = 5
MAX_DOCS, MAX_CHARS, ORDERS, SMOOTH = 1_000, 50_000, 5, 0.5
MAX_CACHED = 200_000
SLICE = 1_000_000  # bytes of text that become Python strings and tokens at once
UNKNOWN, LEAST_SCORE = "und", 0.5


def letters_only(token: str) -> list[str]:
    """Lower-case words of letters and combining marks in a token; each holds a letter."""
    token = token.lower()
    if token.isalpha():
        return [token]
    words = "".join(c if c.isalpha() or unicodedata.combining(c) else " " for c in token).split()
    return [w for w in words if any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    padded = word if n == 1 else f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count_words(sample: DataFrame) -> DataFrame:
    """lang, word and its occurrences, counted in each partition before anything moves."""

    def run(batches):
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(text.split())
            for lang, tokens in counts.items():
                words: Counter = Counter()
                for token, n in tokens.items():
                    for word in letters_only(token):
                        words[word] += n
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    return sample.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _count_grams(words: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for order in range(1, ORDERS + 1):
                    for g in grams(word, order):
                        counts[lang, order, g] += n
            if counts:
                keys = list(zip(*counts))
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1], pa.int32()), pa.array(keys[2]), pa.array(list(counts.values()), pa.int64())], names=["lang", "order", "item", "n"])

    return words.mapInArrow(run, "lang string, order int, item string, n long").groupBy("lang", "order", "item").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies of words (order 0) and n-grams by language."""

    def __init__(self, langs: list[str], tables: list[tuple[list[str], np.ndarray]]):
        """``tables``: for each order its items, and their counts with a column a language."""
        self.langs = langs
        self.index = [{x: i for i, x in enumerate(items)} for items, _ in tables]
        self.scores = [np.log(counts + SMOOTH) - np.log(counts.sum(0) + SMOOTH * (len(items) + 1)) for items, counts in tables]
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.cached = np.zeros((1024, len(self.langs)))
        self.used = 1  # row 0: a token without letters

    def __getstate__(self):
        return self.langs, self.index, self.scores

    def __setstate__(self, state):
        self.langs, self.index, self.scores = state
        self._clear()

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row a word: its own scores, or the mean over its known n-grams of the longest order that has any."""
        out = np.zeros((len(words), len(self.langs)))
        look = self.index[0].get
        own = [look(w) for w in words]
        known = [i for i, r in enumerate(own) if r is not None]
        out[known] = self.scores[0][[own[i] for i in known]]
        left = [i for i, r in enumerate(own) if r is None]
        for order in range(ORDERS, 0, -1):
            look, rest, at, sizes, flat = self.index[order].get, [], [], [], []
            for i in left:
                found = [r for r in map(look, grams(words[i], order)) if r is not None]
                if found:
                    at.append(i)
                    sizes.append(len(found))
                    flat += found
                else:
                    rest.append(i)
            if at:
                n = np.array(sizes)
                out[at] = np.add.reduceat(self.scores[order][flat], np.cumsum(n) - n) / n[:, None]
            left = rest
        return out

    def word_score(self, word: str) -> np.ndarray:
        return self.word_scores([word])[0]

    def _learn(self, tokens: list[str]) -> None:
        """Put the rows of new tokens into the cache."""
        split = [letters_only(t) for t in tokens]
        place = {w: i for i, w in enumerate({w for words in split for w in words})}
        scores = self.word_scores(list(place))
        while self.used + len(tokens) > len(self.cached):
            self.cached = np.concatenate((self.cached, np.zeros_like(self.cached)))
        for token, words in zip(tokens, split):
            row = 0
            if words:
                row = self.used
                self.cached[row] = scores[place[words[0]]] if len(words) == 1 else scores[[place[w] for w in words]].sum(0)
                self.used += 1
            self.rows[token] = row

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if self.used > MAX_CACHED:
            self._clear()
        cut = [t.split() if t else [] for t in texts]
        if new := set(chain.from_iterable(cut)).difference(self.rows):
            self._learn(list(new))
        out, look = [], self.rows.__getitem__
        for tokens in cut:
            rows = np.fromiter(map(look, tokens), np.int64, len(tokens))
            if not self.langs or not rows.any():
                out.append((UNKNOWN, 0.0))
                continue
            total = self.cached[rows].sum(0)
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Learn from text and lang of ``docs``, whose rows the caller has chosen."""
    labelled = docs.where(F.col("lang").isNotNull() & (F.length("text") <= MAX_CHARS)).select("lang", "text")
    words = _count_words(smallest(labelled, ["lang", "text"], max_docs).select("lang", "text")).cache()
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    items = words.select("lang", F.lit(0).alias("order"), F.col("word").alias("item"), "n").unionByName(_count_grams(words))
    counts = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
    found = items.groupBy("order", "item").agg(F.count("*").alias("langs"), *counts).orderBy("order", "item").toArrow()
    words.unpersist()
    tables, order = [], found.column("order").to_numpy()
    for k in range(ORDERS + 1):
        a, b = np.searchsorted(order, [k, k + 1])
        own = found.slice(a, b - a)
        matrix = [own.column(f"n{i}").to_numpy().astype(float) for i in range(len(langs))]
        tables.append((own.column("item").to_pylist(), np.stack(matrix, 1) if langs else np.zeros((0, 0))))
    return Model(langs, tables)


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of ``docs`` with the predicted language and its score under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column(columns.index("text"))
            found = [x for a, b in slices(texts, SLICE) for x in shared.value.predict_all(texts.slice(a, b - a).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*columns, *names])
            give_back()

    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE, max_docs: int = MAX_DOCS) -> DataFrame:
    """Documents with a language, predicted with a score of at least ``least`` by a model of the labelled ones."""
    model = fit(docs.where(fold_of(F.col("doc_id"), FOLDS) != 0), max_docs)
    lang, score = fresh(docs.columns, "_language"), fresh(docs.columns, "_language_score")
    rows = predict(docs, model, (lang, score))
    return rows.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(docs.columns)


def identify(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learns from the folds that are not held out."""
    held = fold_of(F.col("doc_id"), FOLDS) == 0
    model = fit(docs.where(~held), max_docs)
    return predict(docs.select(F.col("doc_id").cast("long"), "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
