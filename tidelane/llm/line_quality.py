"""Document quality from lines labelled by a linear-chain conditional random field (operator 13).

Every line with a word is labelled good or bad. Its features are binned shares of character classes (capitals, symbols,
digits, marks), its length and words, how far its words and three-word windows repeat in the document, how often the whole
line does, its first and last characters and place, and the main ones of the lines before and behind it. A linear-chain model
weighs them together with the labels of neighbouring lines. Forward and backward sums give each line's probability of being
good; a document's quality is their mean, weighted by the characters of each line that are no white space.

Features are counted over the bytes of some megabytes of texts at once, by class arrays and segment sums; repeats are found
by sorting hashes of words and windows with their document. A longer text is taken alone, in some 25 bytes of memory for
each of its own. Documents are scored where they lie, nothing is shuffled, and whole texts are read.

The model is fitted on a bounded sample: of the labelled ids, the ``IDS`` with the smallest hashes, and of their texts of at
most ``SAMPLE_CHARS`` characters the ``SAMPLE`` different ones with the smallest hashes. A line of the sample has its
document's label. lang, source, doc_id and labels are no inputs of a score.

Defined cases: a null or empty text, or one without a word, has the share of good documents in the sample as its score (one
more of each kind counted, so one half without a sample); ids with a null or with two different labels, and labels that are
neither 0 nor 1, are not learned from; a null doc_id is in fold 0; repeated rows get equal results; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_encoder import slices
from .fill_middle import text_bytes
from .shared import distinct_sample, fold_of, read_table

FOLDS, HELD_OUT = 3, 1
IDS, SAMPLE, SAMPLE_CHARS = 12_000, 6_000, 20_000
EPOCHS, RATE, DECAY, SEED = 12, 0.15, 1e-4, 7
LEAST, CHUNK = 0.5, 4_000_000

# Bytes by class.
WHITE, UPPER, LOWER, DIGIT, STOP, LOUD, QUOTE, SYMBOL, RULE, CONTROL, LEAD, LATER = range(12)
CLASS = np.full(256, SYMBOL, np.uint8)  # # $ % & * + < > @ and the like
CLASS[:32] = CONTROL
CLASS[[0x20, *range(0x09, 0x0E)]] = WHITE
CLASS[0x41:0x5B] = UPPER
CLASS[0x61:0x7B] = LOWER
CLASS[0x30:0x3A] = DIGIT
CLASS[list(b".,;:")] = STOP
CLASS[list(b"!?")] = LOUD
CLASS[list(b"'\"()-")] = QUOTE
CLASS[list(b"|/\\_=~^")] = RULE
CLASS[0x7F] = CONTROL
CLASS[0x80:0xC0] = LATER
CLASS[0xC0:] = LEAD

SHARES = np.array([1e-9, 0.01, 0.03, 0.08, 0.2, 0.5])  # a share's bin is 0 to 6
#: Features with their number of bins. The first OWN_ONLY are of the line alone, the others also of its neighbours.
OWN_ONLY = [("words", 12), ("stops", 7), ("digits", 7), ("quotes", 7), ("control", 7), ("others", 7), ("word_length", 10), ("distinct", 36), ("first", 12), ("last", 12), ("place", 4), ("gap", 2)]
SHARED = [("length", 16), ("capitals", 7), ("symbols", 7), ("loud", 7), ("rules", 7), ("windows", 7), ("repeats", 4)]
SIZES = [n for _, n in OWN_ONLY + SHARED] + [n + 1 for _, n in SHARED] * 2  # a neighbour may be missing
OFFSETS = np.cumsum([0, *SIZES])
MULTIPLIERS = np.random.default_rng(11).integers(1, 2**63, 1024, dtype=np.uint64) | np.uint64(1)


def share_bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.searchsorted(SHARES, part / np.maximum(whole, 1), side="right")


def bits(n: np.ndarray, most: int) -> np.ndarray:
    """The number of binary digits, at most ``most``."""
    return np.minimum(np.floor(np.log2(np.maximum(n, 0.5))).astype(np.int64) + 1, most)


def mixed(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that are equal only for the same owner."""
    x = (hashes ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def occurrences(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    found = np.empty(len(keys), np.int64)
    found[order] = np.diff(np.append(np.flatnonzero(new), len(keys)))[np.cumsum(new) - 1]
    return found


def words_of(kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where each word begins; a bound of texts ends one too."""
    begins = kinds != WHITE
    solid = begins.copy()
    begins[1:] &= ~solid[:-1]
    inner = bounds[:-1][bounds[:-1] < len(kinds)]
    begins[inner] = solid[inner]
    return np.flatnonzero(begins)


def lines_of(data: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every piece between line feeds and bounds of texts in which a word begins (at ``at``)."""
    feeds = np.flatnonzero(data == 0x0A)
    start = np.concatenate((bounds[:-1], feeds + 1))
    end = np.concatenate((feeds, bounds[1:]))
    start.sort()
    end.sort()
    some = np.searchsorted(at, end) > np.searchsorted(at, start)
    return start[some], end[some], np.searchsorted(bounds, start[some], side="right") - 1


def word_hashes(data: np.ndarray, solid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each word, some megabytes at a time."""
    out = np.empty(len(at), np.uint64)
    stops = np.append(at[1:], len(data))
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(stops, at[first] + CHUNK, side="right")))
        a, b, own = at[first], stops[last - 1], at[first:last] - at[first]
        within = np.arange(b - a) - np.repeat(own, np.diff(np.append(own, b - a)))
        weight = data[a:b] * MULTIPLIERS[within & 1023]
        weight[~solid[a:b]] = 0
        out[first:last] = np.add.reduceat(weight, own)
        first = last
    return out


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of every line of the texts, a row a line; the lines' weights; and how many lines come before each text."""
    kinds = CLASS[data]
    at = words_of(kinds, bounds)
    start, end, text = lines_of(data, bounds, at)
    first_line = np.searchsorted(text, np.arange(len(bounds)))
    if not len(start):
        return np.zeros((0, len(SIZES)), np.int64), np.zeros(0), first_line
    # Segments that alternate between a line and what lies between two lines.
    cuts = np.stack((start, end), 1).reshape(-1)
    count = lambda member: np.add.reduceat(np.append(member, False), cuts, dtype=np.int64)[::2]
    of = {k: count(kinds == k) for k in range(12) if k != LATER}
    latin = np.zeros(len(data), bool)  # capitals from À to Þ
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F)
    capitals = of[UPPER] + count(latin)
    letters = of[UPPER] + of[LOWER] + of[LEAD]
    length = letters + sum(of[k] for k in (DIGIT, STOP, LOUD, QUOTE, SYMBOL, RULE, CONTROL))

    # Words, their hashes, and three-word windows.
    solid = kinds != WHITE
    line = np.searchsorted(start, at, side="right") - 1
    word = word_hashes(data, solid, at)
    n_words = np.bincount(line, minlength=len(start))
    again = occurrences(mixed(word, line))
    distinct = np.bincount(line, weights=1 / again, minlength=len(start))
    window = word * np.uint64(3) + np.roll(word, -1) * np.uint64(0x9E3779B97F4A7C15) + np.roll(word, -2) * np.uint64(0xC2B2AE3D27D4EB4F)
    owner = text[line]
    inside = np.zeros(len(at), bool)
    inside[:-2] = owner[:-2] == owner[2:] if len(at) > 2 else False
    twice = np.zeros(len(at), bool)
    twice[inside] = occurrences(mixed(window[inside], owner[inside])) > 1
    repeated = np.bincount(line, weights=twice, minlength=len(start))
    windows = np.bincount(line, weights=inside, minlength=len(start))
    order = (np.arange(len(at)) - np.searchsorted(line, line)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    line_hash = np.zeros(len(start), np.uint64)
    np.add.at(line_hash, line, word * order)
    same = occurrences(mixed(line_hash, text))

    first = kinds[at[np.searchsorted(line, np.arange(len(start)))]]
    tail = np.searchsorted(at, end) - 1  # each line's last word
    ends = at[tail] + np.add.reduceat(solid, at, dtype=np.int64)[tail] - 1
    alone = np.diff(first_line)[text]
    number = np.arange(len(start)) - first_line[text]
    place = np.where(alone == 1, 0, np.where(number == 0, 1, np.where(number == alone - 1, 2, 3)))
    before = np.append(-1, end[:-1])
    gap = (number > 0) & (start - before > 1)
    bins = {
        "words": bits(n_words, 11),
        "stops": share_bin(of[STOP], length),
        "digits": share_bin(of[DIGIT], length),
        "quotes": share_bin(of[QUOTE], length),
        "control": share_bin(of[CONTROL], length),
        "others": share_bin(of[LEAD], length),
        "word_length": np.minimum(length // np.maximum(n_words, 1), 9),
        "distinct": np.minimum((distinct / np.maximum(n_words, 1) * 5.999).astype(np.int64), 5) * 6 + np.minimum(bits(n_words, 10) // 2, 5),
        "first": first,
        "last": kinds[ends],
        "place": place,
        "gap": gap.astype(np.int64),
        "length": bits(length, 15),
        "capitals": share_bin(capitals, letters),
        "symbols": share_bin(of[SYMBOL], length),
        "loud": share_bin(of[LOUD], length),
        "rules": share_bin(of[RULE], length),
        "windows": share_bin(repeated, windows),
        "repeats": np.minimum(bits(same, 4) - 1, 3),
    }
    own = [bins[name] for name, _ in OWN_ONLY + SHARED]
    missing_before, missing_behind = number == 0, number == alone - 1
    for step, missing in ((1, missing_before), (-1, missing_behind)):
        own += [np.where(missing, n, np.roll(bins[name], step)) for name, n in SHARED]
    return np.stack(own, 1).astype(np.int64) + OFFSETS[:-1], length.astype(float), first_line


def _log_odds(above: float, t: list[list[float]]) -> float:
    """Log odds of good behind a line whose own are ``above``."""
    if above > 0:
        e = math.exp(-above)
        return math.log(math.exp(t[1][1]) + math.exp(t[0][1]) * e) - math.log(math.exp(t[1][0]) + math.exp(t[0][0]) * e)
    e = math.exp(above)
    return math.log(math.exp(t[1][1]) * e + math.exp(t[0][1])) - math.log(math.exp(t[1][0]) * e + math.exp(t[0][0]))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Chain:
    """Weights of features for good (bad has weight 0), and ``next``[label][label behind it]."""

    def __init__(self):
        self.weights = np.zeros(OFFSETS[-1])
        self.next = [[0.0, 0.0], [0.0, 0.0]]
        self.good = self.bad = 0

    def sums(self, s: list[float]) -> tuple[list[float], list[float]]:
        """Log odds of good by all up to each line, and by all behind it."""
        t, ahead, behind = self.next, [], []
        turned = [[t[0][0], t[1][0]], [t[0][1], t[1][1]]]
        come = 0.0
        for x in s:
            ahead.append(come + x)
            come = _log_odds(ahead[-1], t)
        come = 0.0
        for x in reversed(s):
            behind.append(come)
            come = _log_odds(come + x, turned)
        return ahead, behind[::-1]

    def marginals(self, rows: np.ndarray) -> np.ndarray:
        """Each line's probability of being good, of one document."""
        ahead, behind = self.sums(self.weights[rows].sum(1).tolist())
        return sigmoid(np.array(ahead) + np.array(behind))

    def step(self, rows: np.ndarray, label: int, rate: float) -> None:
        """One gradient step of the log likelihood of ``label`` for all lines."""
        s = self.weights[rows].sum(1)
        ahead, behind = self.sums(s.tolist())
        a, b = np.array(ahead), np.array(behind)
        np.add.at(self.weights, rows.reshape(-1), np.repeat(rate * (label - sigmoid(a + b)), rows.shape[1]))
        if len(s) > 1:
            into = s[1:] + b[1:]
            pair = np.array([[self.next[j][k] + a[:-1] * j + into * k for k in (0, 1)] for j in (0, 1)])
            pair = np.exp(pair - pair.max((0, 1)))
            moves = -(pair / pair.sum((0, 1))).sum(2)
            moves[label, label] += len(s) - 1
            self.next = (np.array(self.next) * (1 - rate * DECAY) + rate * moves).tolist()

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> list[float]:
        """The quality of every text between ``bounds``."""
        rows, weight, first = features(data, bounds)
        found, none = [], (self.good + 1) / (self.good + self.bad + 2)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            found.append(float(self.marginals(rows[a:b]) @ weight[a:b] / weight[a:b].sum()) if b > a else none)
        return found


def train(texts: list[str], labels: list[int]) -> Chain:
    chain, rng, examples = Chain(), np.random.default_rng(SEED), []
    for text, label in zip(texts, labels):
        data, bounds = text_bytes(pa.array([text], pa.string()))
        rows = features(data, bounds)[0]
        chain.good, chain.bad = chain.good + label, chain.bad + 1 - label
        if len(rows):
            examples.append((rows, label))
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            rows, label = examples[i]
            chain.step(rows, label, RATE / (1 + 0.5 * epoch) / math.sqrt(len(rows)))
            if i % 64 == 0:
                chain.weights *= 1 - 64 * RATE * DECAY
    return chain


def fit(docs: DataFrame, labels: DataFrame, ids: int = IDS, sample: int = SAMPLE) -> Chain:
    """Learn from the texts of ``docs`` whose id has one quality label in ``labels``; the caller has chosen the rows."""
    quality = F.col("quality").cast("int")
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(quality).alias("_label"), F.max(quality).alias("_most"), F.count("*").alias("_rows"), F.count(quality).alias("_known"))
    chosen = known.where("_label = _most AND _label IN (0, 1) AND _rows = _known").orderBy(F.xxhash64("_id"), "_id").limit(ids).select("_id", "_label")
    found = docs.where(F.length("text") <= SAMPLE_CHARS).select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(chosen), "_id")  # ``ids`` rows at most
    rows = distinct_sample(found, ["text", "_label"], sample)
    return train([r.text for r in rows], [r["_label"] for r in rows])


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in slices(texts):
                found = shared.value.scores(*text_bytes(texts.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held = fold_of(F.col("doc_id"), FOLDS) == HELD_OUT
    chain = fit(docs.where(~held), labels.where(~held))
    return score(docs, chain).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
