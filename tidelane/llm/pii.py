"""Personal data by patterns and a semi-Markov conditional random field (operator 9).

Base spans come from four fixed patterns with their checks (address of mail, of a machine, card, phone). A semi-Markov
model adds spans in other writings, such as a phone number without its plus or a card with dots. A text is cut into
tokens (digit runs, letter runs, single other characters); the model looks at whole runs of digits and separators and at
whole words around at-signs, however long. A
segment is a background token or an entity of at most ``MAX_TOKENS`` tokens; its score is a weight vector over features
of the whole span (digits, groups, separators, checksum, neighbours), plus a weight for two neighbouring types. Dynamic
programming over segment ends picks boundaries and types together. Base spans stay, and a model span may not touch one.

The model is fitted on a bounded sample: the ``SAMPLE`` different texts with a digit or an at-sign, of at most
``SAMPLE_CHARS`` characters, whose hashes are smallest, and their windows of at most ``SAMPLE_TOKENS`` tokens. Base spans
are the labels, in their own writing, rewritten in others that keep their digits, and among up to ``NUMBER_LINES`` lines of plain numbers. Training maximises the conditional likelihood by gradient steps
over forward and backward sums. All texts are then searched whole, where they lie; nothing is shuffled.

Defined cases: a null or empty text has no spans; repeated rows get equal results; a null doc_id stays null; other
columns are ignored; an empty table gives no rows; with no labelled span in the sample only base spans are found.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import distinct_sample, pieces, read_table

KINDS = ("email", "ip", "card", "phone")
# The base patterns (fixed values).
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Pieces of the first two, by which they are found in one pass over any text.
LOCAL, DOMAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED, PART = re.compile(r"[0-9]+(?:\.[0-9]+)*"), re.compile(r"[0-9]+")

DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
RUN = re.compile(r"[(+]?[0-9][0-9 ().+-]{5,}")
GAP = re.compile(r"[\s@]")
MAX_TOKENS, MAX_DIGITS, SAMPLE, SAMPLE_CHARS, SAMPLE_TOKENS, NUMBER_LINES, EPOCHS, RATE, DECAY = 14, 19, 1_500, 100_000, 400, 120, 12, 0.3, 1e-3
PLAIN = frozenset("0123456789 ().+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def mail_spans(text: str) -> list[tuple[int, int]]:
    """What EMAIL finds, from each at-sign outwards."""
    out, end, mark = [], 0, text.find("@")
    while mark >= 0:
        start = mark
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < mark and (m := DOMAIN.match(text, mark + 1)):
            end = m.end()
            out.append((start, end))
        mark = text.find("@", max(end, mark + 1))
    return out


def ip_spans(text: str) -> list[tuple[int, int]]:
    """What IP finds, four by four parts of each run of dotted numbers, where no part is above 255."""
    out = []
    for m in DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts = [(p.start(), p.end()) for p in PART.finditer(text, m.start(), m.end())]
            for i in range(0, len(parts) - 3, 4):
                if all(int(text[a:b].lstrip("0")[:4] or 0) <= 255 for a, b in parts[i : i + 4]):
                    out.append((parts[i][0], parts[i + 3][1]))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns, by kind and then start."""
    out = [("email", *span) for span in mail_spans(text)]
    if DIGIT.search(text):
        out += [("ip", *span) for span in ip_spans(text)]
        for m in CARD.finditer(text):
            d = digits_of(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def plausible(piece: str, kind: str) -> bool:
    """Cheap bounds on a candidate, which keep the lattice small."""
    if kind == "email":
        return "@" in piece and not re.search(r"\s", piece) and piece[0].isalnum() and piece[-1].isalnum()
    if "@" in piece or re.search(r"[^0-9 ().+-]", piece) or not piece[-1].isdigit():
        return False
    n = len(digits_of(piece))
    if kind == "ip":
        return piece[0].isdigit() and piece.count(".") == 3 and n <= 12
    if kind == "card":
        return piece[0].isdigit() and 13 <= n <= 19
    return 9 <= n <= 15 and (piece[0].isdigit() or piece[0] in "+(")


def span_features(text: str, a: int, b: int, kind: str) -> list[str]:
    piece = text[a:b]
    before, after = text[a - 1] if a else "^", text[b] if b < len(text) else "$"
    d = digits_of(piece)
    groups = [len(x) for x in re.findall("[0-9]+", piece)]
    marks = "".join(sorted(set(re.sub(r"[\w]", "", piece))))
    kinds = {"a": before.isalnum(), "d": before == "." or before == "-" or before == "+", "s": before.isspace() or before == "^"}
    ends = {"a": after.isalnum(), "d": after in ".-@" and b + 1 < len(text) and text[b + 1].isalnum(), "s": True}
    out = ["bias", f"n{len(d)}", f"g{len(groups)}", f"m{marks}", f"l{next((k for k, v in kinds.items() if v), 'o')}", f"r{next(k for k, v in ends.items() if v)}"]
    if kind == "card":
        out += [f"luhn{luhn(d)}", f"even{len(set(groups[:-1])) <= 1}"]
    elif kind == "ip":
        out.append(f"octets{all(len(x) < 4 and int(x) < 256 for x in re.findall('[0-9]+', piece))}")
    elif kind == "phone":
        out += [f"shape{'-'.join(map(str, groups))}", f"first{piece[0] if not piece[0].isdigit() else 'd'}", f"balanced{piece.count('(') == piece.count(')')}", f"luhn{len(d) > 12 and luhn(d)}"]
    else:
        host = piece.rsplit("@", 1)[-1]
        out += [f"dots{min(3, host.count('.'))}", f"ats{piece.count('@')}", f"tld{host.rsplit('.', 1)[-1].isalpha()}", f"plain{bool(EMAIL.fullmatch(piece))}"]
    return [f"{kind}:{x}" for x in out]


class Lattice:
    """Candidate segments of one window, by the token at which they end; ``weigh`` keeps a number for their features.

    A candidate is of digits and separators alone, with at most MAX_DIGITS digits, or holds an at-sign, and its place is
    ``free``; others are not looked at."""

    def __init__(self, text: str, start: int, stop: int, weigh=lambda features: features, free=lambda a, b: True):
        tokens = [(start + m.start(), start + m.end()) for m in TOKEN.finditer(text[start:stop])]
        self.n, self.tokens = len(tokens), tokens
        self.ends: dict[int, list] = {}  # end token: (first token, kind index from 1, features or score)
        digits = [b - a if text[a].isdecimal() else 0 if text[a] in PLAIN else -1 for a, b in tokens]
        marks = [i for i, (a, _) in enumerate(tokens) if text[a] == "@"]
        for i in range(self.n):
            head = text[tokens[i][0]]
            if not (head.isalnum() or head in "(+"):
                continue
            at = bisect_left(marks, i)
            mail = marks[at] if at < len(marks) else self.n + MAX_TOKENS
            if digits[i] < 0 and mail >= i + MAX_TOKENS:
                continue
            count, dots, plain = 0, 0, True
            for j in range(i, min(self.n, i + MAX_TOKENS)):
                plain = plain and digits[j] >= 0
                count += max(0, digits[j])
                dots += text[tokens[j][0]] == "."
                kinds = (1,) if j > mail else ()
                if plain:
                    kinds = (2,) * (dots == 3 and 4 <= count <= 12) + (3,) * (13 <= count <= MAX_DIGITS) + (4,) * (9 <= count <= 15)
                if not plain and mail >= i + MAX_TOKENS or plain and count > MAX_DIGITS and mail >= i + MAX_TOKENS:
                    break
                a, b = tokens[i][0], tokens[j][1]
                if not kinds or b - a < 6 or not text[b - 1].isalnum() or not free(a, b):
                    continue
                for k in kinds:
                    if plausible(text[a:b], KINDS[k - 1]):
                        self.ends.setdefault(j + 1, []).append((i, k, weigh(span_features(text, a, b, KINDS[k - 1]))))

    def any(self) -> bool:
        return bool(self.ends)

    def clusters(self) -> list[tuple[int, int]]:
        """Stretches of tokens that candidates cover; all others are background."""
        out: list[list[int]] = []
        for j in sorted(self.ends):
            i = min(x[0] for x in self.ends[j])
            while out and i < out[-1][1]:
                i = min(i, out.pop()[0])
            out.append([i, j])
        return [(a, b) for a, b in out]


class SemiMarkov:
    """Weights of span features and of neighbouring types; type 0 is a background token of weight 0."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.weights = np.zeros(len(names))
        self.next = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
        self.scores: dict[str, float] | None = None

    def score(self, features) -> float:
        if self.scores is None:
            self.scores = dict(zip(self.names, self.weights.tolist()))
        get = self.scores.get
        return sum([get(f, -1.0) for f in features])  # a feature never seen speaks against the span

    def decode(self, lattice: Lattice) -> list[tuple[str, int, int]]:
        """The best segmentation's entities, stretch by stretch: a background token between two makes them independent."""
        out = []
        for first, last in lattice.clusters():
            out += self._decode(lattice, first, last)
        return out

    def _decode(self, lattice: Lattice, first: int, last: int) -> list[tuple[str, int, int]]:
        size = len(KINDS) + 1
        best, back = np.full((last - first + 1, size), -np.inf), {}
        best[0, 0] = 0.0
        for j in range(first + 1, last + 1):
            for i, k, features in [(j - 1, 0, ()), *lattice.ends.get(j, ())]:
                come = best[i - first] + self.next[:, k]
                p = int(come.argmax())
                s = come[p] + ((features if isinstance(features, float) else self.score(features)) if k else 0.0)
                if s > best[j - first, k]:
                    best[j - first, k], back[j, k] = s, (i, p)
        out, j, k = [], last, int((best[-1] + (self.next[:, 0] if last < lattice.n else 0.0)).argmax())
        while j > first:
            i, p = back[j, k]
            if k:
                out.append((KINDS[k - 1], lattice.tokens[i][0], lattice.tokens[j - 1][1]))
            j, k = i, p
        return out[::-1]

    def step(self, lattice: Lattice, gold: set, rate: float) -> None:
        """One gradient step of the conditional log likelihood."""
        size, n = len(KINDS) + 1, lattice.n
        segments = [(j, i, k, [self.names[f] for f in features if f in self.names]) for j in range(1, n + 1) for i, k, features in [(j - 1, 0, ()), *lattice.ends.get(j, ())]]
        values = [self.weights[f].sum() if k else 0.0 for _, _, k, f in segments]
        ahead, behind = np.full((n + 1, size), -np.inf), np.full((n + 1, size), -np.inf)
        ahead[0, 0], behind[n] = 0.0, 0.0
        for (j, i, k, _), v in zip(segments, values):
            ahead[j, k] = np.logaddexp(ahead[j, k], np.logaddexp.reduce(ahead[i] + self.next[:, k]) + v)
        for (j, i, k, _), v in zip(reversed(segments), reversed(values)):
            behind[i] = np.logaddexp(behind[i], self.next[:, k] + v + behind[j, k])
        total = np.logaddexp.reduce(ahead[n])
        grad, trans = np.zeros_like(self.weights), np.zeros_like(self.next)
        for (j, i, k, f), v in zip(segments, values):
            share = np.exp(ahead[i] + self.next[:, k] + v + behind[j, k] - total)
            trans[:, k] -= share
            if k:
                np.add.at(grad, f, -share.sum())
        at, last = 0, 0
        by = {(i, j): (k, f) for j, i, k, f in segments if (KINDS[k - 1] if k else "", lattice.tokens[i][0], lattice.tokens[j - 1][1]) in gold}
        while at < n:
            stop, (k, f) = next(((j, v) for (i, j), v in by.items() if i == at), (at + 1, (0, [])))
            trans[last, k] += 1
            if k:
                np.add.at(grad, f, 1.0)
            at, last = stop, k
        self.weights += rate * (grad - DECAY * self.weights)
        self.next += rate * (trans - DECAY * self.next)
        self.scores = None


def rewritten(text: str, span: tuple, rng) -> tuple[str, tuple] | None:
    """The text with one span in another writing of the same digits, and the new span."""
    kind, a, b = span
    d = digits_of(text[a:b])
    if kind == "phone" and len(d) in (10, 11):
        tail = d[-10:]
        new = rng.choice([f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"{tail[:3]}.{tail[3:6]}.{tail[6:]}", f"({tail[:3]}){tail[3:6]}-{tail[6:]}"])
    elif kind == "card" and len(d) == 16:
        sep = str(rng.choice([".", " ", "-"]))
        new = sep.join(d[i : i + 4] for i in range(0, 16, 4))
    else:
        return None
    new = str(new)
    return text[:a] + new + text[b:], (kind, a, a + len(new))


def mail_window(text: str, at: int) -> tuple[int, int] | None:
    """From ``at`` on, the first at-sign with all that touches it on both sides."""
    mark = text.find("@", at)
    while mark >= 0:
        a, gap = mark, GAP.search(text, mark + 1)
        while a > at and not GAP.match(text[a - 1]):
            a -= 1
        b = gap.start() if gap else len(text)
        if a < mark and mark + 1 < b:
            return a, b
        mark = text.find("@", mark + 1)
    return None


def windows(text: str) -> list[tuple[int, int]]:
    """Whole runs of digits and separators, and whole words around at-signs, from left to right without overlaps."""
    out, at, end = [], 0, (len(text) + 1, 0)
    next_run = lambda: m.span() if (m := RUN.search(text, at)) else end
    run, mail = next_run(), mail_window(text, 0) or end
    while min(run, mail) != end:
        out.append(run if run[0] <= mail[0] else mail)
        at = out[-1][1]
        run = run if run[0] >= at else next_run()
        mail = mail if mail[0] >= at else mail_window(text, at) or end
    return out


def among_numbers(piece: str, kind: str, rng) -> tuple[str, set]:
    """A line of plain numbers around a piece (none, where it is empty), and the piece's span."""
    lists = [" ".join(str(rng.integers(0, 10 ** rng.integers(1, 6))) for _ in range(rng.integers(0, 9))) for _ in range(2)]
    if rng.random() < 0.3:
        lists[0] = " ".join(map(str, range(rng.integers(1, 20), rng.integers(20, 36))))
    a = len(lists[0]) + 1 if lists[0] else 0
    line = " ".join(x for x in (lists[0], piece, lists[1]) if x)
    return line, {(kind, a, a + len(piece))} if piece else set()


def train(texts: list[str], seed: int = 5) -> SemiMarkov:
    """Fit on texts labelled by their base spans."""
    rng, examples = np.random.default_rng(seed), []
    lists: list[tuple] = []
    for text in texts:
        spans = base_spans(text)
        for other in [None, *spans]:
            if other and not (changed := rewritten(text, other, rng)):
                continue
            now, gold = (text, set(spans)) if other is None else (changed[0], {changed[1]})
            if len(lists) < NUMBER_LINES:
                lists.append(among_numbers(now[changed[1][1] : changed[1][2]] if other else "", changed[1][0] if other else "", rng))
            for a, b in windows(now):
                near = {s for s in gold if s[1] >= a and s[2] <= b}
                if other and not near:
                    continue
                lattice = Lattice(now, a, b)
                if lattice.any() and lattice.n <= SAMPLE_TOKENS:
                    examples.append((lattice, near))
    for line, gold in lists:
        if not set(base_spans(line)) - gold:
            for a, b in windows(line):
                lattice = Lattice(line, a, b)
                if lattice.any():
                    examples.append((lattice, gold))
    names: dict[str, int] = {}
    for lattice, _ in examples:
        for segments in lattice.ends.values():
            for _, _, features in segments:
                for f in features:
                    names.setdefault(f, len(names))
    model = SemiMarkov(names)
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            model.step(*examples[i], RATE / (1 + epoch))
    return model


def find(text: str | None, model: SemiMarkov) -> tuple[list, list]:
    """Base spans, and all spans: both by kind and start."""
    text = text or ""
    base = base_spans(text)
    more = []
    if model.names:
        by_start = sorted((a, b) for _, a, b in base)
        starts, reach = [a for a, _ in by_start], [0, *accumulate((b for _, b in by_start), max)]  # furthest end of the first n
        for a, b in windows(text):
            if reach[bisect_right(starts, a)] >= b:
                continue
            lattice = Lattice(text, a, b, model.score, lambda x, y: reach[bisect_left(starts, y)] <= x)
            if lattice.any():
                more += model.decode(lattice)
    every = sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))
    return base, every


def fit(docs: DataFrame, sample: int = SAMPLE) -> SemiMarkov:
    """Fit on at most ``sample`` different texts that hold a digit or an at-sign, of at most SAMPLE_CHARS characters each."""
    rows = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS)).select("text")
    return train([r.text for r in distinct_sample(rows, ["text"], sample)])


def written_out(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, model: SemiMarkov) -> DataFrame:
    """The op9 columns of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches, lambda batch: batch.column(1)):
            found = [find(t, shared.value) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(written_out(base).encode()).hexdigest() for base, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([written_out(x) for _, x in found])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def redact(docs: DataFrame, model: SemiMarkov) -> DataFrame:
    """``docs`` with each span's text replaced by its kind in brackets (overlaps: one replacement, the first kind)."""
    shared, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def clean(text):
        if text is None:
            return None
        out, at = [], 0
        for kind, a, b in sorted(find(text, shared.value)[1], key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"[{kind}]"]
            at = max(at, b)
        return "".join([*out, text[at:]]) if out else text

    def run(batches):
        for batch in pieces(batches, lambda batch: batch.column(columns.index("text"))):
            texts = pa.array([clean(t) for t in batch.column(columns.index("text")).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(i) for i, c in enumerate(columns)], names=columns)

    return docs.mapInArrow(run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return detect(docs, fit(docs))
