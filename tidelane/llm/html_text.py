"""Main text of web pages by a linear-chain conditional random field over blocks (operator 5).

A page is cut into leaf blocks: runs of text between the starts and ends of block elements, with character references
decoded. Each block has features of its ancestors (tags, roles and words of class and id, by group) and of its text
(length, share inside links, closing mark, place). A linear-chain model labels the blocks main text or not and is
decoded by Viterbi, so a short line among paragraphs or a long one in a menu follows its neighbours.

The model is trained on at most ``SAMPLE`` labelled pages, the different ones with the smallest hashes, of at most
``SAMPLE_CHARS`` characters: pages that say with ``article``, ``main`` or a role what their main text is. A block is labelled main text there if it lies inside such an element and outside menus,
headers, forms and the like. In a part of the training pages the features that name the main element are left out, so
that pages without such marks are read by text, links and neighbours. Extraction reads every whole page where it lies.

Defined cases: null html is empty and gives empty text; a page without a main block gives empty text; markup that is
never closed ends with the page, or is text where it has no end at all; with more than ``DEEPEST`` elements open a new ``li``,
``p`` or the like closes only one among the inmost of them, which changes features, never texts; a header inside an article
is a header, its heading too; repeated rows get equal results; other columns are ignored; an empty table gives no
rows; with no labelled page in the sample a block is main text if it is inside no menu or the like.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import distinct_sample, read_table

SAMPLE, SAMPLE_CHARS, EPOCHS, RATE, DECAY, LEFT_OUT = 400, 200_000, 10, 0.2, 1e-3, 0.35

# HTML's elements by kind, and words of class and id by group.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
GENERIC = frozenset("html body div section center table tbody tr td dd dl dt".split())  # say nothing of what is inside
VOID = frozenset("hr br img input link meta area base col embed source track wbr param".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table menu".split())
NOT_MAIN = frozenset("nav footer header aside form button label option menu dialog fieldset legend".split())
MAIN_WORDS = frozenset("article articlebody main content post entry story body text maincontent".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored banner promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot sidebar side aside widget related recommended"
    " comment comments respond reply replies discussion disqus cookie cookies consent notice alert popup modal overlay subscribe newsletter signup login share sharing social toolbar pagination pager tags copyright legal"
    " search form skip hidden".split()
)
ROLES = {"main": "main", "article": "main", "navigation": "other", "banner": "other", "contentinfo": "other", "complementary": "other", "search": "other", "dialog": "other", "alert": "other", "form": "other"}

RAW = frozenset("script style noscript template svg textarea iframe object title select".split())  # read over whole

NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
INSIDE = re.compile(r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+")
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
DEEPEST = 512  # open elements looked through for one that a new element closes
CACHED_CHARS = 300
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|style)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)


def element(tag: str, attributes: str) -> tuple[str, ...]:
    """Feature names that an element gives to the blocks inside it; short attributes are looked at once."""
    return _short_element(tag, attributes) if len(attributes) <= CACHED_CHARS else _element(tag, attributes)


@lru_cache(20_000)
def _short_element(tag: str, attributes: str) -> tuple[str, ...]:
    return _element(tag, attributes)


def _element(tag: str, attributes: str) -> tuple[str, ...]:
    out = set() if tag in GENERIC else {f"in={tag}"}
    if tag in NOT_MAIN:
        out.add("group=other")
    if tag in ("article", "main"):
        out.add("group=main")
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    out.add("group=other")
            elif name == "role":
                if value in ROLES:
                    out.add(f"group={ROLES[value]}")
            else:
                words = set(re.findall("[a-z]+", value))
                if words & OTHER_WORDS:
                    out.add("group=other")
                elif words & MAIN_WORDS:
                    out.add("word=main")
                    if name == "itemprop" and "articlebody" in words:
                        out.add("group=main")
        if re.search(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true", attributes, re.I):
            out.add("group=other")
    return tuple(sorted(out))


def markup(html: str):
    """(start, end, closing, tag, attributes) of every piece of markup in turn; the tag is empty for comments, declarations
    and elements that are read over whole. One pass: what is searched for in vain once is not searched for again."""
    at, end, last, quotes = html.find("<"), len(html), html.rfind(">"), True
    while at >= 0:
        stop, closing, tag, attributes = at, "", "", ""
        if html.startswith("<!--", at):
            close = html.find("-->", at + 4)
            stop = end if close < 0 else close + 3
        elif html.startswith(("<!", "<?"), at):
            stop = html.find(">", at) + 1 if at < last else at
        elif at < last and (m := NAME.match(html, at + 1)):
            close = INSIDE.match(html, m.end()).end() if quotes else end
            if close >= end or html[close] != ">":  # a quote that is never closed: from here on quotes say nothing
                quotes, close = False, html.find(">", m.end())
            stop, closing, tag, attributes = close + 1, m[1], m[2].lower(), html[m.end() : close]
            if tag in RAW:
                if not closing:
                    ends = CLOSING[tag].search(html, stop)
                    stop = end if not ends else html.find(">", ends.end()) + 1 if ends.end() <= last else end
                tag = ""
        if stop > at:
            yield at, stop, closing, tag, attributes
        at = html.find("<", max(stop, at + 1))


def blocks(html: str) -> list[tuple[str, str, frozenset, float]]:
    """(text, tag, features of the ancestors, share of characters inside links) of every leaf block with text."""
    out, stack, parts, opened = [], [], [], Counter()
    linked = in_link = at = 0
    empty = frozenset()

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, stack[-1][0] if stack else "", stack[-1][1] if stack else empty, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if in_link:
                linked += len(raw.strip())

    def close(i: int):
        opened.subtract(name for name, _ in stack[i:])
        del stack[i:]

    for start, stop, closing, tag, attributes in markup(html):
        add(html[at:start])
        at = stop
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        in_link = 0
        if closing:
            if opened[tag] > 0:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in VOID:
            continue
        ends = CLOSES.get(tag, ())
        for i in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEPEST), -1):
            name = stack[i][0]
            if name == "p" or name in ends:
                close(i)
            if name in SCOPES or name not in ("p", *ends) and not ends:
                break
        above = stack[-1][1] if stack else empty
        stack.append((tag, above.union(element(tag, attributes))))
        opened[tag] += 1
    add(html[at:])
    flush()
    return out


def own_features(text: str, tag: str, links: float, place: float) -> list[str]:
    n = len(text)
    return [
        f"tag={'block' if tag in GENERIC else tag}",
        f"long={min(7, n.bit_length())}",
        f"links={'none' if links == 0 else 'some' if links < 0.5 else 'most'}",
        f"links={links >= 0.5}&long={min(7, n.bit_length())}",
        f"ends={text[-1] in '.!?…»”\"'}",
        f"sign={'©' in text}",
        f"place={int(place * 4)}",
    ]


def features(page: list) -> list[list[str]]:
    last = max(1, len(page) - 1)
    return [["bias", *above, *own_features(text, tag, links, i / (last + 1))] for i, (text, tag, above, links) in enumerate(page)]


def labels(page: list) -> list[bool] | None:
    """True for main text; None where the page does not say."""
    if not any("group=main" in above for _, _, above, _ in page):
        return None
    return ["group=main" in above and "group=other" not in above for _, _, above, _ in page]


def _log_add(a: float, b: float) -> float:
    high = max(a, b)
    return high + math.log1p(math.exp(min(a, b) - high))


class Chain:
    """Weights of block features for main text (the other label has weight 0) and of neighbouring labels."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.next = [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, page: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in block]) for block in page]

    def decode(self, page: list[list[str]]) -> list[bool]:
        if not self.weights:
            return ["group=other" not in block for block in page]
        t, back, best = self.next, [], None
        for s in self.scores(page):
            if best is None:
                best = [0.0, s]
                continue
            come = [0 if best[0] + t[0][k] >= best[1] + t[1][k] else 1 for k in (0, 1)]
            back.append(come)
            best = [best[come[k]] + t[come[k]][k] + (s if k else 0.0) for k in (0, 1)]
        if best is None:
            return []
        path = [int(best[1] > best[0])]
        for come in reversed(back):
            path.append(come[path[-1]])
        return [bool(x) for x in reversed(path)]

    def step(self, page: list[list[str]], gold: list[bool], rate: float) -> None:
        """One gradient step of the conditional log likelihood."""
        s, t, n = self.scores(page), self.next, len(page)
        ahead = [[0.0, s[0]]]
        for i in range(1, n):
            ahead.append([_log_add(ahead[-1][0] + t[0][k], ahead[-1][1] + t[1][k]) + (s[i] if k else 0.0) for k in (0, 1)])
        behind = [[0.0, 0.0]]
        for i in range(n - 1, 0, -1):
            behind.append([_log_add(t[j][0] + behind[-1][0], t[j][1] + s[i] + behind[-1][1]) for j in (0, 1)])
        behind.reverse()
        total = _log_add(ahead[-1][0], ahead[-1][1])
        moves = [[0.0, 0.0], [0.0, 0.0]]
        for i, block in enumerate(page):
            p = math.exp(ahead[i][1] + behind[i][1] - total)
            d = rate * (gold[i] - p)
            for f in block:
                w = self.weights.get(f, 0.0)
                self.weights[f] = w + d - rate * DECAY * w
            if i:
                moves[gold[i - 1]][gold[i]] += 1
                for j in (0, 1):
                    for k in (0, 1):
                        moves[j][k] -= math.exp(ahead[i - 1][j] + t[j][k] + (s[i] if k else 0.0) + behind[i][k] - total)
        self.next = [[t[j][k] + rate * (moves[j][k] - DECAY * t[j][k]) for k in (0, 1)] for j in (0, 1)]


def train(pages: list[str], seed: int = 3) -> Chain:
    rng, examples, chain = np.random.default_rng(seed), [], Chain()
    for html in pages:
        page = blocks(html)
        gold = labels(page)
        if gold:
            examples.append((features(page), gold))
    marks = ("group=main", "word=main", "in=article", "in=main")
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            page, gold = examples[i]
            if rng.random() < LEFT_OUT:
                page = [[f for f in block if f not in marks] for block in page]
            chain.step(page, gold, RATE / (1 + 0.5 * epoch))
    return chain


def main_text(html: str | None, chain: Chain) -> str:
    page = blocks(html or "")
    return "\n\n".join(text for (text, *_), keep in zip(page, chain.decode(features(page))) if keep)


def fit(pages: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fit on at most ``sample`` different labelled pages of at most SAMPLE_CHARS characters."""
    marked = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b|role\s*=\s*.?(main|article)|articleBody") & (F.length("html") <= SAMPLE_CHARS))
    return train([r.html for r in distinct_sample(marked, ["html"], sample)])


def extract(pages: DataFrame, chain: Chain) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for batch in batches:
            texts = [main_text(h, shared.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
