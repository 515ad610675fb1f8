"""Whole yearbooks: the pages of each station by the contents, and its readings with its name.

Input are the placed words of all pages (doc, page, text, x0, top, bottom, page_width, page_height). The contents give each
station the page where it begins, the next one where it ends. A range of pages becomes a row a page, so pages meet their
stations in an equi-join on document and page, whose small side has one row a page. That join is on the keys by which the
words are already dealt out for everything else done with a page: words are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import extract_lines, extract_words

CONTENTS_PAGES = 15  # contents lie within the first pages of a book
CONTENTS_WORDS = ("Table of Contents", "Tide Tables")
TIDE, CURRENT = extract_lines.SECTIONS
CURRENT_PAGES = 4  # pages of a station of the current tables
PAGE = extract_words.PAGE
TASK_WORDS = 400_000  # words that one task reads


def page_texts(words: DataFrame) -> DataFrame:
    """doc, page and the texts of its lines."""
    return extract_words.page_lines(words).select(*PAGE, F.transform("lines", extract_words.line_text).alias("texts"))


def headings(words: DataFrame, pages: DataFrame) -> DataFrame:
    """``pages`` with the texts of the lines that their headers are read from: the first one of a tide page, all of others."""
    first = F.filter("words", lambda w: w["top"] - F.get("words", F.lit(0))["top"] <= extract_words.TOLERANCE)
    rows = extract_words.page_words(words.join(pages.select(*PAGE), PAGE, "left_semi")).join(pages, PAGE)
    rows = rows.withColumn("words", F.when(F.col("section") == TIDE, first).otherwise(F.col("words")))
    return rows.withColumn("texts", F.transform(extract_words.lines_of(F.col("words")), extract_words.line_text)).drop("words")


def contents_pages(words: DataFrame, least: Column) -> DataFrame:
    """The words of each document's contents page, its first page with the words for it. ``least``: the number of a
    document's first page.

    Lines are words with spaces between, so only a page where the longest part of those texts is in a word can have them in a
    line; the lines of other pages are not made."""
    early = words.where(F.col("page") < least + CONTENTS_PAGES)
    for text in CONTENTS_WORDS:
        early = early.join(early.where(F.contains("text", F.lit(max(text.split(" "), key=len)))).select(*PAGE).distinct(), PAGE, "left_semi")
    rows = page_texts(early)
    for text in CONTENTS_WORDS:
        rows = rows.where(F.exists("texts", lambda t: F.contains(t, F.lit(text))))  # noqa: B023
    return words.join(rows.groupBy("doc").agg(F.min("page").alias("page")), PAGE, "left_semi")


def read_contents(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries of contents pages, from the words of their left half, and what leads from printed pages to pages."""
    left = words.where(F.col("x0") < extract_lines.COLUMN_SPLIT_X)
    return extract_lines.contents(extract_words.word_rows(left)), extract_lines.page_offset(words)


def station_pages(entries: DataFrame, offsets: DataFrame, ends: DataFrame) -> DataFrame:
    """A row for each page of each station: doc, page, section, title, first_page.

    A tide station's pages go up to the next one's; those of the last up to the first current station's, or to the
    document's end (``ends``: doc, end, the page behind its last). A current station has ``CURRENT_PAGES`` pages at most."""
    order = Window.partitionBy("doc", "section").orderBy("row")
    first_current = F.min(F.when(F.col("section") == CURRENT, F.struct("row", "printed_page"))).over(Window.partitionBy("doc"))["printed_page"]
    rows = entries.where(F.col("section").isNotNull() & (F.size("tables") == 0)).withColumn("_next", F.coalesce(F.lead("printed_page").over(order), first_current))
    rows = rows.join(offsets.where("offset is not null"), "doc").join(ends, "doc")
    first = F.col("printed_page") + F.col("offset")
    tide_end = F.when(F.col("_next") > 0, F.col("_next") + F.col("offset")).otherwise(F.col("end"))
    rows = rows.withColumns({"first_page": first, "_end": F.least(F.when(F.col("section") == TIDE, tide_end).otherwise(first + CURRENT_PAGES), F.col("end"))})
    pages = F.when(F.col("_end") > F.col("first_page"), F.sequence("first_page", F.col("_end") - 1))
    return rows.select("doc", "section", "title", "first_page", F.explode(pages).alias("page"))


def headed_pages(words: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pages`` that have a header of their section, each with the header of its station's first page; and the stations
    whose first page has none, none of whose pages are in the first frame."""
    texts = headings(words, pages)
    tide, current = extract_lines.tide_header(F.get("texts", F.lit(0))), extract_lines.current_header(F.col("texts"))
    flow = extract_lines.flow_directions(F.array_join("texts", "\n"))
    empty = lambda kind: F.lit(None).cast(kind)
    head = F.when(F.col("section") == TIDE, F.when(tide.isNotNull(), F.struct(tide["name"].alias("name"), tide["timezone"].alias("timezone"), tide["utc_offset"].alias("utc_offset"), tide["year"].alias("year"), empty("int").alias("flood"), empty("int").alias("ebb"))))
    head = head.otherwise(F.when(current.isNotNull(), F.struct(current["name"].alias("name"), empty("string").alias("timezone"), current["utc_offset"].alias("utc_offset"), current["year"].alias("year"), flow["flood"].alias("flood"), flow["ebb"].alias("ebb"))))
    rows = texts.select("doc", "page", "section", "title", "first_page", head.alias("_head"))
    station = Window.partitionBy("doc", "section", "title", "first_page")
    rows = rows.withColumn("station", F.max(F.when(F.col("page") == F.col("first_page"), F.col("_head"))).over(station))
    good = rows.where("_head is not null and station is not null").select("doc", "page", "section", "title", "first_page", "station.*")
    missing = pages.select("doc", "section", "title", "first_page").distinct().join(rows.where("station is not null").select("doc", "section", "title", "first_page").distinct(), ["doc", "section", "title", "first_page"], "left_anti")
    return good, missing


def stations_of(words: DataFrame, section: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The headed pages of all documents, and the stations without a header, from the words of all pages; with ``section``, of
    its stations alone. The pages of the contents are written, as words meet them more than once."""
    bounds = words.groupBy("doc").agg(F.min("page").alias("_least"), (F.max("page") + 1).alias("end"))
    early = words.join(bounds.select("doc", "_least"), "doc")
    entries, offsets = read_contents(written(contents_pages(early, F.col("_least")).drop("_least"), "contents-words"))
    pages = station_pages(entries, offsets, bounds.select("doc", "end"))
    return headed_pages(words, written(pages.where(F.col("section") == section) if section else pages, "station-pages"))


def _dealt(words: DataFrame, pages: DataFrame) -> DataFrame:
    """The words of ``pages``, dealt out by page to a task for each ``TASK_WORDS`` of all words, so that neither a task's memory
    nor its time grows with the books."""
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, -(-words.count() // TASK_WORDS))
    return words.repartition(tasks, *PAGE).join(pages.select(*PAGE), PAGE, "left_semi")


def tide_readings(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Readings of the headed tide ``pages`` with their stations; words of other pages are dropped before anything is read."""
    tides = pages.where(F.col("section") == TIDE)
    found = extract_words.tide_page(_dealt(words, tides))
    return found.join(tides.select(*PAGE, "name", "timezone", "utc_offset", "year"), PAGE)


def current_events(words: DataFrame, pages: DataFrame) -> DataFrame:
    """The same for events of current pages, with the directions of flood and ebb."""
    currents = pages.where(F.col("section") == CURRENT)
    found = extract_words.current_page(_dealt(words, currents))
    return found.join(currents.select(*PAGE, "name", "utc_offset", "year", "flood", "ebb"), PAGE)
