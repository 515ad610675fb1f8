"""Whole yearbooks: what is read of which pages, and what a task holds."""

from pyspark.sql import functions as F

from tidelane.operators import extract_words, yearbook

WORDS = "doc string, page int, text string, x0 double, top double, bottom double, page_width double, page_height double"


def placed(spark, rows):
    return spark.createDataFrame([(d, p, t, x, y, y + 8, 620.0, 2200.0) for d, p, t, x, y in rows], WORDS)


def test_lines_keep_their_words_and_order(spark):
    rows = [("a", 1, "b", 20.0, 1.0), ("a", 1, "a", 10.0, 2.9), ("a", 1, "c", 5.0, 3.1), ("a", 1, "d", 1.0, 5.2), ("b", 1, "z", 1.0, 1.0)]
    got = {r["doc"]: r["texts"] for r in yearbook.page_texts(placed(spark, rows)).collect()}
    assert got == {"a": ["a b", "c", "d"], "b": ["z"]}


def test_words_that_are_no_numbers_raise_no_exceptions(spark):
    """Most words are no numbers; a ``try_cast`` of each took three quarters of the time of a page."""
    words = placed(spark, [("a", 1, "Day", 20.0, 80.0)])
    for rows in (extract_words.tide_page(words), extract_words.current_page(words)):
        assert "cast(text#" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_grow_with_the_words(spark, monkeypatch):
    monkeypatch.setattr(yearbook, "TASK_WORDS", 10)
    words = placed(spark, [("a", p, "w", 20.0, 80.0) for p in range(100)])
    pages = words.where("page < 50").select("doc", "page")
    dealt = yearbook._dealt(words, pages)
    assert dealt.count() == 50
    assert dealt.select(F.spark_partition_id()).distinct().count() > 4 and dealt.rdd.getNumPartitions() == 10


def test_headings_of_other_pages_are_not_read(spark):
    """A tide page's heading is its first line, a current page's all lines; pages of neither are left out."""
    rows = [("a", p, t, x, y) for p in (1, 2, 3) for t, x, y in (("two", 30.0, 20.0), ("one", 20.0, 21.0), ("below", 20.0, 30.0))]
    pages = spark.createDataFrame([("a", 1, yearbook.TIDE), ("a", 2, yearbook.CURRENT)], "doc string, page int, section string")
    got = {r["page"]: r["texts"] for r in yearbook.headings(placed(spark, rows), pages).collect()}
    assert got == {1: ["one two"], 2: ["one two", "below"]}
