"""Quality rules by cross-document line frequency, in DataFrame functions only (operator 2).

Two kinds of rule decide whether a document stays. Base rules look at one text: its words and the words inside 3-word
windows that the text holds twice or more. The line rule looks across documents: normalised lines are hashed, and for
every host (``source``) the distinct documents that hold a line are counted, where exact copies of a text count once.
A line that more than ``max_share`` of the host's distinct documents hold, and more than ``min_docs`` of them, is
removed; a document is rejected as depleted when less than ``min_left`` of its words are left.

Scale: texts are not shuffled. Line hashes are, once by distinct text and once as partial counts, so a hot host or a
very common line is summed before it moves. Lines above the limit are few: a host has at most (mean lines a
document) / ``max_share`` of them, so they come back as one small array a host. That table is broadcast up to
``BROADCAST_HOSTS`` hosts with ``BROADCAST_LINES`` lines (8 bytes each) in all and joined by shuffle beyond.

Defined cases: a null text has no words and fails the base rules; an empty one likewise; a null source is a host of its
own; repeated rows get equal results; other columns pass through ``apply_rules`` and ``keep`` untouched, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, read_table, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_DOCS, MAX_SHARE, MIN_LEFT = 20, 0.05, 0.3
BROADCAST_HOSTS, BROADCAST_LINES = 10_000, 2_000_000
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    windows = F.when(F.size(words) >= 4, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, covered))

    return let(windows, count)


def base_struct(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    return let(words_of(text), of_words)


def normalised(line: Column) -> Column:
    """Lower case, with each run of white space one space and none at the ends."""
    return F.lower(F.btrim(F.regexp_replace(line, GAP, " "), F.lit(" ")))


def line_hashes(text: Column) -> Column:
    """A hash for every line of the text; null where the line has no word."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: let(normalised(x), lambda y: F.when(y != "", F.xxhash64(y))))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """host and the array ``frequent`` of its line hashes above the limit; hosts without any are absent."""
    host = F.coalesce(F.col("source"), F.lit("")).alias("host")
    each = docs.select(host, F.xxhash64("text").alias("whole"), F.array_compact(F.array_distinct(line_hashes(F.col("text")))).alias("lines"))
    texts = each.groupBy("host", "whole").agg(F.first("lines").alias("lines"))
    # The count of the host's documents travels as a line of its own (null), so one aggregation gives both.
    rows = texts.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "lines")).alias("line"))
    counts = rows.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("line").isNull() | (F.col("n") > min_docs))
    above = written(counts, "line-counts")
    total = above.where("line is null").select("host", F.col("n").alias("docs"))
    found = above.where("line is not null").join(total, "host").where(F.col("n") > F.col("docs") * max_share)
    return found.groupBy("host").agg(F.collect_list("line").alias("frequent"))


def verdict_name(docs: DataFrame) -> str:
    """The column that ``apply_rules`` adds: ``quality``, with underscores behind where ``docs`` has such a column."""
    return fresh(docs.columns, "quality")


def apply_rules(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """All rows and columns of ``docs`` with the struct ``verdict_name(docs)``: base columns, left_words, base_failed,
    depleted, kept, and clean_text (the text without the lines above the limit)."""
    host, frequent, base_, clean_, left_ = (fresh(docs.columns, x) for x in ("_host", "_frequent", "_base", "_clean", "_left"))
    limits = written(frequent_lines(docs, min_docs, max_share).select(F.col("host").alias(host), F.col("frequent").alias(frequent)), "frequent-lines")
    hosts, lines = limits.agg(F.count("*"), F.sum(F.size(frequent))).first()
    if hosts <= BROADCAST_HOSTS and (lines or 0) <= BROADCAST_LINES:
        limits = F.broadcast(limits)
    joined = docs.withColumn(host, F.coalesce(F.col("source"), F.lit(""))).join(limits, host, "left").drop(host)
    text = F.coalesce(F.col("text"), F.lit(""))

    def cleaned(bad: Column) -> Column:
        pairs = F.arrays_zip(F.split(text, "\n").alias("line"), line_hashes(F.col("text")).alias("h"))
        left = F.filter(pairs, lambda x: x["h"].isNull() | ~F.array_contains(bad, x["h"]))
        return F.array_join(F.transform(left, lambda x: x["line"]), "\n")

    clean = F.when(F.col(frequent).isNull() | F.col("text").isNull(), F.col("text")).otherwise(let(F.col(frequent), cleaned))
    rows = joined.withColumn(base_, base_struct(F.col("text"))).withColumn(clean_, clean).drop(frequent)
    n, same = F.col(f"{base_}.n_words"), F.col(clean_).isNull() | (F.col(clean_) == F.col("text"))
    left = F.when(same, n).otherwise(F.size(words_of(F.col(clean_))).cast("long"))
    rows = rows.withColumn(left_, left)
    failed = (n < MIN_WORDS) | (F.col(f"{base_}.n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT)
    depleted = F.col(left_) < n * min_left
    verdict = F.struct(f"{base_}.*", F.col(left_).alias("left_words"), failed.alias("base_failed"), depleted.alias("depleted"), (~failed & ~depleted).alias("kept"), F.col(clean_).alias("clean_text"))
    return rows.withColumn(verdict_name(docs), verdict).drop(base_, clean_, left_)


def keep(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that the rules keep, with the lines above their host's limit taken out of ``text``.

    The filter also reads a row number, which the optimiser does not move: a filter on the verdict alone would be pushed
    below it, and the rules worked out again for each of its terms."""
    quality, row = verdict_name(docs), fresh(docs.columns, "_row")
    rows = apply_rules(docs, min_docs, max_share, min_left).withColumn(row, F.monotonically_increasing_id())
    kept = rows.where(F.col(f"{quality}.kept") & (F.col(row) >= 0))
    return kept.select([F.col(f"{quality}.clean_text").alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return apply_rules(docs).select("doc_id", *(F.col(f"quality.{c}") for c in fields))


#: The same in DuckDB. ``docs`` stands for the table read.
VERDICTS_SQL = r"""
words AS (SELECT doc_id, text, source, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, text, coalesce(source, '') AS host, line, pos, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS norm
  FROM (SELECT doc_id, text, source, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS l FROM docs))),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE norm <> '' GROUP BY doc_id),
hosts AS (SELECT coalesce(source, '') AS host, count(DISTINCT coalesce(text, chr(0))) AS docs FROM docs GROUP BY 1),
frequent AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT text) AS n FROM lines WHERE norm <> '' GROUP BY 1, 2) JOIN hosts USING (host) WHERE n > 20 AND n > docs * 0.05),
rest AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS clean FROM lines LEFT JOIN frequent USING (host, norm) WHERE frequent.norm IS NULL OR frequent.host IS NULL GROUP BY doc_id),
judged AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_concat([''], w), 'string_agg', '')) AS BIGINT) AS word_chars,
    CAST(length(coalesce(d.text, '')) - length(regexp_replace(coalesce(d.text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(regexp_split_to_array(coalesce(clean, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS left_words, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(clean, '') END AS clean
  FROM words d LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN rest USING (doc_id)),
verdicts AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, left_words < n_words * 0.3 AS depleted FROM judged)
"""

OP2_SQL = f"""WITH docs AS (SELECT doc_id, text, source FROM documents), {VERDICTS_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept FROM verdicts"""
