"""Names against rules of keywords, by an inverted index of short pieces of text.

A rule has groups of keywords, and fits a name of which every group has at least one keyword inside. Names are cut into
pieces of up to ``PIECE`` characters. Each keyword is looked up by one of its pieces, the one that fewest names hold, and what
is found is held against the name where it lies. A rule then meets only the names of its rarest group of keywords, and is
checked on those as a whole. All joins are on equal pieces, keywords or rules, so work grows with the texts, the places
found and the result, never with names times rules; sides are broadcast by Spark where it measures them small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 3


def pieces(text: Column, size: Column) -> Column:
    """Pieces of ``size`` characters at every place (from 1 on); of size zero the empty piece alone, at place 1."""
    last = F.length(text) - size + 1
    at = F.when(size == 0, F.array(F.lit(1))).when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda p: F.struct(p.cast("int").alias("at"), F.substring(text, p, size).alias("piece")))


def keyword_hits(names: DataFrame, keywords: DataFrame) -> DataFrame:
    """(name, keyword) for every keyword inside a ``low`` of ``names`` (name, low); both sides are distinct."""
    sized = keywords.withColumn("size", F.least(F.length("keyword"), F.lit(PIECE)))
    sizes = sized.select("size").distinct()  # PIECE + 1 rows at most
    cut = names.select("name", "low", F.explode(F.array(*map(F.lit, range(PIECE + 1)))).alias("size")).join(F.broadcast(sizes), "size")
    cut = cut.select("name", "low", "size", F.explode(pieces(F.col("low"), F.col("size"))).alias("p")).select("name", "low", "size", "p.*")
    wanted = sized.select("keyword", "size", F.explode(pieces(F.col("keyword"), F.col("size"))).alias("p")).select("keyword", "size", F.col("p.at").alias("offset"), "p.piece")
    held = cut.join(wanted.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    rarest = wanted.join(held, "piece", "left").groupBy("keyword").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece", "offset")).alias("r"))
    rarest = rarest.where("r.n > 0").select("keyword", "r.piece", "r.offset")
    found = cut.join(rarest, "piece").where(F.substring(F.col("low"), F.col("at") - F.col("offset") + 1, F.length("keyword")) == F.col("keyword"))
    return found.where("at >= offset").select("name", "keyword").distinct()


def matches(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(label, name) of every rule (label, groups: array<array<string>>) and every distinct ``name`` that it fits. A rule
    without groups fits every name; null names and null keywords fit nothing."""
    known = names.select("name").where("name is not null").distinct().withColumn("low", F.lower("name"))
    rules = rules.select("label", "groups").distinct()
    groups = rules.select("label", "groups", F.posexplode(F.when(F.size("groups") > 0, F.col("groups")).otherwise(F.array(F.array(F.lit(""))))).alias("g", "words"))
    words = groups.select("label", "groups", "g", F.explode("words").alias("keyword")).where("keyword is not null")
    hits = keyword_hits(known, words.select("keyword").distinct())
    frequency = hits.groupBy("keyword").agg(F.count("*").alias("n"))
    each = words.join(frequency, "keyword", "left").groupBy("label", "groups", "g").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rarest = each.groupBy("label", "groups").agg(F.min(F.struct("n", "g")).alias("r")).where("r.n > 0").select("label", "groups", F.col("r.g").alias("g"))
    asked = words.join(rarest, ["label", "groups", "g"]).select("label", "groups", "keyword").distinct()
    found = hits.join(asked, "keyword").select("label", "groups", "name").distinct()
    fits = F.forall("groups", lambda g: F.coalesce(F.exists(g, lambda k: F.contains(F.lower("name"), k)), F.lit(False)))
    return found.where(fits).select("label", "name")
