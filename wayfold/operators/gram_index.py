"""A stored index of names by their runs of characters (grams): names that hold a text, names similar to one.

Tables: ``texts`` (text), ``grams`` (gram, df: names that hold it, parts), ``postings`` (gram, part, text) and
``signatures`` (gram, part, text).  A gram that many names hold is divided into parts of about POSTING names, so that no
key of a join stands for more.

* Names that hold a query hold all its grams: a query meets the postings of its rarest gram only, then the exact test.
* A pattern of n characters with similarity t (a share) to a window of another text lacks at most
  ``most_lost`` of its n - g + 1 grams of size g there: every character of it that is missing spoils g grams, every foreign
  one g - 1.  So it shares one of any most_lost + 1 of its grams, and the rarest are taken (its signature).  Where the
  query is the shorter side its signature meets the postings; names shorter than the query have their signatures stored,
  made for FLOOR.  Grams have two characters where that leaves any, else one.  Candidates are then counted
  (shared grams) and compared.  No match is lost; short patterns meet many names, as the bound is weak there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import text
from wayfold.functions.fuzzy import partial_ratio
from wayfold.tables import stored

#: Names of a gram that stand under one key of a join, about.
POSTING = 10_000
#: Patterns of a task, where each is as many rows as it has grams, about.
PATTERNS = 10_000
#: The lowest similarity (per cent) that can be asked for.
FLOOR = 70


@dataclass
class GramIndex:
    texts: DataFrame
    grams: DataFrame
    postings: DataFrame
    signatures: DataFrame

    def save(self, path: str) -> None:
        """As Parquet tables below ``path``, sorted by gram, so that a look-up reads the row groups of its grams."""
        for name in ("texts", "grams", "postings", "signatures"):
            table = getattr(self, name)
            keys = [c for c in ("gram", "part", "text") if c in table.columns]
            table.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> GramIndex:
        return GramIndex(*(spark.read.parquet(f"{path}/{n}") for n in ("texts", "grams", "postings", "signatures")))


def runs(c: Column, size: Column | int) -> Column:
    """All runs of ``size`` characters in order, repeated ones too."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.length(c) >= size, F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(c, i, size))).otherwise(F.array().cast("array<string>"))


def most_lost(n: Column, size: int, share: float) -> Column:
    """Grams that a pattern of n characters may lack in a window with this similarity.

    With a of its characters missing and b foreign ones (b <= a, windows are no longer than the pattern):
    2 (n - a) >= share (2 n - a + b), and size * a + (size - 1) * b grams are spoilt; the corners of that region bound it.
    """
    return F.floor(F.greatest(size * 2 * (1 - share) / (2 - share) * n, (2 * size - 1) * (1 - share) * n) + 1e-9).cast("int")


def _sized(rows: DataFrame, c: str, share: float) -> DataFrame:
    """``rows`` with the size of grams to use for the pattern ``c`` and how many of them it may lack (least: how many it shares)."""
    n = F.length(c)
    lost = [most_lost(n, k, share) for k in (1, 2)]
    two = lost[1] < n - 1
    return rows.withColumns({"size": F.when(two, 2).otherwise(1), "lost": F.when(two, lost[1]).otherwise(lost[0])}).withColumn("least", n - F.col("size") + 1 - F.col("lost"))


def _signed(rows: DataFrame, c: str, grams: DataFrame, share: float) -> DataFrame:
    """(c, gram, parts): the rarest grams of each pattern (a stored table of distinct ones), as many as make one of them sure.  Unknown grams are the rarest, and meet nothing.

    A pattern is many rows here, so both steps deal patterns to tasks by their number, not by the size of their short texts.
    """
    parts = max(1, -(-rows.count() // PATTERNS))
    patterns = rows.select(c).where(F.length(c) > 0).repartition(parts, c)
    each = _sized(patterns, c, share).withColumn("runs", runs(F.col(c), F.col("size")))
    each = each.select(c, "lost", "runs", F.explode(F.array_distinct("runs")).alias("gram"))
    counted = each.select(c, "lost", "gram", F.size(F.filter("runs", lambda g: g == F.col("gram"))).alias("times")).join(grams, "gram", "left")
    counted = counted.repartition(parts, c)
    before = F.sum("times").over(Window.partitionBy(c).orderBy(F.coalesce("df", F.lit(0)), "gram").rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumn("before", F.coalesce(before, F.lit(0))).where("before <= lost and parts is not null").select(c, "gram", "parts")


def _parted(rows: DataFrame) -> DataFrame:
    """A row for each part of its gram."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def build_index(names: DataFrame, column: str) -> GramIndex:
    """The index of the distinct non-empty values of a column."""
    texts = stored(names.select(F.col(column).alias("text")).where("text <> ''").distinct())
    held = texts.select("text", F.explode(F.concat(*(text.grams(F.col("text"), k) for k in (1, 2, 3)))).alias("gram"))
    grams = stored(held.groupBy("gram").agg(F.count("*").alias("df")).withColumn("parts", F.ceil(F.col("df") / POSTING).cast("int")))
    part = F.pmod(F.xxhash64("text"), F.col("parts")).cast("int").alias("part")
    postings = stored(held.join(grams, "gram").select("gram", part, "text"))
    signatures = stored(_signed(texts, "text", grams, FLOOR / 100).select("gram", part, "text"))
    return GramIndex(texts, grams, postings, signatures)


def names_holding(queries: DataFrame, column: str, index: GramIndex) -> DataFrame:
    """(column, text): the names of the index that hold each distinct query, itself included."""
    size = F.least(F.lit(3), F.length(column))
    asked = queries.select(column).where(F.length(column) > 0).distinct().withColumn("gram", F.explode(F.array_distinct(runs(F.col(column), size))))
    met = asked.join(index.grams, "gram", "left").groupBy(column).agg(F.min_by(F.struct("gram", "parts"), F.struct("df", "gram")).alias("g"), F.count_if(F.col("df").isNull()).alias("unknown"))
    rarest = _parted(met.where("unknown = 0").select(column, "g.*"))
    return rarest.join(index.postings, ["gram", "part"]).where(F.contains("text", F.col(column))).select(column, "text")


def names_similar(queries: DataFrame, column: str, index: GramIndex, least: float) -> DataFrame:
    """(column, text, similarity) of all names with a partial similarity of at least ``least`` (FLOOR or more) to each distinct query."""
    if least < FLOOR:
        raise ValueError(f"the index answers similarities from {FLOOR} on")
    share = least / 100
    asked = stored(queries.select(column).where(F.length(column) > 0).distinct())
    shorter = _parted(_signed(asked, column, index.grams, share)).join(index.postings, ["gram", "part"]).where(F.length(column) <= F.length("text"))
    every = asked.withColumn("gram", F.explode(F.concat(*(text.grams(F.col(column), k) for k in (1, 2)))))
    longer = _parted(every.join(index.grams, "gram").select(column, "gram", "parts")).join(index.signatures, ["gram", "part"]).where(F.length("text") < F.length(column))
    met = shorter.select(column, "text").union(longer.select(column, "text")).distinct()
    q, t = F.col(column), F.col("text")
    met = met.withColumns({"short": F.when(F.length(q) <= F.length(t), q).otherwise(t), "long": F.when(F.length(q) <= F.length(t), t).otherwise(q)})
    shared = F.size(F.filter(runs(F.col("short"), F.col("size")), lambda g: F.contains("long", g)))
    met = _sized(met, "short", share).where(shared >= F.col("least"))
    return met.select(column, "text", partial_ratio("short", "long").alias("similarity")).where(F.col("similarity") >= least)
