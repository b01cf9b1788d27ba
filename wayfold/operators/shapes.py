"""General relational operators of the library, each over any columns; the gazetteer and the resolver are made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine_km, pair_score, street_score
from wayfold.tables import numbered


def centroids(points: DataFrame, by: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Mean position and number of points of each group, and the score that grows with the number."""
    n = F.count("*")
    return points.groupBy(*by).agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), n.alias("houses")).withColumn("score", street_score(F.col("houses")))


def pair_centroids(places: DataFrame, group: str, id: str, digits: int = 3) -> DataFrame:
    """Unordered pairs of places (lat, lon, houses) of one group: distance, midpoint and score.

    A join on the group; places are already one row a street, so a group is as large as a city's street list.
    """
    a, b = places.alias("a"), places.alias("b")
    joined = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{id}") < F.col(f"b.{id}")))
    fewer = F.least("a.houses", "b.houses")
    return joined.select(
        F.col(f"a.{group}").alias(group), F.col(f"a.{id}").alias("a"), F.col(f"b.{id}").alias("b"),
        F.round(haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), digits).alias("sep_km"),
        ((F.col("a.lat") + F.col("b.lat")) / 2).alias("lat"), ((F.col("a.lon") + F.col("b.lon")) / 2).alias("lon"),
        fewer.alias("fewer"), (F.col("a.houses") + F.col("b.houses")).alias("houses"), pair_score(fewer).alias("score"),
    )


def cooccurring_pairs(links: DataFrame, node: str, item: str) -> DataFrame:
    """Unordered pairs of items that meet at a node, with the number of such nodes.

    Nodes with one item are gone before the self-join (their items can meet nobody).  Map nodes have a few
    street names each; the pairs of a node are the result itself.
    """
    distinct = links.select(node, item).dropna().distinct()
    many = distinct.groupBy(node).agg(F.count("*").alias("__n")).where("__n >= 2").select(node)
    met = distinct.join(many, node, "left_semi")
    a, b = met.alias("a"), met.alias("b")
    both = a.join(b, (F.col(f"a.{node}") == F.col(f"b.{node}")) & (F.col(f"a.{item}") < F.col(f"b.{item}")))
    return both.groupBy(F.col(f"a.{item}").alias("a"), F.col(f"b.{item}").alias("b")).agg(F.count("*").alias("nodes"))


def best_group_of_pairs(members: DataFrame, group: str, item: str, weights: DataFrame, weight: str) -> DataFrame:
    """For each pair of items that share groups the group with the largest weight (then the smallest group)."""
    a, b = members.alias("a"), members.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{item}") < F.col(f"b.{item}")))
    weighed = pairs.select(F.col(f"a.{group}").alias(group), F.col(f"a.{item}").alias("a"), F.col(f"b.{item}").alias("b")).join(weights.select(group, weight), group, "left")
    w = F.coalesce(F.col(weight), F.lit(0))
    return weighed.groupBy("a", "b").agg(F.max_by(F.struct(group, w.alias(weight)), F.struct(w, -F.col(group))).alias("__best")).select("a", "b", f"__best.{group}", f"__best.{weight}")


def first_wins(rows: DataFrame, key: list[str], seq: str | list[str], payload: list[str]) -> DataFrame:
    """One row a key: the payload that came first, and when (the columns ``seq``)."""
    seq = [seq] if isinstance(seq, str) else seq
    first = F.min(F.struct(*seq, *payload)).alias("__first")
    return rows.groupBy(*key).agg(first).select(*key, *(f"__first.{c}" for c in [*seq, *payload]))


def last_wins(rows: DataFrame, key: list[str], seq: str, payload: list[str]) -> DataFrame:
    """One row a key: the last payload, in the place of the first."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*payload), seq).alias("__last"), F.min(seq).alias(seq)).select(*key, seq, "__last.*")


def absent(new: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``present``: what an insert-if-absent appends."""
    return new.join(present.select(*key).distinct(), key, "left_anti")


def nearest_number(asked: DataFrame, known: DataFrame, key: list[str], number: str, id: str) -> DataFrame:
    """For each row of ``asked`` (key, ``number``) the row of ``known`` with the nearest number, ties to the smaller number, then id.

    ``known`` is reduced to one row for each key and number first, so repeated numbers do not multiply the join.
    """
    small = known.where(F.col(number).isNotNull()).groupBy(*key, F.col(number).alias("__found")).agg(F.min(id).alias(id))
    gap = F.abs(F.col(number) - F.col("__found"))
    best = F.min(F.struct(gap.alias("distance"), F.col("__found").alias("found"), F.col(id).alias(id)))
    return asked.join(small, key).groupBy(*key, number).agg(best.alias("__b")).select(*key, number, "__b.found", f"__b.{id}", "__b.distance")


def exact_then_part(asked: DataFrame, known: DataFrame, term: str, name: str, id: str) -> DataFrame:
    """(term, id, how): rows of ``known`` whose name is the term, or, for terms without any, those that hold it.

    Parts are found by the term's first word: names are exploded to their words' beginnings only where a term needs
    them, so the second step is an equi-join as well (a term begins at a word of the name).
    """
    terms = asked.select(term).where(F.col(term) != "").distinct()
    exact = terms.join(known.select(id, name), F.col(term) == F.col(name)).select(term, id, F.lit("exact").alias("how"))
    left = terms.join(exact.select(term).distinct(), term, "left_anti").withColumn("__word", F.substring_index(term, " ", 1))
    words = known.select(id, name, F.explode(F.array_distinct(F.split(name, " "))).alias("__word"))
    part = left.join(words, "__word").where(F.contains(F.concat(F.lit(" "), F.col(name), F.lit(" ")), F.concat(F.lit(" "), F.col(term), F.lit(" "))))
    return exact.union(part.select(term, id, F.lit("part").alias("how")))


def cascade(stages: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first stage that has any, for each key; adds the column stage (from 0)."""
    tagged = [df.withColumn("stage", F.lit(i).cast("long")) for i, df in enumerate(stages)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    first = F.min("stage").over(Window.partitionBy(key))
    return every.withColumn("__first", first).where("stage = __first").drop("__first")


def merge_top(candidates: DataFrame, key: str, same: list[str], k: int = 8) -> DataFrame:
    """The k best by score, then priority, then seq, of each key, the first of those that are the same; adds rank (from 1)."""
    order = [F.col("score").desc(), F.col("priority"), F.col("seq")]
    once = candidates.withColumn("__n", F.row_number().over(Window.partitionBy(key, *same).orderBy(*order))).where("__n = 1").drop("__n")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def slice_then_merge(candidates: DataFrame, key: str, same: list[str], k: int = 8) -> DataFrame:
    """The k best of each key first, then the first of those that are the same (the order of a single text's clues)."""
    order = [F.col("score").desc(), F.col("seq")]
    top = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("rank") <= k)
    return top.withColumn("__n", F.row_number().over(Window.partitionBy(key, *same).orderBy("rank"))).where("__n = 1").drop("__n")


def running_flag(rows: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Adds seen (the flag was set at this row or before it) and any (set anywhere in the group)."""
    w = Window.partitionBy(key)
    so_far = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("seen", F.max(F.coalesce(flag, F.lit(False))).over(so_far)).withColumn("any", F.max(F.coalesce(flag, F.lit(False))).over(w))


def gap_groups(rows: DataFrame, key: list[str], order: list[str], gap: Column) -> DataFrame:
    """Adds line (from 1): a new one wherever ``gap`` (an expression over the row and ``previous``) is true.

    ``previous`` is the first ordering column of the row before.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    marked = rows.withColumn("previous", F.lag(order[0]).over(w)).withColumn("__new", F.coalesce(gap, F.lit(False)).cast("long"))
    total = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("line", total + 1).drop("__new", "previous")


def mode_value(rows: DataFrame, key: str, value: str, seq: list[str], times: str | None = None) -> DataFrame:
    """The most frequent value of each key (``times``: how often a row counts); ties to the longer one, then to the first seen."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg((F.sum(times) if times else F.count("*")).alias("n"), F.min(F.struct(*seq)).alias("__first"))
    order = F.struct((-F.col("n")).alias("a"), (-F.length(value)).alias("b"), F.col("__first"), F.col(value).alias("v"), F.col("n").alias("n"))
    return counts.groupBy(key).agg(F.min(order).alias("__b")).select(key, F.col("__b.v").alias(value), F.col("__b.n").alias("n"))


def keyword_scores(texts: DataFrame, id: str, words: str, names: DataFrame) -> DataFrame:
    """(id, name, score): 5 for a name among the words, 1.5 for each of its parts there, 2 more for the whole name.

    ``names`` (name) is broken into the words that score for it; distinct words of the texts meet these in one join.
    """
    whole = names.select(F.col("name"), F.col("name").alias("__word"), F.lit(7.0).alias("__points"))
    parts = names.select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("__word"), F.lit(1.5).alias("__points"))
    table = whole.union(parts).groupBy("name", "__word").agg(F.sum("__points").alias("__points"))
    met = texts.select(id, F.explode(F.array_distinct(words)).alias("__word")).join(table, "__word")
    return met.groupBy(id, "name").agg(F.sum("__points").alias("score"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) for each table."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.union, counts)


def latency_summary(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Median, and the element at index int(0.95 n) - 1 of the sorted samples (at least the first).

    Samples are numbered over all keys by ranges, so a key with a third of them is spread over tasks as well.
    """
    ranked = numbered(samples.where(F.col(value).isNotNull()).select(key, value), "__at", key, value)
    ends = ranked.groupBy(key).agg(F.min("__at").alias("__first"), F.count("*").alias("__n")).withColumnRenamed(key, "__key")
    rank, n = F.col("__at") - F.col("__first") + 1, F.col("__n")
    at = F.greatest(F.lit(1), F.floor(n * 95 / 100))
    middle = rank.between(F.floor((n + 1) / 2), F.ceil((n + 1) / 2))
    met = ranked.join(ends, F.col(key).eqNullSafe(F.col("__key")))
    return met.groupBy(key).agg(F.avg(F.when(middle, F.col(value))).alias("median"), F.max(F.when(rank == at, F.col(value))).alias("p95"), F.count("*").alias("n"))
