"""Regression cases over resolved answers, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import normalize
from wayfold.sources.seeds import csv_rows, split_list


def verdict(kind: Column, name: Column, kinds: Column, parts: Column, others: Column) -> Column:
    """Whether the kind is one of ``kinds``, and the name holds all ``parts`` and none of ``others``; null answers fail."""
    right_kind = (F.size(kinds) == 0) | F.array_contains(kinds, kind)
    return F.coalesce(right_kind & F.forall(parts, lambda p: F.contains(name, p)) & ~F.exists(others, lambda p: F.contains(name, p)), F.lit(False))


def cases(spark, path: str) -> DataFrame:
    """Enabled cases: id, manual_text and what is expected."""
    columns = ["id", "enabled", "expect_kind", "expect_contains_all", "expect_not_contains", "manual_text", "note"]
    rows = csv_rows(spark, path, columns).where(~F.lower(F.trim(F.coalesce("enabled", F.lit("1")))).isin("0", "false", "no", "off"))
    return rows.select("id", "manual_text", *(split_list(c).alias(c) for c in columns[2:5]))


def checked(cases: DataFrame, best: DataFrame) -> DataFrame:
    """id, kind, name and ok of each case; ``best``: id, kind, name of the best answers."""
    parts = lambda c: F.transform(c, normalize)
    ok = verdict(F.col("kind"), normalize(F.col("name")), F.col("expect_kind"), parts(F.col("expect_contains_all")), parts(F.col("expect_not_contains")))
    return cases.join(best, "id", "left").select("id", "kind", "name", (ok & F.col("name").isNotNull()).alias("ok"))


def summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("ok").alias("passed"), F.count("*").alias("cases"))
