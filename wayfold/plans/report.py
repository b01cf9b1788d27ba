"""A text report: row counts of the tables, latency by class, share of passed regression cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.gazetteer import Gazetteer
from wayfold.operators.shapes import latency_summary
from wayfold.plans.health import health
from wayfold.plans.locate import Seeds
from wayfold.plans.regression import summary


def report(gazetteer: Gazetteer, seeds: Seeds, samples: DataFrame | None = None, results: DataFrame | None = None) -> DataFrame:
    """(nth, line); ``samples`` (class, ms) and ``results`` (ok) add their parts."""
    parts = [health(gazetteer, seeds).select(F.concat(F.lit("1 "), "name").alias("nth"), F.format_string("%s: %d rows", "name", "n").alias("line"))]
    if samples is not None:
        timed = latency_summary(samples, "class", "ms")
        parts.append(timed.select(F.concat(F.lit("2 "), "class").alias("nth"), F.format_string("%s: median %.2f ms, p95 %.2f ms of %d", "class", "median", "p95", "n").alias("line")))
    if results is not None:
        share = F.when(F.col("cases") > 0, 100 * F.col("passed") / F.col("cases")).otherwise(0.0)
        parts.append(summary(results).select(F.lit("3").alias("nth"), F.format_string("cases passed: %d of %d (%.1f %%)", "passed", "cases", share).alias("line")))
    return reduce(DataFrame.union, parts)
