"""State of the tables that resolving needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.gazetteer import Gazetteer
from wayfold.operators.shapes import table_counts
from wayfold.plans.locate import Seeds


def health(gazetteer: Gazetteer, seeds: Seeds) -> DataFrame:
    """(name, n, empty) of gazetteer and seed tables; empty ones switch their stage off."""
    tables = gazetteer.tables() | {f"seed_{k}": t for k, t in vars(seeds).items() if t is not None}
    return table_counts(tables).withColumn("empty", F.col("n") == 0)
