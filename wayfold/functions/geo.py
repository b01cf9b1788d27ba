"""Distances, centres and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dp, dl = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dp) * F.sin(dp) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dl) * F.sin(dl)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def street_score(houses: Column) -> Column:
    return F.round(F.greatest(F.lit(0.38), 0.68 - 1.0 / (3.0 + houses)), 4)


def pair_score(fewer_houses: Column) -> Column:
    return F.round(F.greatest(F.lit(0.45), 0.82 - 1.0 / (4.0 + fewer_houses)), 4)


def ordinal_score(distance: Column, houses: Column) -> Column:
    return F.round(F.greatest(F.lit(0.22), 0.52 - 0.06 * distance - 1.0 / (3.0 + houses)), 4)


def house_score(similarity: Column, distance: Column) -> Column:
    """Similarity (0..100) less a step penalty for the difference of numbers (0: the exact house)."""
    penalty = F.when(distance == 0, 0.0).when(distance <= 2, 0.15).when(distance <= 10, 0.25).otherwise(0.35)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity / 100 - penalty)), 4)


def emblem_score(similarity: Column) -> Column:
    return F.round(F.least(F.lit(0.99), similarity), 3)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Scaled to length one; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def percent_text(score: Column) -> Column:
    """0..1 as percent (no decimals from 10 % on, else one); larger numbers with two decimals; null as empty."""
    p = score * 100
    share = F.when(p >= 10, F.format_string("%.0f%%", p)).otherwise(F.format_string("%.1f%%", p))
    return F.when(score.isNull(), "").when(score.between(0, 1), share).otherwise(F.format_string("%.2f", score))
