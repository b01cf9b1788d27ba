"""Nearest places on the sphere by cells of a grid, level by level, with an exact stop.

Positions become unit vectors, so that neither poles nor the date line are special, and space is cut into cubes of a
side.  A point meets the places of its cube and the 26 around it in an equi-join.  The nearest one found is the nearest
of all if it is closer than the border of those 27 cubes; other points go on to cubes four times as wide.  The last
level covers the sphere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geo import EARTH_KM, haversine_km
from wayfold.tables import stored

#: Sides of the cubes, in radii of the earth: from about 1.5 km on.
SIDES = (*(4.0**k for k in range(-6, 1)), 2.0)


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    p, l = F.radians(lat), F.radians(lon)
    return [F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p)]


def _cells(side: float) -> list[Column]:
    return [F.floor(F.col(c) / side).cast("int").alias(f"c{c}") for c in "xyz"]


def nearest_places(points: DataFrame, places: DataFrame, id: str, place: str) -> DataFrame:
    """(id, place, km) of each point (id, lat, lon): the nearest of ``places`` (place, lat, lon), ties to the smaller one.

    Distances count to a millimetre.  Rows without a position take no part.  Equal positions are looked up once, so
    copies of a position never meet each other.
    """
    where = ["lat", "lon"]
    xyz = lambda df: df.withColumns(dict(zip("xyz", unit_vector(F.col("lat"), F.col("lon")), strict=True)))
    asked = points.dropna(subset=where).select(id, *where)
    known = stored(xyz(places.dropna(subset=where).groupBy(*where).agg(F.min(place).alias(place))))
    left = stored(xyz(asked.select(*where).distinct()))
    found, step = [], F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1))))
    for side in SIDES:
        around = known.select(place, F.col("lat").alias("plat"), F.col("lon").alias("plon"), *_cells(side))
        for c in ("cx", "cy", "cz"):
            around = around.withColumn("d", step).withColumn(c, F.col(c) + F.col("d")).drop("d")
        inside = [F.col(c) / side - F.floor(F.col(c) / side) for c in "xyz"]
        border = side * (1 + F.least(*inside, *(1 - x for x in inside)))
        km = F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")), 6)
        met = left.select(*where, border.alias("border"), *_cells(side)).join(around, ["cx", "cy", "cz"])
        best = met.groupBy(*where).agg(F.min(F.struct(km.alias("km"), F.col(place).alias("place"))).alias("best"), F.first("border").alias("border"))
        # Straight through the sphere, a little longer than measured, so that rounding never ends the search early.
        chord = 2 * F.sin((F.col("best.km") + 1e-5) / (2 * EARTH_KM))
        sure = stored(best.where((chord <= F.col("border")) | F.lit(side == SIDES[-1])).select(*where, F.col("best.place").alias(place), F.col("best.km").alias("km")))
        found.append(sure)
        if side == SIDES[-1]:
            break
        left = stored(left.join(sure, where, "left_anti"))
        if left.isEmpty():
            break
    return asked.join(reduce(DataFrame.union, found), where).select(id, place, "km")
