"""Distances and coordinate checks as column expressions."""

from __future__ import annotations

from math import cos, pi, radians, sin

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radius in miles, miles of a degree of latitude, margin of bounding boxes.
EARTH_MILES, DEGREE_MILES, MARGIN = 3958.8, 69.0, 1.1
#: The boxes in which coordinates count as British, for the geocoder and for the seed validator.
UK_BOX = (49.0, 61.0, -11.0, 2.0)
SEED_BOX = (49.0, 61.5, -11.0, 2.5)


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * EARTH_MILES


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float] = UK_BOX) -> Column:
    """Within the box and not (0, 0); false for nulls."""
    south, north, west, east = box
    return F.coalesce(lat.between(south, north) & lng.between(west, east) & ~((lat == 0) & (lng == 0)), F.lit(False))


def bounding_box(lat: float, lng: float, miles: float) -> tuple[float, float, float, float]:
    """south, north, west, east of a box that holds the circle, with a margin."""
    d = miles * MARGIN / DEGREE_MILES
    e = d / max(cos(radians(lat)), 0.01)
    return lat - d, lat + d, lng - e, lng + e


def _reach(miles: float) -> float:
    """The chord of a distance on the unit sphere, and a little more."""
    return 2 * sin(min(pi / 2, miles / EARTH_MILES / 2)) * 1.000001 + 1e-9


def _axes(lat: Column, lng: Column) -> list[Column]:
    """A place as a point of the unit sphere. There are no edges: places across the 180th meridian or around a pole are
    as near to each other as anywhere."""
    return [F.cos(F.radians(lat)) * F.cos(F.radians(lng)), F.cos(F.radians(lat)) * F.sin(F.radians(lng)), F.sin(F.radians(lat))]


def cell(lat: Column, lng: Column, miles: float) -> Column:
    """The cube of space that holds a place; its edge is twice the chord of the distance."""
    edge = 2 * _reach(miles)
    return F.struct(*[F.floor(x / edge).alias(n) for x, n in zip(_axes(lat, lng), "xyz", strict=True)])


def cells_around(lat: Column, lng: Column, miles: float) -> Column:
    """The cubes that a place within the distance can be in: at most two along each axis, fewer on average, and only
    those that the sphere's surface passes through."""
    reach = _reach(miles)
    edge = 2 * reach
    spans = [F.sequence(F.floor((x - reach) / edge), F.floor((x + reach) / edge)) for x in _axes(lat, lng)]

    def surface(c: Column) -> Column:
        low = [F.greatest(c[n] * edge, -(c[n] + 1) * edge, F.lit(0.0)) for n in "xyz"]
        high = [F.greatest(F.abs(c[n] * edge), F.abs((c[n] + 1) * edge)) for n in "xyz"]
        squares = lambda v: v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
        return (squares(low) <= 1.000001) & (squares(high) >= 0.999999)

    every = F.flatten(F.flatten(F.transform(spans[0], lambda x: F.transform(spans[1], lambda y: F.transform(spans[2], lambda z: F.struct(x.alias("x"), y.alias("y"), z.alias("z")))))))
    return F.filter(every, surface)


def coordinates_in(text: Column) -> tuple[Column, Column]:
    """(latitude, longitude) from "latitude":"…" fields, data-lat attributes or a map link, in that order."""

    def first(name: str, short: str, at: int) -> Column:
        number = r"(-?\d+(?:\.\d+)?)"
        options = [rf'"{name}"\s*:\s*"?{number}', rf'data-{short}="{number}"']
        cast = [F.regexp_extract(text, p, 1).try_cast("double") for p in options]
        return F.coalesce(*cast, F.regexp_extract(text, rf"maps/@{number},{number}", at).try_cast("double"))

    return first("latitude", "lat", 1), first("longitude", "lng", 2)
