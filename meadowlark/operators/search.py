"""Filters, orders, pages and projections over event and venue tables (workload: search)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, geo, rules
from ..functions.tags import from_json_list

#: People of one task of a radius join, on average, and tasks that the people of one point are dealt to.
PEOPLE, DEALS = 2000, 8
TOKEN = re.compile(r"[a-z][a-z-]*:[a-z0-9-]+")


def visible() -> Column:
    """hidden is not true; null counts as visible."""
    return ~F.col("hidden").eqNullSafe(True)


def in_window(start: Column | None, end: Column | None = None) -> Column:
    """Overlap with a lower bound (either date reaches it); the upper bound holds for the start alone."""
    out = F.lit(True)
    if start is not None:
        out = out & ((F.col("date_start") >= start) | F.coalesce(F.col("date_end") >= start, F.lit(False)))
    return out if end is None else out & (F.col("date_start") <= end)


def in_scope(scope: str, today: Column) -> Column:
    return in_window(*dates.scope_bounds(scope, today))


def has_all(tokens: list[str], tags: Column) -> Column:
    """All tokens present; malformed tokens are ignored."""
    out = F.lit(True)
    for t in tokens:
        if TOKEN.fullmatch(t):
            out = out & F.array_contains(tags, t)
    return out


def has_any(tokens: list[str], tags: Column) -> Column:
    return F.arrays_overlap(tags, F.array(*[F.lit(t) for t in tokens]))


def lacks(token: str, tags: Column) -> Column:
    return ~F.coalesce(F.array_contains(tags, token), F.lit(False))


def of_disciplines(names: list[str], tags: Column) -> Column:
    """The column is one of the names, or a tag of its slug is there."""
    return F.coalesce(F.col("discipline").isin(names), F.lit(False)) | has_any([f"discipline:{n.lower().replace(' ', '-')}" for n in names], tags)


def default_view(event_type: str | None = None, spectator: bool | None = None, venue_id: int | None = None) -> Column:
    """The chosen type, spectator flag or venue (without hire); with none of them, competitions."""
    if event_type is None and spectator is None and venue_id is None:
        return F.col("event_type") == "competition"
    out = F.lit(True)
    if event_type is not None:
        out = out & (F.col("event_type") == event_type)
    if spectator is not None:
        out = out & F.coalesce(F.col("spectator"), F.lit(False)).eqNullSafe(spectator)
    if venue_id is not None:
        out = out & (F.col("venue_id") == venue_id) & (F.col("event_type") != "venue_hire")
    return out


def mentions(term: str, classes: Column) -> Column:
    """The term, whatever its case, in the name or a class."""
    t = term.lower()
    return F.contains(F.lower("name"), F.lit(t)) | F.contains(F.lower(F.array_join(classes, "\n")), F.lit(t))


def at_venue_named(term: str, venue_name: str = "venue_name") -> Column:
    """The term, whatever its case and without blanks around it, in the venue's name; an empty one lets all pass, also
    events without a venue. The signs % and _ mean themselves."""
    t = term.strip().lower()
    return F.lit(True) if not t else F.coalesce(F.contains(F.lower(venue_name), F.lit(t)), F.lit(False))


def within_box(bounds: tuple[float | None, ...], lat: str = "latitude", lng: str = "longitude") -> Column:
    """south, north, west, east; without one of them everything passes."""
    if any(b is None for b in bounds):
        return F.lit(True)
    return F.col(lat).between(bounds[0], bounds[1]) & F.col(lng).between(bounds[2], bounds[3])


def real_place(name: Column) -> Column:
    """Not one of the names that stand for no place on maps."""
    return ~F.lower(F.trim(name)).isin(rules.MAP_PLACEHOLDERS)


def with_venue(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Left join with the venue's columns as venue_name, postcode, latitude and longitude. The side that fits is
    broadcast by its size; else both are joined by venue_id, skewed ids split by adaptive execution."""
    v = venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name"), "postcode", "latitude", "longitude")
    return events.join(v, "venue_id", "left")


def without_online(miles: float | None, include_online: bool = False) -> Column:
    """Asked within a radius, events of the venue Online go, and those without a venue, unless they are wanted too."""
    return F.lit(True) if miles is None or include_online else F.coalesce(F.col("venue_name") != "Online", F.lit(False))


def public_record(events: DataFrame, venues: DataFrame) -> DataFrame:
    joined = with_venue(events, venues)
    return joined.select(
        "id", "name", "date_start", "date_end", F.coalesce("venue_name", F.lit("Unknown")).alias("venue_name"), F.col("postcode").alias("venue_postcode"),
        "latitude", "longitude", "discipline", "event_type", from_json_list(F.col("tags")).alias("tags"), from_json_list(F.col("classes")).alias("classes"),
    )


def by_effective_date(today: Column) -> list[Column]:
    """Running events sort as if they began today; ties by end, then id."""
    return [F.greatest("date_start", today), F.coalesce("date_end", "date_start"), F.col("id")]


def by_distance(descending: bool = False) -> list[Column]:
    """Unknown distances last ascending and first descending."""
    return [F.desc_nulls_first("distance") if descending else F.asc_nulls_last("distance"), F.col("id")]


def page(df: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """One page of an ordered table with total, pages and page. A number beyond the last page means the last; the
    count is one aggregate, the rows a top-k."""
    total = df.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumns({"total": F.lit(total).cast("long"), "pages": F.lit(pages).cast("long"), "page": F.lit(number).cast("long")})


def near(df: DataFrame, lat: float, lng: float, miles: float) -> DataFrame:
    """Rows with coordinates within the radius, with distance in miles: a box that can be pushed down, then exact."""
    boxed = df.where(within_box(geo.bounding_box(lat, lng, miles)))
    measured = boxed.withColumn("distance", geo.haversine_miles(F.lit(lat), F.lit(lng), F.col("latitude"), F.col("longitude")))
    return measured.where(F.col("distance") <= miles)


def near_each(people: DataFrame, places: DataFrame, miles: float) -> DataFrame:
    """id, place_id, distance for all places within the radius of each person, anywhere on the globe. Points meet first,
    each different one once, by an equi-join on cubes of space: a person's point is sent to the few that the circle can
    reach, a place's is in one, so no pair is made twice; the exact distance decides. Places and people follow by their
    points, so that a pair of them costs a row of a join only. The rows to make are far more than those that meet, so tasks
    are as many as the people ask for (PEOPLE), and those of one point are dealt to several."""
    located = "latitude IS NOT NULL AND longitude IS NOT NULL"
    own = people.where(located).select("id", "latitude", "longitude")
    p = places.where(located).select(F.col("id").alias("place_id"), F.col("latitude").alias("plat"), F.col("longitude").alias("plng"))
    seen = p.select("plat", "plng").distinct().withColumn("cell", geo.cell(F.col("plat"), F.col("plng"), miles))
    spread = own.select("latitude", "longitude").distinct().withColumn("cell", F.explode(geo.cells_around(F.col("latitude"), F.col("longitude"), miles)))
    met = spread.join(seen, "cell").withColumn("distance", geo.haversine_miles(F.col("latitude"), F.col("longitude"), F.col("plat"), F.col("plng")))
    around = met.where(F.col("distance") <= miles).join(p, ["plat", "plng"]).select("latitude", "longitude", "place_id", "distance")
    # a point as one text: Spark deals doubles anew for a join, whatever they have been dealt by
    parts, keys = max(1, -(-own.count() // PEOPLE)), ["point", "deal"]
    point = F.concat_ws(" ", *[F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)) for c in ("latitude", "longitude")])
    dealt = own.select("id", point.alias("point"), F.pmod(F.hash("id"), F.lit(DEALS)).alias("deal")).repartition(parts, *keys)
    around = around.select(point.alias("point"), F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"), "place_id", "distance").repartition(parts, *keys)
    # a merge, since a broadcast would leave all rows to the few tasks of the other side
    return dealt.join(around.hint("merge"), keys).select("id", "place_id", "distance")
