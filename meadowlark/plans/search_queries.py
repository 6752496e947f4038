"""Queries of the search workload: filters (P), orders and pages (O), and set operations (U)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, dates, geo, rules, text
from ..functions.tags import from_json_list
from ..operators import search as S
from ..sources import feeds
from ..operators.scans import numbered
from .demo import TODAY
from .registry import query

T = f"DATE '{TODAY}'"
#: Lists of tags and classes from their JSON text in DuckDB.
TAGS = "coalesce(TRY_CAST(CASE WHEN json_valid(tags) THEN tags END AS VARCHAR[]), [])"
LISTS = "coalesce(from_json(CASE WHEN json_valid({0}) AND json_type({0}) = 'ARRAY' THEN {0} END, '[\"VARCHAR\"]'), [])"
TAGS, CLASSES = LISTS.format("tags"), LISTS.format("classes")
DIST = "2 * atan2(sqrt({a}), sqrt(1 - ({a}))) * 3958.8"


def miles(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2)"
    return DIST.format(a=a)


HOME = (52.0, -1.5)
JOINED = "SELECT e.*, v.name AS venue_name, v.postcode, v.latitude, v.longitude FROM event e LEFT JOIN venue v ON e.venue_id = v.id"


@query("P1_visible_only", "SELECT id, hidden FROM event WHERE hidden IS NULL OR NOT hidden")
def _(t):
    return t.event.where(S.visible()).select("id", "hidden")


@query("P2_date_window", f"SELECT id, date_start, date_end FROM event WHERE (date_start >= {T} OR coalesce(date_end >= {T}, false)) AND date_start <= DATE '1998-09-01'")
def _(t):
    return t.event.where(S.in_window(t.today(), F.lit("1998-09-01").cast("date"))).select("id", "date_start", "date_end")


@query(
    "P3_date_scopes",
    f"""WITH b(scope, lo, hi) AS (VALUES ('upcoming', {T}, NULL), ('today', {T}, {T}), ('weekend', DATE '1998-06-06', DATE '1998-06-07'), ('week', {T}, DATE '1998-06-07'), ('month', {T}, DATE '1998-06-30'))
    SELECT scope, count(*) AS n, min(id) AS first_id FROM event JOIN b ON (date_start >= lo OR coalesce(date_end >= lo, false)) AND (hi IS NULL OR date_start <= hi) GROUP BY scope""",
)
def _(t):
    parts = [t.event.where(S.in_scope(s, t.today())).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).withColumn("scope", F.lit(s)) for s in ("upcoming", "today", "weekend", "week", "month")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("P4_tags_all", f"SELECT id FROM event WHERE list_contains({TAGS}, 'discipline:dressage') AND list_contains({TAGS}, 'discipline:polo')")
def _(t):
    return t.event.where(S.has_all(["discipline:dressage", "discipline:polo", "Not A Token"], from_json_list(F.col("tags")))).select("id")


@query("P5_tag_excluded", f"SELECT id FROM event WHERE NOT list_contains({TAGS}, 'affiliation:nsea')")
def _(t):
    return t.event.where(S.lacks("affiliation:nsea", from_json_list(F.col("tags")))).select("id")


@query("P6_tags_any", f"SELECT id FROM event WHERE list_has_any({TAGS}, ['affiliation:nsea', 'tier:elite'])")
def _(t):
    return t.event.where(S.has_any(["affiliation:nsea", "tier:elite"], from_json_list(F.col("tags")))).select("id")


@query("P7_disciplines", f"SELECT id, discipline FROM event WHERE coalesce(discipline IN ('Show Jumping', 'Polo'), false) OR list_has_any({TAGS}, ['discipline:show-jumping', 'discipline:polo'])")
def _(t):
    return t.event.where(S.of_disciplines(["Show Jumping", "Polo"], from_json_list(F.col("tags")))).select("id", "discipline")


@query("P8_default_view", "SELECT id, 'default' AS view FROM event WHERE event_type = 'competition' UNION ALL SELECT id, 'watch' FROM event WHERE coalesce(spectator, false) UNION ALL SELECT id, 'show' FROM event WHERE event_type = 'show'")
def _(t):
    views = (("default", {}), ("watch", {"spectator": True}), ("show", {"event_type": "show"}))
    a, b, c = (t.event.where(S.default_view(**k)).select("id", F.lit(n).alias("view")) for n, k in views)
    return a.union(b).union(c)


@query("P9_venue", "SELECT id, venue_id FROM event WHERE venue_id = 32 AND event_type <> 'venue_hire' UNION ALL SELECT e.id, venue_id FROM event e JOIN venue v ON v.id = venue_id WHERE v.name IN ('Hickstead 8', 'Online')")
def _(t):
    by_id = t.event.where(S.default_view(venue_id=32)).select("id", "venue_id")
    return by_id.union(S.with_venue(t.event, t.venue).where(F.col("venue_name").isin("Hickstead 8", "Online")).select("id", "venue_id"))


@query("P10_text_search", f"SELECT id, name FROM event WHERE contains(lower(name), 'foxhunter') OR contains(lower(array_to_string({CLASSES}, chr(10))), 'foxhunter')")
def _(t):
    return t.event.where(S.mentions("Foxhunter", from_json_list(F.col("classes")))).select("id", "name")


@query("P10_export_search", f"SELECT id, venue_name FROM ({JOINED}) WHERE (date_start >= {T} OR date_end >= {T}) AND contains(lower(venue_name), 'onley')")
def _(t):
    """The export's search: running and coming events at venues whose name has the text."""
    rows = S.with_venue(t.event, t.venue).where(S.in_window(t.today()) & S.at_venue_named(" Onley "))
    return rows.select("id", "venue_name")


#: Terms of all kinds: long, short, with signs, and one that no text has.
TERMS = ("Foxhunter", "show", "qual", "c&", "&", " f", "Area Final", "no such thing")


@query("P10_text_index", f"SELECT term, id FROM event, (SELECT unnest([{', '.join(repr(x.lower()) for x in TERMS)}]) AS term) WHERE contains(lower(name || chr(10) || array_to_string({CLASSES}, chr(10))), term)")
def _(t):
    """The same search by an index of trigrams, which several terms use."""
    from ..operators.storage import scratch
    from ..operators.textindex import TextIndex

    text = F.concat("name", F.lit("\n"), F.array_join(from_json_list(F.col("classes")), "\n"))
    index = TextIndex.build(t.event.select("id", text.alias("text")), scratch(t.spark, "index"))
    return reduce(DataFrame.union, [index.find(x).select(F.lit(x.lower()).alias("term"), "id") for x in TERMS])


@query("P11_source_filter", "SELECT e.id, s.name AS source_name FROM event e JOIN source s ON s.id = e.source_id WHERE s.name IN ('Feed 3', 'Feed 7')")
def _(t):
    s = t.source.where(F.col("name").isin("Feed 3", "Feed 7")).select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return t.event.join(s, "source_id").select("id", "source_name")


@query("P12_without_online", f"SELECT 'radius' AS asked, id FROM ({JOINED}) WHERE venue_name <> 'Online' UNION ALL SELECT 'radius with online', id FROM ({JOINED}) UNION ALL SELECT 'everywhere', id FROM ({JOINED})")
def _(t):
    j = S.with_venue(t.event, t.venue)
    asked = (("radius", 25.0, False), ("radius with online", 25.0, True), ("everywhere", None, False))
    a, b, c = (j.where(S.without_online(miles, include)).select(F.lit(name).alias("asked"), "id") for name, miles, include in asked)
    return a.union(b).union(c)


@query("P13_viewport", "SELECT id, latitude, longitude FROM venue WHERE latitude BETWEEN 51 AND 53.5 AND longitude BETWEEN -3 AND 0")
def _(t):
    return t.venue.where(S.within_box((51.0, 53.5, -3.0, 0.0))).where(S.within_box((None, 1.0, 1.0, 1.0))).select("id", "latitude", "longitude")


@query("P14_real_places", "SELECT id, name FROM venue WHERE lower(trim(name)) NOT IN ('tbc', 'tba', 'tbd', 'various', 'unknown', 'online')")
def _(t):
    return t.venue.where(S.real_place(F.col("name"))).select("id", "name")


@query(
    "P15_public_record",
    f"SELECT id, name, date_start, date_end, coalesce(venue_name, 'Unknown') AS venue_name, postcode AS venue_postcode, latitude, longitude, discipline, event_type, array_to_string({TAGS}, ';') AS tags, array_to_string({CLASSES}, ';') AS classes FROM ({JOINED})",
)
def _(t):
    return S.public_record(t.event, t.venue).withColumn("tags", F.array_join("tags", ";")).withColumn("classes", F.array_join("classes", ";"))


@query(
    "P16_validity_gate",
    "SELECT batch_seq, TRY_CAST(date_start AS DATE) AS date_start, TRY_CAST(date_end AS DATE) AS date_end, CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url END AS url FROM extracted WHERE TRY_CAST(date_start AS DATE) IS NOT NULL",
)
def _(t):
    from ..operators.ingest import gate

    return gate(t.extracted).select("batch_seq", "date_start", "date_end", "url")


@query(
    "P17_unlocatable",
    r"SELECT batch_seq, venue_name, venue_postcode FROM extracted WHERE NOT (lower(trim(coalesce(venue_name, ''))) IN ('tbc', 'tba', 'tbd', 'various', 'unknown', '') AND NOT coalesce(regexp_matches(trim(venue_postcode), '^(?i)([A-Z]{1,2}[0-9][A-Z0-9]?)\s*([0-9][A-Z]{2})\.?$'), false))",
)
def _(t):
    from ..operators.ingest import locatable

    return t.extracted.where(locatable(F.col("venue_name"), F.col("venue_postcode"))).select("batch_seq", "venue_name", "venue_postcode")


PAID = r"""regexp_matches(n, '\b(payt|balance due|deposits|camp deposit|booking deposit)\b') OR regexp_matches(n, '[-–(/:] *deposit\b')
 OR regexp_matches(n, '\b(final|first|second|third|fourth|fifth|sixth|[0-9]{1,2}(st|nd|rd|th)?) (payment|payments|instalment|instalments|installment|installments)\b')"""


@query("P18_hidden_flag", rf"SELECT id, coalesce(date_end - date_start > 120, false) OR {PAID} AS hide FROM (SELECT *, regexp_replace(lower(name), '\s+', ' ', 'g') AS n FROM event)")
def _(t):
    return t.event.select("id", classify.is_hidden(F.col("name"), F.col("date_start"), F.col("date_end")).alias("hide"))


@query("P19_irrelevant_rows", "SELECT id FROM event WHERE NOT (id % 3 = 0 AND id % 9 <> 0) AND NOT coalesce(event_type = 'training', false) AND id % 4 <> 1")
def _(t):
    status = F.when(F.col("id") % 9 == 0, "open").when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, " X ").otherwise("Cancelled"))
    country = F.when(F.col("id") % 4 == 1, "FRA").when(F.col("id") % 4 == 2, "GBR")
    return feeds.relevant(t.event.withColumns({"status": status, "country": country})).select("id")


@query("P20_still_running", f"SELECT batch_seq FROM extracted WHERE coalesce(TRY_CAST(coalesce(date_end, date_start) AS DATE) >= {T}, true)")
def _(t):
    return t.extracted.where(dates.still_running(F.col("date_start"), F.col("date_end"), t.today())).select("batch_seq")


ORDER = f"greatest(date_start, {T}), coalesce(date_end, date_start), id"


@query("O1_effective_date_order", f"SELECT id, row_number() OVER (ORDER BY {ORDER}) AS place FROM event WHERE date_start >= {T} OR date_end >= {T}")
def _(t):
    day, end, _ = S.by_effective_date(t.today())
    rows = t.event.where(S.in_window(t.today())).select("id", day.alias("day"), end.alias("last"))
    return numbered(rows, ["day", "last", "id"], 0).select("id", F.col("number").cast("long").alias("place"))


SORTED = " UNION ALL ".join(f"SELECT '{c}' AS sorted_by, {k} AS key, id FROM ({JOINED})" for c, k in (("name", "name"), ("discipline", "discipline"), ("venue", "venue_name")))


@query(
    "O2_sort_by_column",
    f"""WITH k AS ({SORTED}) SELECT sorted_by, 'asc' AS way, id, row_number() OVER (PARTITION BY sorted_by ORDER BY key NULLS FIRST, id) AS place FROM k
    UNION ALL SELECT sorted_by, 'desc', id, row_number() OVER (PARTITION BY sorted_by ORDER BY key DESC NULLS LAST, id) FROM k UNION ALL SELECT 'newest', 'desc', id, row_number() OVER (ORDER BY id DESC) FROM event""",
)
def _(t):
    """Rows without the key are first ascending, and last descending."""
    named = S.with_venue(t.event, t.venue).select("id", "name", "discipline", "venue_name")
    ways = {"asc": F.asc_nulls_first, "desc": F.desc_nulls_last}
    parts = [(by, way, numbered(named.select("id", c), [order(c), "id"], 0)) for by, c in (("name", "name"), ("discipline", "discipline"), ("venue", "venue_name")) for way, order in ways.items()]
    parts.append(("newest", "desc", numbered(t.event.select("id"), [F.desc("id")], 0)))
    rows = [df.select(F.lit(by).alias("sorted_by"), F.lit(way).alias("way"), "id", F.col("number").cast("long").alias("place")) for by, way, df in parts]
    return reduce(DataFrame.union, rows)


@query("O3_distance_sort", f"WITH d AS (SELECT id, round({miles('52.0', '-1.5', 'latitude', 'longitude')}, 3) AS distance FROM venue) SELECT 'asc' AS way, id, distance, row_number() OVER (ORDER BY distance NULLS LAST, id) AS place FROM d UNION ALL SELECT 'desc', id, distance, row_number() OVER (ORDER BY distance DESC NULLS FIRST, id) FROM d")
def _(t):
    d = t.venue.select("id", F.round(geo.haversine_miles(F.lit(HOME[0]), F.lit(HOME[1]), F.col("latitude"), F.col("longitude")), 3).alias("distance"))
    far = d.withColumns({"unknown": F.col("distance").isNull().cast("int"), "back": -F.col("distance")}).withColumn("known", 1 - F.col("unknown"))
    up, down = numbered(far, ["unknown", "distance", "id"], 0), numbered(far, ["known", "back", "id"], 0)
    return up.select(F.lit("asc").alias("way"), "id", "distance", F.col("number").cast("long").alias("place")).union(down.select(F.lit("desc").alias("way"), "id", "distance", F.col("number").cast("long").alias("place")))


@query("O4_page", f"WITH e AS (SELECT id, date_start, date_end FROM event WHERE event_type = 'competition' AND date_start >= {T}), n AS (SELECT count(*) AS total FROM e) SELECT id, total, greatest(1, (total + 49) // 50) AS pages, 3 AS page FROM e, n ORDER BY {ORDER} LIMIT 50 OFFSET 100")
def _(t):
    return S.page(t.event.where((F.col("event_type") == "competition") & (F.col("date_start") >= t.today())), S.by_effective_date(t.today()), 3).select("id", "total", "pages", "page")


@query("O5_busiest", f"SELECT venue_id, count(*) AS n FROM event WHERE date_start >= {T} AND venue_id IS NOT NULL GROUP BY venue_id ORDER BY n DESC, venue_id LIMIT 25")
def _(t):
    return t.event.where((F.col("date_start") >= t.today()) & F.col("venue_id").isNotNull()).groupBy("venue_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "venue_id").limit(25)


@query("O6_due_sources", f"SELECT id, last_scanned_at FROM source WHERE enabled AND (last_scanned_at IS NULL OR last_scanned_at < TIMESTAMP '{TODAY} 00:00:00' - INTERVAL 24 HOUR) ORDER BY last_scanned_at NULLS FIRST, id LIMIT 10")
def _(t):
    due = F.col("last_scanned_at").isNull() | (F.col("last_scanned_at") < F.lit(TODAY).cast("timestamp") - F.expr("INTERVAL 24 HOURS"))
    return t.source.where(F.col("enabled") & due).orderBy(F.asc_nulls_first("last_scanned_at"), "id").limit(10).select("id", "last_scanned_at")


@query("U1_union_of_feeds", "SELECT batch_seq, name, url, NULL AS organiser FROM extracted UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def _(t):
    other = t.customer.select(F.col("c_custkey").alias("batch_seq"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("organiser"))
    return t.extracted.select("batch_seq", "name", "url").unionByName(other, allowMissingColumns=True)


@query("U2_distinct_pairs", "SELECT DISTINCT e.venue_id, s.name AS source_name FROM event e JOIN source s ON s.id = e.source_id WHERE venue_id IS NOT NULL")
def _(t):
    return t.event.where("venue_id IS NOT NULL").select("venue_id", "source_id").distinct().join(t.source.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id").select("venue_id", "source_name")


@query("U3_stale_ids", f"SELECT DISTINCT source_id FROM event EXCEPT SELECT source_id FROM event WHERE date_start >= {T} AND source_id < 15")
def _(t):
    return t.event.select("source_id").distinct().join(t.event.where((F.col("date_start") >= t.today()) & (F.col("source_id") < 15)), "source_id", "left_anti")


@query("flagship_search", f"""SELECT id, name, venue_name, round(distance, 3) AS distance FROM (SELECT *, {miles('52.0', '-1.5', 'latitude', 'longitude')} AS distance FROM ({JOINED})) e
WHERE NOT coalesce(hidden, false) AND (date_start >= {T} OR coalesce(date_end >= {T}, false)) AND event_type = 'competition' AND distance <= 100 ORDER BY {ORDER} LIMIT 50""")
def flagship(t):
    """Workload search: predicates on the scan, venue join, radius, effective-date order, first page."""
    kept = t.event.where(S.visible() & S.in_window(t.today()) & S.default_view())
    close = S.near(S.with_venue(kept, t.venue), *HOME, 100.0)
    return close.orderBy(*S.by_effective_date(t.today())).limit(50).select("id", "name", "venue_name", F.round("distance", 3).alias("distance"))
