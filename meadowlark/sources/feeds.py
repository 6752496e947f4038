"""Feeds: stored payloads (JSON, HTML, XML, text) to extracted event rows. A registry maps feed keys to readers."""

from __future__ import annotations

import json
from collections.abc import Callable
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from . import archive
from .markup import table_rows

#: Feed key -> function of a table (source_id, url, body) to extracted rows.
FEEDS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def feed(key: str) -> Callable:
    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        FEEDS[key] = f
        return f

    return add


PAYLOAD = "source_id long, url string, body string"


def read(spark: SparkSession, key: str, path: str, stream: bool = False, files: int | None = None) -> DataFrame:
    """Event rows of stored payloads: files of JSON lines with source_id, url and body in a folder, read at once or as a
    stream (new files as they come, so many a batch). Spark splits files of lines by bytes and keeps a stream's offsets.
    An unknown feed key is an error; lines that are no JSON have no rows."""
    if key not in FEEDS:
        raise KeyError(f"no feed {key}; there are {', '.join(sorted(FEEDS))}")
    reader = (spark.readStream if stream else spark.read).schema(PAYLOAD)
    if stream and files:
        reader = reader.option("maxFilesPerTrigger", files)
    return FEEDS[key](reader.json(path).where("body IS NOT NULL"))


def archived(spark: SparkSession, key: str, path: str, stream: bool = False, split: int | None = None) -> DataFrame:
    """Event rows of the payloads of one feed in an archive (archive.Payloads), which may hold many feeds' payloads and
    go on growing while a stream follows it. An unknown feed key is an error."""
    if key not in FEEDS:
        raise KeyError(f"no feed {key}; there are {', '.join(sorted(FEEDS))}")
    spark.dataSource.register(archive.Payloads)
    reader = (spark.readStream if stream else spark.read).format(archive.FORMAT).option("path", path).option("feed", key)
    if split:
        reader = reader.option("splitbytes", split)
    return FEEDS[key](reader.load())


def unescape_html(value: Column) -> Column:
    """Character references decoded, in Arrow batches; texts without any stay in the JVM's hands."""

    @F.arrow_udf("string")
    def decode(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unescape(x) for x in values.to_pylist()], pa.string())

    return decode(value)


CALENDAR = "events array<struct<title:string,start_date:string,end_date:string,url:string,venue:string>>"


@feed("calendar_api")
def calendar_api(pages: DataFrame) -> DataFrame:
    """{"events": [{title, start_date, end_date, url, venue}]}: one row each; the end only if it is another day."""
    rows = pages.select("source_id", F.posexplode(F.from_json("body", CALENDAR)["events"]).alias("pos", "e"))
    start, end = dates.parse_date(F.col("e.start_date")), dates.parse_date(F.col("e.end_date"))
    return rows.select("source_id", F.col("pos").alias("batch_seq"), F.col("e.title").alias("name"), start.alias("date_start"), F.nullif(end, start).alias("date_end"), F.col("e.venue").alias("venue_name"), F.col("e.url").alias("url"))


MEETINGS = "array<struct<id:long,name:string,start_on:string,end_on:string,venue_country:string>>"


@feed("meetings_api")
def meetings_api(pages: DataFrame) -> DataFrame:
    """A bare array of meetings, British ones only."""
    rows = pages.select("source_id", F.explode(F.from_json("body", MEETINGS)).alias("e")).where("e.venue_country = 'GBR'")
    return rows.select("source_id", F.col("e.id").alias("batch_seq"), F.col("e.name").alias("name"), F.try_to_date("e.start_on").alias("date_start"), F.nullif(F.try_to_date("e.end_on"), F.try_to_date("e.start_on")).alias("date_end"))


SEARCH = "rows array<struct<id:long,name:string,start:string,end:string,venue_name:string,publicUrl:string>>"


@feed("search_api")
def search_api(pages: DataFrame) -> DataFrame:
    """{"rows": [{id, name, start, end, venue_name, publicUrl}]}: one row per id, the first of repeated ones."""
    rows = pages.select("source_id", F.explode(F.from_json("body", SEARCH)["rows"]).alias("e"))
    start, end = dates.parse_date(F.col("e.start")), dates.parse_date(F.col("e.end"))
    flat = rows.select("source_id", F.col("e.id").alias("batch_seq"), F.col("e.name").alias("name"), start.alias("date_start"), F.nullif(end, start).alias("date_end"), F.col("e.venue_name").alias("venue_name"), F.col("e.publicUrl").alias("url"))
    return flat.dropDuplicates(["source_id", "batch_seq"])


TOUR = "payload struct<show_ids:array<struct<virtual_week_code:string,description:string,start_at:string,end_at:string>>>"


@feed("tour_api")
def tour_api(pages: DataFrame) -> DataFrame:
    """{"payload": {"show_ids": [{virtual_week_code, description, start_at, end_at}]}}: names of code and description."""
    rows = pages.select("source_id", F.posexplode(F.from_json("body", TOUR)["payload"]["show_ids"]).alias("batch_seq", "e"))
    start, end = dates.parse_date(F.substring("e.start_at", 1, 10)), dates.parse_date(F.substring("e.end_at", 1, 10))
    return rows.select("source_id", "batch_seq", F.concat_ws(" ", "e.virtual_week_code", "e.description").alias("name"), start.alias("date_start"), F.nullif(end, start).alias("date_end"))


DATA = "data array<struct<id:long,full_show_name:string,venue_name:string,start:string,end:string,class_range:string,status:string,event_status_id:int>>"
#: Fixed value: the status of a cancelled event.
CANCELLED = 5


@feed("data_api")
def data_api(pages: DataFrame) -> DataFrame:
    """{"data": [{id, full_show_name, venue_name, start, end, class_range, status, event_status_id}]}: names and venues
    with their character references decoded, classes joined by "+"; cancelled rows, and rows without a name or a
    readable start, go. A row without a venue is at TBC."""
    rows = pages.select("source_id", F.explode(F.from_json("body", DATA)["data"]).alias("e"))
    off = F.coalesce((F.lower("e.status") == "cancelled") | (F.col("e.event_status_id") == CANCELLED), F.col("e.event_status_id") == CANCELLED, F.lit(False))
    start, end = dates.parse_date(F.col("e.start")), dates.parse_date(F.col("e.end"))
    flat = rows.where(~off).select(
        "source_id", F.col("e.id").alias("batch_seq"), F.trim(unescape_html(F.col("e.full_show_name"))).alias("name"), start.alias("date_start"), F.nullif(end, start).alias("date_end"),
        F.coalesce(F.nullif(F.trim(unescape_html(F.col("e.venue_name"))), F.lit("")), F.lit("TBC")).alias("venue_name"), listed_classes(F.col("e.class_range"), "+").alias("classes"),
    )
    return flat.where("name <> '' AND date_start IS NOT NULL")


def listed_classes(value: Column, sign: str) -> Column:
    """The parts of a text between signs, trimmed, empty ones gone."""
    return F.filter(F.transform(F.split(value, f"[{sign}]"), lambda x: F.trim(x)), lambda x: x != "")


@feed("html_table")
def html_table(pages: DataFrame) -> DataFrame:
    """Rows of tables, known by their number of cells. Seven: dates, name, classes, venue, -, -, status (cancelled rows
    go). Four: date, type, area, link. Eight: actions, name, first day, last day, discipline, venue with postcode,
    county, number (rows without a name or a readable first day go; "UK Location" and the like are at the organiser's,
    which the name begins with). Tables within cells are tables of their own."""
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("source_id", F.posexplode(table_rows(F.col("body"), url)).alias("batch_seq", "r"))
    rows = rows.select("source_id", "batch_seq", F.col("r.cells").alias("c"), F.col("r.link").alias("url"))
    seven, four, eight = (F.size("c") == k for k in (7, 4, 8))
    start, end = dates.date_range(F.get("c", 0))
    first, last = (F.try_to_date(F.get("c", k), "dd/MM/yyyy") for k in (2, 3))
    cancelled = seven & F.upper(F.trim(F.get("c", 6))).isin("X", "CANCELLED")
    usable = seven | four | (eight & (F.get("c", 1) != "") & first.isNotNull())
    name = F.when(four, F.concat_ws(" - ", F.get("c", 1), F.get("c", 2))).otherwise(F.get("c", 1))
    code = F.nullif(F.regexp_extract(F.get("c", 5), r"(?i)\b([A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2})\b", 1), F.lit(""))
    place = F.rtrim(F.trim(F.when(code.isNull(), F.get("c", 5)).otherwise(F.replace(F.get("c", 5), code, F.lit("")))), F.lit("() "))
    unknown = F.lower(place).isin("uk location", "n/a", "")
    own = F.coalesce(F.when(~unknown, place), text.organiser_of_title(F.get("c", 1)), F.get("c", 1))
    return rows.where(usable & ~cancelled).select(
        "source_id", "batch_seq", name.alias("name"), F.when(eight, first).otherwise(start).alias("date_start"), F.when(eight, F.nullif(last, first)).otherwise(end).alias("date_end"),
        F.when(seven, F.get("c", 3)).when(eight, own).otherwise(F.get("c", 2)).alias("venue_name"), F.when(seven, listed_classes(F.get("c", 2), ",")).alias("classes"),
        F.when(eight, text.normalise_postcode(code)).alias("venue_postcode"), F.when(eight, F.nullif(F.get("c", 4), F.lit(""))).alias("discipline"), "url",
    )


ITEM = "title string, link string, pubDate string"


@feed("rss")
def rss(pages: DataFrame) -> DataFrame:
    """<item> elements: title, link and the first date of URL, title and pubDate."""
    items = pages.select("source_id", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)(<item>.*?</item>)"), 1)).alias("batch_seq", "x"))
    item = items.withColumn("i", F.from_xml("x", ITEM))
    published = F.try_to_date(F.regexp_extract("i.pubDate", r"(\d{1,2} \w{3} \d{4})", 1), "d MMM yyyy")
    day = F.coalesce(dates.date_in_url(F.col("i.link")), dates.date_range(F.col("i.title"))[0], published)
    return item.select("source_id", "batch_seq", F.col("i.title").alias("name"), F.col("i.link").alias("url"), day.alias("date_start"))


def json_ld_event(body: Column) -> Column:
    """The first Event among a page's JSON-LD blocks (object, array or @graph) as JSON text; null without one."""
    blocks = F.regexp_extract_all(body, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)

    def events(block: Column) -> Column:
        one = F.when(F.get_json_object(block, "$.@type") == "Event", F.array(block))
        many = F.from_json(F.coalesce(F.get_json_object(block, "$.@graph"), F.when(F.ltrim(block).startswith("["), block)), "array<string>")
        return F.coalesce(one, F.filter(many, lambda x: F.get_json_object(x, "$.@type") == "Event"), F.array().cast("array<string>"))

    return F.try_element_at(F.flatten(F.transform(blocks, events)), F.lit(1))


@feed("json_ld")
def json_ld(pages: DataFrame) -> DataFrame:
    event = pages.withColumn("e", json_ld_event(F.col("body"))).where("e IS NOT NULL")
    get = lambda path: F.get_json_object("e", path)
    start, end = dates.parse_date(F.substring(get("$.startDate"), 1, 10)), dates.parse_date(F.substring(get("$.endDate"), 1, 10))
    return event.select("source_id", "url", get("$.name").alias("name"), start.alias("date_start"), F.nullif(end, start).alias("date_end"), get("$.location.name").alias("venue_name"))


def relevant(rows: DataFrame, country: str = "GBR", kinds: tuple[str, ...] = ("training",)) -> DataFrame:
    """Feed rows without those that are cancelled (status X or cancelled), of another country (if one is told), or of
    kinds that a feed lists but isn't read for."""
    status = F.upper(F.trim(F.coalesce(F.col("status"), F.lit(""))))
    return rows.where(~status.isin("X", "CANCELLED") & (F.coalesce(F.col("country"), F.lit(country)) == country) & ~F.coalesce(F.col("event_type").isin(*kinds), F.lit(False)))


def repair(text: str | None) -> str | None:
    """The JSON array in a reply: what stands around it goes; a truncated one is closed after its last whole object."""
    if text is None or (at := text.find("[")) < 0:
        return None
    body, depth, quoted, skip, whole = text[at:], 0, False, False, 0
    for k, c in enumerate(body):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if depth == 0:
                return body[: k + 1]
            if depth == 1 and c == "}":
                whole = k + 1
    return body[:whole] + "]" if whole else None


REPLY = "array<struct<name:string,date_start:string,date_end:string,venue_name:string,venue_postcode:string,url:string>>"


def reply_rows(replies: DataFrame, body: str = "body") -> DataFrame:
    """Event rows of reply texts that hold a JSON array, whole or cut off; rows without name, date or venue go."""

    @F.arrow_udf("string")
    def repaired(values: pa.Array) -> pa.Array:
        out = []
        for x in values.to_pylist():
            fixed = repair(x)
            try:
                json.loads(fixed or "")
            except ValueError:
                fixed = None
            out.append(fixed)
        return pa.array(out, pa.string())

    keys = [F.col(f"`{c}`") for c in replies.columns if c != body]
    rows = replies.select(*keys, F.explode(F.from_json(repaired(F.col(body)), REPLY)).alias("e")).select(*keys, "e.*")
    return rows.where("name IS NOT NULL AND date_start IS NOT NULL AND venue_name IS NOT NULL")


def venue_seeds(payload: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """{name: {postcode, lat, lng, aliases}} to venues (name, postcode, latitude, longitude) and aliases (alias, name)."""
    parsed = payload.select(F.explode(F.from_json(body, "map<string,struct<postcode:string,lat:double,lng:double,aliases:array<string>>>")).alias("name", "v"))
    venues = parsed.select("name", F.col("v.postcode").alias("postcode"), F.col("v.lat").alias("latitude"), F.col("v.lng").alias("longitude"))
    return venues, parsed.select(F.explode("v.aliases").alias("alias"), "name")


def rule_rows(payload: DataFrame, body: str = "body") -> DataFrame:
    """{key: [words]} rule JSON to rows key, word, place."""
    return payload.select(F.explode(F.from_json(body, "map<string,array<string>>")).alias("key", "words")).select("key", F.posexplode("words").alias("place", "word"))
