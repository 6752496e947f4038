"""Sinks: Parquet event table, iCalendar text, JSON reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.tags import valid


def ical_escape(value: Column) -> Column:
    out = value
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def ical_event(rfc: bool = False) -> Column:
    """One VEVENT of id, name, date_start, date_end, venue_name, discipline, url; lines end in CRLF. The end is the
    day after the last. Description parts are joined by an escaped newline whose backslash is escaped once more,
    unless rfc is set."""
    esc = lambda c: ical_escape(F.coalesce(F.col(c), F.lit("")))
    mark = "\\n" if rfc else "\\\\n"
    parts = F.concat_ws(mark, F.nullif(esc("discipline"), F.lit("")), F.nullif(esc("url"), F.lit("")))
    lines = [
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:event-"), F.col("id").cast("string")), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("date_start", "yyyyMMdd")),
        F.concat(F.lit("DTEND;VALUE=DATE:"), F.date_format(F.date_add(F.coalesce("date_end", "date_start"), 1), "yyyyMMdd")), F.concat(F.lit("SUMMARY:"), esc("name")),
        F.concat(F.lit("LOCATION:"), esc("venue_name")), F.concat(F.lit("DESCRIPTION:"), parts), F.lit("BEGIN:VALARM"), F.lit("TRIGGER:-P7D"), F.lit("ACTION:DISPLAY"), F.lit("END:VALARM"), F.lit("END:VEVENT"),
    ]
    return F.concat_ws("\r\n", *lines)


def ical_export(events: DataFrame, most: int = 200) -> DataFrame:
    """The first `most` events by start date as one calendar text (column calendar): the export's own limit."""
    top = events.orderBy("date_start", "id").limit(most).select("date_start", "id", ical_event().alias("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date_start", "id", "text"))), lambda x: x["text"]), "\r\n")
    return top.agg(F.concat(F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0\r\n"), body, F.lit("\r\nEND:VCALENDAR\r\n")).alias("calendar"))


def write_events(events: DataFrame, path: str, json_lists: bool = False) -> None:
    """Parquet by month of date_start, overwriting only the months of the input. Tags outside the vocabulary are an
    error. json_lists: tags and classes as JSON text."""
    bad = events.where(F.size("tags") != F.size(valid(F.col("tags")))).select("id").limit(1).collect()
    if bad:
        raise ValueError(f"unknown tags in event {bad[0][0]}; known namespaces: {', '.join(rules.VOCABULARY)}")
    out = events.withColumns({c: F.to_json(c) for c in ("tags", "classes")}) if json_lists else events
    out.withColumn("month", F.date_format("date_start", "yyyy-MM")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def postcode_report(venues: DataFrame) -> DataFrame:
    """postcode, n, venues (JSON): the venues of each postcode that has more than one."""
    groups = venues.where("postcode IS NOT NULL").groupBy("postcode").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", "name"))).alias("venues"))
    return groups.where("n > 1").select("postcode", "n", F.to_json("venues").alias("venues"))


def manifest_report(found: DataFrame, total: DataFrame, most: int = 100) -> DataFrame:
    """total_new_venues, total_with_context, venues (JSON of the most by count): found as by new_venue_manifest with no
    limit, total the names of all new venues."""
    top = found.orderBy(F.desc("n"), "name").limit(most)
    listed = top.agg(F.to_json(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "name", "n", "postcode", "latitude", "longitude", "urls", "names")))).alias("venues"))
    counts = total.agg(F.count("*").alias("total_new_venues")).join(found.agg(F.count("*").alias("total_with_context")), F.lit(True))
    return counts.join(listed, F.lit(True))
