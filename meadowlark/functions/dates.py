"""Dates from free text as column expressions. Everything is null-safe: what can't be read becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import found, let, lookup

#: Formats tried in order; the first that fits wins.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy", "dd.MM.yyyy", "dd-MM-yyyy", "d MMMM yyyy", "d MMM yyyy", "d MMM yy", "yyyyMMdd")
ORDINAL = r"(?i)(\d{1,2})(?:st|nd|rd|th)\b"


def parse_date(text: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The date under the first format that fits the whole trimmed text; ordinals and weekday names are ignored."""
    t = F.regexp_replace(F.trim(text), ORDINAL, "$1")
    t = F.regexp_replace(t, r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+", "")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in formats])


def month_number(word: Column, months: list[str] | None = None) -> Column:
    """1 to 12 of a month name: its first three letters (English), or a whole word of another list."""
    if months is None:
        return lookup({m: str(k) for k, m in enumerate(rules.MONTHS, 1)}, F.lower(F.substring(word, 1, 3))).cast("int")
    return lookup({m: str(k) for k, m in enumerate(months, 1)}, F.lower(word)).cast("int")


def full_year(year: Column) -> Column:
    y = year.try_cast("int")
    return F.when(y < 100, y + 2000).otherwise(y)


def make(year: Column, month: Column, day: Column) -> Column:
    """A date, null if there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day.try_cast("int")), "yyyy-MM-dd")


def date_range(text: Column) -> tuple[Column, Column]:
    """(start, end) of "30 Oct - 1 Nov 2026", "4 - 7 March 26", "28 Mar 2026", "4th & 5th May 2026", and of two such
    ranges joined by "&" ("4 - 5 May & 8 - 9 May 2026"): the first day and the last. The end is null for a single
    day. Each date is taken apart once; what it lacks of month and year is that of the next one."""
    piece = r"(\d{1,2})(?:\s+([A-Za-z]{3,9})\b(?:,?\s+(\d{4}|\d{2})\b)?)?"
    whole = rf"({piece}(?:\s*-\s*{piece})*)"

    def parts(p: Column) -> Column:
        """Year, month and day of a date, all by one match."""
        words = F.split(F.regexp_replace(p, rf"(?s)^.*?{piece}.*$", "$1;$2;$3"), ";")
        return let(words, lambda w: F.struct(full_year(F.nullif(F.get(w, 2), F.lit(""))).alias("y"), month_number(F.nullif(F.get(w, 1), F.lit(""))).alias("m"), F.nullif(F.get(w, 0), F.lit("")).alias("d")))

    def read(t: Column) -> Column:
        """Days of the first run of dates that ends with a year."""
        runs = F.regexp_extract_all(t, F.lit(whole), 1)
        run = F.get(F.filter(runs, lambda r: r.rlike(r"[A-Za-z]{3,9},?\s+(?:\d{4}|\d{2})$")), 0)
        pieces = F.transform(F.regexp_extract_all(run, F.lit(rf"({piece})"), 1), parts)

        def before(later: Column, p: Column) -> Column:
            """The days so far, with p in front: of the month and year of the day after it unless it has its own."""
            after = F.get(later, 0)
            month = F.coalesce(p["m"], after["m"])
            year = F.coalesce(p["y"], F.when(month > after["m"], after["y"] - 1).otherwise(after["y"]))
            return F.concat(F.array(F.struct(year.alias("y"), month.alias("m"), p["d"].alias("d"))), later)

        return F.aggregate(F.reverse(pieces), F.array().cast("array<struct<y:int,m:int,d:string>>"), before)

    t = F.regexp_replace(F.regexp_replace(F.trim(text), ORDINAL, "$1"), r"\s*(?:&|–|—|\bto\b|\band\b)\s*", " - ")
    days = let(t, read)
    both = let(days, lambda x: F.struct(*[make(F.get(x, k)["y"], F.get(x, k)["m"], F.get(x, k)["d"]).alias(n) for n, k in (("start", F.lit(0)), ("end", F.size(x) - 1))]))
    start = let(F.get(days, 0), lambda x: make(x["y"], x["m"], x["d"]))
    return start, let(both, lambda x: F.nullif(x["end"], x["start"]))


def mentioned(text: Column) -> tuple[Column, Column]:
    """First and last date (dd/MM/yyyy) that a text mentions; the end is null if both are one day."""
    days = F.regexp_extract_all(text, F.lit(r"(\d{1,2}/\d{1,2}/\d{4})"), 1)
    start, end = (F.try_to_date(F.try_element_at(days, F.lit(k)), "d/M/yyyy") for k in (1, -1))
    return start, F.nullif(end, start)


def roll_forward(month: Column, day: Column, today: Column) -> Column:
    """The next such day: this year's, or next year's if that lies before today."""
    this = make(F.year(today), month, day.cast("string"))
    return F.when(this < today, make(F.year(today) + 1, month, day.cast("string"))).otherwise(this)


def academic_date(month: Column, day: Column, start_year: Column) -> Column:
    """September to December fall in the first year of an academic year, January to August in the next."""
    return make(F.when(month >= 9, start_year).otherwise(start_year + 1), month, day.cast("string"))


def date_in_url(url: Column, today: Column | None = None) -> Column:
    """From …-YYYYMMDD, /on/YYYY/MM/DD or dd-mm-yyyy in a URL; with today also from …-4th-march, the next such day."""
    on = r"/on/(\d{4})/(\d{1,2})/(\d{1,2})"
    dashed = r"(\d{1,2})-(\d{1,2})-(\d{4})"
    named = r"(?i)(?:^|[-/])(\d{1,2})(?:st|nd|rd|th)-(" + "|".join(rules.MONTHS) + r")[a-z]*(?:[-/.?#]|$)"
    options = [
        F.try_to_date(found(url, r"-(\d{8})(?:\D|$)"), "yyyyMMdd"),
        make(found(url, on, 1).try_cast("int"), found(url, on, 2).try_cast("int"), found(url, on, 3)),
        make(found(url, dashed, 3).try_cast("int"), found(url, dashed, 2).try_cast("int"), found(url, dashed, 1)),
    ]
    if today is not None:
        options.append(roll_forward(month_number(found(url, named, 2)), found(url, named, 1).try_cast("int"), today))
    return F.coalesce(*options)


def day_list(text: Column, months: list[str]) -> tuple[Column, Column]:
    """(first, last) of "26.27.28 GIUGNO 2026": days, a month name of the list, a year."""
    p = r"((?:\d{1,2}[.,&\s]+)+)(\p{L}+)\s+(\d{4})"
    days = F.transform(F.regexp_extract_all(found(text, p, 1), F.lit(r"(\d{1,2})"), 1), lambda d: d.cast("int"))
    month, year = month_number(found(text, p, 2), months), found(text, p, 3).try_cast("int")
    start, end = make(year, month, F.array_min(days).cast("string")), make(year, month, F.array_max(days).cast("string"))
    return start, F.nullif(end, start)


def still_running(start: Column, end: Column, today: Column) -> Column:
    """Ends (or, of one day, starts) today or later; dates that can't be read count as running."""
    return F.coalesce(F.try_to_date(F.coalesce(end, start), "yyyy-MM-dd") >= today, F.lit(True))


def scope_bounds(scope: str, today: Column) -> tuple[Column, Column | None]:
    """(from, to) of upcoming, today, weekend, week (Monday to Sunday) and month; no upper bound: None."""
    weekday = F.weekday(today)  # Monday is 0
    saturday = F.when(weekday == 6, F.date_sub(today, 1)).otherwise(F.date_add(today, (5 - weekday)))
    sunday = F.date_add(today, 6 - weekday)
    return {
        "upcoming": (today, None),
        "today": (today, today),
        "weekend": (F.greatest(saturday, today), sunday),
        "week": (today, sunday),
        "month": (today, F.last_day(today)),
    }[scope]
