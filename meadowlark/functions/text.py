"""Normalisation of venue names, postcodes, disciplines and titles, as column expressions (nothing leaves the JVM)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

POSTCODE = r"\b[A-Z]{1,2}\d[A-Z\d]?\s+\d[A-Z]{2}\b"
OUTWARD = r"^([A-Z]{1,2}\d[A-Z\d]?)"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def any_of(words: list[str]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\-", "-").replace(r"\&", "&") for w in words)


def lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def title_case(text: Column) -> Column:
    """Each run of letters capitalised, whatever stands before it."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), 1), F.initcap), "")


def normalise_postcode(postcode: Column) -> Column:
    """Upper case with one space; null where the text is no UK postcode. A trailing dot is allowed."""
    p = r"(?i)^([A-Z]{1,2}\d[A-Z\d]?)\s*(\d[A-Z]{2})\.?$"
    return F.when(F.trim(postcode).rlike(p), F.upper(F.concat(F.regexp_extract(F.trim(postcode), p, 1), F.lit(" "), F.regexp_extract(F.trim(postcode), p, 2))))


def extract_postcode(text: Column) -> Column:
    """The first UK postcode in a text, as it stands there."""
    return F.trim(found(text, f"(?i)({POSTCODE})"))


def outward_code(postcode: Column) -> Column:
    return found(F.upper(F.trim(postcode)), OUTWARD)


def area_letters(postcode: Column) -> Column:
    return found(F.upper(F.trim(postcode)), r"^([A-Z]{1,2})\d")


def compact_postcode(postcode: Column) -> Column:
    return F.upper(F.replace(postcode, F.lit(" "), F.lit("")))


def disambiguate_venue(name: Column, postcode: Column, ambiguous: list[str] | None = None) -> Column:
    """An ambiguous name with the outward code in brackets, if there is a postcode."""
    code = found(F.upper(F.trim(postcode)), OUTWARD + r"\s")
    return F.when(name.isin(ambiguous or rules.AMBIGUOUS) & code.isNotNull(), F.concat(name, F.lit(" ("), code, F.lit(")"))).otherwise(name)


def normalise_venue_name(name: Column) -> Column:
    """Canonical form of a venue name: show numbers, event brackets, postcodes, company forms and common endings go;
    title case; junk becomes Tbc, virtual places Online; long addresses are cut at the first comma."""
    marks, outward = "-–—:&,. \t\n\r", r"\(([a-z]{1,2}\d[a-z\d]?)\)$"

    def ending(words: list[str]) -> str:
        return rf"(?i)(?:\s+(?:{any_of(words)}))"

    def titled(x: Column) -> Column:
        """Title case, but for an outward code in brackets at the end, which is in capitals."""
        code = F.regexp_extract(x, "(?i)" + outward, 1)
        return F.when(code == "", title_case(x)).otherwise(F.concat(title_case(F.regexp_replace(x, "(?i)" + outward, "")), F.lit("("), F.upper(code), F.lit(")")))

    def uncoded(x: Column) -> Column:
        return F.coalesce(F.nullif(F.trim(F.regexp_replace(x, rf"(?i)[\s(]*{POSTCODE}\)?\s*", " ")), F.lit("")), x)

    def guarded(x: Column) -> Column:
        first, rest = F.trim(F.split_part(x, F.lit(","), F.lit(1))), F.size(F.split(x, ",")) - 1
        odd = normalise_postcode(x).isNotNull() | x.rlike(r"^[A-Za-z\d]{4,}\+[A-Za-z\d]") | F.lower(x).rlike("^https?:")
        address = (F.length(first) >= 4) & ((rest >= 2) | ((rest == 1) & (F.length(x) > 50)))
        return F.when(odd | ~F.length(x).between(2, 100), "Tbc").when(address, first).otherwise(x)

    event = rf"(?i)\s*\([^)]*(?:{any_of(rules.EVENT_WORDS)})[^)]*\)\s*$"
    t = F.regexp_replace(F.regexp_replace(name, r"\s*\(\d+\)(?:\s*-.*)?$", ""), event, "")
    t = let(let(F.trim(t), titled), uncoded)
    t = F.regexp_replace(F.regexp_replace(t, ending(["limited"]) + "$", ""), r"\s*-\s+[A-Z][A-Za-z]{1,4}$", "")
    t = F.regexp_replace(F.rtrim(F.regexp_replace(t, ending(rules.VENUE_SUFFIXES) + "+$", "")), r"\s+", " ")
    t = F.trim(F.rtrim(t, F.lit(marks)))
    t = F.trim(F.regexp_replace(t, ending(rules.LEFT_OVER) + r"\s*$", ""))
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(low == "", "Tbc").when(low.startswith("online") | (low == "virtual"), "Online").otherwise(let(t, guarded))


def normalise_discipline(raw: Column) -> Column:
    """Canonical discipline of a code or alias; of a composite (split at , and /) the first that is known; else null."""
    table = {a: d for d, aliases in rules.DISCIPLINES.items() for a in aliases}

    def one(x: Column) -> Column:
        return lookup(table, F.replace(F.lower(F.trim(x)), F.lit("_"), F.lit(" ")))

    parts = F.filter(F.transform(F.split(raw, "[,/]"), one), lambda d: d.isNotNull())
    return F.coalesce(one(raw), F.try_element_at(parts, F.lit(1)))


def venue_at(name: Column) -> Column:
    """The place in "... at Place": more than two characters, not starting with a digit."""
    place = F.trim(found(name, r"(?i)\bat\s+(.+?)$"))
    return F.when((F.length(place) > 2) & ~place.rlike(r"^\d"), place)


def venue_after_sign(name: Column) -> Column:
    """The place in "... @ Place"."""
    return F.nullif(F.trim(found(name, r"@\s*(.+)$")), F.lit(""))


def venue_or_organiser(name: Column, organiser: Column) -> Column:
    """The place that a title names ("at Place", "@ Place"), else who holds the event, else TBC."""
    return F.coalesce(venue_at(name), venue_after_sign(name), F.nullif(F.trim(organiser), F.lit("")), F.lit("TBC"))


def organiser_of_title(name: Column) -> Column:
    """Who holds an event by its title: the text up to the first word of an organiser's name (Riding Club, RC, …), else
    what stands before " - "; null without either."""
    spaced = "|".join([*(x.replace(" ", r"\s+") for x in rules.ORGANISERS), *(rf"{x}\b" for x in rules.ORGANISERS_SHORT)])
    before = F.when(F.contains(name, F.lit(" - ")), F.nullif(F.trim(F.split_part(name, F.lit(" - "), F.lit(1))), F.lit("")))
    return F.coalesce(F.nullif(F.trim(found(name, f"(?i)^(.*?(?:{spaced}))")), F.lit("")), before)


def venue_of_title(name: Column) -> Column:
    """The place in "Place - Title", "Place : Title" or "Place | Title", or before a word that titles go on with; it has
    more than three characters; else Tbc. A bracket at the end goes first."""

    def long(x: Column) -> Column:
        return F.when(F.length(x) > 3, x)

    def before(t: Column) -> Column:
        parts = [long(F.trim(F.regexp_replace(t, rf"(?s) {re.escape(sign)} .*$", ""))) for sign in ("-", ":", "|")]
        cut = [F.when(F.contains(t, F.lit(f" {sign} ")), part) for sign, part in zip(("-", ":", "|"), parts, strict=True)]
        words = any_of(sorted(rules.TITLE_GOES_ON, key=len, reverse=True))
        goes_on = rf"(?is)\b(?:(?:{words})\b|(?:{any_of(rules.TITLE_GOES_ON_NUMBERED)})\s+\d|\d{{1,2}}(?:st|nd|rd|th)\s+(?:{any_of(rules.MONTHS)})).*$"
        told = F.when(t.rlike(goes_on), long(F.trim(F.rtrim(F.trim(F.regexp_replace(t, goes_on, "")), F.lit("-: ")))))
        return F.coalesce(*cut, told, F.lit("Tbc"))

    return let(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""), before)


def is_junk_venue(name: Column) -> Column:
    """A booking link or a street address that stands where a venue should."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return low.rlike(f"^(?:{any_of(rules.JUNK_BEGINNINGS)})") | low.rlike(rf"\d+ +\w+ +(?:{any_of(rules.STREETS)})\b")


def split_place(text: Column) -> tuple[Column, Column]:
    """(venue, postcode) of "venue, address, POSTCODE": the text before the postcode without its trailing marks, its
    first part as the venue; TBC if nothing is there, or junk."""
    code = extract_postcode(text)
    before = F.when(code.isNull(), text).otherwise(F.substring(text, F.lit(1), F.instr(text, code) - 1))
    venue = F.trim(F.rtrim(F.split_part(F.rtrim(before, F.lit(" ,.-")), F.lit(","), F.lit(1)), F.lit(" ,.-")))
    return F.coalesce(F.when(~is_junk_venue(before), F.nullif(venue, F.lit(""))), F.lit("TBC")), normalise_postcode(code)


def venue_stem(name: Column, stems: dict[str, str], location: Column) -> Column:
    """The venue of an event title such as "Aston-le-Walls International (2)": what follows the stem goes, then the
    dictionary; the location for travelling finals; else the stem itself."""

    def cleaned(t: Column) -> Column:
        t = F.regexp_replace(t, r"\s+-\s.*$", "")
        t = F.regexp_replace(t, rf"(?i)\s+(?:{any_of(rules.STEM_ENDINGS)})\b.*$", "")
        for ending in (r"\s+horse trials?", r"\s+\d{4}", r"\s*\(\d+\)", r"\s+international"):
            t = F.regexp_replace(t, rf"(?i){ending}\s*$", "")
        return title_case(F.trim(t))

    def named(stem: Column) -> Column:
        known = lookup({k.lower(): v for k, v in stems.items()}, F.lower(stem))
        travels = F.lower(name).rlike(r"\b(?:" + any_of(rules.TRAVELLING) + ")")
        return F.coalesce(known, F.when(~travels, F.nullif(stem, F.lit(""))), F.nullif(F.trim(location), F.lit("")), F.lit("TBC"))

    return let(let(F.trim(name), cleaned), named)


def prefix_venue(name: Column, label: Column) -> Column:
    """The label before the name, unless the name has the label's first word."""
    n = F.trim(F.coalesce(name, F.lit("")))
    key = F.lower(F.split_part(F.trim(label), F.lit(" "), F.lit(1)))
    return F.when(F.contains(F.lower(n), key), n).otherwise(F.concat(label, F.lit(" — "), n))


def event_title(grade: Column, discipline: Column, venue: Column) -> Column:
    return F.concat_ws(" - ", F.concat_ws(" ", grade, discipline), venue)


def title_of_slug(slug: Column) -> Column:
    """A readable title of a URL slug: numbers at the end go; null below two words; at most 100 characters."""
    t = F.regexp_replace(slug, r"^.*/", "")
    t = F.regexp_replace(t, r"(?:-\d+)+$", "")
    t = F.trim(F.regexp_replace(t, r"[-_]+", " "))
    return F.when(F.size(F.split(t, " ")) >= 2, F.substring(title_case(t), 1, 100))
