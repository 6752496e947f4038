"""Event type, discipline and spectator value of a listing, as column expressions built from the rule tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .keywords import Scanned
from .text import let, normalise_discipline

U = "(?U)"


def escaped(word: str) -> str:
    return "".join("\\" + c if c in r".+*?()[]{}|^$\/" else c for c in word)


def word(keyword: str) -> str:
    """A pattern of the keyword as a whole word; plain words of four letters or more also in the plural."""
    return U + r"\b" + escaped(keyword) + (r"s?\b" if re.fullmatch("[a-z]{4,}", keyword) else r"\b")


def has(text: Column | Scanned, keywords: list[str]) -> Column:
    """One of the keywords as a whole word. A text whose keywords have been found already isn't read again."""
    if isinstance(text, Scanned):
        return text.has(keywords)
    plural = [escaped(k) for k in keywords if re.fullmatch("[a-z]{4,}", k)]
    exact = [escaped(k) for k in keywords if not re.fullmatch("[a-z]{4,}", k)]
    parts = [rf"\b(?:{'|'.join(plural)})s?\b"] * bool(plural) + [rf"\b(?:{'|'.join(exact)})\b"] * bool(exact)
    return text.rlike(U + "(?:" + "|".join(parts) + ")")


def whole(text: Column, words: list[str]) -> Column:
    """One of the words or phrases, in lower case, as it stands."""
    return text.rlike(U + r"\b(?:" + "|".join(map(escaped, words)) + r")\b")


def begins(text: Column, words: list[str]) -> Column:
    """A word or phrase that begins with one of these."""
    return text.rlike(U + r"\b(?:" + "|".join(map(escaped, words)) + ")")


def tidy(name: Column) -> Column:
    """Lower case, single spaces, none around stars and slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " "), r" ?([*/]) ?", "$1")


def starred(text: Column, stars: tuple[int, int]) -> Column:
    """A rating of so many stars in a tidy text."""
    return text.rlike(rf"(?:^|\D)[{stars[0]}-{stars[1]}]\*")


def normalised(*parts: Column) -> Column:
    """Lower case, & as and, single spaces."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))
    return F.trim(F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), r"(?U)\s+", " "))


def event_type(name: Column, hint: Column | None = None) -> Column:
    """By keywords in the name, longest first, whole words with a plural; "combined training" is no training."""
    ordered = sorted(((k, t) for t, ks in rules.EVENT_TYPES.items() for k in ks), key=lambda x: -len(x[0]))

    def typed(low: Column) -> Column:
        out = None
        for k, t in ordered:
            hit = low.rlike(rf"(?U)\b{escaped(k)}(?:e?s)?\b")
            if k == "training":
                hit = hit & ~low.rlike(r"combined\s+training|arena\s+eventing\s+training")
            out = F.when(hit, t) if out is None else out.when(hit, t)
        return out.otherwise("competition")

    out = let(F.lower(F.coalesce(name, F.lit(""))), typed)
    return out if hint is None else F.coalesce(F.nullif(hint, F.lit("")), out)


def discipline_of(name: Column, hint: Column | None = None, description: Column | None = None) -> Column:
    """The hint's discipline, or the one whose first alias in name and description is longest; ties: table order."""
    text = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit("")) if description is not None else F.lit("")))

    def longest(text: Column) -> Column:
        options = []
        for k, (d, aliases) in enumerate(rules.DISCIPLINES.items()):
            hit = F.regexp_extract(text, r"(?U)\b(" + "|".join(map(escaped, aliases)) + r")\b", 1)
            options.append(F.struct(F.length(hit).alias("n"), F.lit(-k).alias("order"), F.lit(d).alias("name")))
        return let(F.array_max(F.array(*options)), lambda best: F.when(best["n"] > 0, best["name"]))

    found = let(text, longest)
    return found if hint is None else F.coalesce(normalise_discipline(hint), found)


def first_discipline(text: Column) -> Column:
    """The first discipline, in table order, that a text names."""

    def first(low: Column) -> Column:
        out = None
        for d, aliases in rules.DISCIPLINES.items():
            out = F.when(whole(low, aliases), d) if out is None else out.when(whole(low, aliases), d)
        return out

    return let(F.lower(text), first)


def should_skip(discipline: Column, name: Column) -> Column:
    """A discipline that is given but unknown, or a name that is no competition's."""
    given = F.coalesce(discipline, F.lit("")) != ""
    return (given & normalise_discipline(discipline).isNull()) | (event_type(name) != "competition")


def spectator(name: Column, kind: Column, hint: Column | None = None) -> Column:
    """Worth watching: the hint, else a show, an international code, any star rating or a marquee term."""

    def watched(n: Column) -> Column:
        return F.coalesce(kind == "show", F.lit(False)) | whole(n, rules.SHOW_CODES + rules.MARQUEE_TERMS) | n.rlike(r"\d\*")

    out = let(tidy(name), watched)
    return out if hint is None else F.coalesce(hint, out)


def continental_type(name: Column) -> Column:
    """Training by name; a competition if amateurs may enter, a show if only the elite does; else a competition."""

    def typed(n: Column) -> Column:
        open_to = whole(n, rules.AMATEUR_WORDS) | begins(n, rules.AMATEUR_BEGINNINGS) | starred(n, rules.AMATEUR_STARS)
        elite = whole(n, rules.ELITE_CODES) | starred(n, rules.ELITE_STARS) | n.rlike("|".join(map(escaped, rules.ELITE_TERMS)))
        return F.when(event_type(n) == "training", "training").when(open_to, "competition").when(elite, "show").otherwise("competition")

    return let(tidy(name), typed)


def continental_discipline(name: Column) -> Column:
    n = F.upper(F.coalesce(name, F.lit("")))
    return F.when(F.contains(n, F.lit("CDI")) | F.contains(n, F.lit("DRESSAGE")), "Dressage").when(F.contains(n, F.lit("CCI")) | F.contains(n, F.lit("EVENTING")), "Eventing").otherwise("Show Jumping")


def rally_type(name: Column) -> Column:
    """A rally is training unless its name speaks of competing."""
    compete = F.lower(name).rlike(r"(?U)\b(?:competition|championship|qualifier|show|league)s?\b")
    return F.when(F.lower(name).rlike(r"(?U)\brall(?:y|ies)\b") & ~compete, "training").otherwise(event_type(name))


def is_booking_payment(name: Column) -> Column:
    """Deposits and instalments that sources list as rows of their own: a term, a deposit behind a dash or bracket, or
    a payment that is told apart from others by a number or word."""
    numbered = "|".join([*rules.WHICH_PAYMENT, r"\d{1,2}(?:st|nd|rd|th)?"])

    def paid(n: Column) -> Column:
        behind = F.transform(F.slice(F.split(n, f"[{rules.DEPOSIT_AFTER}]"), 2, 1000), lambda x: F.trim(x))
        deposit = F.exists(behind, lambda x: x.rlike(rf"^{rules.DEPOSIT}\b"))
        return whole(n, rules.PAYMENT_TERMS) | deposit | n.rlike(rf"{U}\b(?:{numbered}) (?:{'|'.join(rules.PAYMENTS)})\b")

    return F.coalesce(let(F.regexp_replace(F.lower(name), r"\s+", " "), paid), F.lit(False))


def is_long(start: Column, end: Column, days: int = 120) -> Column:
    return F.coalesce(F.datediff(end, start) > days, F.lit(False))


def is_hidden(name: Column, start: Column, end: Column, days: int = 120) -> Column:
    """Spans of more than `days` days, and booking rows."""
    return is_long(start, end, days) | is_booking_payment(name)
