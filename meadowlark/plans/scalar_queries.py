"""Queries of scalar functions: names and postcodes (N), dates (D), classification and tags (T), geo and JSON (G)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import classify, dates, geo, rules, tags, text
from .demo import TODAY, pick
from .registry import query
from .search_queries import CLASSES, LISTS, TAGS, T, miles

C = F.col
PC = "[A-Z]{1,2}[0-9][A-Z0-9]?"


def title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"


def rx(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}')"


SUFFIX = "|".join(rules.VENUE_SUFFIXES)


@query(
    "N1_venue_name",
    rf"""WITH a AS (SELECT batch_seq, coalesce(venue_name, '') AS raw FROM extracted),
    b AS (SELECT *, {rx("raw", r"\s*\([0-9]+\)(\s*-\s*.+)?$")} AS t FROM a),
    c AS (SELECT *, {title("trim(t)")} AS t2 FROM b),
    d AS (SELECT *, trim(regexp_replace(t2, '(?i)\s*\(?\b{PC}\s+[0-9][A-Z]{{2}}\b\)?\s*', ' ', 'g')) AS bare FROM c),
    e AS (SELECT *, {rx(rx("CASE WHEN bare = '' THEN t2 ELSE bare END", r"(?i)\s+Limited$"), r"\s*-\s+[A-Z][A-Za-z]{1,4}$")} AS t3 FROM d),
    f AS (SELECT *, trim({rx(f"rtrim({rx('t3', rf'(?i)(\s+({SUFFIX}))+$')})", r"[-:&,.\s]+$")}) AS t4 FROM e),
    g AS (SELECT *, trim({rx("t4", r"(?i)\s+(Of|At|In|For|The|And|&)\s*$")}) AS t5 FROM f)
    SELECT batch_seq, CASE WHEN trim(raw) = '' THEN 'Tbc' WHEN starts_with(lower(trim(raw)), 'online') OR lower(trim(raw)) = 'virtual' THEN 'Online'
      WHEN length(t5) < 2 OR length(t5) > 100 OR regexp_matches(t5, '^(?i){PC}\s*[0-9][A-Z]{{2}}$') THEN 'Tbc'
      WHEN contains(t5, ',') AND length(trim(split_part(t5, ',', 1))) >= 4 AND (length(t5) - length(replace(t5, ',', '')) >= 2 OR length(t5) > 50) THEN trim(split_part(t5, ',', 1)) ELSE t5 END AS venue FROM g""",
)
def _(t):
    return t.extracted.select("batch_seq", text.normalise_venue_name(F.coalesce("venue_name", F.lit(""))).alias("venue"))


NPC = rf"CASE WHEN regexp_matches(trim(@), '^(?i)({PC})\s*([0-9][A-Z]{{2}})\.?$') THEN upper(regexp_replace(trim(@), '^(?i)({PC})\s*([0-9][A-Z]{{2}})\.?$', '\1 \2')) END"


@query("N2_postcode", f"WITH p AS (SELECT batch_seq, CASE batch_seq % 4 WHEN 0 THEN replace(lower(venue_postcode), ' ', '') WHEN 1 THEN venue_postcode || '.' ELSE '  ' || venue_postcode END AS raw FROM extracted) SELECT batch_seq, {NPC.replace('@', 'raw')} AS postcode FROM p")
def _(t):
    k = C("batch_seq") % 4
    raw = F.when(k == 0, F.replace(F.lower("venue_postcode"), F.lit(" "), F.lit(""))).when(k == 1, F.concat("venue_postcode", F.lit("."))).otherwise(F.concat(F.lit("  "), C("venue_postcode")))
    return t.extracted.select("batch_seq", text.normalise_postcode(raw).alias("postcode"))


DISC = {a: d for d, al in rules.DISCIPLINES.items() for a in al}
DISC_MAP = "MAP {" + ", ".join(f"'{a}': '{d}'" for a, d in DISC.items()) + "}"


DISC_SQL = "coalesce(m[replace(lower(trim({x})), '_', ' ')], list_filter(list_transform(regexp_split_to_array({x}, '[,/]'), lambda y: m[replace(lower(trim(y)), '_', ' ')]), lambda y: y IS NOT NULL)[1])"


@query("N3_discipline", f"WITH m AS (SELECT {DISC_MAP} AS m) SELECT batch_seq, discipline AS raw, {DISC_SQL.format(x='discipline')} AS discipline FROM extracted, m")
def _(t):
    return t.extracted.select("batch_seq", C("discipline").alias("raw"), text.normalise_discipline(C("discipline")).alias("discipline"))


@query("N4_first_postcode", rf"SELECT batch_seq, nullif(regexp_extract(venue_name, '(?i)\b{PC}\s+[0-9][A-Z]{{2}}\b'), '') AS postcode FROM extracted")
def _(t):
    return t.extracted.select("batch_seq", text.extract_postcode(C("venue_name")).alias("postcode"))


@query(
    "N5_disambiguated",
    f"SELECT batch_seq, CASE WHEN split_part(venue_name, ' 1', 1) IN ('Rectory Farm', 'Brook Farm') AND nullif(regexp_extract(upper(venue_postcode), '^({PC}) ', 1), '') IS NOT NULL THEN split_part(venue_name, ' 1', 1) || ' (' || regexp_extract(upper(venue_postcode), '^({PC}) ', 1) || ')' ELSE split_part(venue_name, ' 1', 1) END AS venue FROM extracted",
)
def _(t):
    name = F.split_part(C("venue_name"), F.lit(" 1"), F.lit(1))
    return t.extracted.select("batch_seq", text.disambiguate_venue(name, C("venue_postcode")).alias("venue"))


AT = r"CASE WHEN length(trim(regexp_extract(name, '(?i)\bat\s+(.+?)$', 1))) > 2 AND NOT regexp_matches(trim(regexp_extract(name, '(?i)\bat\s+(.+?)$', 1)), '^[0-9]') THEN trim(regexp_extract(name, '(?i)\bat\s+(.+?)$', 1)) END"
SIGN = r"nullif(trim(regexp_extract(name, '@\s*(.+)$', 1)), '')"


@query(
    "N6_venue_in_title",
    f"""SELECT id, {AT} AS at_venue, {SIGN} AS sign_venue, coalesce({AT}, {SIGN}, CASE WHEN id % 2 = 0 THEN 'Club' || id END, 'TBC') AS held_by,
    CASE id % 5 WHEN 0 THEN 'Arena ' || id WHEN 1 THEN 'Arena ' || id WHEN 2 THEN 'Arena' WHEN 3 THEN 'Arena' ELSE 'Tbc' END AS titled FROM event""",
)
def _(t):
    k, n = C("id") % 5, C("id").cast("string")
    made = F.when(k == 0, F.concat(F.lit("Arena "), n, F.lit(" - Show (open)"))).when(k == 1, F.concat(F.lit("Arena "), n, F.lit(" | Show"))).when(k == 2, "Arena British Dressage 2026").when(k == 3, "Arena Sat 4").otherwise("Mini")
    return t.event.select("id", text.venue_at(C("name")).alias("at_venue"), text.venue_after_sign(C("name")).alias("sign_venue"), text.venue_or_organiser(C("name"), F.when(C("id") % 2 == 0, F.concat(F.lit("Club"), n))).alias("held_by"), text.venue_of_title(made).alias("titled"))


@query("N7_split_place", rf"WITH p AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'Book now' WHEN id % 5 = 1 THEN id || ' Mill Lane' ELSE name || ', Long Lane, ' || coalesce(postcode, '') END AS place FROM venue) SELECT id, CASE WHEN id % 5 < 2 THEN 'TBC' ELSE regexp_replace(split_part(regexp_replace(regexp_replace(place, '\b{PC} [0-9][A-Z]{{2}}$', ''), '[ ,.-]+$', ''), ',', 1), '[ ,.-]+$', '') END AS venue, nullif(regexp_extract(place, '\b{PC} [0-9][A-Z]{{2}}$'), '') AS postcode FROM p")
def _(t):
    k = C("id") % 5
    place = F.when(k == 0, "Book now").when(k == 1, F.concat(C("id").cast("string"), F.lit(" Mill Lane"))).otherwise(F.concat(C("name"), F.lit(", Long Lane, "), F.coalesce("postcode", F.lit(""))))
    venue, code = text.split_place(place)
    return t.venue.select("id", venue.alias("venue"), code.alias("postcode"))


@query("N8_event_stem", "SELECT id, CASE id % 4 WHEN 0 THEN 'Aston-le-Walls' WHEN 1 THEN 'Hickstead' WHEN 2 THEN name ELSE 'Nowhere ' || upper(substr(split_part(name, ' ', 1), 1, 1)) || lower(substr(split_part(name, ' ', 1), 2)) END AS venue FROM (SELECT id, replace(name, '-', ' ') AS name FROM venue)")
def _(t):
    v = t.venue.withColumn("name", F.replace("name", F.lit("-"), F.lit(" ")))
    k = C("id") % 4
    made = F.when(k == 0, "Aston International (2)").when(k == 1, "HICKSTEAD Horse Trials sponsored by Acme").when(k == 2, "Grassroots Championship").otherwise(F.concat(F.lit("NOWHERE "), F.split_part("name", F.lit(" "), F.lit(1)), F.lit(" International 2026")))
    return v.select("id", text.venue_stem(made, {"Aston": "Aston-le-Walls", "Hickstead": "Hickstead"}, C("name")).alias("venue"))


@query("N9_names_built", "SELECT e.id, CASE WHEN contains(lower(e.name), lower(split_part(v.name, ' ', 1))) THEN trim(e.name) ELSE v.name || ' — ' || trim(e.name) END AS prefixed, 'BS Senior' || coalesce(' ' || e.discipline, '') || coalesce(' - ' || v.name, '') AS built FROM event e LEFT JOIN venue v ON v.id = e.venue_id")
def _(t):
    from ..operators.search import with_venue

    j = with_venue(t.event, t.venue)
    return j.select("id", text.prefix_venue(C("name"), C("venue_name")).alias("prefixed"), text.event_title(F.lit("BS Senior"), C("discipline"), C("venue_name")).alias("built"))


SLUG = "trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), '( [0-9]+)+ *$', ''))"


@query("N10_slug_title", f"SELECT id, CASE WHEN contains(x, ' ') THEN substr({title('x')}, 1, 100) END AS title FROM (SELECT id, {SLUG} AS x FROM event)")
def _(t):
    slug = F.rtrim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), F.lit("-"))
    return t.event.select("id", text.title_of_slug(F.concat(F.lit("events/"), slug, F.lit("-20260304"))).alias("title"))


@query("N11_postcode_parts", f"SELECT id, nullif(regexp_extract(postcode, '^{PC}'), '') AS outward, nullif(regexp_extract(postcode, '^([A-Z]{{1,2}})[0-9]', 1), '') AS area, replace(postcode, ' ', '') AS compact FROM venue")
def _(t):
    p = C("postcode")
    return t.venue.select("id", text.outward_code(p).alias("outward"), text.area_letters(p).alias("area"), text.compact_postcode(p).alias("compact"))


# -- dates --------------------------------------------------------------------------------------------------------

DAYS = "SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders"


def days(t):
    return t.orders.select(C("o_orderkey").alias("k"), C("o_orderdate").cast("date").alias("d"))


@query("D1_formats", f"SELECT k, CASE WHEN k % 7 = 6 THEN NULL ELSE d END AS parsed FROM ({DAYS})")
def _(t):
    k, d = C("k") % 7, C("d")
    raw = F.when(k == 6, "no date")
    for n, f in enumerate(("yyyy-MM-dd", "dd/MM/yyyy", "d MMMM yyyy", "dd.MM.yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss")):
        raw = raw.when(k == n, F.date_format(d, f))
    return days(t).select("k", dates.parse_date(raw).alias("parsed"))


@query("D2_range_text", f"SELECT k, d AS start, CASE WHEN k % 4 = 2 THEN NULL ELSE d + 1 + CAST(k % 20 AS INT) + CASE WHEN k % 4 = 3 THEN 4 ELSE 0 END END AS finish FROM ({DAYS})")
def _(t):
    """Two days of one month or two; one day; two ranges, of which the first day and the last count."""
    end, kind, day = F.date_add("d", (C("k") % 20).cast("int") + 1), C("k") % 4, F.date_format("d", "d")
    own_month = F.when(F.date_trunc("month", "d") == F.date_trunc("month", end), "").otherwise(F.concat(F.lit(" "), F.date_format("d", "MMM")))
    cross = F.concat(day, F.lit("th "), F.date_format("d", "MMM"), F.lit(" – "), F.date_format(end, "d MMMM yyyy"))
    double = F.concat(cross, F.lit(" & "), F.date_format(F.date_add(end, 2), "d MMM"), F.lit(" - "), F.date_format(F.date_add(end, 4), "d MMM yyyy"))
    both = F.concat(day, own_month, F.lit(" & "), F.date_format(end, "d MMM yyyy"))
    raw = F.when(kind == 0, cross).when(kind == 1, both).when(kind == 2, F.date_format("d", "d MMM yyyy")).otherwise(double)
    start, finish = dates.date_range(raw)
    return days(t).select("k", start.alias("start"), finish.alias("finish"))


@query("D3_mentioned", f"SELECT k, d AS start, CASE WHEN k % 5 = 0 THEN NULL ELSE d + CAST(k % 5 AS INT) END AS finish FROM ({DAYS})")
def _(t):
    end = F.date_add("d", (C("k") % 5).cast("int"))
    start, finish = dates.mentioned(F.concat(F.lit("Opens "), F.date_format("d", "dd/MM/yyyy"), F.lit(" and closes "), F.date_format(end, "d/M/yyyy"), F.lit(".")))
    return days(t).select("k", start.alias("start"), finish.alias("finish"))


@query("D4_year_inferred", f"SELECT k, CASE WHEN make_date(1998, month(d), least(day(d), 28)) < {T} THEN make_date(1999, month(d), least(day(d), 28)) ELSE make_date(1998, month(d), least(day(d), 28)) END AS rolled, make_date(CASE WHEN month(d) >= 9 THEN 1997 ELSE 1998 END, month(d), least(day(d), 28)) AS academic FROM ({DAYS})")
def _(t):
    m, day = F.month("d"), F.least(F.dayofmonth("d"), F.lit(28))
    return days(t).select("k", dates.roll_forward(m, day, t.today()).alias("rolled"), dates.academic_date(m, day, F.lit(1997)).alias("academic"))


@query("D5_date_in_url", f"SELECT k, CASE k % 5 WHEN 3 THEN NULL WHEN 4 THEN make_date(CASE WHEN make_date(1998, month(d), least(day(d), 28)) < {T} THEN 1999 ELSE 1998 END, month(d), least(day(d), 28)) ELSE d END AS found FROM ({DAYS})")
def _(t):
    k, low = C("k") % 5, F.make_date(F.lit(1998), F.month("d"), F.least(F.dayofmonth("d"), F.lit(28)))
    slug = F.concat(F.lit("/e/show-"), F.dayofmonth(low).cast("string"), F.lit("th-"), F.lower(F.date_format("d", "MMMM")), F.lit("-final"))
    url = F.when(k == 0, F.concat(F.lit("https://e.example/show-"), F.date_format("d", "yyyyMMdd"))).when(k == 1, F.concat(F.lit("/on/"), F.date_format("d", "yyyy/MM/dd"))).when(k == 2, F.concat(F.lit("/e/"), F.date_format("d", "dd-MM-yyyy"), F.lit("/x"))).when(k == 4, slug).otherwise("/none")
    return days(t).select("k", dates.date_in_url(url, t.today()).alias("found"))


@query("D6_day_list", f"SELECT k, make_date(year(d), month(d), 1 + k % 20) AS start, make_date(year(d), month(d), 3 + k % 20) AS finish FROM ({DAYS})")
def _(t):
    k = C("k") % 20
    month = F.element_at(F.array(*[F.lit(m.upper()) for m in rules.ITALIAN_MONTHS]), F.month("d"))
    start, finish = dates.day_list(F.concat((k + 1).cast("string"), F.lit("."), (k + 2).cast("string"), F.lit("."), (k + 3).cast("string"), F.lit(" "), month, F.lit(" "), F.year("d").cast("string")), rules.ITALIAN_MONTHS)
    return days(t).select("k", start.alias("start"), finish.alias("finish"))


@query("D7_end_only_if_later", "SELECT id, nullif(date_end, date_start) AS date_end FROM event")
def _(t):
    return t.event.select("id", F.nullif("date_end", "date_start").alias("date_end"))


# -- classification and tags --------------------------------------------------------------------------------------

LOW = "lower(name)"


def sql_word(k: str, plural: bool = True) -> str:
    return r"\b" + re.sub(r"([.+*?()\[\]{}|^$\\])", r"\\\1", k) + (r"s?\b" if plural and re.fullmatch("[a-z]{4,}", k) else r"\b" if re.search(r"\w$", k) else "")


def sql_has(x: str, words: list[str]) -> str:
    return f"regexp_matches({x}, '{'|'.join(map(sql_word, words))}')"


TYPE = "CASE " + " ".join(
    f"WHEN regexp_matches({LOW}, '\\b{k.replace('+', '[+]')}(e?s)?\\b')" + (" AND NOT regexp_matches(lower(name), 'combined\\s+training|arena\\s+eventing\\s+training')" if k == "training" else "") + f" THEN '{v}'"
    for k, v in sorted(((k, v) for v, ks in rules.EVENT_TYPES.items() for k in ks), key=lambda x: -len(x[0]))
) + " ELSE 'competition' END"
NORM = r"trim(regexp_replace(replace(lower(name || ' ' || coalesce(description, '')), '&', ' and '), '\s+', ' ', 'g'))"


@query("T1_event_type", f"SELECT id, {TYPE} AS kind FROM event")
def _(t):
    return t.event.select("id", classify.event_type(C("name")).alias("kind"))


def best_alias(x: str) -> str:
    rows = ", ".join(f"{{'n': length(regexp_extract({x}, '{'|'.join(sql_word(a, False) for a in al)}')), 'o': {-k}, 'd': '{d}'}}" for k, (d, al) in enumerate(rules.DISCIPLINES.items()))
    return f"(SELECT CASE WHEN m.n > 0 THEN m.d END FROM (SELECT list_max([{rows}]) AS m))"


@query("T2_discipline", f"SELECT id, {best_alias('x')} AS discipline FROM (SELECT id, lower(name || ' ' || coalesce(description, '')) AS x FROM event)")
def _(t):
    return t.event.select("id", classify.discipline_of(C("name"), None, C("description")).alias("discipline"))


FIRST = "CASE " + " ".join(f"WHEN regexp_matches({LOW}, '{'|'.join(sql_word(a, False) for a in al)}') THEN '{d}'" for d, al in rules.DISCIPLINES.items()) + " END"


@query("T3_first_match", f"SELECT id, {FIRST} AS discipline, {TYPE} <> 'competition' OR coalesce(discipline, '') = 'Yoga' AS skip FROM (SELECT id, name, CASE WHEN id % 7 = 0 THEN 'Yoga' ELSE discipline END AS discipline FROM event)")
def _(t):
    given = F.when(C("id") % 7 == 0, "Yoga").otherwise(C("discipline"))
    return t.event.select("id", classify.first_discipline(C("name")).alias("discipline"), classify.should_skip(given, C("name")).alias("skip"))


TIDY = r"regexp_replace(regexp_replace(lower(name), '\s+', ' ', 'g'), ' ?([*/]) ?', '\1', 'g')"
MARQUEE = "county show|country fair|country festival|village show|ploughing match|hedgelaying|agricultural|national championship|world championship|european championship|world cup|nations cup|international horse show"


@query("T4_spectator", rf"SELECT id, coalesce(CASE WHEN id % 13 = 0 THEN spectator END, coalesce(event_type = 'show', false) OR regexp_matches(n, '\b(csi|csio|cdi|cdio|cci|ccio|chi|chio|{MARQUEE})\b') OR regexp_matches(n, '[0-9][*]')) AS watch FROM (SELECT *, {TIDY} AS n FROM event)")
def _(t):
    return t.event.select("id", classify.spectator(C("name"), C("event_type"), F.when(C("id") % 13 == 0, C("spectator"))).alias("watch"))


OPEN_TO = r"regexp_matches(n, '\b(yh|youth|children|u21|u25|j/p)\b') OR regexp_matches(n, '\b(young ?horse|jonge ?paard|junior|pony|amateur|talent)') OR regexp_matches(n, '(^|[^0-9])[12][*]')"
ELITE = r"regexp_matches(n, '\b(csio|chio|cdio|ccio)\b') OR regexp_matches(n, '(^|[^0-9])[3-5][*]') OR regexp_matches(n, 'nations? cup|world cup|championship|global champions|grand champions')"


@query(
    "T5_continental",
    f"SELECT id, CASE WHEN {TYPE} = 'training' THEN 'training' WHEN {OPEN_TO} THEN 'competition' WHEN {ELITE} THEN 'show' ELSE 'competition' END AS kind, CASE WHEN contains(upper(name), 'CDI') OR contains(upper(name), 'DRESSAGE') THEN 'Dressage' WHEN contains(upper(name), 'CCI') OR contains(upper(name), 'EVENTING') THEN 'Eventing' ELSE 'Show Jumping' END AS discipline FROM (SELECT *, {TIDY} AS n FROM event)",
)
def _(t):
    return t.event.select("id", classify.continental_type(C("name")).alias("kind"), classify.continental_discipline(C("name")).alias("discipline"))


@query("T6_rally_rule", rf"SELECT id, CASE WHEN regexp_matches({LOW}, '\brall(y|ies)\b') AND NOT regexp_matches({LOW}, '\b(competition|championship|qualifier|show|league)s?\b') THEN 'training' ELSE {TYPE} END AS kind FROM event")
def _(t):
    return t.event.select("id", classify.rally_type(C("name")).alias("kind"))


@query("T7_multi_discipline")
def _(t):
    """Span claiming can't be told in SQL; tests compare it with examples."""
    classes = tags.from_json_list(C("classes"))
    found = tags.discipline_tags(C("name"), classes, C("discipline"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return t.event.select("id", F.array_join(found, ";").alias("tags"))


def sql_tags(namespace: str, table: dict[str, list[str]]) -> str:
    return "[" + ", ".join(f"CASE WHEN {sql_has('x', words)} THEN '{namespace}:{v}' END" for v, words in table.items()) + "]"


def joined(*lists: str) -> str:
    return "array_to_string(list_filter(" + " || ".join(lists) + ", lambda z: z IS NOT NULL), ';')"


def worded(t):
    """Events with their normalised text, computed once for all tags."""
    return t.event.withColumn("x", classify.normalised(C("name"), C("description")))


NORMALISED = f"(SELECT id, name, classes, {NORM} AS x FROM event)"


def one_of(*cases: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {hit} THEN '{tag}'" for hit, tag in cases) + " END"


LEVEL = one_of(
    (sql_has("x", ["championship"]), "level:championship"), (r"regexp_matches(regexp_replace(x, '\badvanced\s+(booking|notice|entr)', '', 'g'), '\badvanced\b')", "level:advanced"), (sql_has("x", ["intermediate"]), "level:intermediate"),
    (sql_has("x", ["novice"]), "level:novice"), (sql_has("x", ["beginner"]), "level:beginner"), (sql_has("x", ["all levels", "mixed level"]), "level:mixed"),
)
AFFILIATION, FORMAT = sql_tags("affiliation", rules.AFFILIATIONS), sql_tags("format", rules.FORMATS)
SCOPE = one_of((sql_has("x", rules.SCOPES["international"]), "scope:international"), (sql_has("x", rules.SCOPES["national"]), "scope:national"))
AGE = r"[CASE WHEN regexp_matches(regexp_replace(x, '\bseniors?\s+citizens?', '', 'g'), '\bseniors?\b') THEN 'age:senior' END] || " + sql_tags("age", rules.AGES)
SPECIAL = sql_tags("special", rules.SPECIALS) + f" || [CASE WHEN {sql_has('x', rules.MOORLAND)} THEN 'special:mountain-and-moorland' END, CASE WHEN {sql_has('x', rules.NATIVE)} THEN 'special:native-breed' END, CASE WHEN NOT {sql_has('x', rules.MOORLAND)} AND NOT {sql_has('x', rules.NATIVE)} AND {sql_has('x', rules.BREED)} THEN 'special:breed-specific' END, CASE WHEN {sql_has('x', rules.LONG_FORMAT)} THEN 'special:long-format' END]"


@query("T8_rule_tags", f"SELECT id, {LEVEL} AS level, {joined(AFFILIATION)} AS affiliation, {joined(FORMAT)} AS format, {SCOPE} AS scope, {joined(AGE)} AS age, {joined(SPECIAL)} AS special FROM {NORMALISED}")
def _(t):
    x, none = C("x"), F.lit(None).cast("string")
    return worded(t).select(
        "id", tags.level_tag(x).alias("level"), F.array_join(tags.affiliation_tags(x, none), ";").alias("affiliation"), F.array_join(tags.format_tags(x), ";").alias("format"),
        tags.scope_tag(x).alias("scope"), F.array_join(tags.age_tags(x), ";").alias("age"), F.array_join(tags.special_tags(x), ";").alias("special"),
    )


SERIES = "[" + ", ".join(f"CASE WHEN {sql_has('x', w)}" + (f" AND {sql_has('x', n)}" if n else "") + (f" AND NOT {sql_has('x', b)}" if b else "") + f" THEN 'series:{k}' END" for k, (w, n, b) in rules.SERIES.items()) + "]"


@query("T9_series", f"SELECT id, {joined(SERIES)} AS series FROM {NORMALISED}")
def _(t):
    return worded(t).select("id", F.array_join(tags.series_tags(C("x")), ";").alias("series"))


def class_sql(c: str) -> str:
    ordered = sorted(rules.CLASS_SERIES.items(), key=lambda x: -len(x[1][0]))
    cases = " ".join(f"WHEN {sql_has(c, [k])} THEN '{v}'" for v, (k, _) in ordered)
    heights = " ".join(f"WHEN {sql_has(c, [k])} THEN {cm or 'NULL'}" for _, (k, cm) in ordered)
    parsed = rf"CASE WHEN regexp_matches({c}, '\b[0-9][.][0-9][0-9]\s*m\b') THEN CAST(regexp_extract({c}, '\b([0-9])[.][0-9][0-9]\s*m\b', 1) AS INT) * 100 + CAST(regexp_extract({c}, '\b[0-9][.]([0-9][0-9])\s*m\b', 1) AS INT) ELSE TRY_CAST(regexp_extract({c}, '\b([0-9]{{2,3}})\s*cm\b', 1) AS INT) END"
    cm = f"coalesce(CASE {heights} END, nullif({parsed}, 0))"
    return rf"['class:' || (CASE {cases} END), CASE WHEN regexp_matches({c}, '\bpony\b') THEN 'audience:pony' WHEN regexp_matches({c}, '\b(junior|children)\b') THEN 'audience:junior' WHEN regexp_matches({c}, '\bseniors?\b') THEN 'audience:senior' WHEN regexp_matches({c}, '\b(amateur|veteran|adult)\b') THEN 'audience:adult' END, CASE WHEN {cm} IS NOT NULL THEN 'height:' || CAST(greatest(80, least(140, {cm} // 10 * 10)) AS VARCHAR) END]"


@query("T10_class_ladder", f"SELECT id, array_to_string(list_filter(flatten(list_transform({CLASSES}, lambda raw: {class_sql('lower(raw)')})), lambda z: z IS NOT NULL), ';') AS found FROM event")
def _(t):
    return t.event.select("id", F.array_join(tags.class_tags(tags.from_json_list(C("classes"))), ";").alias("found"))


CATEGORY = "[" + ", ".join("CASE WHEN " + " OR ".join(f"contains(x, '{w}')" for w in ws) + f" THEN 'category:{v}' END" for v, ws in rules.CATEGORIES.items()) + "]"


def tier_sql(affiliated: str) -> str:
    elite = r"regexp_matches(x, '\b(csi|csio|cdi|cdio|cci|ccio|chi|chio)\b') OR regexp_matches(x, '[3-5]\s*[*]') OR contains(x, 'world cup') OR contains(x, 'nations cup') OR contains(x, 'global champions')"
    return one_of((elite, "tier:elite"), (sql_has("x", rules.COUNTY_SHOW), "tier:county-show"), (sql_has("x", rules.NATIONAL_SHOW), "tier:national"), (affiliated, "tier:affiliated"), (sql_has("x", rules.UNAFFILIATED), "tier:unaffiliated"))


@query("T11_category_tier", f"SELECT id, {joined(CATEGORY)} AS category, {tier_sql(' OR '.join(sql_has('x', w) for w in rules.AFFILIATIONS.values()))} AS tier FROM {NORMALISED}")
def _(t):
    x = C("x")
    return worded(t).select("id", F.array_join(tags.category_tags(x), ";").alias("category"), tags.tier_tag(x, tags.affiliation_tags(x, F.lit(None).cast("string"))).alias("tier"))


ALL = f"(SELECT id, x || coalesce(' | ' || nullif(lower(array_to_string({CLASSES}, ' | ')), ''), '') AS y FROM {NORMALISED})"
FINAL = f"NOT ({' OR '.join(f'contains(y, {chr(39)}{w}{chr(39)})' for w in rules.FINALS_EXCLUDE)}) AND (regexp_matches(y, '\\b({'|'.join(rules.FINALS)})') OR {' OR '.join('(' + ' AND '.join(f'regexp_matches(y, {chr(39)}{chr(92)}b{p}{chr(39)})' for p in g) + ')' for g in rules.FINALS_ALL)})"


@query("T12_championship_final", f"SELECT id, {FINAL} AS is_final FROM {ALL}")
def _(t):
    x = C("x")
    return worded(t).select("id", tags.final_tag(x, tags.from_json_list(C("classes"))).isNotNull().alias("is_final"))


KIND = "'type:' || CASE coalesce(event_type, '') WHEN 'training' THEN 'training' WHEN 'venue_hire' THEN 'venue-hire' WHEN 'show' THEN 'show' WHEN 'social' THEN 'social' WHEN 'other' THEN 'other' ELSE 'competition' END"


def ruled(source: str) -> str:
    """All tags but disciplines, in order, of a table with id, x (normalised text), cl (classes), event_type and own
    (the source's affiliation)."""
    affs = f"CASE WHEN own IN ({', '.join(repr(v) for v in rules.VOCABULARY['affiliation'])}) AND NOT list_contains(texts, 'affiliation:' || own) THEN list_append(texts, 'affiliation:' || own) ELSE texts END"
    found = f"flatten(list_transform(cl, lambda raw: {class_sql('lower(raw)')}))"
    every = f"[{KIND}, {LEVEL}] || affs || {FORMAT} || [{SCOPE}] || {AGE} || {SPECIAL} || [CASE WHEN {FINAL} THEN 'special:championship-final' END] || {SERIES} || found || {CATEGORY} || [{tier_sql('len(affs) > 0')}]"
    return f"""SELECT id, array_to_string(list_filter({every}, lambda z: z IS NOT NULL), ';') AS tags FROM (SELECT *, {affs} AS affs, {found} AS found, x || coalesce(' | ' || nullif(lower(array_to_string(cl, ' | ')), ''), '') AS y
    FROM (SELECT *, list_filter({AFFILIATION}, lambda z: z IS NOT NULL) AS texts FROM ({source})))"""


@query("T13_all_tags", ruled(f"SELECT e.id, {NORM} AS x, {CLASSES} AS cl, event_type, s.affiliation AS own FROM event e LEFT JOIN source s ON s.id = e.source_id".replace("lower(name ||", "lower(e.name ||")))
def _(t):
    """The whole assembly, of which SQL tells all but the disciplines: their spans are claimed in order (T7)."""
    from ..operators.search import with_venue

    j = with_venue(t.event, t.venue).join(t.source.select(C("id").alias("source_id"), "affiliation"), "source_id", "left")
    every = tags.extract_tags(C("name"), C("description"), C("discipline"), C("event_type"), C("affiliation"), tags.from_json_list(C("classes")), C("venue_name"))
    return j.select("id", F.array_join(F.filter(every, lambda x: ~F.startswith(x, F.lit("discipline:"))), ";").alias("tags"))


VALID = "[" + ", ".join(f"'{n}:{v}'" for n, vs in rules.VOCABULARY.items() for v in vs) + "]"


@query("T14_vocabulary", f"SELECT id, array_to_string(list_filter(list_append({TAGS}, 'mood:sunny'), lambda z: list_contains({VALID}, z)), ';') AS tags FROM event")
def _(t):
    return t.event.select("id", F.array_join(tags.valid(F.array_append(tags.from_json_list(C("tags")), "mood:sunny")), ";").alias("tags"))


SHOWN = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in rules.DISPLAY.items()) + "}"


@query("T15_display_names", f"WITH m AS (SELECT {SHOWN} AS m), g AS (SELECT DISTINCT unnest({TAGS}) AS tag FROM event) SELECT tag, coalesce(m[split_part(tag, ':', 2)], {title(chr(114) + 'eplace(split_part(tag, ' + chr(39) + ':' + chr(39) + ', 2), ' + chr(39) + '-' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')')}) AS label FROM g, m")
def _(t):
    return t.event.select(F.explode(tags.from_json_list(C("tags"))).alias("tag")).distinct().select("tag", tags.display_name(C("tag")).alias("label"))


@query("T16_detail_text", f"SELECT id, trim(concat_ws(' ', nullif(description, ''), nullif(array_to_string({CLASSES}, ' '), ''))) AS detail FROM event")
def _(t):
    return t.event.select("id", tags.detail_text(C("description"), tags.from_json_list(C("classes"))).alias("detail"))


# -- geo, JSON, arrays --------------------------------------------------------------------------------------------


@query("G1_haversine", f"SELECT id, round({miles('51.5', '-0.12', 'latitude', 'longitude')}, 1) AS miles FROM venue")
def _(t):
    return t.venue.select("id", F.round(geo.haversine_miles(F.lit(51.5), F.lit(-0.12), C("latitude"), C("longitude")), 1).alias("miles"))


@query("G2_uk_box", "SELECT postcode, latitude BETWEEN 49 AND 61 AND longitude BETWEEN -11 AND 2 AND NOT (latitude = 0 AND longitude = 0) AS in_uk FROM postcode")
def _(t):
    return t.postcode.select("postcode", geo.in_box(C("latitude"), C("longitude")).alias("in_uk"))


@query("G3_coordinates_in_text", "SELECT id, latitude, longitude FROM venue")
def _(t):
    k, la, lo = C("id") % 3, C("latitude").cast("decimal(9,2)").cast("string"), C("longitude").cast("decimal(9,2)").cast("string")
    body = F.when(k == 0, F.concat(F.lit('{"latitude":"'), la, F.lit('", "longitude":"'), lo, F.lit('"}'))).when(k == 1, F.concat(F.lit('<div data-lat="'), la, F.lit('" data-lng="'), lo, F.lit('">'))).otherwise(F.concat(F.lit("https://maps/@"), la, F.lit(","), lo))
    lat, lng = geo.coordinates_in(body)
    return t.venue.select("id", lat.alias("latitude"), lng.alias("longitude"))


@query("G4_json_lists", f"SELECT id, len({CLASSES}) AS n, array_to_string({CLASSES}, ';') AS classes FROM event")
def _(t):
    c = tags.from_json_list(C("classes"))
    return t.event.select("id", F.size(c).cast("long").alias("n"), F.array_join(c, ";").alias("classes"))


@query("G5_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("G6_class_list", r"SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(name, '^Classes:', ''), '[,+|]|\band\b'), lambda x: trim(regexp_replace(trim(x), '\s+[0-9]+$', ''))), lambda x: x <> ''), ';') AS found FROM event")
def _(t):
    return t.event.select("id", F.array_join(tags.class_list(C("name")), ";").alias("found"))


@query("G6_headed_classes", r"SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(CASE WHEN id % 3 = 2 THEN '' ELSE name || ' / 90cm' END, '[|,/]'), lambda x: trim(x)), lambda x: x <> ''), ';') AS found FROM event")
def _(t):
    k = C("id") % 3
    text = F.concat(F.lit("All welcome.\n"), F.when(k == 0, "Heights: ").when(k == 1, "CLASSES - ").otherwise("Also "), C("name"), F.lit(" / 90cm\nBring a hat: a, b"))
    return t.event.select("id", F.array_join(tags.classes_after_heading(text), ";").alias("found"))


@query("G7_escapes", r"SELECT id, replace(replace(replace(replace(name, '\', '\\'), ';', '\;'), ',', '\,'), chr(10), '\n') AS ical, trim(regexp_replace(name || '  x' || chr(9) || ' & y', '\s+', ' ', 'g')) AS plain FROM event")
def _(t):
    from ..sources.sinks import ical_escape
    from ..sources.feeds import unescape_html

    body = F.concat(F.replace(C("name"), F.lit("&"), F.lit("&amp;")), F.lit("  x\t &#38; y"))
    return t.event.select("id", ical_escape(C("name")).alias("ical"), F.trim(F.regexp_replace(unescape_html(body), r"\s+", " ")).alias("plain"))
