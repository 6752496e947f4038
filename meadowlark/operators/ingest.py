"""Validation, venue resolution, classification and upsert of extracted listings (workload: ingest)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, geo, rules, tags, text
from .scans import numbered


def iso_date(value: Column) -> Column:
    """yyyy-MM-dd or yyyyMMdd; anything else is null. (A text that can't be read costs an exception for each form, so one
    without a digit isn't tried.)"""
    return F.when(value.rlike("[0-9]"), F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "yyyyMMdd")))


def gate(extracted: DataFrame) -> DataFrame:
    """Rows with a readable start date; unreadable end dates and URLs that aren't http(s) become null."""
    start, end = iso_date(F.col("date_start")), iso_date(F.col("date_end"))
    url = F.when(F.col("url").rlike("^https?://"), F.col("url"))
    return extracted.withColumns({"date_start": start, "date_end": end, "url": url}).where("date_start IS NOT NULL")


def locatable(venue: Column, postcode: Column) -> Column:
    """A real venue name, or a valid postcode."""
    nowhere = F.lower(F.trim(F.coalesce(venue, F.lit("")))).isin([*rules.PLACEHOLDERS, ""])
    return ~(nowhere & text.normalise_postcode(postcode).isNull())


def keep_first(df: DataFrame, keys: list[str], order: str = "batch_seq") -> DataFrame:
    """The first row of each key in arrival order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def resolve_venues(names: DataFrame, venues: DataFrame, aliases: DataFrame) -> DataFrame:
    """venue_name, postcode -> venue_id, matched_name, confidence, match_type for distinct pairs.

    In turn: virtual names are the venue Online; a placeholder with a postcode is the only venue there; a venue's
    name; an alias of a venue that exists (both whatever their case); else new. Three left joins on small keys.
    """
    low = F.lower(F.trim("venue_name"))
    v = venues.select(F.col("id").alias("vid"), F.col("name").alias("vname"), text.normalise_postcode(F.col("postcode")).alias("vpc"))
    unique = v.where("vpc IS NOT NULL").groupBy("vpc").agg(F.count("*").alias("n"), F.min("vid").alias("pc_id"), F.min("vname").alias("pc_name")).where("n = 1").drop("n")
    by_name = v.groupBy(F.lower("vname").alias("key")).agg(F.min_by("vid", "vid").alias("n_id"), F.min_by("vname", "vid").alias("n_name"))
    by_alias = aliases.join(v, aliases["venue_id"] == v["vid"]).groupBy(F.lower("alias").alias("akey")).agg(F.min_by("vid", "vid").alias("a_id"), F.min_by("vname", "vid").alias("a_name"))
    pairs = names.select("venue_name", "postcode").distinct().withColumn("key", F.when(low.isin(rules.VIRTUAL), "online").otherwise(low))
    joined = pairs.join(unique, F.when(F.col("key").isin(rules.PLACEHOLDERS), F.col("postcode")) == F.col("vpc"), "left").join(by_name, "key", "left").join(by_alias, F.col("key") == F.col("akey"), "left")
    kind = F.when(F.col("pc_id").isNotNull(), "postcode").when(F.col("n_id").isNotNull(), "exact").when(F.col("a_id").isNotNull(), "alias").otherwise("new")
    return joined.select(
        "venue_name", "postcode", F.coalesce("pc_id", "n_id", "a_id").alias("venue_id"),
        F.coalesce("pc_name", "n_name", "a_name", F.when(F.col("key") == "online", "Online").otherwise(F.col("venue_name"))).alias("matched_name"),
        F.when(F.col("pc_id").isNotNull(), 0.95).when(F.coalesce("n_id", "a_id").isNotNull(), 1.0).otherwise(0.0).alias("confidence"), kind.alias("match_type"),
    )


def new_venues(rows: DataFrame, venues: DataFrame) -> DataFrame:
    """One venue for each unknown name (whatever its case), numbered by first appearance after the largest id."""
    unknown = rows.join(venues.select(F.lower("name").alias("key")), F.lower("matched_name") == F.col("key"), "left_anti")
    first = unknown.groupBy(F.lower("matched_name").alias("key")).agg(F.min("batch_seq").alias("batch_seq"), F.min_by("matched_name", "batch_seq").alias("name"), F.min_by("postcode", "batch_seq").alias("postcode"))
    largest = venues.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return numbered(first, ["batch_seq"], largest).select(F.col("number").alias("id"), "name", "postcode", "batch_seq")


def named(rows: DataFrame) -> DataFrame:
    """Rows with canonical venue name and postcode, ambiguous names told apart, unlocatable rows gone."""
    rows = rows.where(locatable(F.col("venue_name"), F.col("venue_postcode"))).withColumn("postcode", text.normalise_postcode(F.col("venue_postcode")))
    return rows.withColumn("venue_name", text.disambiguate_venue(text.normalise_venue_name(F.coalesce("venue_name", F.lit(""))), F.col("postcode")))


def prepare(extracted: DataFrame) -> DataFrame:
    """Gated rows with canonical venue name and postcode, ambiguous names told apart, unlocatable rows gone."""
    return named(gate(extracted))


def places(gated: DataFrame) -> DataFrame:
    """The different places that gated rows name (column place: name and postcode as they stand), without unlocatable
    ones, with canonical venue name and postcode, and the first batch_seq of each."""
    first = gated.groupBy("venue_name", "venue_postcode").agg(F.min("batch_seq").alias("batch_seq"))
    return named(first.withColumn("place", F.struct("venue_name", "venue_postcode")))


def matched(rows: DataFrame, venues: DataFrame, aliases: DataFrame) -> DataFrame:
    """Prepared rows with venue_id (null: not known yet), matched_name and venue_match_type."""
    found = resolve_venues(rows, venues, aliases).select(F.col("venue_name").alias("v_name"), F.col("postcode").alias("v_code"), "venue_id", "matched_name", F.col("match_type").alias("venue_match_type"))
    return rows.join(found, (F.col("venue_name") == F.col("v_name")) & F.col("postcode").eqNullSafe(F.col("v_code")), "left").drop("v_name", "v_code")


def with_new_venues(rows: DataFrame, made: DataFrame) -> DataFrame:
    """Rows of matched() with the ids of the venues that were made for unknown names."""
    ids = made.select(F.lower("name").alias("m_key"), F.col("id").alias("m_id"))
    # rows of known venues have nothing to look up; in the join they would meet in the one task of null keys
    joined = rows.where("venue_id IS NULL").join(ids, F.lower("matched_name") == F.col("m_key"), "left")
    return rows.where("venue_id IS NOT NULL").unionByName(joined.withColumn("venue_id", F.col("m_id")).drop("m_key", "m_id"))


RAW = "struct<description:string,classes:array<string>,affiliation:string,venue_postcode:string>"


def raw_extract(description: Column, classes: Column, affiliation: Column, venue_postcode: Column) -> Column:
    """The parts of an extract that later runs make tags and venues of anew, as JSON."""
    return F.to_json(F.struct(description.alias("description"), classes.alias("classes"), affiliation.alias("affiliation"), venue_postcode.alias("venue_postcode")))


def listing(rows: DataFrame) -> Column:
    """All that a row is classified by, as a struct. Its venue's name counts only where the title may hold it, as the
    title's disciplines are read without it; lower case is sure to be the same everywhere for ASCII only."""
    plain = [F.replace(F.lower(c), F.lit("&"), F.lit(" and ")) for c in ("name", "venue_name")]
    odd = F.concat("name", "venue_name").rlike(r"[^\x00-\x7F]")
    own = F.col("affiliation") if "affiliation" in rows.columns else F.lit(None).cast("string")
    held = F.when(odd | F.contains(*plain), F.col("venue_name"))
    return F.struct("name", "description", "classes", "discipline", "event_type", own.alias("feed_affiliation"), held.alias("venue_name"))


def classified(listings: DataFrame) -> DataFrame:
    """Listings (the fields of listing() as columns) with canonical discipline, event type, spectator flag, whether they
    are bookings, tags (JSON), and class_list, their classes."""
    classes = tags.from_json_list(F.col("classes"))
    rows = listings.withColumns({"detail": tags.detail_text(F.col("description"), classes), "event_type": classify.event_type(F.col("name"), F.col("event_type")), "class_list": classes})
    rows = rows.withColumns({
        "discipline": classify.discipline_of(F.col("name"), F.col("discipline"), F.col("detail")), "spectator": classify.spectator(F.col("name"), F.col("event_type")),
        "booking": classify.is_booking_payment(F.col("name")),
    })
    every = tags.extract_tags(F.col("name"), F.col("detail"), F.col("discipline"), F.col("event_type"), F.col("feed_affiliation"), classes, F.col("venue_name"))
    return rows.withColumn("tags", F.to_json(every))


KEY = ["name", "date_start", "venue_id"]
REFRESHED = ["discipline", "event_type", "spectator", "hidden", "description", "classes", "tags", "raw_extract", "venue_match_type"]


def changes(table: DataFrame, batch: DataFrame, refreshed: list[str]) -> DataFrame:
    """What a batch does to a table of events, of which id, source_id and KEY are read: one row for each stored row that
    it hits (t_id) and for each new one (t_id is null), with first_source, first_seq, KEY, the refreshed columns of the
    last row, the first date_end and the last url that aren't null. Rows are in order of source_id, then batch_seq.

    The batch is aggregated by key and source before its first shuffle, so that a key of any size is one row per
    source by then. These rows meet the stored keys in one join by key; what follows is grouped by key too and needs
    no shuffle of its own. The columns that tell most come first, as the sorts compare them in this order.
    """
    keys = ["k_venue_id", "k_date_start", "k_name"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"k_name": F.coalesce("name", F.lit("\x00")), "k_date_start": F.col("date_start"), "k_venue_id": F.coalesce("venue_id", F.lit(-1))})

    def folded(df: DataFrame, by: list[str], by_order: str, kept: list) -> DataFrame:
        order = F.struct(by_order)
        ended, linked = F.when(F.col("date_end").isNotNull(), order), F.when(F.col("url").isNotNull(), order)
        return df.groupBy(*by).agg(*kept, F.max_by("last", order).alias("last"), F.min_by("date_end", ended).alias("date_end"), F.max_by("url", linked).alias("url"))

    rows = keyed(batch).withColumn("last", F.struct(*KEY, *refreshed))
    per_source = folded(rows, [*keys, "source_id"], "batch_seq", [F.min("batch_seq").alias("first_seq")])
    stored = keyed(table).select(*keys, F.col("id").alias("t_id"), F.col("source_id").alias("t_source"))
    met = per_source.withColumn("all", F.struct("first_seq", "last", "date_end", "url")).join(stored, keys, "left")
    choice = F.coalesce(F.min(F.when(F.col("t_source") == F.col("source_id"), F.col("t_id"))), F.min("t_id"))
    targets = met.groupBy(*keys, "source_id").agg(choice.alias("t_id"), F.first("all").alias("all")).select(*keys, "source_id", "t_id", "all.*")
    news = folded(targets, [*keys, "t_id"], "source_id", [F.min("source_id").alias("first_source"), F.min("first_seq").alias("first_seq")])
    return news.select("t_id", "first_source", "first_seq", "last.*", "date_end", "url")


#: The order in which new rows of changes() are numbered, and how many of them a task numbers.
NUMBERED = 200_000
ARRIVAL = ["first_source", "first_seq", "name", "date_start", "venue_id"]


def upsert(table: DataFrame, batch: DataFrame, seen_at: Column, largest: int | None = None, made: dict[str, Column] | None = None) -> DataFrame:
    """The event table after a batch (columns of the table, batch with source_id and batch_seq).

    A row's target is the stored row with its name, date and venue (null is a venue of its own), of the same source if
    there is one, else the one with the lowest id; rows without a target make one new row per key. Refreshed columns
    get the last row's values, date_end the first value that isn't null unless one is stored, url the last that isn't
    null; name, date, source and first_seen_at stay. largest: the largest id in use, if the table is only a part. made: values of
    further columns of new rows.

    The changes are found by changes(); only the ids of their new rows and their meeting with the table need shuffles
    of their own.
    """
    refreshed = [c for c in REFRESHED if c in table.columns]
    news = changes(table, batch, refreshed).checkpoint()
    kept = refreshed_rows(table, news, refreshed, seen_at, "left")
    if largest is None:
        largest = table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return kept.unionByName(new_rows(news, largest, seen_at, made or {}).select(*table.columns))


def refreshed_rows(table: DataFrame, news: DataFrame, refreshed: list[str], seen_at: Column, how: str) -> DataFrame:
    """Rows of the table with the values of those changes that hit them; how: left for all rows, inner for these."""
    changed = news.where("t_id IS NOT NULL").select(F.col("t_id").alias("id"), F.lit(True).alias("hit"), *[F.col(c).alias(f"new_{c}") for c in [*refreshed, "date_end", "url"]])
    values = {c: F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in refreshed}
    values |= {"date_end": F.coalesce("date_end", "new_date_end"), "url": F.coalesce("new_url", "url"), "last_seen_at": F.when(F.col("hit"), seen_at).otherwise(F.col("last_seen_at"))}
    return table.join(changed, "id", how).select(*[values.get(c, F.col(c)).alias(c) for c in table.columns])


def new_rows(news: DataFrame, largest: int, seen_at: Column, made: dict[str, Column]) -> DataFrame:
    """The changes that hit no stored row as new ones, numbered in order of arrival after the largest id."""
    fresh = numbered(news.where("t_id IS NULL"), ARRIVAL, largest, NUMBERED)
    return fresh.withColumns({"id": F.col("number"), "source_id": F.col("first_source"), "first_seen_at": seen_at, "last_seen_at": seen_at, **made})


EVENT_COLUMNS = ["id", "source_id", *KEY, "date_end", *REFRESHED, "url", "first_seen_at", "last_seen_at"]


def run_counters(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """source_id, competitions, others, exact, alias, postcode, new, inserted: a run's rows by type and by how their
    venue was found, and how many keys (name and date) the stored events don't have yet."""
    kind = F.coalesce("event_type", F.lit("competition"))
    by_match = [F.count_if(F.col("venue_match_type") == m).alias(m) for m in ("exact", "alias", "postcode", "new")]
    counted = rows.groupBy("source_id").agg(F.count_if(kind == "competition").alias("competitions"), F.count_if(kind != "competition").alias("others"), *by_match)
    unseen = rows.select("source_id", "name", "date_start").distinct().join(stored.select("name", "date_start").distinct(), ["name", "date_start"], "left_anti")
    inserted = unseen.groupBy("source_id").agg(F.count("*").alias("inserted"))
    return counted.join(inserted, "source_id", "left").withColumn("inserted", F.coalesce("inserted", F.lit(0)))


def resolve_coordinates(venues: DataFrame, parsed: DataFrame, postcodes: DataFrame) -> DataFrame:
    """venues with coordinates and postcode in order: own, the own postcode's, those that parsers gave (venue_id, lat,
    lng), the rows' postcode's (venue_id, row_postcode). Names with a bracketed outward code take only a postcode's;
    Online takes none; only coordinates in the box count; a row's postcode fills a missing one."""
    ok = geo.in_box(F.col("plat"), F.col("plng"))
    p = postcodes.select(text.normalise_postcode(F.col("postcode")).alias("pc"), F.col("latitude").alias("plat"), F.col("longitude").alias("plng")).where(ok).dropDuplicates(["pc"])
    own = p.select(F.col("pc").alias("pc1"), F.col("plat").alias("lat1"), F.col("plng").alias("lng1"))
    row = p.select(F.col("pc").alias("pc2"), F.col("plat").alias("lat2"), F.col("plng").alias("lng2"))
    given = parsed.withColumn("row_pc", text.normalise_postcode(F.col("row_postcode"))).groupBy("venue_id").agg(
        F.min_by("lat", F.when(geo.in_box(F.col("lat"), F.col("lng")), F.col("batch_seq"))).alias("glat"), F.min_by("lng", F.when(geo.in_box(F.col("lat"), F.col("lng")), F.col("batch_seq"))).alias("glng"),
        F.min_by("row_pc", F.when(F.col("row_pc").isNotNull(), F.col("batch_seq"))).alias("row_pc"),
    )
    j = venues.join(given, venues["id"] == given["venue_id"], "left").join(own, text.normalise_postcode(F.col("postcode")) == F.col("pc1"), "left").join(row, F.col("row_pc") == F.col("pc2"), "left")
    told = F.col("name").rlike(r"\([A-Z]{1,2}\d[A-Z\d]?\)$")

    def point(lat: str, lng: str, allowed: Column) -> Column:
        return F.when(F.col(lat).isNotNull() & allowed, F.struct(F.col(lat).alias("a"), F.col(lng).alias("o")))

    pair = F.coalesce(point("latitude", "longitude", ~told), point("lat1", "lng1", F.lit(True)), point("glat", "glng", ~told), point("lat2", "lng2", F.lit(True)))
    pair = F.when(F.col("name") != "Online", pair)
    return j.select("id", "name", F.coalesce("postcode", "row_pc").alias("postcode"), pair["a"].alias("latitude"), pair["o"].alias("longitude"))
