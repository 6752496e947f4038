"""Jobs on the venue dimension: ids, coordinates, seeds, aliases, placeholders, directories (workload: audit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, rules, text
from ..functions.tags import from_json_list
from .ingest import RAW
from .scans import numbered

#: Names that stand for no place in the manifest of new venues, and for none in events to be resolved.
MANIFEST_SKIPS = ["online", "zoom", "teams", "microsoft teams", "google meet", "skype", "webinar", "virtual", "tbc", "tba", "tbd"]
UNRESOLVED = [*rules.PLACEHOLDERS, "none"]
DISAMBIGUATED = r"\([A-Z]{1,2}\d[A-Z\d]?\)$"


def backfill_ids(rows: DataFrame, venues: DataFrame) -> DataFrame:
    """rows (batch_seq, venue_name) with venue_id: that of the venue of this name, or a new one, by first appearance."""
    known = venues.select("name", "id")
    first = rows.join(known, rows["venue_name"] == known["name"], "left_anti").groupBy(F.col("venue_name").alias("name")).agg(F.min("batch_seq").alias("first_seq"))
    largest = venues.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    every = known.union(numbered(first, ["first_seq"], largest).select("name", F.col("number").alias("id")))
    return rows.join(every, rows["venue_name"] == every["name"]).select(*[rows[c] for c in rows.columns], F.col("id").alias("venue_id"))


def postcode_points(postcodes: DataFrame) -> DataFrame:
    """postcode, latitude, longitude: one point in the box for each postcode, that of least latitude, then longitude."""
    inside = postcodes.where(geo.in_box(F.col("latitude"), F.col("longitude")))
    return inside.groupBy(text.normalise_postcode(F.col("postcode")).alias("postcode")).agg(F.min(F.struct("latitude", "longitude")).alias("p")).select("postcode", "p.latitude", "p.longitude")


def with_points(rows: DataFrame, postcodes: DataFrame, code: str) -> DataFrame:
    """rows with latitude and longitude of their postcode; null where it is none or not known."""
    p = postcode_points(postcodes).withColumnRenamed("postcode", "p_code")
    return rows.join(p, text.normalise_postcode(F.col(code)) == F.col("p_code"), "left").drop("p_code")


def orphans(venues: DataFrame, events: DataFrame) -> DataFrame:
    """Venues without events."""
    return venues.join(events.where("venue_id IS NOT NULL").select(F.col("venue_id").alias("id")).distinct(), "id", "left_anti")


def dead_aliases(aliases: DataFrame, venues: DataFrame) -> DataFrame:
    """Aliases whose venue is gone."""
    return aliases.join(venues.select(F.col("id").alias("venue_id")), "venue_id", "left_anti")


def absent_seeds(seeds: DataFrame, venues: DataFrame) -> DataFrame:
    """Seeds that no venue has the name of."""
    return seeds.join(venues.select("name"), "name", "left_anti")


def unseeded(venues: DataFrame, seeds: DataFrame, seed_aliases: DataFrame) -> DataFrame:
    """Dynamic venues that neither a seed nor a seed's alias has the name of."""
    return venues.where("source = 'dynamic'").join(seeds.select("name").union(seed_aliases.select("alias")).distinct(), "name", "left_anti")


def merge_seeds(venues: DataFrame, seeds: DataFrame) -> DataFrame:
    """name, postcode, latitude, longitude, hire_url, source: venues that miss are inserted; of others only what is
    null is filled (coordinates as a pair); both are stamped as seeded."""
    s = seeds.select("name", F.col("postcode").alias("s_code"), F.col("latitude").alias("s_lat"), F.col("longitude").alias("s_lng"), F.col("hire_url").alias("s_hire"), F.lit("seed").alias("s_source"))
    j = venues.join(s, "name", "full")
    own = F.col("latitude").isNotNull()
    return j.select(
        "name", F.coalesce("postcode", "s_code").alias("postcode"), F.when(own, F.col("latitude")).otherwise(F.col("s_lat")).alias("latitude"), F.when(own, F.col("longitude")).otherwise(F.col("s_lng")).alias("longitude"),
        F.coalesce("hire_url", "s_hire").alias("hire_url"), F.coalesce("s_source", "source").alias("source"),
    )


def merge_aliases(aliases: DataFrame, seeds: DataFrame) -> DataFrame:
    """alias, venue_id, origin: seeds (alias, venue_id) replace where an alias points and are stamped; others stay."""
    s = seeds.select("alias", F.col("venue_id").alias("s_id"))
    return aliases.join(s, "alias", "full").select("alias", F.coalesce("s_id", "venue_id").alias("venue_id"), F.when(F.col("s_id").isNotNull(), "seed").otherwise(F.col("origin")).alias("origin"))


def enrich(stubs: DataFrame, details: DataFrame) -> DataFrame:
    """Stubs with description and end date of the detail pages (url, description, date_end) of their URL; the least
    values of a URL that has several; without a page the name stands for the description."""
    d = details.where("url IS NOT NULL").groupBy("url").agg(F.min("description").alias("d_text"), F.min("date_end").alias("d_end"))
    j = stubs.join(d, "url", "left")
    return j.select(*[c for c in stubs.columns if c not in ("description", "date_end")], F.coalesce("d_text", "name").alias("description"), F.col("d_end").alias("date_end"))


def share_point(rows: DataFrame) -> DataFrame:
    """Rows with the first coordinates (by batch_seq) that any row of their venue name has."""
    known = rows.where("latitude IS NOT NULL AND venue_name <> ''").groupBy("venue_name").agg(F.min_by(F.struct("latitude", "longitude"), "batch_seq").alias("p"))
    return rows.drop("latitude", "longitude").join(known, "venue_name", "left").select("*", "p.latitude", "p.longitude").drop("p")


def latest_runs(scans: DataFrame) -> DataFrame:
    """source_id, last_id, last_good, status: each source's last run, last completed run, and how the last one went."""
    return scans.groupBy("source_id").agg(F.max("id").alias("last_id"), F.max(F.when(F.col("status") == "completed", F.col("id"))).alias("last_good"), F.max_by("status", "id").alias("status"))


def longest_names(venues: DataFrame) -> DataFrame:
    """postcode, canonical: of the venues at a postcode the longest name, then the lowest id."""
    return venues.where("postcode IS NOT NULL").groupBy("postcode").agg(F.max_by("name", F.struct(F.length("name"), -F.col("id"))).alias("canonical"))


def consolidate(seeds: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds that stay, alias rows) after the seeds of one postcode have become one: the longest name (then the lowest
    id) keeps its aliases and takes the other names as new ones; the others go, with their aliases."""
    keepers = longest_names(seeds).withColumnRenamed("postcode", "k_code")
    joined = seeds.join(keepers, F.col("postcode") == F.col("k_code"), "left").withColumn("keeper", F.coalesce("canonical", "name"))
    kept = joined.where("keeper = name").select(*seeds.columns)
    lost = joined.where("keeper <> name").select(F.col("name").alias("alias"), F.col("keeper").alias("name"))
    own = aliases.select("alias", "name").join(kept.select("name"), "name", "left_semi").select("alias", "name")
    return kept, own.union(lost).distinct()


def shared_postcodes(venues: DataFrame) -> DataFrame:
    """id, name, postcode, n of venues that share their postcode with others."""
    n = venues.where("postcode IS NOT NULL").groupBy(F.col("postcode").alias("n_code")).agg(F.count("*").alias("n")).where("n > 1")
    return venues.join(n, F.col("postcode") == F.col("n_code")).select("id", "name", "postcode", "n")


def reset_disambiguated(venues: DataFrame, seeds: DataFrame) -> DataFrame:
    """Venues whose name ends in an outward code in brackets lose their coordinates, to be found anew, and take the
    postcode of the seed of their name."""
    s = seeds.where("postcode IS NOT NULL").groupBy("name").agg(F.min("postcode").alias("s_code"))
    told = F.col("name").rlike(DISAMBIGUATED)
    j = venues.join(s, "name", "left")
    new = {"postcode": F.when(told, F.coalesce("s_code", "postcode")).otherwise(F.col("postcode")), **{c: F.when(~told, F.col(c)) for c in ("latitude", "longitude")}}
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in venues.columns])


def resolve_placeholders(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Events with venue_id moved from placeholders to the only real venue at a postcode: the placeholder's own, else
    that of the event's stored extract."""
    nowhere = F.lower(F.trim("name")).isin(UNRESOLVED)
    real = venues.where(~nowhere & F.col("postcode").isNotNull()).groupBy(F.upper(F.trim("postcode")).alias("r_code")).agg(F.count("*").alias("n"), F.min("id").alias("r_id")).where("n = 1").drop("n")
    held = venues.where(nowhere).select(F.col("id").alias("h_id"), F.upper(F.trim("postcode")).alias("h_code"))
    first = held.join(real, F.col("h_code") == F.col("r_code"), "left").select("h_id", F.col("r_id").alias("first_id"))
    code = text.normalise_postcode(F.from_json("raw_extract", RAW)["venue_postcode"])
    j = events.join(first, F.col("venue_id") == F.col("h_id"), "left").withColumn("e_code", F.when(F.col("h_id").isNotNull() & F.col("first_id").isNull(), code))
    j = j.join(real, F.col("e_code") == F.col("r_code"), "left")
    return j.select(*[F.coalesce("first_id", "r_id", "venue_id").alias(c) if c == "venue_id" else F.col(c) for c in events.columns])


def emptied_placeholders(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Placeholder venues that no event has any more: these can go."""
    return orphans(venues.where(F.lower(F.trim("name")).isin(UNRESOLVED)), events)


def rename_values(events: DataFrame, column: str, old: str, new: str, namespace: str) -> DataFrame:
    """Events with a value renamed in its column and in their tags (JSON text or list)."""
    listed = F.col("tags") if events.schema["tags"].dataType.typeName() == "array" else from_json_list(F.col("tags"))
    a, b = (f"{namespace}:{v.replace('_', '-')}" for v in (old, new))
    renamed = F.transform(listed, lambda x: F.when(x == a, b).otherwise(x))
    return events.withColumns({column: F.when(F.col(column) == old, new).otherwise(F.col(column)), "tags": renamed})


def type_of_legacy(is_competition: Column, discipline: Column) -> Column:
    """The event type of rows from before there was one: by the flag, and by disciplines that were none."""
    return F.when(F.coalesce(is_competition, F.lit(True)), "competition").when(discipline == "Venue Hire", "venue_hire").otherwise("training")


def last_and_first(rows: DataFrame, keys: list[str], order: str, first: list[str], last: list[str]) -> DataFrame:
    """One row per key: the first and last values, by order, that aren't null."""
    present = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    return rows.groupBy(*keys).agg(F.min(order).alias(order), *[F.min_by(c, present(c)).alias(c) for c in first], *[F.max_by(c, present(c)).alias(c) for c in last])


def facets(events: DataFrame, venues: DataFrame, today: Column) -> DataFrame:
    """facet, value: disciplines, affiliations and venues of upcoming events, each once."""
    up = events.where(F.col("date_start") >= today)
    tags = F.filter(from_json_list(F.col("tags")), lambda x: F.startswith(x, F.lit("affiliation:")))
    own = F.filter(F.array(F.struct(F.lit("discipline").alias("facet"), F.col("discipline").alias("value"))), lambda x: x["value"].isNotNull())
    named = F.transform(tags, lambda x: F.struct(F.lit("affiliation").alias("facet"), x.alias("value")))
    both = up.select(F.explode(F.concat(own, named)).alias("f")).select("f.*").distinct()
    at = venues.join(up.select(F.col("venue_id").alias("id")).distinct(), "id", "left_semi").select(F.lit("venue").alias("facet"), F.col("name").alias("value")).distinct()
    return both.union(at)


def feed_validity(events: DataFrame, today: Column) -> DataFrame:
    """source_id, valid_to (the last day that any event of the source reaches), stale."""
    return events.groupBy("source_id").agg(F.max(F.coalesce("date_end", "date_start")).alias("valid_to")).withColumn("stale", F.col("valid_to") < today)


def venue_health(venues: DataFrame, events: DataFrame, reviews: DataFrame) -> DataFrame:
    """total, located, share (percent, one decimal), missing (a postcode but no coordinates), placeholders, orphans and
    pending reviews, in one row."""
    used = events.where("venue_id IS NOT NULL").select(F.col("venue_id").alias("id")).distinct().withColumn("used", F.lit(1))
    one = venues.join(used, "id", "left").agg(
        F.count("*").alias("total"), F.count("latitude").alias("located"), F.round(100.0 * F.count("latitude") / F.count("*"), 1).alias("share"), F.count_if(F.col("postcode").isNotNull() & F.col("latitude").isNull()).alias("missing"),
        F.count_if(F.lower("name").isin(rules.HEALTH_PLACEHOLDERS)).alias("placeholders"), F.count_if(F.col("used").isNull()).alias("orphans"),
    )
    return one.join(reviews.agg(F.count_if(F.col("status") == "pending").alias("pending")), F.lit(True))


def placeholder_counts(venues: DataFrame, events: DataFrame) -> DataFrame:
    """id, name, n: events of each placeholder venue."""
    n = events.groupBy("venue_id").agg(F.count("*").alias("n"))
    held = venues.where(F.lower("name").isin(rules.HEALTH_PLACEHOLDERS)).select("id", "name")
    return held.join(n, F.col("id") == F.col("venue_id"), "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"))


def new_venue_manifest(events: DataFrame, seeds: DataFrame, today: Column, most: int | None = 100) -> DataFrame:
    """Venues with upcoming events (venue_name, name, url, postcode, latitude, longitude, in order of id) that no seed
    has the name of, whatever its case: name, n, urls (of the first three events), names (of the first two), the last
    postcode and coordinates; only those with a postcode, coordinates or URL; the most by count. None: all of them.

    Counts and last values are aggregated, the first events cut off by rank before anything is collected."""
    up = events.where((F.col("date_start") >= today) & F.col("venue_name").isNotNull() & (F.col("venue_name") != "") & ~F.lower("venue_name").isin(MANIFEST_SKIPS))
    up = up.join(seeds.select(F.lower("name").alias("s_key")).distinct(), F.lower("venue_name") == F.col("s_key"), "left_anti")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    totals = up.groupBy("venue_name").agg(F.count("*").alias("n"), *[latest(c) for c in ("postcode", "latitude", "longitude")])
    place = F.row_number().over(Window.partitionBy("venue_name").orderBy("id"))
    first = up.select("venue_name", "id", "name", "url").withColumn("place", place).where("place <= 3")
    listed = lambda c, n: F.transform(F.array_sort(F.collect_list(F.when((F.col("place") <= n) & F.col(c).isNotNull(), F.struct("place", c)))), lambda x: x[c])
    samples = first.groupBy("venue_name").agg(listed("url", 3).alias("urls"), listed("name", 2).alias("names"))
    found = totals.join(samples, "venue_name").where("postcode IS NOT NULL OR latitude IS NOT NULL OR size(urls) > 0").withColumnRenamed("venue_name", "name")
    return found if most is None else found.orderBy(F.desc("n"), "name").limit(most)


def venue_page(events: DataFrame, venues: DataFrame, today: Column, most: int = 5) -> DataFrame:
    """venue_id, n, links for each venue: its upcoming events, and those of venues with one to `most` in date order.
    Venues are counted first, and only events that are shown are collected."""
    up = events.where((F.col("date_start") >= today) & F.col("venue_id").isNotNull()).select("venue_id", "date_start", "id")
    n = up.groupBy("venue_id").agg(F.count("*").alias("n"))
    few = up.join(n.where(F.col("n") <= most).select("venue_id"), "venue_id", "left_semi").groupBy("venue_id").agg(F.sort_array(F.collect_list(F.struct("date_start", "id"))).alias("e"))
    every = venues.select(F.col("id").alias("venue_id")).join(n, "venue_id", "left").join(few, "venue_id", "left")
    return every.select("venue_id", F.coalesce("n", F.lit(0)).alias("n"), F.transform("e", lambda x: x["id"]).alias("links"))


def venue_names(venues: DataFrame, aliases: DataFrame, events: DataFrame, sources: DataFrame) -> DataFrame:
    """venue_id, kind, name: the aliases of each venue, and the sources of each dynamic venue's events, each once."""
    alias = aliases.join(venues.select(F.col("id").alias("venue_id")), "venue_id", "left_semi").select("venue_id", F.lit("alias").alias("kind"), F.col("alias").alias("name"))
    dynamic = venues.where("source = 'dynamic'").select(F.col("id").alias("venue_id"))
    pairs = events.select("venue_id", "source_id").distinct().join(dynamic, "venue_id", "left_semi")
    return alias.union(pairs.join(sources.select(F.col("id").alias("source_id"), "name"), "source_id").select("venue_id", F.lit("source"), "name")).distinct()
