"""Aggregates, windows and consolidation jobs over event, venue and run-log tables (workload: audit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, rules, tags
from ..functions.text import area_letters, disambiguate_venue, normalise_discipline, normalise_venue_name
from .scans import filled, lagged
from .search import real_place

#: Fixed values of the alerts: share of the run before, length of a streak, runs looked back on.
DROP, STREAK, LOOK_BACK = 0.5, 3, 20


def venue_map(events: DataFrame, venues: DataFrame, today: Column, most: int = 600, around: tuple[float, float, float] | None = None) -> DataFrame:
    """venue_id, n, disciplines of the busiest venues by upcoming events that are no hire; placeholders left out.
    around: latitude, longitude and miles; of the busiest, those so near, with their distance."""
    v = venues.where(real_place(F.col("name")) & F.col("latitude").isNotNull()).select(F.col("id").alias("venue_id"), "latitude", "longitude")
    up = events.where((F.col("date_start") >= today) & (F.col("event_type") != "venue_hire") & ~F.col("hidden").eqNullSafe(True))
    counted = up.join(v, "venue_id").groupBy("venue_id", "latitude", "longitude").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("discipline")).alias("disciplines"))
    top = counted.orderBy(F.desc("n"), "venue_id").limit(most)
    if around is None:
        return top
    lat, lng, miles = around
    far = F.round(geo.haversine_miles(F.lit(lat), F.lit(lng), F.col("latitude"), F.col("longitude")), 1)
    return top.withColumn("distance", far).where(F.col("distance") <= miles)


def venue_search(events: DataFrame, venues: DataFrame, term: str, today: Column, most: int = 25) -> DataFrame:
    """Venues whose name has the term, or whose postcode starts with it, with upcoming events, busiest first. The
    signs % and _ are taken out; a term shorter than two characters finds nothing."""
    term = term.replace("%", "").replace("_", "").strip().lower()
    hit = (F.contains(F.lower("name"), F.lit(term)) | F.startswith(F.lower("postcode"), F.lit(term))) & F.lit(len(term) >= 2)
    up = events.where((F.col("date_start") >= today) & (F.col("event_type") != "venue_hire") & ~F.col("hidden").eqNullSafe(True))
    found = venues.where(F.coalesce(hit, F.lit(False)) & real_place(F.col("name")))
    return up.join(found.select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name")), "venue_id").groupBy("venue_id", "venue_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "venue_id").limit(most)


def hire_directory(events: DataFrame, venues: DataFrame, today: Column) -> DataFrame:
    """Venues with a curated hire link or upcoming hire events: count and largest event URL."""
    slots = events.where((F.col("event_type") == "venue_hire") & (F.col("date_start") >= today) & ~F.col("hidden").eqNullSafe(True)).groupBy("venue_id").agg(F.count("*").alias("n"), F.max("url").alias("slot_url"))
    j = venues.join(slots, venues["id"] == slots["venue_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.where(F.col("hire_url").isNotNull() | (F.col("n") > 0)).select("id", "name", "postcode", "hire_url", "n", "slot_url")


def one_per_postcode(hire: DataFrame) -> DataFrame:
    """One venue of each postcode (venues without one stand alone): a curated link first, then the lowest id."""
    key = F.coalesce(F.upper(F.replace("postcode", F.lit(" "), F.lit(""))), F.concat(F.lit("id:"), F.col("id").cast("string")))
    place = F.row_number().over(Window.partitionBy("__key").orderBy(F.col("hire_url").isNull(), "id"))
    return hire.withColumn("__key", key).withColumn("__place", place).where("__place = 1").drop("__key", "__place")


def source_totals(events: DataFrame, today: Column) -> DataFrame:
    up = F.col("date_start") >= today
    totals = events.groupBy("source_id").agg(
        F.count_if(up & (F.col("event_type") == "competition")).alias("competitions"), F.count_if(up & F.col("event_type").isin("training", "venue_hire")).alias("others"),
        F.count_if(up).alias("future"), F.count("*").alias("ever"),
    )
    return totals.withColumn("stale", (F.col("ever") > 0) & (F.col("future") == 0))


def dynamic_venues(venues: DataFrame, seeds: DataFrame, seed_aliases: DataFrame) -> DataFrame:
    """id, name, matched, word, n for each dynamic venue: whether a seed or a seed's alias has its name; for the others
    the first word, and how many of them share it (null if alone): candidates to be made one."""
    known = seeds.select(F.col("name").alias("known")).union(seed_aliases.select("alias")).distinct()
    dynamic = venues.where("source = 'dynamic'").select("id", "name").join(known, F.col("name") == F.col("known"), "left")
    dynamic = dynamic.select("id", "name", F.col("known").isNotNull().alias("matched"), F.when(F.col("known").isNull(), F.split_part(F.trim("name"), F.lit(" "), F.lit(1))).alias("word"))
    counts = dynamic.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    return dynamic.join(counts, "word", "left").select("id", "name", "matched", "word", "n")


def match_share(audited: DataFrame) -> DataFrame:
    """total, matched, unmatched, groups, share (percent, one decimal) of dynamic_venues()."""
    g = audited.groupBy("word", "n").agg(F.count("*").alias("rows"), F.count_if("matched").alias("matched"))
    total, matched = F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("matched"), F.lit(0))
    return g.agg(total.alias("total"), matched.alias("matched"), (total - matched).alias("unmatched"), F.count_if(F.col("n").isNotNull()).alias("groups"), F.coalesce(F.round(100.0 * matched / total, 1), F.lit(0.0)).alias("share"))


def collapse_days(rows: DataFrame, key: str, day: str, category: str) -> DataFrame:
    """One row per key: first day, last day (null for a single one), the categories in order."""
    g = rows.groupBy(key).agg(F.min(day).alias("date_start"), F.max(day).alias("last"), F.array_sort(F.collect_set(category)).alias("categories"))
    return g.select(key, "date_start", F.nullif("last", "date_start").alias("date_end"), "categories")


def run_drops(scans: DataFrame, share: float = DROP) -> DataFrame:
    """Completed runs that found less than a share of the completed run before of their source."""
    total = F.col("competitions_found_comp") + F.col("competitions_found_training")
    done = lagged(scans.where("status = 'completed'").select("id", "source_id", total.alias("found")), ["source_id"], ["id"], "found", "before")
    return done.where(F.col("found") < F.col("before") * share).select("id", "source_id", "found", "before")


def zero_streaks(scans: DataFrame, look_back: int = LOOK_BACK, alert: int = STREAK) -> DataFrame:
    """Of each source how many of its latest completed runs in a row found nothing, and whether that is an alert. Each
    task keeps the latest runs of a source before they meet, so that a source of any size is a few rows by then."""
    total = F.col("competitions_found_comp") + F.col("competitions_found_training")
    w = Window.partitionBy("source_id").orderBy(F.desc("id"))
    last = scans.where("status = 'completed'").withColumn("back", F.row_number().over(w)).where(F.col("back") <= look_back)
    filled = last.withColumn("some", F.sum((total > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.groupBy("source_id").agg(F.count_if(F.col("some") == 0).alias("streak")).withColumn("alert", F.col("streak") >= alert)


def fill_down(rows: DataFrame, partition: str, order: str, value: str) -> DataFrame:
    """The last value that isn't null so far: headings apply to the rows after them."""
    return filled(rows, [partition], [order], value)


def prefer(feeds: DataFrame, partition: str, rank: Column) -> DataFrame:
    """Rows of the preferred feed on each key, all of them; others only where it has none. The best rank of a key is
    aggregated before its shuffle and joined back, so that a key of any size can be split."""
    best = feeds.select(F.col(partition).alias("p_key"), rank.alias("p_rank")).groupBy("p_key").agg(F.min("p_rank").alias("p_best"))
    return feeds.join(best, F.col(partition).eqNullSafe(F.col("p_key")) & (rank == F.col("p_best"))).drop("p_key", "p_best")


def unique_postcodes(venues: DataFrame) -> DataFrame:
    """Postcodes of exactly one venue."""
    g = venues.where("postcode IS NOT NULL").groupBy("postcode").agg(F.count("*").alias("n"), F.min("id").alias("venue_id"))
    return g.where("n = 1").drop("n")


def canonical_names(venues: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, canonical: the normalised name, or that of the venue it is an alias of, told apart by postcode."""
    names = venues.select("id", "postcode", normalise_venue_name(F.col("name")).alias("c"))
    known = aliases.join(venues.select(F.col("id").alias("venue_id"), F.col("name").alias("target")), "venue_id").groupBy(F.lower("alias").alias("k")).agg(F.min("target").alias("target"))
    j = names.join(known, F.lower("c") == F.col("k"), "left")
    return j.select("id", disambiguate_venue(normalise_venue_name(F.coalesce("target", "c")), F.col("postcode")).alias("canonical"))


def merge_plan(venues: DataFrame, canonical: DataFrame) -> DataFrame:
    """id, keeper, name, postcode, latitude, longitude: of each canonical name the kept venue (name already right, then
    coordinates, then postcode, then lowest id) with the first postcode and coordinates that its group has, in that
    order. Groups are aggregated before their shuffle and joined back, so that a hot name can be split."""
    v = venues.join(canonical, "id")
    order = F.struct(F.col("name") != F.col("canonical"), F.col("latitude").isNull(), F.col("postcode").isNull(), F.col("id"))
    point = F.min_by(F.struct("latitude", "longitude"), F.when(F.col("latitude").isNotNull(), order))
    groups = v.groupBy(F.col("canonical").alias("name")).agg(F.min_by("id", order).alias("keeper"), F.min_by("postcode", F.when(F.col("postcode").isNotNull(), order)).alias("postcode"), point.alias("point"))
    joined = v.select("id", "canonical").join(groups, F.col("canonical") == F.col("name"))
    return joined.select("id", "keeper", "name", "postcode", F.col("point.latitude").alias("latitude"), F.col("point.longitude").alias("longitude"))


def renormalise(venues: DataFrame, aliases: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """One job over all venues: plan (what each venue becomes: MERGE, RENAME, FILL or KEEP; nothing is written, so this
    is the dry run), venues (the keepers with their names, postcodes and coordinates), aliases and events with the
    keepers' ids, dead aliases gone."""
    plan = merge_plan(venues, canonical_names(venues, aliases))
    old = venues.select("id", F.col("name").alias("old_name"), F.col("postcode").alias("old_code"), F.col("latitude").alias("old_lat"))
    action = F.when(F.col("id") != F.col("keeper"), "MERGE").when(F.col("old_name") != F.col("name"), "RENAME").when(~F.col("postcode").eqNullSafe(F.col("old_code")) | ~F.col("latitude").eqNullSafe(F.col("old_lat")), "FILL").otherwise("KEEP")
    told = plan.join(old, "id").withColumn("action", action)
    kept = plan.where("id = keeper").select("id", "name", "postcode", "latitude", "longitude")
    alive = remap(aliases, plan).join(kept.select(F.col("id").alias("venue_id")), "venue_id", "left_semi")
    return {"plan": told.select("id", "action", "old_name", "keeper", "name"), "venues": kept, "aliases": alive.select(*aliases.columns), "events": remap(events, plan)}


def remap(rows: DataFrame, plan: DataFrame, key: str = "venue_id") -> DataFrame:
    """Rows with venue ids replaced by those kept. Only ids that change are joined."""
    moved = plan.where("id <> keeper").select(F.col("id").alias(key), "keeper")
    return rows.join(moved, key, "left").withColumn(key, F.coalesce("keeper", key)).drop("keeper").select(*rows.columns)


#: Postcode areas outside the postcode table.
CROWN_AREAS = ["GY", "JE", "IM"]


def seed_issues(seeds: DataFrame, postcodes: DataFrame, miles: float = 20.0) -> DataFrame:
    """issue, name: bad postcode, out of bounds, postcode not known, far from its postcode, alias like its own name (if
    there is a column aliases), coordinates without postcode, and ambiguous names that no seed has."""
    ok = F.col("postcode").rlike(r"^[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}$")
    p = postcodes.groupBy("postcode").agg(F.min("latitude").alias("plat"), F.min("longitude").alias("plng"))
    far = geo.haversine_miles(F.col("latitude"), F.col("longitude"), F.col("plat"), F.col("plng")) > miles
    located = F.col("latitude").isNotNull()
    checked = located & ok & ~area_letters(F.col("postcode")).isin(CROWN_AREAS)
    s = seeds.join(p, "postcode", "left")
    own = F.array_contains("aliases", F.col("name")) if "aliases" in seeds.columns else F.lit(False)
    issues = F.array_compact(F.array(
        F.when(F.col("postcode").isNotNull() & ~ok, F.lit("format")), F.when(located & ~geo.in_box(F.col("latitude"), F.col("longitude"), geo.SEED_BOX), F.lit("bounds")),
        F.when(checked & F.col("plat").isNull(), F.lit("unknown postcode")), F.when(checked & far, F.lit("far")), F.when(own, F.lit("self alias")),
        F.when(located & F.col("postcode").isNull(), F.lit("no postcode")),
    ))
    names = seeds.sparkSession.createDataFrame([(x,) for x in rules.AMBIGUOUS], "name string")
    missing = names.join(seeds.select("name"), "name", "left_anti").select(F.lit("ambiguous missing").alias("issue"), "name")
    return s.select(F.explode(issues).alias("issue"), "name").union(missing)


def sync_actions(wanted: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, action: create, update (a column differs, nulls counted) or delete; rows in step give none."""
    a, b = wanted.select(F.col(key), F.struct(*columns).alias("w")), stored.select(F.col(key), F.struct(*columns).alias("s"))
    j = a.join(b, key, "full")
    action = F.when(F.col("s").isNull(), "create").when(F.col("w").isNull(), "delete").when(~F.col("w").eqNullSafe(F.col("s")), "update")
    return j.select(key, action.alias("action")).where("action IS NOT NULL")


def nearest_postcode(points: DataFrame, postcodes: DataFrame, steps_km: tuple[float, ...] = (2.0, 20.0)) -> DataFrame:
    """id, postcode, km of the nearest postcode within the first step, else within the next: an equi-join on cells of
    space as wide as the step asks for, anywhere on the globe; only points without a hit go on to the next."""
    left, out = points.where("latitude IS NOT NULL AND longitude IS NOT NULL").select("id", "latitude", "longitude"), None
    for km in steps_km:
        miles = km * 0.621371
        p = postcodes.select("postcode", F.col("latitude").alias("plat"), F.col("longitude").alias("plng"), geo.cell(F.col("latitude"), F.col("longitude"), miles).alias("cell"))
        around = left.withColumn("cell", F.explode(geo.cells_around(F.col("latitude"), F.col("longitude"), miles)))
        d = geo.haversine_miles(F.col("latitude"), F.col("longitude"), F.col("plat"), F.col("plng"))
        hit = around.join(p, "cell").withColumn("km", d / 0.621371).where(F.col("km") <= km)
        best = hit.groupBy("id").agg(F.min(F.struct("km", "postcode")).alias("b")).select("id", F.col("b.postcode").alias("postcode"), F.col("b.km").alias("km"))
        left = left.join(best, "id", "left_anti")
        out = best if out is None else out.union(best)
    return out


def discipline_audit(rows: DataFrame) -> DataFrame:
    """raw, n, canonical, outcome (kept, rewritten, unmapped) of each raw discipline. Values are normalised after they
    have been counted, once each."""
    g = rows.groupBy(F.col("discipline").alias("raw")).agg(F.count("*").alias("n")).withColumn("canonical", normalise_discipline(F.col("raw")))
    return g.withColumn("outcome", F.when(F.col("canonical").isNull(), "unmapped").when(F.col("canonical") == F.col("raw"), "kept").otherwise("rewritten"))


def canonical_disciplines(rows: DataFrame) -> DataFrame:
    """rows with each discipline that has a canonical form replaced by it: the rewrites of discipline_audit(). Values are
    normalised once each, and only those that change are joined."""
    known = discipline_audit(rows).where("outcome = 'rewritten'").select(F.col("raw").alias("__raw"), "canonical")
    told = rows.join(known, F.col("discipline") == F.col("__raw"), "left")
    return told.withColumn("discipline", F.coalesce("canonical", "discipline")).select(*rows.columns)


#: Upper bounds of the run-time buckets in seconds.
BUCKETS = (1, 5, 10, 30, 60, 120, 300, 600)


def run_time_buckets(scans: DataFrame) -> DataFrame:
    """source_id, le, n: how many runs of each source took so many seconds at most, for each bucket and +Inf (all runs);
    runs without a time count in none."""
    s = F.col("seconds").cast("double")
    counts = [F.struct(F.lit(float(b)).alias("le"), F.count_if(s <= b).alias("n")) for b in BUCKETS]
    every = F.struct(F.lit(float("inf")).alias("le"), F.count("seconds").alias("n"))
    return scans.groupBy("source_id").agg(F.array(*counts, every).alias("b")).select("source_id", F.explode("b").alias("b")).select("source_id", "b.*")


#: Size of the quantile sketches; their error of rank is below RANK_ERROR.
SKETCH_K, RANK_ERROR = 800, 0.005


def run_time_sketches(scans: DataFrame, period: str = "day") -> DataFrame:
    """source_id, the period, and a mergeable quantile sketch of the run times in it: what is kept of runs, so that times
    over any window of periods come from sketches, not from the runs. Runs without a time are left out."""
    return scans.where("seconds IS NOT NULL").groupBy("source_id", period).agg(F.kll_sketch_agg_double(F.col("seconds").cast("double"), F.lit(SKETCH_K)).alias("sketch"))


def run_time_quantile(sketches: DataFrame, share: float, by: list[str]) -> DataFrame:
    """by, runs, seconds: the run time that a share of the runs doesn't exceed, from merged sketches; its rank is right
    within RANK_ERROR, and exactly where a sketch has kept all (few runs)."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("s"))
    return merged.select(*by, F.kll_sketch_get_n_double("s").alias("runs"), F.kll_sketch_get_quantile_double("s", F.lit(share)).alias("seconds"))


def gauges(events: DataFrame, venues: DataFrame, sources: DataFrame, scans: DataFrame, today: Column) -> DataFrame:
    """gauge, label, value: run time per source (95 of 100), active competitions by discipline, venues by source and
    with coordinates, enabled sources."""

    def rows(df: DataFrame, gauge: str, label: Column, value: Column) -> DataFrame:
        return df.groupBy(label.cast("string").alias("label")).agg(value.cast("double").alias("value")).select(F.lit(gauge).alias("gauge"), "label", "value")

    active = events.where((F.col("event_type") == "competition") & (F.col("date_start") >= today))
    parts = [
        rows(active, "active by discipline", F.coalesce("discipline", F.lit("none")), F.count("*")), rows(venues, "venues by source", F.col("source"), F.count("*")),
        rows(venues, "venues located", F.lit("all"), F.count("latitude")), rows(sources, "sources enabled", F.lit("all"), F.count_if("enabled")),
    ]
    out = rows(scans, "scan p95", F.col("source_id"), F.percentile_approx("seconds", 0.95, 100_000))
    for p in parts:
        out = out.union(p)
    return out


RAW = "struct<description:string,classes:array<string>,affiliation:string,venue_postcode:string>"


def retag(events: DataFrame, feed_affiliation: bool = True) -> DataFrame:
    """events (with raw_extract, JSON) with description, classes and tags made anew from the stored extract, and which
    of the three changed. The extract's affiliation counts first unless feed_affiliation is off."""
    raw = F.from_json("raw_extract", RAW)
    empty = F.array().cast("array<string>")
    e = events.withColumns({"__raw": raw, "__old": tags.from_json_list(F.col("classes"))})
    classes = F.coalesce("__raw.classes", empty)
    own = F.col("__raw.affiliation") if feed_affiliation else F.lit(None).cast("string")
    detail = tags.detail_text(F.col("__raw.description"), classes)
    new = tags.extract_tags(F.col("name"), detail, F.col("discipline"), F.col("event_type"), own, classes, F.lit(None).cast("string"))
    e = e.withColumns({"__tags": new, "__before": tags.from_json_list(F.col("tags"))})
    return e.select(
        "id", F.col("__raw.description").alias("description"), classes.alias("classes"), F.col("__tags").alias("tags"),
        (F.coalesce("description", F.lit("")) != F.coalesce("__raw.description", F.lit(""))).alias("description_changed"), (F.col("__old") != classes).alias("classes_changed"), (F.col("__before") != F.col("__tags")).alias("tags_changed"),
    )
