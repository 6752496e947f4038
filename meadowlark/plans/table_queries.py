"""Queries over whole tables: joins (J), aggregates (A), windows (W), write-path jobs (M), feeds (S) and streams (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, geo, text
from ..functions.tags import from_json_list
from ..operators import audit as A
from ..operators import ingest as I
from ..operators import search as S
from ..operators import venues as V
from ..sources import feeds, markup, sinks
from ..streaming.alerts import ALERTS
from .demo import TODAY
from .registry import query
from .scalar_queries import DISC_MAP, DISC_SQL, TYPE, ruled, title
from .search_queries import CLASSES, JOINED, TAGS, T, miles

C = F.col
ROWS = "SELECT id, name, postcode FROM venue"


@query("J1_event_venue", f"SELECT id, venue_id, venue_name, postcode FROM ({JOINED})")
def _(t):
    return S.with_venue(t.event, t.venue).select("id", "venue_id", "venue_name", "postcode")


#: Names and postcodes as the resolver gets them.
PAIRS = "SELECT DISTINCT CASE batch_seq % 5 WHEN 0 THEN 'TBC' WHEN 1 THEN 'zoom' ELSE coalesce(venue_name, '') END AS venue_name, CASE WHEN batch_seq % 3 = 0 THEN venue_postcode END AS postcode FROM extracted"
RESOLVED = f"""pairs AS ({PAIRS}), k AS (SELECT *, CASE WHEN lower(trim(venue_name)) IN ('zoom', 'teams', 'microsoft teams', 'google meet', 'skype', 'webinar') THEN 'online' ELSE lower(trim(venue_name)) END AS key FROM pairs),
uniq AS (SELECT postcode AS vpc, min(id) AS pc_id, min(name) AS pc_name FROM venue WHERE postcode IS NOT NULL GROUP BY postcode HAVING count(*) = 1),
byname AS (SELECT lower(name) AS nkey, min(id) AS n_id, arg_min(name, id) AS n_name FROM venue GROUP BY 1), byalias AS (SELECT lower(alias) AS akey, min(v.id) AS a_id, arg_min(v.name, v.id) AS a_name FROM alias JOIN venue v ON v.id = venue_id GROUP BY 1),
r AS (SELECT venue_name, postcode, coalesce(pc_id, n_id, a_id) AS venue_id, coalesce(pc_name, n_name, a_name, CASE WHEN key = 'online' THEN 'Online' ELSE venue_name END) AS matched_name,
 CASE WHEN pc_id IS NOT NULL THEN 0.95 WHEN coalesce(n_id, a_id) IS NOT NULL THEN 1.0 ELSE 0.0 END AS confidence, CASE WHEN pc_id IS NOT NULL THEN 'postcode' WHEN n_id IS NOT NULL THEN 'exact' WHEN a_id IS NOT NULL THEN 'alias' ELSE 'new' END AS match_type
 FROM k LEFT JOIN uniq ON vpc = CASE WHEN key IN ('tbc', 'tba', 'tbd', 'various', 'unknown') THEN postcode END LEFT JOIN byname ON nkey = key LEFT JOIN byalias ON akey = key)"""


def pairs(t):
    k = C("batch_seq") % 5
    return t.extracted.select("batch_seq", F.when(k == 0, "TBC").when(k == 1, "zoom").otherwise(F.coalesce("venue_name", F.lit(""))).alias("venue_name"), F.when(C("batch_seq") % 3 == 0, C("venue_postcode")).alias("postcode"))


@query("J2_venue_resolution", f"WITH {RESOLVED} SELECT * FROM r")
def _(t):
    return I.resolve_venues(pairs(t), t.venue, t.alias)


@query(
    "J3_new_venues",
    "WITH n AS (SELECT lower(venue_name) AS key, min(batch_seq) AS batch_seq, arg_min(venue_name, batch_seq) AS name FROM extracted WHERE venue_name <> '' AND lower(venue_name) NOT IN (SELECT lower(name) FROM venue) GROUP BY 1) SELECT (SELECT max(id) FROM venue) + row_number() OVER (ORDER BY batch_seq) AS id, name, batch_seq FROM n",
)
def _(t):
    rows = t.extracted.where("venue_name <> ''").select("batch_seq", C("venue_name").alias("matched_name"), C("venue_postcode").alias("postcode"))
    return I.new_venues(rows, t.venue).select("id", "name", "batch_seq")


@query("J4_backfill_venue_ids", "WITH n AS (SELECT venue_name AS name, min(batch_seq) AS b FROM extracted WHERE venue_name <> '' AND venue_name NOT IN (SELECT name FROM venue) GROUP BY 1), x AS (SELECT name, (SELECT max(id) FROM venue) + row_number() OVER (ORDER BY b) AS id FROM n UNION ALL SELECT name, id FROM venue) SELECT batch_seq, x.id AS venue_id FROM extracted JOIN x ON x.name = venue_name")
def _(t):
    return V.backfill_ids(t.extracted.where("venue_name <> ''").select("batch_seq", "venue_name"), t.venue).select("batch_seq", "venue_id")


UK = "latitude BETWEEN 49 AND 61 AND longitude BETWEEN -11 AND 2"


@query("J5_postcode_coordinates", f"SELECT batch_seq, p.latitude, p.longitude FROM extracted LEFT JOIN (SELECT * FROM postcode WHERE {UK}) p ON p.postcode = venue_postcode")
def _(t):
    return V.with_points(t.extracted.select("batch_seq", "venue_postcode"), t.postcode, "venue_postcode").select("batch_seq", "latitude", "longitude")


KM = f"{miles('r.latitude', 'r.longitude', 'p.latitude', 'p.longitude')} / 0.621371"


@query("J6_nearest_postcode", f"WITH d AS (SELECT r.id, p.postcode, {KM} AS km FROM rider r JOIN postcode p ON {KM} <= 20) SELECT id, arg_min(postcode, {{'a': km, 'b': postcode}}) AS postcode, round(min(km), 6) AS km FROM d GROUP BY id")
def _(t):
    return A.nearest_postcode(t.rider, t.postcode).select("id", "postcode", F.round("km", 6).alias("km"))


M = miles("r.latitude", "r.longitude", "v.latitude", "v.longitude")


@query("J7_radius_join", f"SELECT r.id, v.id AS place_id, round({M}, 6) AS distance FROM rider r JOIN venue v ON {M} <= 25")
def _(t):
    return S.near_each(t.rider, t.venue, 25.0).select("id", "place_id", F.round("distance", 6).alias("distance"))


def parsed(t):
    given = C("batch_seq") % 8 == 0
    return t.extracted.select((C("batch_seq") % 100 + 1).alias("venue_id"), "batch_seq", F.when(given, F.lit(52.5)).alias("lat"), F.when(given, F.lit(-2.5)).alias("lng"), C("venue_postcode").alias("row_postcode"))


@query(
    "J8_venue_coordinates",
    f"""WITH p AS (SELECT postcode, latitude AS la, longitude AS lo FROM postcode WHERE {UK}),
    g AS (SELECT batch_seq % 100 + 1 AS vid, bool_or(batch_seq % 8 = 0) AS given, arg_min(venue_postcode, batch_seq) FILTER (WHERE venue_postcode <> 'nowhere') AS rp FROM extracted GROUP BY 1)
    SELECT v.id, v.name, coalesce(v.postcode, rp) AS postcode, CASE WHEN name = 'Online' THEN NULL ELSE coalesce(latitude, a.la, CASE WHEN given THEN 52.5 END, b.la) END AS latitude,
      CASE WHEN name = 'Online' THEN NULL ELSE coalesce(longitude, a.lo, CASE WHEN given THEN -2.5 END, b.lo) END AS longitude
    FROM venue v LEFT JOIN g ON vid = v.id LEFT JOIN p a ON a.postcode = v.postcode LEFT JOIN p b ON b.postcode = rp""",
)
def _(t):
    return I.resolve_coordinates(t.venue, parsed(t), t.postcode)


@query("J9_semi_join", f"SELECT id, name FROM venue WHERE id IN (SELECT venue_id FROM event WHERE date_start >= {T})")
def _(t):
    return t.venue.join(t.event.where(C("date_start") >= t.today()).select(C("venue_id").alias("id")), "id", "left_semi").select("id", "name")


@query(
    "J10_anti_joins",
    """SELECT 'orphan' AS kind, CAST(id AS VARCHAR) AS what FROM venue WHERE id NOT IN (SELECT venue_id FROM event WHERE venue_id IS NOT NULL) UNION ALL SELECT 'dead alias', alias FROM alias WHERE venue_id NOT IN (SELECT id FROM venue)
    UNION ALL SELECT 'absent seed', 'Seeded ' || name FROM venue WHERE id % 10 = 0 UNION ALL SELECT 'unseeded', name FROM venue WHERE source = 'dynamic' AND id % 4 <> 0""",
)
def _(t):
    known = t.alias.where("origin = 'seed'").select("alias")
    parts = ((V.orphans(t.venue, t.event), "orphan", "id"), (V.dead_aliases(t.alias, t.venue), "dead alias", "alias"), (V.absent_seeds(seeds(t), t.venue), "absent seed", "name"), (V.unseeded(t.venue, seeds(t), known), "unseeded", "name"))
    a, b, c, d = (df.select(F.lit(kind).alias("kind"), C(column).cast("string").alias("what")) for df, kind, column in parts)
    return a.union(b).union(c).union(d)


SEED = "SELECT name, 'SD' || CAST(id AS VARCHAR) AS pc, CASE WHEN id % 8 = 0 THEN NULL ELSE 51.0 END AS la, -1.0 AS lo, 'https://h/' || id AS hire FROM venue WHERE id % 4 = 0 UNION ALL SELECT 'Seeded ' || name, 'SN1 1AA', 50.0, -2.0, NULL FROM venue WHERE id % 10 = 0"


def seeds(t):
    old = t.venue.where("id % 4 = 0").select("name", F.concat(F.lit("SD"), C("id").cast("string")).alias("postcode"), F.when(C("id") % 8 != 0, 51.0).alias("latitude"), F.lit(-1.0).alias("longitude"), F.concat(F.lit("https://h/"), C("id").cast("string")).alias("hire_url"))
    return old.union(t.venue.where("id % 10 = 0").select(F.concat(F.lit("Seeded "), C("name")), F.lit("SN1 1AA"), F.lit(50.0), F.lit(-2.0), F.lit(None).cast("string")))


@query("J11_seed_merge", f"WITH s AS ({SEED}) SELECT coalesce(v.name, s.name) AS name, coalesce(postcode, pc) AS postcode, coalesce(latitude, la) AS latitude, CASE WHEN latitude IS NULL THEN lo ELSE longitude END AS longitude, coalesce(hire_url, hire) AS hire_url, CASE WHEN s.name IS NULL THEN source ELSE 'seed' END AS source FROM venue v FULL JOIN s ON s.name = v.name")
def _(t):
    return V.merge_seeds(t.venue, seeds(t))


@query("J12_alias_merge", "WITH s AS (SELECT alias, venue_id + 1 AS nid FROM alias WHERE venue_id % 2 = 0 UNION ALL SELECT name || ' Alt', id FROM venue WHERE id % 6 = 0) SELECT coalesce(a.alias, s.alias) AS alias, coalesce(nid, venue_id) AS venue_id, CASE WHEN nid IS NOT NULL THEN 'seed' ELSE origin END AS origin FROM alias a FULL JOIN s ON s.alias = a.alias")
def _(t):
    new = t.alias.where("venue_id % 2 = 0").select("alias", (C("venue_id") + 1).alias("venue_id")).union(t.venue.where("id % 6 = 0").select(F.concat("name", F.lit(" Alt")), "id"))
    return V.merge_aliases(t.alias, new)


@query("J13_enrich_stubs", "SELECT e.batch_seq, coalesce(d.description, e.name) AS description, d.date_end FROM extracted e LEFT JOIN (SELECT url, min(description) AS description, min(date_end) AS date_end FROM event WHERE url IS NOT NULL GROUP BY url) d ON d.url = e.url")
def _(t):
    return V.enrich(t.extracted.select("batch_seq", "name", "url"), t.event).select("batch_seq", "description", "date_end")


@query("J14_shared_coordinates", "WITH c AS (SELECT venue_name, min(batch_seq) AS b FROM extracted WHERE batch_seq % 7 = 0 AND venue_name <> '' GROUP BY 1) SELECT e.batch_seq, 50 + CAST(b % 100 AS DOUBLE) * 0.125 AS latitude, CASE WHEN b IS NOT NULL THEN CAST(-1.5 AS DOUBLE) END AS longitude FROM extracted e LEFT JOIN c ON c.venue_name = e.venue_name")
def _(t):
    some = C("batch_seq") % 7 == 0
    e = t.extracted.select("batch_seq", "venue_name", F.when(some, 50 + (C("batch_seq") % 100).cast("double") * 0.125).alias("latitude"), F.when(some, F.lit(-1.5)).alias("longitude"))
    return V.share_point(e).select("batch_seq", "latitude", "longitude")


@query("J15_latest_runs", "SELECT source_id, max(id) AS last_id, max(CASE WHEN status = 'completed' THEN id END) AS last_good, arg_max(status, id) AS status FROM scan GROUP BY source_id")
def _(t):
    return V.latest_runs(t.scan)


@query("J16_sync_actions", "SELECT id, CASE WHEN id % 10 = 0 THEN 'delete' WHEN id % 10 = 1 THEN 'create' ELSE 'update' END AS action FROM event WHERE id % 10 IN (0, 1) OR id % 10 = 2 AND date_end IS NOT NULL")
def _(t):
    stored = t.event.where("id % 10 <> 1").select("id", "name", F.when(C("id") % 10 == 2, None).otherwise(C("date_end")).alias("date_end"))
    return A.sync_actions(t.event.where("id % 10 <> 0"), stored, "id", ["name", "date_end"])


UP = f"date_start >= {T} AND event_type <> 'venue_hire' AND NOT coalesce(hidden, false)"
REAL = "lower(trim(name)) NOT IN ('tbc', 'tba', 'tbd', 'various', 'unknown', 'online')"


MAP = f"SELECT venue_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT discipline) FILTER (WHERE discipline IS NOT NULL)), ';') AS disciplines, latitude, longitude FROM event JOIN (SELECT id AS vid, latitude, longitude FROM venue WHERE {REAL} AND latitude IS NOT NULL) ON vid = venue_id WHERE {UP} GROUP BY venue_id, latitude, longitude ORDER BY n DESC, venue_id LIMIT 600"


@query("A1_venue_map", f"WITH m AS ({MAP}) SELECT 'all' AS asked, venue_id, n, disciplines FROM m UNION ALL SELECT 'near', venue_id, n, disciplines FROM m WHERE round({miles('52.0', '-1.5', 'latitude', 'longitude')}, 1) <= 100")
def _(t):
    def shown(asked, df):
        return df.select(F.lit(asked).alias("asked"), "venue_id", "n", F.nullif(F.array_join("disciplines", ";"), F.lit("")).alias("disciplines"))

    return shown("all", A.venue_map(t.event, t.venue, t.today())).union(shown("near", A.venue_map(t.event, t.venue, t.today(), around=(52.0, -1.5, 100.0))))


@query("A2_venue_search", f"SELECT v.id AS venue_id, v.name AS venue_name, count(*) AS n FROM event e JOIN venue v ON v.id = e.venue_id WHERE {UP.replace('date_start', 'e.date_start')} AND (contains(lower(v.name), 'farm') OR starts_with(lower(v.postcode), 'farm')) GROUP BY 1, 2 ORDER BY n DESC, venue_id LIMIT 25")
def _(t):
    return A.venue_search(t.event, t.venue, "%Farm_", t.today())


HIRE = f"SELECT v.id, v.name, postcode, hire_url, count(e.id) AS n, max(e.url) AS slot_url FROM venue v LEFT JOIN event e ON e.venue_id = v.id AND event_type = 'venue_hire' AND date_start >= {T} AND NOT coalesce(hidden, false) GROUP BY 1, 2, 3, 4 HAVING hire_url IS NOT NULL OR count(e.id) > 0"


@query("A3_hire_directory", HIRE)
def _(t):
    return A.hire_directory(t.event, t.venue, t.today())


@query("A4_hire_per_postcode", f"SELECT id, name FROM ({HIRE}) h QUALIFY row_number() OVER (PARTITION BY coalesce(replace(postcode, ' ', ''), 'id:' || id) ORDER BY hire_url IS NULL, id) = 1")
def _(t):
    return A.one_per_postcode(A.hire_directory(t.event, t.venue, t.today())).select("id", "name")


@query("A5_facets", f"WITH u AS (SELECT * FROM event WHERE date_start >= {T}) SELECT DISTINCT 'discipline' AS facet, discipline AS value FROM u WHERE discipline IS NOT NULL UNION ALL SELECT DISTINCT 'affiliation', a FROM (SELECT unnest(list_filter({TAGS}, lambda x: starts_with(x, 'affiliation:'))) AS a FROM u) UNION ALL SELECT DISTINCT 'venue', v.name FROM u JOIN venue v ON v.id = u.venue_id")
def _(t):
    return V.facets(t.event, t.venue, t.today())


@query("A6_tags_of_category", f"SELECT DISTINCT tag FROM (SELECT unnest({TAGS}) AS tag FROM event) WHERE starts_with(tag, 'discipline:')")
def _(t):
    return t.event.select(F.explode(F.filter(from_json_list(C("tags")), lambda x: F.startswith(x, F.lit("discipline:")))).alias("tag")).distinct()


#: Events whose source is another one once they are over, so that some sources have only old ones.
RETIRED = f"SELECT * REPLACE (CASE WHEN source_id % 3 = 1 AND coalesce(date_end, date_start) < {T} THEN source_id + 100 ELSE source_id END AS source_id) FROM event"


def retired(t):
    over = F.coalesce("date_end", "date_start") < t.today()
    return t.event.withColumn("source_id", F.when((C("source_id") % 3 == 1) & over, C("source_id") + 100).otherwise(C("source_id")))


@query("A7_source_totals", f"SELECT source_id, count(CASE WHEN date_start >= {T} AND event_type = 'competition' THEN 1 END) AS competitions, count(CASE WHEN date_start >= {T} AND event_type IN ('training', 'venue_hire') THEN 1 END) AS others, count(CASE WHEN date_start >= {T} THEN 1 END) AS future, count(*) AS ever, count(CASE WHEN date_start >= {T} THEN 1 END) = 0 AS stale FROM ({RETIRED}) GROUP BY source_id")
def _(t):
    return A.source_totals(retired(t), t.today())


@query("A8_feed_validity", f"SELECT source_id, max(coalesce(date_end, date_start)) AS valid_to, max(coalesce(date_end, date_start)) < {T} AS stale FROM ({RETIRED}) GROUP BY source_id")
def _(t):
    return V.feed_validity(retired(t), t.today())


SEEN = "SELECT source_id, name, TRY_CAST(date_start AS DATE) AS d, coalesce(nullif(event_type, ''), " + TYPE + ") AS kind, CASE batch_seq % 5 WHEN 0 THEN 'TBC' WHEN 1 THEN 'zoom' ELSE coalesce(venue_name, '') END AS venue_name, CASE WHEN batch_seq % 3 = 0 THEN venue_postcode END AS postcode FROM extracted"


@query(
    "A9_run_counters",
    f"""WITH {RESOLVED}, x AS ({SEEN}), c AS (SELECT source_id, count(CASE WHEN kind = 'competition' THEN 1 END) AS competitions, count(CASE WHEN kind <> 'competition' THEN 1 END) AS others, count(CASE WHEN match_type = 'exact' THEN 1 END) AS exact,
    count(CASE WHEN match_type = 'alias' THEN 1 END) AS alias, count(CASE WHEN match_type = 'postcode' THEN 1 END) AS postcode, count(CASE WHEN match_type = 'new' THEN 1 END) AS new FROM x JOIN r ON r.venue_name = x.venue_name AND r.postcode IS NOT DISTINCT FROM x.postcode GROUP BY source_id),
    i AS (SELECT source_id, count(*) AS n FROM (SELECT DISTINCT source_id, name, d FROM x) y WHERE NOT EXISTS (SELECT 1 FROM event e WHERE e.name = y.name AND e.date_start = y.d) GROUP BY source_id)
    SELECT c.*, coalesce(i.n, 0) AS inserted FROM c LEFT JOIN i USING (source_id)""",
)
def _(t):
    rows = t.extracted.join(pairs(t).select("batch_seq", C("venue_name").alias("asked"), "postcode"), "batch_seq").withColumn("venue_name", C("asked"))
    rows = I.matched(rows, t.venue, t.alias).withColumns({"event_type": classify.event_type(C("name"), C("event_type")), "date_start": C("date_start").try_cast("date")})
    return I.run_counters(rows, t.event)


HELD = "lower(name) IN ('tbc', 'tba', 'tbd', 'none', 'unknown')"


@query("A10_venue_health", f"SELECT count(*) AS total, count(latitude) AS located, round(100.0 * count(latitude) / count(*), 1) AS share, count(CASE WHEN postcode IS NOT NULL AND latitude IS NULL THEN 1 END) AS missing, count(CASE WHEN {HELD} THEN 1 END) AS placeholders, count(CASE WHEN id NOT IN (SELECT venue_id FROM event WHERE venue_id IS NOT NULL) THEN 1 END) AS orphans, (SELECT count(*) FROM alias WHERE venue_id % 5 = 0) AS pending FROM venue")
def _(t):
    return V.venue_health(t.venue, t.event, t.alias.select(F.when(C("venue_id") % 5 == 0, "pending").otherwise("done").alias("status")))


@query("A10_placeholder_counts", f"SELECT v.id, v.name, count(e.id) AS n FROM (SELECT id, CASE WHEN id % 6 = 1 THEN 'TBD' ELSE name END AS name FROM venue) v LEFT JOIN event e ON e.venue_id = v.id WHERE {HELD.replace('name', 'v.name')} GROUP BY 1, 2")
def _(t):
    return V.placeholder_counts(t.venue.withColumn("name", F.when(C("id") % 6 == 1, "TBD").otherwise(C("name"))), t.event)


@query("A11_discipline_audit", f"WITH m AS (SELECT {DISC_MAP} AS m), g AS (SELECT discipline AS raw, count(*) AS n FROM extracted GROUP BY discipline) SELECT raw, n, {DISC_SQL.format(x='raw')} AS canonical, CASE WHEN {DISC_SQL.format(x='raw')} IS NULL THEN 'unmapped' WHEN {DISC_SQL.format(x='raw')} = raw THEN 'kept' ELSE 'rewritten' END AS outcome FROM g, m")
def _(t):
    return A.discipline_audit(t.extracted)


#: Dynamic venues beside seeds, and aliases of seeds that some have the names of.
DYNAMIC = f"""s AS ({SEED}), k AS (SELECT name FROM s UNION SELECT name FROM venue WHERE id % 9 = 2), d AS (SELECT id, name, name IN (SELECT name FROM k) AS matched FROM venue WHERE source = 'dynamic'),
w AS (SELECT *, CASE WHEN NOT matched THEN split_part(trim(name), ' ', 1) END AS word FROM d), g AS (SELECT word, count(*) AS n FROM w WHERE word IS NOT NULL GROUP BY word HAVING count(*) > 1)"""


def audited(t):
    return A.dynamic_venues(t.venue, seeds(t), t.venue.where("id % 9 = 2").select(C("name").alias("alias")))


@query("A11_rewritten", f"WITH m AS (SELECT {DISC_MAP} AS m) SELECT batch_seq, coalesce({DISC_SQL.format(x='discipline')}, discipline) AS discipline FROM extracted, m")
def _(t):
    return A.canonical_disciplines(t.extracted.select("batch_seq", "discipline"))


@query("A12_prefix_groups", f"WITH {DYNAMIC} SELECT id, name, matched, w.word, n FROM w LEFT JOIN g ON g.word = w.word")
def _(t):
    return audited(t)


@query("A12_match_share", f"WITH {DYNAMIC} SELECT count(*) AS total, count(CASE WHEN matched THEN 1 END) AS matched, count(CASE WHEN NOT matched THEN 1 END) AS unmatched, (SELECT count(*) FROM g) AS groups, round(100.0 * count(CASE WHEN matched THEN 1 END) / count(*), 1) AS share FROM w")
def _(t):
    return A.match_share(audited(t))


@query("A13_duplicate_postcodes", "SELECT id, name, postcode, count(*) OVER (PARTITION BY postcode) AS n FROM venue WHERE postcode IS NOT NULL QUALIFY n > 1")
def _(t):
    return V.shared_postcodes(t.venue)


@query("A14_multi_day_collapse", "SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS date_start, CASE WHEN CAST(max(l_shipdate) AS DATE) <> CAST(min(l_shipdate) AS DATE) THEN CAST(max(l_shipdate) AS DATE) END AS date_end, array_to_string(list_sort(list(DISTINCT l_returnflag)), ';') AS categories FROM lineitem GROUP BY l_orderkey")
def _(t):
    days = t.lineitem.select("l_orderkey", C("l_shipdate").cast("date").alias("day"), "l_returnflag")
    return A.collapse_days(days, "l_orderkey", "day", "l_returnflag").withColumn("categories", F.array_join("categories", ";"))


#: Upcoming events of venues that no seed names, whatever the case.
CAME = f"""WITH s AS ({SEED}), u AS (SELECT id, name, CASE WHEN id % 3 = 0 THEN NULL ELSE url END AS url, venue_name, postcode, latitude, longitude FROM ({JOINED}) WHERE date_start >= {T} AND venue_name IS NOT NULL AND lower(venue_name) NOT IN ('online', 'zoom', 'teams', 'microsoft teams', 'google meet', 'skype', 'webinar', 'virtual', 'tbc', 'tba', 'tbd') AND lower(venue_name) NOT IN (SELECT lower(name) FROM s)),
r AS (SELECT *, row_number() OVER (PARTITION BY venue_name ORDER BY id) AS place FROM u),
m AS (SELECT venue_name AS name, count(*) AS n, arg_max(postcode, id) FILTER (WHERE postcode IS NOT NULL) AS postcode, arg_max(latitude, id) FILTER (WHERE latitude IS NOT NULL) AS latitude, array_to_string(list(url ORDER BY place) FILTER (WHERE place <= 3 AND url IS NOT NULL), ';') AS urls, array_to_string(list(name ORDER BY place) FILTER (WHERE place <= 2), ';') AS names FROM r GROUP BY venue_name)"""


def manifest(t, most):
    e = S.with_venue(t.event, t.venue).withColumn("url", F.when(C("id") % 3 != 0, C("url")))
    return V.new_venue_manifest(e, seeds(t), t.today(), most)


@query("A15_new_venue_manifest", f"{CAME} SELECT name, n, postcode, latitude, urls, names FROM m WHERE postcode IS NOT NULL OR latitude IS NOT NULL OR urls <> '' ORDER BY n DESC, name LIMIT 100")
def _(t):
    return manifest(t, 100).select("name", "n", "postcode", "latitude", F.nullif(F.array_join("urls", ";"), F.lit("")).alias("urls"), F.array_join("names", ";").alias("names"))


@query(
    "A16_gauges",
    f"""SELECT 'scan p95' AS gauge, CAST(source_id AS VARCHAR) AS label, CAST(quantile_disc(seconds, 0.95) AS DOUBLE) AS value FROM scan GROUP BY source_id
    UNION ALL SELECT 'active by discipline', coalesce(discipline, 'none'), count(*) FROM event WHERE event_type = 'competition' AND date_start >= {T} GROUP BY discipline
    UNION ALL SELECT 'venues by source', source, count(*) FROM venue GROUP BY source UNION ALL SELECT 'venues located', 'all', count(latitude) FROM venue UNION ALL SELECT 'sources enabled', 'all', count(CASE WHEN enabled THEN 1 END) FROM source""",
)
def _(t):
    return A.gauges(t.event, t.venue, t.source, t.scan, t.today())


@query("A16_run_buckets", "SELECT source_id, le, count(CASE WHEN seconds <= le THEN 1 END) AS n FROM scan, (SELECT unnest([1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0, CAST('inf' AS DOUBLE)]) AS le) GROUP BY source_id, le")
def _(t):
    return A.run_time_buckets(t.scan)


@query("A16_run_times", "SELECT source_id, count(*) AS runs, quantile_disc(seconds, 0.95) AS seconds FROM scan WHERE day BETWEEN 5 AND 24 GROUP BY source_id")
def _(t):
    """95 of 100 runs over a window of days, from the sketch of each day; few runs, so the sketches are exact."""
    return A.run_time_quantile(A.run_time_sketches(t.scan).where("day BETWEEN 5 AND 24"), 0.95, ["source_id"])


@query("A17_venue_page", f"SELECT v.id AS venue_id, count(e.id) AS n, CASE WHEN count(e.id) BETWEEN 1 AND 5 THEN array_to_string(list(e.id ORDER BY date_start, e.id), ';') END AS links FROM venue v LEFT JOIN event e ON e.venue_id = v.id AND date_start >= {T} GROUP BY v.id")
def _(t):
    return V.venue_page(t.event, t.venue, t.today()).select("venue_id", "n", F.array_join(F.transform("links", lambda x: x.cast("string")), ";").alias("links"))


@query("A17_venue_names", "SELECT DISTINCT venue_id, 'alias' AS kind, alias AS name FROM alias WHERE venue_id IN (SELECT id FROM venue) UNION ALL SELECT DISTINCT e.venue_id, 'source', s.name FROM event e JOIN venue v ON v.id = e.venue_id JOIN source s ON s.id = e.source_id WHERE v.source = 'dynamic'")
def _(t):
    return V.venue_names(t.venue, t.alias, t.event, t.source)


@query("W1_keep_first", "SELECT batch_seq FROM extracted QUALIFY row_number() OVER (PARTITION BY lower(name), date_start ORDER BY batch_seq) = 1")
def _(t):
    return I.keep_first(t.extracted.withColumn("key", F.lower("name")), ["key", "date_start"]).select("batch_seq")


@query("W2_last_and_first", "SELECT name, arg_max(discipline, batch_seq) AS discipline, min(batch_seq) AS batch_seq, arg_min(date_end, batch_seq) FILTER (WHERE date_end IS NOT NULL) AS date_end, arg_max(url, batch_seq) FILTER (WHERE url IS NOT NULL) AS url FROM (SELECT * REPLACE (coalesce(discipline, '') AS discipline) FROM extracted) GROUP BY name")
def _(t):
    e = t.extracted.withColumn("discipline", F.coalesce("discipline", F.lit("")))
    return V.last_and_first(e, ["name"], "batch_seq", ["date_end"], ["discipline", "url"])


GROUPED = "SELECT *, regexp_replace(name, ' [0-9]+$', '') AS canonical FROM venue"


def grouped(t):
    return t.venue.select("id", F.regexp_replace("name", " [0-9]+$", "").alias("canonical"))


@query("W3_group_keeper", f"SELECT id, first_value(id) OVER (PARTITION BY canonical ORDER BY (name = canonical) DESC, (latitude IS NOT NULL) DESC, (postcode IS NOT NULL) DESC, id) AS keeper FROM ({GROUPED})")
def _(t):
    return A.merge_plan(t.venue, grouped(t)).select("id", "keeper")


@query("W4_longest_name", "SELECT postcode, arg_max(name, {'a': length(name), 'b': -id}) AS canonical FROM venue WHERE postcode IS NOT NULL GROUP BY 1")
def _(t):
    return V.longest_names(t.venue)


FOUND = "competitions_found_comp + competitions_found_training"


@query("W5_run_drops", f"SELECT id, source_id, found, before FROM (SELECT id, source_id, {FOUND} AS found, lag({FOUND}) OVER (PARTITION BY source_id ORDER BY id) AS before FROM scan WHERE status = 'completed') WHERE found < before * 0.5")
def _(t):
    return A.run_drops(t.scan)


@query("W6_zero_streaks", f"WITH r AS (SELECT source_id, id, {FOUND} AS found, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS back FROM scan WHERE status = 'completed'), s AS (SELECT source_id, sum(CASE WHEN found > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY id DESC) AS hits FROM r WHERE back <= 20) SELECT source_id, count(CASE WHEN hits = 0 THEN 1 END) AS streak, count(CASE WHEN hits = 0 THEN 1 END) >= 3 AS alert FROM s GROUP BY source_id")
def _(t):
    return A.zero_streaks(t.scan)


@query("W7_date_groups", f"SELECT greatest(date_start, {T}) AS day, count(*) AS n, min(id) AS first_id FROM event WHERE date_start >= {T} OR date_end >= {T} GROUP BY 1")
def _(t):
    return t.event.where(S.in_window(t.today())).groupBy(F.greatest("date_start", t.today()).alias("day")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


W8_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity", "l_shipdate"]


@query("W8_fill_down", f"SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_linenumber % 3 = 1 THEN l_returnflag END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(W8_ORDER)}) AS heading FROM lineitem")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.struct(*W8_ORDER).alias("o"), F.when(C("l_linenumber") % 3 == 1, C("l_returnflag")).alias("heading"))
    return A.fill_down(rows, "l_orderkey", "o", "heading").select("l_orderkey", "l_linenumber", "heading")


@query("W9_preferred_feed", "SELECT id FROM event QUALIFY source_id % 4 = min(source_id % 4) OVER (PARTITION BY date_start)")
def _(t):
    return A.prefer(t.event.withColumn("rank", C("source_id") % 4), "date_start", C("rank")).select("id")


# -- write-path jobs ----------------------------------------------------------------------------------------------

STORED = "SELECT id, source_id, name, date_start, venue_id, date_end, coalesce(discipline, '-') AS discipline, url FROM event WHERE id % 2 = 0"
BATCH = "SELECT id AS batch_seq, CASE WHEN id % 3 = 0 THEN source_id ELSE (source_id + 1) % 20 END AS source_id, name, date_start, venue_id, date_end, 'new ' || coalesce(discipline, '-') AS discipline, CASE WHEN id % 5 = 0 THEN NULL ELSE 'u' || id END AS url FROM event"


@query(
    "M1_upsert",
    f"""WITH st AS ({STORED}), ba AS ({BATCH}), m AS (SELECT b.*, arg_min(s.id, {{'o': s.source_id <> b.source_id, 'i': s.id}}) AS tid FROM ba b LEFT JOIN st s ON s.name = b.name AND s.date_start = b.date_start AND s.venue_id IS NOT DISTINCT FROM b.venue_id GROUP BY ALL),
    g AS (SELECT tid, CASE WHEN tid IS NULL THEN name END AS n, CASE WHEN tid IS NULL THEN date_start END AS d, CASE WHEN tid IS NULL THEN venue_id END AS v, arg_max(discipline, (source_id, batch_seq)) AS discipline, arg_min(date_end, (source_id, batch_seq)) FILTER (WHERE date_end IS NOT NULL) AS date_end, arg_max(url, (source_id, batch_seq)) FILTER (WHERE url IS NOT NULL) AS url, min((source_id, batch_seq)) AS o, min(batch_seq) AS b, arg_min(source_id, (source_id, batch_seq)) AS source_id FROM m GROUP BY ALL)
    SELECT s.id, s.source_id, s.name, s.date_start, s.venue_id, coalesce(s.date_end, g.date_end) AS date_end, coalesce(g.discipline, s.discipline) AS discipline, coalesce(g.url, s.url) AS url FROM st s LEFT JOIN g ON g.tid = s.id
    UNION ALL SELECT (SELECT max(id) FROM st) + row_number() OVER (ORDER BY source_id, b), source_id, n, d, v, date_end, discipline, url FROM g WHERE tid IS NULL""",
)
def m1(t):
    now = F.lit(f"{TODAY} 00:00:00").cast("timestamp")
    none = {c: F.lit(None).cast(k) for c, k in (("event_type", "string"), ("spectator", "boolean"), ("hidden", "boolean"), ("description", "string"), ("classes", "string"), ("raw_extract", "string"), ("venue_match_type", "string"))}
    stored = t.event.where("id % 2 = 0").withColumns({**none, "discipline": F.coalesce("discipline", F.lit("-")), "first_seen_at": now, "last_seen_at": now}).select(*I.EVENT_COLUMNS)
    batch = t.event.withColumns({
        **none, "batch_seq": C("id"), "source_id": F.when(C("id") % 3 == 0, C("source_id")).otherwise((C("source_id") + 1) % 20),
        "discipline": F.concat(F.lit("new "), F.coalesce("discipline", F.lit("-"))), "url": F.when(C("id") % 5 != 0, F.concat(F.lit("u"), C("id").cast("string"))),
    }).select("batch_seq", "source_id", *I.KEY, "date_end", *I.REFRESHED, "url")
    return I.upsert(stored, batch, now).select("id", "source_id", "name", "date_start", "venue_id", "date_end", "discipline", "url")


CANON = f"""SELECT *, CASE WHEN c IN ('Rectory Farm', 'Brook Farm') AND postcode IS NOT NULL THEN c || ' (' || split_part(postcode, ' ', 1) || ')' ELSE c END AS canonical
FROM (SELECT * REPLACE (CASE WHEN id % 4 = 0 THEN upper(regexp_replace(name, ' [0-9]+$', '')) || ' EC' ELSE regexp_replace(name, ' [0-9]+$', '') END AS name), {title("regexp_replace(name, ' [0-9]+$', '')")} AS c FROM venue)"""


MERGED = f"""c AS ({CANON}), o AS (SELECT *, {{'a': name <> canonical, 'b': latitude IS NULL, 'c': postcode IS NULL, 'd': id}} AS o FROM c),
g AS (SELECT canonical, arg_min(id, o) AS keeper, arg_min(postcode, o) FILTER (WHERE postcode IS NOT NULL) AS pc, arg_min(latitude, o) FILTER (WHERE latitude IS NOT NULL) AS la, arg_min(longitude, o) FILTER (WHERE latitude IS NOT NULL) AS lo FROM o GROUP BY canonical),
p AS (SELECT o.*, keeper, pc, la, lo FROM o JOIN g USING (canonical))"""


def merged(t):
    """The re-normalisation of venues without numbers in their names, of which some are in capitals, and of aliases."""
    bare = F.regexp_replace("name", " [0-9]+$", "")
    v = t.venue.withColumn("name", F.when(C("id") % 4 == 0, F.concat(F.upper(bare), F.lit(" EC"))).otherwise(bare))
    return A.renormalise(v, t.alias, t.event.select("id", "venue_id"))


@query("M2_renormalise", f"WITH {MERGED} SELECT e.id, coalesce(p.keeper, e.venue_id) AS venue_id FROM event e LEFT JOIN p ON p.id = e.venue_id")
def _(t):
    return merged(t)["events"]


@query("M2_venues", f"WITH {MERGED} SELECT id, canonical AS name, pc AS postcode, la AS latitude, lo AS longitude FROM p WHERE id = keeper")
def _(t):
    return merged(t)["venues"]


@query("M2_aliases", f"WITH {MERGED} SELECT alias, p.keeper AS venue_id, origin FROM alias JOIN p ON p.id = venue_id")
def _(t):
    return merged(t)["aliases"]


@query("M2_plan", f"WITH {MERGED} SELECT id, CASE WHEN id <> keeper THEN 'MERGE' WHEN name <> canonical THEN 'RENAME' WHEN pc IS DISTINCT FROM postcode OR la IS DISTINCT FROM latitude THEN 'FILL' ELSE 'KEEP' END AS action, name AS old_name, keeper, canonical AS name FROM p")
def _(t):
    return merged(t)["plan"]


#: Venues of which some are placeholders, one of them beside a single real venue of its postcode.
HELD_VENUE = "SELECT * REPLACE (CASE WHEN id % 10 IN (5, 6) THEN 'tbd' WHEN id % 10 = 8 THEN 'Various' ELSE name END AS name) FROM venue"
HELD_NAMES = "lower(trim(name)) IN ('tbc', 'tba', 'tbd', 'various', 'unknown', 'none')"
MOVED = f"""hv AS ({HELD_VENUE}), u AS (SELECT postcode AS pc, min(id) AS rid FROM hv WHERE postcode IS NOT NULL AND NOT {HELD_NAMES} GROUP BY 1 HAVING count(*) = 1),
h AS (SELECT id AS hid, rid FROM hv LEFT JOIN u ON pc = postcode WHERE {HELD_NAMES}),
moved AS (SELECT e.id, coalesce(h.rid, u.rid, e.venue_id) AS venue_id FROM event e LEFT JOIN h ON hid = e.venue_id LEFT JOIN venue x ON x.id = 1 + e.id % (SELECT greatest(count(*) - 10, 10) FROM venue) LEFT JOIN u ON hid IS NOT NULL AND h.rid IS NULL AND u.pc = x.postcode)"""


def held(t):
    k = C("id") % 10
    venues = t.venue.withColumn("name", F.when(k.isin(5, 6), "tbd").when(k == 8, "Various").otherwise(C("name")))
    codes = t.venue.select(C("id").alias("x_id"), F.to_json(F.struct(F.lower("postcode").alias("venue_postcode"))).alias("raw_extract"))
    events = t.event.select("id", "venue_id").join(codes, 1 + C("id") % max(t.venue.count() - 10, 10) == C("x_id"), "left").drop("x_id")
    return V.resolve_placeholders(events, venues), venues


@query("M3_placeholders_resolved", f"WITH {MOVED} SELECT id, venue_id FROM moved")
def _(t):
    return held(t)[0].select("id", "venue_id")


@query("M3_emptied_placeholders", f"WITH {MOVED} SELECT id, name FROM hv WHERE {HELD_NAMES} AND id NOT IN (SELECT venue_id FROM moved WHERE venue_id IS NOT NULL)")
def _(t):
    return V.emptied_placeholders(*held(t)).select("id", "name")


#: Events after their descriptions and classes have been taken anew from the extract.
FRESH = f"SELECT *, CASE WHEN id % 5 = 0 THEN 'Fresh text' ELSE coalesce(description, '') END AS fresh, CASE WHEN id % 3 = 0 THEN ['Discovery'] ELSE {CLASSES} END AS cl FROM event"
#: Their normalised names and details.
FRESH_X = r"trim(regexp_replace(replace(lower(name || ' ' || trim(concat_ws(' ', nullif(fresh, ''), nullif(array_to_string(cl, ' '), '')))), '&', ' and '), '\s+', ' ', 'g'))"


@query("M4_retagged", f"WITH f AS ({FRESH}), r AS ({ruled(f'SELECT id, {FRESH_X} AS x, cl, event_type, {chr(39)}nsea{chr(39)} AS own FROM f')}) SELECT f.id, coalesce(description, '') <> fresh AS description_changed, id % 3 = 0 AND array_to_string({CLASSES}, ';') <> 'Discovery' AS classes_changed, r.tags FROM f JOIN r ON r.id = f.id".replace("SELECT f.id, coalesce(description", "SELECT f.id, coalesce(f.description").replace("AND array_to_string(", "AND array_to_string(").replace("id % 3 = 0 AND array", "f.id % 3 = 0 AND array"))
def _(t):
    new = F.struct(F.when(C("id") % 5 == 0, "Fresh text").otherwise(F.coalesce("description", F.lit(""))).alias("description"), F.when(C("id") % 3 == 0, F.array(F.lit("Discovery"))).otherwise(from_json_list(C("classes"))).alias("classes"), F.lit("nsea").alias("affiliation"))
    done = A.retag(t.event.withColumn("raw_extract", F.to_json(new)))
    return done.select("id", "description_changed", "classes_changed", F.array_join(F.filter("tags", lambda x: ~F.startswith(x, F.lit("discipline:"))), ";").alias("tags"))


@query("M5_disambiguated_reset", "SELECT id, name, CASE WHEN told AND id % 2 = 0 THEN 'ZZ1 1ZZ' ELSE postcode END AS postcode, CASE WHEN told THEN NULL ELSE latitude END AS latitude, CASE WHEN told THEN NULL ELSE longitude END AS longitude FROM (SELECT *, regexp_matches(name, '[(][A-Z]{1,2}[0-9][A-Z0-9]?[)]$') AS told FROM (SELECT * REPLACE (CASE WHEN postcode IS NOT NULL AND id % 3 = 0 THEN name || ' (' || split_part(postcode, ' ', 1) || ')' ELSE name END AS name) FROM venue))")
def _(t):
    v = t.venue.withColumn("name", F.when(C("postcode").isNotNull() & (C("id") % 3 == 0), F.concat("name", F.lit(" ("), text.outward_code(C("postcode")), F.lit(")"))).otherwise(C("name")))
    return V.reset_disambiguated(v, v.where("id % 2 = 0").select("name", F.lit("ZZ1 1ZZ").alias("postcode"))).select("id", "name", "postcode", "latitude", "longitude")


GOOD_CODE = "regexp_matches(s.postcode, '^[A-Z]{1,2}[0-9][A-Z0-9]? [0-9][A-Z]{2}$')"


@query(
    "M6_seed_issues",
    f"""WITH s AS (SELECT v.*, p.latitude AS pla, p.longitude AS plo FROM (SELECT id, CASE WHEN id = 3 THEN 'Brook Farm' ELSE name END AS name, CASE WHEN id % 8 = 0 THEN 'bad' WHEN id % 10 = 1 THEN 'XX9 9XX' WHEN id % 10 = 9 THEN 'JE2 3AB' ELSE postcode END AS postcode, CASE WHEN id % 9 = 0 THEN 70 ELSE latitude END AS latitude, longitude FROM venue) v LEFT JOIN postcode p ON p.postcode = v.postcode),
    c AS (SELECT * FROM s WHERE latitude IS NOT NULL AND {GOOD_CODE} AND NOT starts_with(postcode, 'JE'))
    SELECT 'format' AS issue, name FROM s WHERE NOT {GOOD_CODE} UNION ALL SELECT 'bounds', name FROM s WHERE latitude IS NOT NULL AND NOT coalesce(latitude BETWEEN 49 AND 61.5 AND longitude BETWEEN -11 AND 2.5, false)
    UNION ALL SELECT 'unknown postcode', name FROM c WHERE pla IS NULL UNION ALL SELECT 'far', name FROM c WHERE {miles('latitude', 'longitude', 'pla', 'plo')} > 20 UNION ALL SELECT 'self alias', name FROM s WHERE id % 12 = 0
    UNION ALL SELECT 'no postcode', name FROM s WHERE latitude IS NOT NULL AND postcode IS NULL UNION ALL SELECT 'ambiguous missing', unnest(['Rectory Farm', 'Manor Farm', 'Home Farm', 'Church Farm', 'Lodge Farm', 'Hill Farm', 'Park Farm', 'Grange Farm', 'Hall Farm', 'Mill Farm', 'Glebe Farm', 'Moor Farm', 'Field Farm'])""",
)
def _(t):
    k = C("id")
    v = t.venue.withColumns({
        "name": F.when(k == 3, "Brook Farm").otherwise(C("name")), "postcode": F.when(k % 8 == 0, "bad").when(k % 10 == 1, "XX9 9XX").when(k % 10 == 9, "JE2 3AB").otherwise(C("postcode")),
        "latitude": F.when(k % 9 == 0, F.lit(70.0)).otherwise(C("latitude")),
    })
    v = v.withColumn("aliases", F.array(F.when(k % 12 == 0, C("name")).otherwise(F.concat("name", F.lit(" Alt")))))
    return A.seed_issues(v.select("name", "postcode", "latitude", "longitude", "aliases"), t.postcode)


@query(
    "M7_consolidated_seeds",
    """WITH v AS (SELECT id, name, postcode, CASE WHEN postcode IS NULL THEN name ELSE first_value(name) OVER (PARTITION BY postcode ORDER BY length(name) DESC, id) END AS keeper FROM venue)
    SELECT 'seed' AS kind, name, postcode AS value FROM v WHERE name = keeper UNION ALL SELECT 'alias', name, name || ' Alt' FROM v WHERE name = keeper UNION ALL SELECT 'alias', keeper, name FROM v WHERE name <> keeper""",
)
def _(t):
    kept, aliases = V.consolidate(t.venue.select("id", "name", "postcode"), t.venue.select(F.concat("name", F.lit(" Alt")).alias("alias"), "name"))
    return kept.select(F.lit("seed").alias("kind"), "name", C("postcode").alias("value")).union(aliases.select(F.lit("alias"), "name", "alias"))


@query("M8_values_renamed", f"SELECT id, CASE WHEN event_type = 'show' THEN 'fair' ELSE event_type END AS event_type, array_to_string(list_transform({TAGS}, lambda x: CASE WHEN x = 'type:show' THEN 'type:fair' ELSE x END), ';') AS tags, CASE WHEN id % 3 <> 0 THEN 'competition' WHEN id % 2 = 0 THEN 'venue_hire' ELSE 'training' END AS legacy FROM event")
def _(t):
    legacy = V.type_of_legacy(F.when(C("id") % 6 != 1, C("id") % 3 != 0), F.when(C("id") % 2 == 0, "Venue Hire").otherwise("Training"))
    return V.rename_values(t.event, "event_type", "show", "fair", "type").select("id", "event_type", F.array_join("tags", ";").alias("tags"), legacy.alias("legacy"))


# -- feeds and sinks ----------------------------------------------------------------------------------------------

#: Ids of one payload of seeds or rules, however many there are in all.
BUCKET = 1000
CLEAN = "replace(name, '&', 'and')"


def listed(t):
    """Events as a feed gives them; a page of a source and month holds so many ids at most, however many there are."""
    month = F.date_format("date_start", "yyyy-MM")
    return t.event.select(
        "source_id", month.alias("month"), F.floor(C("id") / BUCKET).alias("page"), "id", F.replace("name", F.lit("&"), F.lit("and")).alias("name"), "date_start",
        F.coalesce("date_end", "date_start").alias("date_end"), F.coalesce("url", F.lit("")).alias("url"),
    )


def paged(t, body):
    """Payloads of the pages. Events are dealt out first: most pages hold few of them, so lists made before the shuffle
    would cost a sort more and spare no rows, and markup is longer than what it is made of."""
    return listed(t).repartition("source_id", "month", "page").groupBy("source_id", "month", "page").agg(body.alias("body"))


@query("S1_json_payloads", f"SELECT {CLEAN} AS name, date_start, nullif(date_end, date_start) AS date_end FROM event")
def _(t):
    rows = F.collect_list(F.struct(C("name").alias("title"), F.concat(C("date_start").cast("string"), F.lit(" 10:00:00")).alias("start_date"), F.concat(C("date_end").cast("string"), F.lit(" 16:00:00")).alias("end_date"), "url"))
    return feeds.FEEDS["calendar_api"](paged(t, F.to_json(F.struct(rows.alias("events"))))).select("name", "date_start", "date_end")


@query("S1_meetings", f"SELECT id AS batch_seq, {CLEAN} AS name, date_start, nullif(date_end, date_start) AS date_end FROM event WHERE id % 3 <> 1")
def _(t):
    row = F.struct("id", "name", C("date_start").cast("string").alias("start_on"), C("date_end").cast("string").alias("end_on"), F.when(C("id") % 3 == 1, "FRA").otherwise("GBR").alias("venue_country"))
    return feeds.FEEDS["meetings_api"](paged(t, F.to_json(F.collect_list(row)))).select("batch_seq", "name", "date_start", "date_end")


@query("S1_search", f"SELECT id AS batch_seq, {CLEAN} AS name, date_start, nullif(date_end, date_start) AS date_end, 'Bury Farm' AS venue_name FROM event")
def _(t):
    row = F.struct("id", "name", F.concat(C("date_start").cast("string"), F.lit(" 09:00:00")).alias("start"), F.concat(C("date_end").cast("string"), F.lit(" 17:00:00")).alias("end"), F.lit("Bury Farm").alias("venue_name"))
    rows = F.flatten(F.collect_list(F.array_repeat(row, F.when(C("id") % 4 == 0, 2).otherwise(1))))  # the feed repeats some of its rows
    return feeds.FEEDS["search_api"](paged(t, F.to_json(F.struct(rows.alias("rows"))))).select("batch_seq", "name", "date_start", "date_end", "venue_name")


@query("S1_tour", f"SELECT 'W' || source_id || ' ' || {CLEAN} AS name, date_start, nullif(date_end, date_start) AS date_end FROM event")
def _(t):
    week = F.concat(F.lit("W"), C("source_id").cast("string"))
    row = F.struct(week.alias("virtual_week_code"), C("name").alias("description"), F.concat(C("date_start").cast("string"), F.lit("T08:00")).alias("start_at"), F.concat(C("date_end").cast("string"), F.lit("T20:00")).alias("end_at"))
    return feeds.FEEDS["tour_api"](paged(t, F.to_json(F.struct(F.struct(F.collect_list(row).alias("show_ids")).alias("payload"))))).select("name", "date_start", "date_end")


@query(
    "S1_data_rows",
    f"""SELECT id AS batch_seq, trim({CLEAN}) || ' & more' AS name, date_start, nullif(date_end, date_start) AS date_end, CASE WHEN id % 6 = 0 THEN 'TBC' ELSE 'Jo''s Yard' END AS venue_name,
    CASE WHEN id % 2 = 0 THEN 'Prelim 1;Novice 2' ELSE '' END AS classes FROM event WHERE id % 5 <> 0 AND id % 7 <> 0""",
)
def _(t):
    k = C("id")
    row = F.struct(
        "id", F.concat("name", F.lit(" &amp; more")).alias("full_show_name"), F.when(k % 6 != 0, "Jo&#39;s Yard").alias("venue_name"), C("date_start").cast("string").alias("start"), C("date_end").cast("string").alias("end"),
        F.when(k % 2 == 0, "Prelim 1 + Novice 2 +").otherwise("").alias("class_range"), F.when(k % 7 == 0, "Cancelled").otherwise("open").alias("status"), F.when(k % 5 == 0, 5).otherwise(1).alias("event_status_id"),
    )
    rows = feeds.FEEDS["data_api"](paged(t, F.to_json(F.struct(F.collect_list(row).alias("data")))))
    return rows.select("batch_seq", "name", "date_start", "date_end", "venue_name", F.array_join("classes", ";").alias("classes"))


def table_of(row):
    return F.concat(F.lit("<table>"), F.array_join(F.collect_list(row), ""), F.lit("</table>"))


def html_row(cells):
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))


@query("S2_html_tables", f"SELECT trim({CLEAN}) AS name, date_start FROM event WHERE id % 5 <> 0")
def _(t):
    cells = [F.date_format("date_start", "d MMM yyyy"), F.concat(F.lit("<a href='x'>"), C("name"), F.lit("</a>")), F.lit("90cm, 1m"), F.lit("Bury Farm"), F.lit(""), F.lit(""), F.when(C("id") % 5 == 0, "X").otherwise("")]
    return feeds.FEEDS["html_table"](paged(t, table_of(html_row(cells)))).select("name", "date_start")


ORGANISER = r"coalesce(nullif(trim(regexp_extract(nm, '(?i)^(.*?(?:Riding\s+Club|Pony\s+Club|Equestrian\s+Centre|Equestrian\s+Club|RC\b|PC\b))', 1)), ''), CASE WHEN contains(nm, ' - ') THEN nullif(trim(split_part(nm, ' - ', 1)), '') END, nm)"


@query(
    "S2_eight_cells",
    f"""SELECT nm AS name, date_start, nullif(date_end, date_start) AS date_end, CASE WHEN id % 2 = 0 THEN 'Bury Farm' ELSE {ORGANISER} END AS venue_name,
    CASE WHEN id % 2 = 0 THEN 'B94 6JD' END AS venue_postcode, CASE WHEN id % 3 = 0 THEN 'Dressage' END AS discipline, 'https://feed.example/e/' || id AS url
    FROM (SELECT *, trim({CLEAN}) || ' & friends' AS nm FROM event) WHERE id % 5 <> 0""",
)
def _(t):
    """Rows of eight cells, one of them with a table of its own, and cells that no tag ends."""
    k = C("id")
    link = F.concat(F.lit('<a href="/e/'), k.cast("string"), F.lit('">'), C("name"), F.lit("</a> &amp; friends"))
    place = F.when(k % 2 == 0, "Bury Farm (B946JD)").otherwise("UK Location")
    first = F.when(k % 5 == 0, "soon").otherwise(F.date_format("date_start", "dd/MM/yyyy"))
    cells = [F.lit("<table><tr><td>add<td>share</table>"), link, first, F.date_format("date_end", "dd/MM/yyyy"), F.when(k % 3 == 0, "Dressage").otherwise(""), place, F.lit("Kent"), F.lit("3")]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c) for c in cells])
    pages = paged(t, table_of(row)).withColumn("url", F.lit("https://feed.example/list?page=1"))
    return feeds.FEEDS["html_table"](pages).select("name", "date_start", "date_end", "venue_name", "venue_postcode", "discipline", "url")


#: Pages of one file of payloads, as a rule; a page holds up to a source's events of a month in a bucket of ids.
PAGES = 20_000


@query("S2_feed_stream", f"SELECT trim({CLEAN}) AS name, date_start FROM event WHERE id % 5 <> 0")
def _(t):
    """The same pages as payload files that a stream reads as they come."""
    from ..operators.storage import discard, scratch
    from ..streaming.ingest import landed

    cells = [F.date_format("date_start", "d MMM yyyy"), C("name"), F.lit("90cm, 1m"), F.lit("Bury Farm"), F.lit(""), F.lit(""), F.when(C("id") % 5 == 0, "X").otherwise("")]
    landing, found, offsets = (scratch(t.spark, x) for x in ("payloads", "rows", "offsets"))
    pages = paged(t, table_of(html_row(cells))).select("source_id", F.lit(None).cast("string").alias("url"), "body")
    each = landed(pages, landing, 3, "json", PAGES)
    rows = feeds.read(t.spark, "html_table", landing, stream=True, files=each).select("name", "date_start")
    rows.writeStream.format("parquet").option("path", found).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    discard(t.spark, landing, offsets)
    return t.spark.read.schema("name string, date_start date").parquet(found)


ARCHIVED = f"SELECT 'calendar_api' AS feed, {CLEAN} AS name, date_start, nullif(date_end, date_start) AS date_end FROM event WHERE id % 3 > 0 UNION ALL SELECT 'meetings_api', {CLEAN}, date_start, nullif(date_end, date_start) FROM event WHERE id % 3 = 0"


def archive_pages(t):
    """All events as payloads of two feeds: every third in those of one, the others in those of the other."""
    last = F.concat(C("date_end").cast("string"), F.lit(" 16:00:00"))
    row = F.struct("id", "name", C("name").alias("title"), last.alias("end_date"), C("date_start").cast("string").alias("start_date"), C("date_start").cast("string").alias("start_on"), C("date_end").cast("string").alias("end_on"), F.lit("GBR").alias("venue_country"), "url")
    own = F.when(C("id") % 3 == 0, "meetings_api").otherwise("calendar_api").alias("feed")
    rows = listed(t).groupBy(own, "source_id", "page", "month").agg(F.collect_list(row).alias("rows"))
    body = F.when(C("feed") == "meetings_api", F.to_json("rows")).otherwise(F.to_json(F.struct(C("rows").alias("events"))))
    return rows.select("feed", "source_id", F.lit(None).cast("string").alias("url"), body.alias("body"))


@query("S1_archive", ARCHIVED)
def _(t):
    """Payloads of two feeds in one archive, read with small splits whose borders fall anywhere."""
    from ..operators.storage import scratch

    landing = scratch(t.spark, "archive")
    archive_pages(t).write.json(landing)
    found = [feeds.archived(t.spark, k, landing, split=1 << 20).select(F.lit(k).alias("feed"), "name", "date_start", "date_end") for k in ("calendar_api", "meetings_api")]
    return found[0].union(found[1])


@query("S1_archive_stream", ARCHIVED)
def _(t):
    """The same archive in three deliveries; a stream of each feed follows it, and is started anew for each delivery
    from where it stood."""
    from ..operators.storage import discard, scratch

    landing, base = scratch(t.spark, "archive"), scratch(t.spark, "rows")
    for k in range(3):
        archive_pages(t).where(F.pmod("source_id", F.lit(3)) == k).write.mode("append").json(landing)
        for key in ("calendar_api", "meetings_api"):
            rows = feeds.archived(t.spark, key, landing, stream=True).select(F.lit(key).alias("feed"), "name", "date_start", "date_end")
            out = rows.writeStream.format("parquet").option("path", f"{base}/{key}").option("checkpointLocation", f"{base}/offsets-{key}")
            out.trigger(availableNow=True).start().awaitTermination()
    discard(t.spark, landing, *[f"{base}/offsets-{key}" for key in ("calendar_api", "meetings_api")])
    found = [t.spark.read.schema("feed string, name string, date_start date, date_end date").parquet(f"{base}/{key}") for key in ("calendar_api", "meetings_api")]
    return found[0].union(found[1])


@query("S3_rss_items", f"SELECT {CLEAN} AS name, date_start FROM event")
def _(t):
    day = C("date_start")
    link = F.when(C("id") % 2 == 0, F.concat(F.lit("https://r.example/on/"), F.date_format(day, "yyyy/MM/dd"))).otherwise("https://r.example/x")
    item = F.concat(F.lit("<item><title>"), C("name"), F.lit("</title><link>"), link, F.lit("</link><pubDate>Mon, "), F.date_format(day, "dd MMM yyyy"), F.lit(" 09:00:00 GMT</pubDate></item>"))
    return feeds.FEEDS["rss"](paged(t, F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")))).select("name", "date_start")


@query("S4_json_ld", "SELECT id AS source_id, name, date_start FROM event WHERE id % 7 <> 0")
def _(t):
    e = t.event
    one = F.to_json(F.struct(F.when(C("id") % 7 == 0, "WebPage").otherwise("Event").alias("@type"), "name", C("date_start").cast("string").alias("startDate")))
    body = F.when(C("id") % 2 == 0, one).when(C("id") % 5 == 0, F.concat(F.lit('[{"@type":"Org"},'), one, F.lit("]"))).otherwise(F.concat(F.lit('{"@graph":['), one, F.lit("]}")))
    pages = e.select(C("id").alias("source_id"), "url", F.concat(F.lit('<html><script type="application/ld+json">'), body, F.lit("</script>")).alias("body"))
    return feeds.FEEDS["json_ld"](pages).select("source_id", "name", "date_start")


@query("S5_clean_html")
def _(t):
    """Text of pages for reading; tests compare it with a plain reader that knows no trees."""
    return t.pages.select("page_id", markup.clean_html(C("html")).alias("text"))


@query("S6_reply_rows", "SELECT id, name, CAST(date_start AS VARCHAR) AS date_start FROM event WHERE id % 4 <> 1")
def _(t):
    row = F.to_json(F.struct("name", C("date_start").cast("string").alias("date_start"), F.when(C("id") % 4 != 1, "Bury Farm").alias("venue_name")))
    cut = F.when(C("id") % 4 == 2, F.concat(F.lit("Here: ["), row, F.lit(', {"name": "cut o'))).otherwise(F.concat(F.lit("Found these: ["), row, F.lit("] as asked.")))
    return feeds.reply_rows(t.event.select("id", cut.alias("body"))).select("id", "name", "date_start")


@query("S7_venue_seeds", "SELECT name, postcode, 'venue' AS kind FROM venue UNION ALL SELECT name, name || ' Alt', 'alias' FROM venue")
def _(t):
    entry = F.struct("postcode", C("latitude").alias("lat"), C("longitude").alias("lng"), F.array(F.concat("name", F.lit(" Alt"))).alias("aliases"))
    payload = t.venue.groupBy(F.floor(C("id") / BUCKET).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", entry)))).alias("body"))
    venues, aliases = feeds.venue_seeds(payload)
    return venues.select("name", "postcode", F.lit("venue").alias("kind")).union(aliases.select("name", "alias", F.lit("alias")))


@query("S8_rule_json", "SELECT p_brand AS key, p_type AS word FROM part")
def _(t):
    payload = t.part.groupBy(F.floor(C("p_partkey") / BUCKET).alias("part"), "p_brand").agg(F.collect_list("p_type").alias("w")).groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", "w")))).alias("body"))
    return feeds.rule_rows(payload).select("key", "word")


@query("S9_event_sink", f"SELECT id, date_start, array_to_string({TAGS}, ';') AS tags FROM event")
def _(t):
    from ..operators.storage import scratch

    path = scratch(t.spark, "events")
    sinks.write_events(t.event.select("id", "date_start", from_json_list(C("tags")).alias("tags"), from_json_list(C("classes")).alias("classes")), path, json_lists=True)
    back = t.spark.read.parquet(path)
    return back.select("id", "date_start", F.array_join(from_json_list(C("tags")), ";").alias("tags"))


VEVENT = r"""'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:event-' || id || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(date_start, '%Y%m%d') || chr(13) || chr(10) || 'DTEND;VALUE=DATE:' || strftime(coalesce(date_end, date_start) + 1, '%Y%m%d') || chr(13) || chr(10) || 'SUMMARY:' || replace(name, ',', '\,') || chr(13) || chr(10) || 'LOCATION:' || replace(coalesce(venue_name, ''), ',', '\,') || chr(13) || chr(10) || 'DESCRIPTION:' || concat_ws('\\n', nullif(coalesce(discipline, ''), ''), url) || chr(13) || chr(10) || 'BEGIN:VALARM' || chr(13) || chr(10) || 'TRIGGER:-P7D' || chr(13) || chr(10) || 'ACTION:DISPLAY' || chr(13) || chr(10) || 'END:VALARM' || chr(13) || chr(10) || 'END:VEVENT'"""


@query("S10_ical", f"SELECT {VEVENT} AS text FROM ({JOINED})")
def _(t):
    return S.with_venue(t.event, t.venue).select(sinks.ical_event().alias("text"))


@query("S10_ical_export", rf"SELECT 'BEGIN:VCALENDAR' || chr(13) || chr(10) || 'VERSION:2.0' || chr(13) || chr(10) || string_agg(text, chr(13) || chr(10) ORDER BY date_start, id) || chr(13) || chr(10) || 'END:VCALENDAR' || chr(13) || chr(10) AS calendar FROM (SELECT date_start, id, {VEVENT} AS text FROM ({JOINED}) ORDER BY date_start, id LIMIT 200)")
def _(t):
    return sinks.ical_export(S.with_venue(t.event, t.venue))


@query("S10_calendars", rf"SELECT CAST(venue_id AS VARCHAR) AS venue, 'BEGIN:VCALENDAR' || chr(13) || chr(10) || 'VERSION:2.0' || chr(13) || chr(10) || string_agg(text, chr(13) || chr(10) ORDER BY date_start, id) || chr(13) || chr(10) || 'END:VCALENDAR' || chr(13) || chr(10) AS calendar FROM (SELECT venue_id, date_start, id, {VEVENT} AS text FROM ({JOINED}) WHERE venue_id IS NOT NULL) GROUP BY venue_id")
def _(t):
    """Every venue's calendar as a file, written and read back."""
    from ..operators.storage import scratch
    from ..sources.calendars import write_calendars

    path = scratch(t.spark, "calendars")
    write_calendars(S.with_venue(t.event, t.venue), path)
    back = t.spark.read.text(f"{path}/*.ics", wholetext=True)
    return back.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.ics$", 1).alias("venue"), C("value").alias("calendar"))


@query("S11_postcode_report", "SELECT postcode, count(*) AS n, array_to_string(list(name ORDER BY id), ';') AS names FROM venue WHERE postcode IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(t):
    rows = F.from_json("venues", "array<struct<id:long,name:string>>")
    return sinks.postcode_report(t.venue).select("postcode", "n", F.array_join(F.transform(rows, lambda x: x["name"]), ";").alias("names"))


@query("S11_manifest_report", f"{CAME}, f AS (SELECT * FROM m WHERE postcode IS NOT NULL OR latitude IS NOT NULL OR urls <> '') SELECT (SELECT count(*) FROM m) AS total_new_venues, (SELECT count(*) FROM f) AS total_with_context, (SELECT array_to_string(list(name ORDER BY n DESC, name), ';') FROM (SELECT * FROM f ORDER BY n DESC, name LIMIT 100)) AS names")
def _(t):
    e = S.with_venue(t.event, t.venue).where((C("date_start") >= t.today()) & C("venue_name").isNotNull() & ~F.lower("venue_name").isin(V.MANIFEST_SKIPS))
    every = e.select("venue_name").distinct().join(seeds(t).select(F.lower("name").alias("s_key")).distinct(), F.lower("venue_name") == C("s_key"), "left_anti")
    rows = F.from_json("venues", "array<struct<name:string>>")
    return sinks.manifest_report(manifest(t, None), every).select("total_new_venues", "total_with_context", F.array_join(F.transform(rows, lambda x: x["name"]), ";").alias("names"))


# -- streams ------------------------------------------------------------------------------------------------------


@query("R1_rolling_ingest", "SELECT name, date_start, min(batch_seq) AS first_seq, count(*) AS deliveries FROM (SELECT batch_seq, name, TRY_CAST(date_start AS DATE) AS date_start FROM extracted) WHERE date_start IS NOT NULL GROUP BY 1, 2")
def _(t):
    from ..streaming.ingest import rolling_ingest

    return rolling_ingest(t.extracted)


@query("R1_stream_upsert")
def _(t):
    """The whole ingest flow per batch, as its events stand at the end. Venues are made and matched batch by batch, which
    SQL can't tell; tests compare it with a plain version."""
    from ..streaming.ingest import stream_upsert

    return stream_upsert(t.extracted, t.venue, t.alias, t.postcode, files=4).events().select("id", "source_id", "name", "date_start", "venue_id", "event_type", "discipline", "tags", "venue_match_type")


@query("R2_run_log_alerts", f"WITH r AS (SELECT source_id, id, {FOUND} AS found, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS back FROM scan WHERE status = 'completed'), s AS (SELECT source_id, sum(CASE WHEN found > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY id DESC) AS hits FROM r WHERE back <= 20) SELECT source_id, count(CASE WHEN hits = 0 THEN 1 END) AS streak, count(CASE WHEN hits = 0 THEN 1 END) >= 3 AS alert FROM s GROUP BY source_id")
def _(t):
    from ..streaming.ingest import run_log

    return A.zero_streaks(run_log(t.scan))


@query(
    "R2_alert_stream",
    f"""WITH r AS (SELECT source_id, id, {FOUND} AS found, lag({FOUND}) OVER w AS before, max(CASE WHEN {FOUND} > 0 THEN n END) OVER w AS hit, n
      FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS n FROM scan WHERE status = 'completed') WINDOW w AS (PARTITION BY source_id ORDER BY id)),
    s AS (SELECT *, CAST(least(n - coalesce(hit, 0), 20) AS INT) AS streak FROM r)
    SELECT source_id, id, 'drop' AS alert, found, before, streak FROM s WHERE found < before * 0.5 UNION ALL SELECT source_id, id, 'zeros', found, before, streak FROM s WHERE streak >= 3""",
)
def _(t):
    """Alerts as they are told while runs arrive, in three deliveries by day."""
    from ..operators.storage import discard, scratch
    from ..streaming.alerts import start, watch

    landing, told, offsets = (scratch(t.spark, x) for x in ("runs", "alerts", "offsets"))
    for days in ("day <= 10", "day > 10 AND day <= 20", "day > 20"):
        t.scan.where(days).coalesce(1).write.mode("append").parquet(landing)
    runs = t.spark.readStream.schema(t.scan.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    start(t.spark, watch(runs), told, offsets).awaitTermination()
    discard(t.spark, landing, offsets)
    return t.spark.read.schema(ALERTS).parquet(told)
