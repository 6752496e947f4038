"""Venue resolution, upsert, feeds and run log on small tables."""

import random

import pytest
from meadowlark.operators import audit, ingest, search
from meadowlark.operators.storage import scratch
from meadowlark.plans.demo import Tables
from meadowlark.sources import feeds, sinks
from meadowlark.streaming.ingest import Listings, stream_upsert
from pyspark.sql import functions as F

def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def venues(spark):
    return spark.createDataFrame([(1, "Hartpury", "GL19 3BE"), (2, "Bury Farm", "B94 6JD"), (3, "Chard", "TA20 1AA"), (4, "Other", "TA20 1AA"), (5, "Online", None)], "id long, name string, postcode string")


def test_resolution(spark):
    aliases = spark.createDataFrame([("Hartpury College", 1), ("Gone", 99)], "alias string, venue_id long")
    names = [("hartpury", None), ("HARTPURY COLLEGE", None), ("Tbc", "B94 6JD"), ("tbc", "TA20 1AA"), ("Zoom", None), ("Gone", None), ("Nowhere", "B94 6JD")]
    got = {r.venue_name: (r.venue_id, r.match_type, float(r.confidence)) for r in ingest.resolve_venues(spark.createDataFrame(names, "venue_name string, postcode string"), venues(spark), aliases).collect()}
    assert got == {"hartpury": (1, "exact", 1.0), "HARTPURY COLLEGE": (1, "alias", 1.0), "Tbc": (2, "postcode", 0.95), "tbc": (None, "new", 0.0), "Zoom": (5, "exact", 1.0), "Gone": (None, "new", 0.0), "Nowhere": (None, "new", 0.0)}


def test_new_venues_are_numbered_once(spark):
    rows = spark.createDataFrame([(5, "Alpha", None), (3, "beta", None), (9, "ALPHA", None), (1, "hartpury", None)], "batch_seq long, matched_name string, postcode string")
    assert sorted((r.id, r.name) for r in ingest.new_venues(rows, venues(spark)).collect()) == [(6, "beta"), (7, "Alpha")]


def listing(spark, rows):
    df = spark.createDataFrame(rows, "batch_seq long, source_id long, name string, date_start string, venue_id long, date_end string, url string, discipline string")
    text = {c: F.lit(None).cast("string") for c in ingest.REFRESHED if c not in ("discipline", "spectator", "hidden")}
    flags = {c: F.lit(False) for c in ("spectator", "hidden")}
    return df.withColumns({**text, **flags, "date_start": F.col("date_start").cast("date"), "date_end": F.col("date_end").cast("date")})


def test_upsert_rules(spark):
    empty = listing(spark, []).withColumns({"id": F.col("batch_seq"), "first_seen_at": now(), "last_seen_at": now()}).select(*ingest.EVENT_COLUMNS)
    batch = listing(spark, [
        (1, 1, "Show", "2026-05-01", 7, None, "u1", "A"), (2, 1, "Show", "2026-05-01", 7, "2026-05-02", None, "B"), (3, 2, "Show", "2026-05-01", 7, "2026-05-09", "u3", "C"), (4, 2, "Ride", "2026-05-01", None, None, None, None),
    ])
    first = ingest.upsert(empty, batch, now()).checkpoint()
    rows = {r.name: r for r in first.collect()}
    assert len(rows) == 2 and {r.id for r in rows.values()} == {1, 2}
    show = rows["Show"]
    assert (show.source_id, show.discipline, show.url, str(show.date_end)) == (1, "C", "u3", "2026-05-02")
    later = F.lit("2026-02-01 00:00:00").cast("timestamp")
    again = ingest.upsert(first, batch, later)
    assert again.drop("last_seen_at").exceptAll(first.drop("last_seen_at")).count() == 0 and again.count() == 2
    assert again.where(F.col("last_seen_at") == later).count() == 2


def test_run_log(spark):
    runs = [(1, 5), (2, 0), (3, 0), (4, 0)]
    log = spark.createDataFrame([(k, 1, "completed", n, 0) for k, n in runs] + [(9, 2, "completed", 50, 0), (10, 2, "completed", 0, 0)], "id long, source_id long, status string, competitions_found_comp long, competitions_found_training long")
    assert {r.source_id: (r.streak, r.alert) for r in audit.zero_streaks(log).collect()} == {1: (3, True), 2: (1, False)}
    assert {(r.source_id, r.id) for r in audit.run_drops(log).collect()} == {(1, 2), (2, 10)}


@pytest.mark.parametrize(("text", "names"), [('Sure: [{"name":"A","date_start":"2026-01-01","venue_name":"V"}] ok', ["A"]), ('[{"name":"A","date_start":"2026-01-01","venue_name":"V"},{"name":"B","da', ["A"]), ("no array", []), ('[{"name":"A"}]', []), (None, [])])
def test_replies(spark, text, names):
    df = spark.createDataFrame([(1, text)], "id long, body string")
    assert [r.name for r in feeds.reply_rows(df).collect()] == names


def test_feeds(spark):
    html = "<table><tr><td>28 - 29 Mar 26</td><td><a>Show &</a></td><td>90, 100</td><td>Bury Farm</td><td></td><td></td><td></td></tr><tr><td>1 May 26</td><td>Off</td><td></td><td>X</td><td></td><td></td><td>X</td></tr><tr><td>2 May 26</td><td>BS</td><td>Kent</td><td>link</td></tr></table>"
    rows = feeds.FEEDS["html_table"](spark.createDataFrame([(1, html)], "source_id long, body string")).collect()
    assert [(r.name, str(r.date_start), str(r.date_end), r.classes) for r in rows] == [("Show &", "2026-03-28", "2026-03-29", ["90", "100"]), ("BS - Kent", "2026-05-02", "None", None)]
    gbr = '[{"id":1,"name":"A","start_on":"2026-01-02","end_on":"2026-01-02","venue_country":"GBR"},{"id":2,"name":"B","start_on":"2026-01-02","venue_country":"FRA"}]'
    assert [(r.batch_seq, r.date_end) for r in feeds.FEEDS["meetings_api"](spark.createDataFrame([(1, gbr)], "source_id long, body string")).collect()] == [(1, None)]
    search = '{"totalRows":2,"rows":[{"id":7,"name":"A","start":"2026-01-02 09:00:00","end":"2026-01-03 09:00:00","venue_name":"V","publicUrl":"u"},{"id":7,"name":"A","start":"2026-01-02 09:00:00"}]}'
    assert [(r.batch_seq, r.name, str(r.date_start)) for r in feeds.FEEDS["search_api"](spark.createDataFrame([(1, search)], "source_id long, body string")).collect()] == [(7, "A", "2026-01-02")]
    tour = '{"payload":{"show_ids":[{"virtual_week_code":"W1","description":"CSI2*","start_at":"2026-02-03T00:00","end_at":"2026-02-08T00:00"}]}}'
    assert [(r.name, str(r.date_end)) for r in feeds.FEEDS["tour_api"](spark.createDataFrame([(1, tour)], "source_id long, body string")).collect()] == [("W1 CSI2*", "2026-02-08")]


def test_calendar_text(spark):
    df = spark.createDataFrame([(1, "Show, big", "2026-03-15", None, "Farm, Kent", "Dressage", "https://x")], "id long, name string, date_start string, date_end string, venue_name string, discipline string, url string")
    df = df.withColumns({"date_start": F.col("date_start").cast("date"), "date_end": F.col("date_end").cast("date")})
    text = sinks.ical_export(df).first().calendar
    assert "DTSTART;VALUE=DATE:20260315\r\nDTEND;VALUE=DATE:20260316" in text and "LOCATION:Farm\\, Kent" in text and "Dressage\\\\nhttps" in text and text.endswith("END:VCALENDAR\r\n")


def test_page_is_clamped(spark):
    df = spark.range(120)
    got = search.page(df, [F.col("id")], 9).collect()
    assert len(got) == 20 and got[0].page == 3 and got[0].total == 120
    assert search.page(df.limit(0), [F.col("id")], 1).count() == 0


def test_upsert_against_plain_version(spark):
    """Random batches: targets by key and source, last and first values, null venues as a venue of their own."""
    rng = random.Random(3)

    def some(n, start):
        return [(start + k, rng.randrange(3), rng.choice("AB"), rng.choice(["2026-05-01", "2026-05-02"]), rng.choice([None, 1, 2]), rng.choice([None, "2026-06-01", "2026-06-02"]), rng.choice([None, f"u{k}"]), rng.choice("xyz")) for k in range(n)]

    first, second = some(14, 0), some(30, 100)
    stored = [(k + 1, *r[1:]) for k, r in enumerate(first)]  # several rows of one key, also of one source
    table = listing(spark, [(r[0], *r[1:]) for r in stored]).withColumns({"id": F.col("batch_seq"), "first_seen_at": now(), "last_seen_at": now()}).select(*ingest.EVENT_COLUMNS)
    got = {(r.id, r.source_id, r.name, str(r.date_start), r.venue_id, str(r.date_end), r.url, r.discipline) for r in ingest.upsert(table, listing(spark, second), now()).collect()}
    state, fresh = {r[0]: list(r) for r in stored}, {}
    ended = {r[0]: r[5] is not None for r in stored}
    for r in sorted(second, key=lambda r: (r[1], r[0])):
        key = (r[2], r[3], r[4])
        same = [i for i, x in state.items() if (x[2], x[3], x[4]) == key]
        target = min(same, key=lambda i: (state[i][1] != r[1], i)) if same else None
        row = state[target] if same else fresh.setdefault(key, [None, r[1], *key, None, None, None, r[0]])
        if row[5] is None:
            row[5] = r[5]
        row[6], row[7] = r[6] or row[6], r[7]
        if not same:
            row[8] = min(row[8], r[0])
    made = sorted(fresh.values(), key=lambda x: (x[1], x[8]))
    want = {tuple(str(v) if k == 5 else v for k, v in enumerate(x)) for x in state.values()} | {tuple(str(v) if k == 5 else v for k, v in enumerate([len(stored) + 1 + n, *x[1:8]])) for n, x in enumerate(made)}
    assert got == want and ended


def extract(spark, rows):
    """batch_seq, source_id, name, date, venue, postcode."""
    df = spark.createDataFrame(rows, "batch_seq long, source_id long, name string, date_start string, venue_name string, venue_postcode string")
    return df.withColumns({"date_end": F.lit(None).cast("string"), "discipline": F.lit("sj"), "event_type": F.lit(None).cast("string"), "classes": F.lit('["NSEA Qualifier"]'), "url": F.lit("https://x"), "description": F.lit("All levels")})


def tables(spark, venues_df):
    aliases = spark.createDataFrame([("Hartpury College", 1)], "alias string, venue_id long")
    postcodes = spark.createDataFrame([("SW1A 1AA", 51.5, -0.13)], "postcode string, latitude double, longitude double")
    return Listings(spark, scratch(spark, "listings"), venues_df, aliases, postcodes)


def test_ingest_makes_venues(spark):
    """Unknown venues are made, with coordinates, and kept apart; a second try and a second delivery change nothing but
    last_seen_at; counters tell what a run did."""
    t = tables(spark, venues(spark))
    rows = [
        (1, 1, "Summer Show", "2026-07-15", "Test Arena", "SW1A 1AA"), (2, 1, "Summer Show", "2026-07-15", "Other Place", None), (3, 2, "Summer Show", "2026-07-15", "TEST ARENA", None),
        (4, 2, "Clinic", "2026-08-01", "Hartpury College", None), (5, 2, "Ride", "2026-08-01", "Tbc", "B94 6JD"), (6, 2, "Ride", "2026-08-02", "Tbc", None), (7, 2, "Ride", "soon", "Chard", None), (8, 3, "Webinar", "2026-08-02", "Zoom", None),
    ]
    early, late = (F.lit(f"2026-01-0{k} 00:00:00").cast("timestamp") for k in (1, 2))
    t.merge(extract(spark, rows), 0, early)
    made = {r.name: r for r in t.venues().where("source = 'dynamic'").collect()}
    assert set(made) == {"Test Arena", "Other Place"} and (made["Test Arena"].latitude, made["Test Arena"].longitude) == (51.5, -0.13) and made["Other Place"].latitude is None
    got = t.events().checkpoint()
    assert sorted((r.name, str(r.date_start), r.venue_id, r.venue_match_type) for r in got.collect()) == sorted([
        ("Summer Show", "2026-07-15", made["Test Arena"].id, "new"), ("Summer Show", "2026-07-15", made["Other Place"].id, "new"), ("Clinic", "2026-08-01", 1, "alias"), ("Ride", "2026-08-01", 2, "postcode"), ("Webinar", "2026-08-02", 5, "exact"),
    ])
    assert got.where("NOT array_contains(from_json(tags, 'array<string>'), 'affiliation:nsea')").isEmpty() and got.select("id").distinct().count() == 5
    runs = {r.source_id: r for r in t.runs().collect()}
    assert (runs[1].competitions, runs[1].new, runs[1].inserted) == (2, 2, 1) and (runs[2].others, runs[2].alias, runs[2].postcode) == (1, 1, 1)
    for number in (0, 1):  # the same batch once more after a failure, and the same rows delivered again
        t.merge(extract(spark, rows), number, late)
        again = t.events()
        assert again.drop("last_seen_at", "venue_match_type").exceptAll(got.drop("last_seen_at", "venue_match_type")).isEmpty() and again.count() == 5
        assert again.where(F.col("last_seen_at") == late).count() == 5
    assert t.venues().count() == 7 and {r.venue_match_type for r in t.events().where("name = 'Summer Show'").collect()} == {"exact"}


def test_stream_of_all_rows(spark):
    """No event without a venue, ids once each, and as many events as different keys, over the whole table."""
    t = Tables(spark, "/root/testdata/sf0.001")
    out = stream_upsert(t.extracted, t.venue, t.alias, t.postcode, files=2)
    got = out.events().checkpoint()
    assert got.where("venue_id IS NULL").isEmpty() and got.select("id").distinct().count() == got.count() == got.select("name", "date_start", "venue_id").distinct().count()
    prepared = ingest.prepare(t.extracted)
    assert got.select("name", "date_start").distinct().exceptAll(prepared.select("name", "date_start").distinct()).isEmpty()
    assert got.select("name", "date_start").distinct().count() == prepared.select("name", "date_start").distinct().count() > 1000
    assert got.join(out.venues().select(F.col("id").alias("venue_id")), "venue_id", "left_anti").isEmpty()
    assert out.runs().agg(F.sum(F.expr("competitions + others"))).first()[0] == prepared.count()
