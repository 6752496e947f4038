"""Alerts from keyed state, rolling state by parts, and batches that run again."""

import glob
import os

from meadowlark.operators import audit
from meadowlark.operators.storage import scratch
from meadowlark.plans.demo import Tables
from meadowlark.streaming import alerts
from meadowlark.streaming.ingest import Listings, Rolling
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
RUN = "id long, source_id long, status string, competitions_found_comp long, competitions_found_training long, finished_at timestamp"


def runs(spark, rows, path):
    """rows: id, source, found or None for a failed run, hour."""
    made = [(i, s, "failed" if n is None else "completed", n, None) for i, s, n, _ in rows]
    df = spark.createDataFrame(made, RUN.rsplit(",", 1)[0]).withColumn("hour", F.element_at(F.create_map(*[F.lit(x) for r in rows for x in (r[0], r[3])]), F.col("id")))
    df.withColumn("finished_at", F.timestamp_seconds(F.col("hour") * 3600)).drop("hour").coalesce(1).write.mode("append").parquet(path)


def told(spark, landing, path, offsets, **kinds):
    stream = spark.readStream.schema(RUN).option("maxFilesPerTrigger", 1).parquet(landing)
    alerts.start(spark, alerts.watch(stream, **kinds), path, offsets).awaitTermination()
    return sorted((r.source_id, r.id, r.alert, r.found, r.before, r.streak) for r in spark.read.schema(alerts.ALERTS).parquet(path).collect())


def test_alerts_go_on_after_a_restart(spark):
    landing, path, offsets = (scratch(spark, x) for x in ("runs", "alerts", "offsets"))
    before = spark.conf.get(alerts.STORE[0])
    first = [(1, 1, 5, 0), (2, 1, 0, 1), (3, 1, None, 2), (4, 2, 50, 0)]
    runs(spark, first, landing)
    assert told(spark, landing, path, offsets) == [(1, 2, "drop", 0, 5, 1)]
    runs(spark, [(5, 1, 0, 3), (6, 2, 20, 3)], landing)
    runs(spark, [(7, 1, 0, 4), (2, 1, 0, 1), (8, 3, 0, 0)], landing)  # run 2 once more
    want = [(1, 2, "drop", 0, 5, 1), (1, 7, "zeros", 0, 0, 3), (2, 6, "drop", 20, 50, 0)]
    assert told(spark, landing, path, offsets) == want
    log = spark.read.schema(RUN).parquet(landing).dropDuplicates(["id"]).na.fill(0)
    assert {(r.source_id, r.id) for r in audit.run_drops(log).collect()} == {x[:2] for x in want if x[2] == "drop"}
    assert {r.source_id for r in audit.zero_streaks(log).where("alert").collect()} == {x[0] for x in want if x[2] == "zeros"}
    assert spark.conf.get(alerts.STORE[0]) == before


def test_late_runs_and_long_streaks(spark):
    landing, path, offsets = (scratch(spark, x) for x in ("runs", "alerts", "offsets"))
    runs(spark, [(10, 1, 0, 0), (30, 1, 0, 0), *[(k, 2, 0, 0) for k in range(100, 130)]], landing)
    runs(spark, [(20, 1, 0, 0), (5, 1, 9, 0), (99, 2, 7, 0)], landing)  # 20 takes its place; 99 is too old to be placed
    got = told(spark, landing, path, offsets)
    assert [x for x in got if x[0] == 1] == []
    assert {x[1]: x[5] for x in got if x[0] == 2} == {k: min(k - 99, 20) for k in range(102, 130)}


def test_overdue_sources(spark):
    landing, path, offsets = (scratch(spark, x) for x in ("runs", "alerts", "offsets"))
    for hour in (0, 20, 60, 100):  # source 1 runs all the time, source 2 only until hour 20
        runs(spark, [(1000 + hour, 1, 5, hour)] + ([(2000 + hour, 2, 5, hour)] if hour <= 20 else []), landing)
    got = told(spark, landing, path, offsets, due_hours=24, late="1 hour")
    assert got == [(2, 2020, "overdue", 5, None, None)]


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/batch=*/*.parquet")}


def test_a_batch_writes_what_it_changes(spark):
    path = scratch(spark, "state")
    state = Rolling(spark, path, ["k"], "k string, n long")
    state.log(spark.range(100).select(F.col("id").cast("string").alias("k"), F.col("id").alias("n")), 0)
    first = files(path)
    state.log(spark.createDataFrame([("7", 700)], "k string, n long").coalesce(1), 1)
    new = [f for f in files(path) if f not in first]
    assert all(files(path)[f] == t for f, t in first.items()) and spark.read.parquet(*new).count() == 1
    for n in (5, 6):  # a batch that runs again
        state.log(spark.createDataFrame([("7", 700), ("new", 1), (None, n)], "k string, n long"), 2)
    state.log(spark.createDataFrame([], "k string, n long"), 3)
    want = {**{str(k): k for k in range(100)}, "7": 700, "new": 1, None: 6}
    for now in (state, state.compacted(scratch(spark, "state"))):
        assert {r.k: r.n for r in now.read().collect()} == want and now.read().count() == 102
    assert state.compacted(scratch(spark, "state")).read().columns == ["k", "n"]


def test_counters_of_a_batch_that_runs_again(spark):
    """What a batch inserted is what no batch before it had, however often it runs; ids stay."""
    t = Tables(spark, SF)
    out = Listings(spark, scratch(spark, "listings"), t.venue, t.alias, t.postcode)
    deliveries = [t.extracted.where(f"batch_seq % 2 = {k}") for k in range(2)]
    seen, want = set(), {}
    for number, batch in enumerate(deliveries):
        from meadowlark.operators.ingest import prepare

        keys = {(r.source_id, r.name, r.date_start) for r in prepare(batch).select("source_id", "name", "date_start").distinct().collect()}
        for source in {k[0] for k in keys}:
            want[number, source] = sum(k[1:] not in seen for k in keys if k[0] == source)
        seen |= {k[1:] for k in keys}
        out.merge(batch, number)
        ids = {(r.name, r.date_start, r.venue_id): r.id for r in out.events().collect()}
        out.merge(batch, number)
        assert {(r.name, r.date_start, r.venue_id): r.id for r in out.events().collect()} == ids
    got = {(r.batch, r.source_id): r.inserted for r in out.runs().collect()}
    assert got == want and sum(got.values()) > 1000
    assert out.events().select("id").distinct().count() == out.events().count() == out.read("marks").agg(F.max("largest")).first()[0]


def test_streams_leave_no_landing_places(spark):
    from meadowlark.streaming.ingest import rolling_ingest, run_log

    base = os.path.dirname(scratch(spark, "x")).removeprefix("file:")
    before = set(os.listdir(base))
    t = Tables(spark, SF)
    assert rolling_ingest(t.extracted, 2).count() and run_log(t.scan, 2).count()
    assert {x.split("-")[0] for x in set(os.listdir(base)) - before} <= {"state", "log"}


def test_rows_of_known_venues_are_not_dealt_to_one_task(spark):
    from meadowlark.operators.ingest import with_new_venues

    before, adaptive = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        rows = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("venue_id"), F.concat(F.lit("At "), F.col("id") % 7).alias("matched_name"))
        made = spark.createDataFrame([(9000 + k, f"At {k}") for k in range(6)], "id long, name string")
        got = with_new_venues(rows, made)
        dealt = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(dealt) == 4000 and max(dealt) < 2000
        assert got.where("venue_id >= 9000").count() == got.where("venue_id >= 9000 AND venue_id = 9000 + int(right(matched_name, 1))").count() > 300
        assert got.where("venue_id IS NULL").select("matched_name").distinct().collect() == [("At 6",)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_deliveries_are_whole_sources_in_many_files(spark, monkeypatch):
    """Each delivery is one batch, whatever its files: no source's rows are counted in two."""
    from meadowlark.streaming import ingest

    monkeypatch.setattr(ingest, "LANDED", 100)
    sizes, landed = [], ingest.landed

    def told(rows, *more):
        sizes.append((rows.count(), landed(rows, *more)))
        return sizes[-1][1]

    monkeypatch.setattr(ingest, "landed", told)
    t = Tables(spark, SF)
    out = ingest.stream_upsert(t.extracted, t.venue, t.alias, t.postcode, files=2)
    assert len(sizes) == 2 and sum(n for n, _ in sizes) == t.extracted.count() and all(f >= n / 100 > 1 for n, f in sizes)
    assert out.runs().groupBy("source_id").count().where("count > 1").isEmpty() and out.runs().select("batch").distinct().count() == 2


def test_rolling_ingest_lands_in_many_files(spark, monkeypatch):
    """However many rows, a file holds about LANDED of them, and the batches stay as many as asked for."""
    from meadowlark.streaming import ingest

    kept = []
    monkeypatch.setattr(ingest, "LANDED", 200)
    monkeypatch.setattr(ingest, "discard", lambda spark, *paths: kept.extend(paths))
    t = Tables(spark, SF)
    got = ingest.rolling_ingest(t.extracted, 2)
    landing, offsets = (x.removeprefix("file:") for x in kept)
    assert len(glob.glob(f"{landing}/*.parquet")) >= t.extracted.count() / 200 > 4
    assert len([x for x in os.listdir(f"{offsets}/offsets") if x.isdigit()]) <= 2
    assert got.agg(F.sum("deliveries")).first()[0] == ingest.gate(t.extracted).count()


def test_feed_stream_lands_in_many_files(spark, monkeypatch):
    """Payload files follow the number of pages; a batch takes several of them."""
    from meadowlark.plans import QUERIES, table_queries
    from meadowlark.sources import feeds

    asked, read = [], feeds.read
    monkeypatch.setattr(table_queries, "PAGES", 100)
    monkeypatch.setattr(feeds, "read", lambda *a, **k: asked.append(k["files"]) or read(*a, **k))
    got = QUERIES["S2_feed_stream"](spark, SF)
    assert asked[0] > 1 and got.count() == Tables(spark, SF).event.where("id % 5 <> 0").count()


def test_a_batch_leaves_the_files_of_earlier_ones(spark, monkeypatch):
    """Events that came before stay where they are; what a later batch changes is stored beside them. A listing is
    classified once, however many rows have it."""
    from meadowlark.operators import ingest as I

    seen, classified = [], I.classified

    def told(listings):
        seen.append(listings.count())
        return classified(listings)

    monkeypatch.setattr(I, "classified", told)
    t = Tables(spark, SF)
    base = scratch(spark, "listings")
    out = Listings(spark, base, t.venue, t.alias, t.postcode)
    rows = t.extracted.where("batch_seq < 300")
    deliveries = [rows, rows.where("batch_seq % 2 = 0").withColumn("url", F.lit("https://new")).unionByName(rows.withColumns({"batch_seq": F.col("batch_seq") + 1000, "date_start": F.lit("2001-01-01")}))]
    out.merge(deliveries[0], 0)
    place = base.removeprefix("file:")
    first = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{place}/events/*/*/*.parquet")}
    before = {r.id: r for r in out.events().collect()}
    out.merge(deliveries[1], 1)
    assert all(os.stat(f).st_mtime_ns == n for f, n in first.items()) and first
    got = {r.id: r for r in out.events().collect()}
    assert len(got) == out.events().count() == len({(r.name, r.date_start, r.venue_id) for r in got.values()}) > len(before)
    prepared = I.prepare(rows)
    hit = {(r.name, r.date_start) for r in prepared.where("batch_seq % 2 = 0").collect()}
    assert {i for i in before if got[i].url == "https://new"} == {i for i, r in got.items() if (r.name, r.date_start) in hit and i in before} != set()
    for i, r in before.items():
        same = [c for c in r.asDict() if c not in ("url", "last_seen_at", "venue_match_type", "date_end")]
        assert got[i].url == "https://new" or got[i] == r
        assert (got[i].last_seen_at > r.last_seen_at) == (got[i].url == "https://new") and [got[i][c] for c in same] == [r[c] for c in same]
    assert len(seen) == 2 and seen[0] <= prepared.count() and seen[1] <= rows.count() < I.prepare(deliveries[1]).count()


def test_classified_once_as_row_by_row(spark):
    """A title that holds its venue's name is read without it, whoever else has the title; other venues share a listing."""
    from meadowlark.operators import ingest as I

    names = [("Polo at Polo Farm", "Polo Farm"), ("Polo at Polo Farm", "Chard"), ("Polo at Polo Farm", "Onley"), ("Showing & Polo", "Polo Farm"), ("Élan Dressage", "ÉLAN DRESSAGE"), (None, "Chard"), ("Dressage & Polo Park Cup", "dressage & polo park")]
    rows = spark.createDataFrame(names, "name string, venue_name string").withColumns({c: F.lit(None).cast("string") for c in ("description", "classes", "discipline", "event_type")})
    listings = rows.select("*", I.listing(rows).alias("listing"))
    once = I.classified(listings.select("listing").distinct().select("listing", "listing.*")).select("listing", "tags", "discipline", "event_type", "spectator")
    each = I.classified(listings.withColumn("feed_affiliation", F.lit(None).cast("string")))
    want = {(r.name, r.venue_name): (r.tags, r.discipline, r.event_type, r.spectator) for r in each.collect()}
    got = {(r.name, r.venue_name): (r.tags, r.discipline, r.event_type, r.spectator) for r in listings.select("name", "venue_name", "listing").join(once, "listing").collect()}
    assert got == want and len(got) == len(names) and once.count() == len(names) - 1


def test_short_methods_are_put_back(spark):
    """Within the ingest plans become methods that the JVM compiles; the session's own setting comes back, also after an
    error, and a lower one stays."""
    from meadowlark.operators.storage import METHOD, short_methods

    before = spark.conf.get(METHOD[0])
    try:
        for own, want in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(METHOD[0], own)
            try:
                with short_methods(spark):
                    assert spark.conf.get(METHOD[0]) == want
                    raise ValueError
            except ValueError:
                assert spark.conf.get(METHOD[0]) == own
    finally:
        spark.conf.set(METHOD[0], before)
