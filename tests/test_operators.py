"""Operators at sizes and places that the driver's tables don't have: ranges, the whole globe, indexes, sketches."""

import random
from math import asin, cos, radians, sin, sqrt

import pytest
from meadowlark.functions import tags
from meadowlark.operators import audit, scans, search, textindex
from meadowlark.operators.storage import scratch
from meadowlark.operators.textindex import TextIndex
from meadowlark.plans.demo import Tables
from pyspark.sql import functions as F
from test_queries import plain_disciplines

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [10, 10_000])
def test_scans_of_one_hot_group(spark, rows):
    """One group holds nearly all rows: its ranges go to several tasks, and the rows are the same."""
    rng = random.Random(1)
    made = [(rng.choice([1, 1, 1, 1, 2, None]), k, rng.choice([None, None, rng.randrange(100)])) for k in rng.sample(range(10_000), 300)]
    df = spark.createDataFrame(made, "g long, k long, v long").repartition(5)
    last, before, fill = {}, {}, {}
    for g, k, v in sorted(made, key=lambda r: r[1]):
        before[k] = last.get((g, "v"))
        last[g, "v"] = v
        last[g, "f"] = fill[k] = v if v is not None else last.get((g, "f"))
    assert {r.k: r.before for r in scans.lagged(df, ["g"], ["k"], "v", "before", rows).collect()} == before
    assert {r.k: r.v for r in scans.filled(df, ["g"], ["k"], "v", rows).collect()} == fill
    order = sorted(made, key=lambda r: -r[1])
    got = scans.numbered(df.select("k"), [F.desc("k")], 100, rows)
    assert {r.k: r.number for r in got.collect()} == {r[1]: 101 + n for n, r in enumerate(order)}
    ranged, parts = scans.ranges(df, ["g", "k"], rows)
    assert parts == -(-300 // rows) and ranged.where("g = 1").select(scans.SEGMENT).distinct().count() >= min(parts, 15)
    assert scans.numbered(df.limit(0), ["k"], 0).count() == scans.filled(df.limit(0), ["g"], ["k"], "v").count() == 0


def miles(a, b, c, d):
    x = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
    return 2 * asin(min(1, sqrt(x))) * 3958.8


def globe(rng, n):
    """Places everywhere, many of them around the poles and the 180th meridian."""
    kinds = [lambda: (rng.uniform(-90, 90), rng.uniform(-180, 180)), lambda: (rng.choice([-1, 1]) * rng.uniform(88, 90), rng.uniform(-180, 180)), lambda: (rng.uniform(-2, 2), rng.choice([-1, 1]) * rng.uniform(179, 180)), lambda: (90.0, 0.0)]
    return [(k, *rng.choice(kinds)()) for k in range(n)]


def test_radius_join_of_people_at_few_points(spark, monkeypatch):
    """Each pair once, by many tasks, also where all stand at few points; ids that come twice stay twice."""
    monkeypatch.setattr(search, "PEOPLE", 50)
    people = spark.range(0, 1000, 1, 1).select("id", (F.lit(52.0) + F.col("id") % 2).cast("double").alias("latitude"), F.lit(-1.5).alias("longitude"))
    places = spark.range(0, 60, 1, 1).select((F.col("id") % 30).alias("id"), F.when(F.col("id") < 50, F.lit(52.1)).otherwise(F.lit(10.0)).alias("latitude"), F.lit(-1.5).alias("longitude"))
    got = search.near_each(people, places, 25.0).cache()
    zero = spark.createDataFrame([(1, -0.0, 0.0), (2, 0.0, -0.0)], "id long, latitude double, longitude double")
    assert search.near_each(zero, zero, 1.0).count() == 4
    assert got.count() == 500 * 50 and got.select("id").distinct().where("id % 2 = 0").count() == 500
    assert got.where("place_id < 20").count() == 500 * 40 and got.where("abs(distance - 6.9095) > 0.001").isEmpty()
    got.unpersist()
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", False)  # which would join partitions as small as these
    try:
        made = [r["count"] for r in search.near_each(people, places, 25.0).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(made) > 3 and max(made) < 0.5 * sum(made)


@pytest.mark.parametrize("radius", [5.0, 80.0, 3000.0])
def test_places_of_the_whole_globe(spark, radius):
    rng = random.Random(radius)
    people, places = globe(rng, 150), globe(rng, 150)
    schema = "id long, latitude double, longitude double"
    got = search.near_each(spark.createDataFrame([*people, (999, None, 1.0)], schema), spark.createDataFrame([*places, (999, 1.0, None)], schema), radius).collect()
    want = {(i, j) for i, a, b in people for j, c, d in places if miles(a, b, c, d) <= radius}
    assert len(got) == len(want) and {(r.id, r.place_id) for r in got} == want and len(want) > 20
    codes = spark.createDataFrame([(f"P{k:03d}", a, b) for k, a, b in places], "postcode string, latitude double, longitude double")
    km = radius / 0.621371
    near = {r.id: r.postcode for r in audit.nearest_postcode(spark.createDataFrame(people, schema), codes, (km / 10, km)).collect()}
    best = {i: min((miles(a, b, c, d) / 0.621371, f"P{j:03d}") for j, c, d in places) for i, a, b in people}
    assert near == {i: p for i, (d, p) in best.items() if d <= km}


def test_text_index(spark):
    rng = random.Random(2)
    texts = [(k, "".join(rng.choices("abcÄ %_.", k=rng.randint(0, 30)))) for k in range(400)] + [(500, None), (501, ""), (502, "ab"), (503, "x" * 50_000 + "needle")]
    index = TextIndex.build(spark.createDataFrame(texts, "id long, text string"), scratch(spark, "index"))
    for term in ("abc", "Aba", "ä %", "%_.", "ab", "a", "", "zzz", "xxneedle", "needle2", "abcabcabc", texts[7][1][:9], texts[9][1]):
        assert {r.id for r in index.find(term).collect()} == {k for k, x in texts if x is not None and term.lower() in x.lower()}, term
    plan = index.find("abcabc")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
    none = TextIndex.build(spark.createDataFrame([], "id long, text string"), scratch(spark, "index"))
    assert none.find("abc").count() == none.find("a").count() == 0


def test_merged_run_times(spark):
    """The sketch's quantile has the rank that is asked for, within the stated error, merged from many parts."""
    rng = random.Random(3)
    runs = [(1, k % 40, rng.expovariate(0.01)) for k in range(30_000)] + [(2, 1, 5.0), (2, 2, None), (3, 1, None)]
    df = spark.createDataFrame(runs, "source_id long, day int, seconds double")
    got = {r.source_id: r for r in audit.run_time_quantile(audit.run_time_sketches(df).where("day < 30"), 0.95, ["source_id"]).collect()}
    own = sorted(s for u, d, s in runs if u == 1 and d < 30)
    assert got[1].runs == len(own) and abs(sum(s <= got[1].seconds for s in own) / len(own) - 0.95) <= audit.RANK_ERROR
    assert got[2].runs == 1 and got[2].seconds == 5.0
    buckets = {(r.source_id, r.le): r.n for r in audit.run_time_buckets(df).collect()}
    assert buckets[1, float("inf")] == 30_000 and buckets[1, 60.0] == sum(s <= 60 for u, _, s in runs if u == 1) and buckets[3, float("inf")] == 0


def test_disciplines_lead_all_tags(spark):
    """T13: the assembled tags begin with the disciplines that a plain search for every alias finds."""
    t = Tables(spark, SF)
    events = search.with_venue(t.event, t.venue)
    every = tags.extract_tags(F.col("name"), F.col("description"), F.lit(None).cast("string"), F.col("event_type"), F.lit(None).cast("string"), tags.from_json_list(F.col("classes")), F.col("venue_name"))
    rows = events.select("name", tags.from_json_list(F.col("classes")).alias("listed"), "venue_name", every.alias("tags")).collect()
    assert len(rows) > 1000
    for r in rows:
        text = r.name.lower().replace("&", " and ")
        if r.venue_name:
            text = text.replace(r.venue_name.lower().replace("&", " and "), " ")
        found = {"discipline:" + d.lower().replace(" ", "-") for d in plain_disciplines(" | ".join([text, *(c.lower() for c in r.listed)]))}
        own = [x for x in r.tags if x.startswith("discipline:")]
        assert r.tags[: len(own)] == own and set(own) - {"discipline:eventers-challenge"} == found - {"discipline:eventers-challenge"}, r


def test_rewritten_disciplines(spark):
    df = spark.createDataFrame([(1, "show_jumping"), (2, "BD"), (3, "yoga"), (4, None), (5, "Dressage")], "canonical long, discipline string")
    got = audit.canonical_disciplines(df.withColumnRenamed("canonical", "id")).collect()
    assert {r.id: r.discipline for r in got} == {1: "Show Jumping", 2: "Dressage", 3: "yoga", 4: None, 5: "Dressage"}


def test_class_lists_after_headings(spark):
    texts = ["Fun.\nClasses: 60cm, 70cm / 80cm | Open\nfood, bar", "Heights - 1m", "classes: a,,b", "no list: x, y", None, "Heights:"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select(tags.classes_after_heading(F.col("x")).alias("c")).collect()
    assert [r.c for r in rows] == [["60cm", "70cm", "80cm", "Open"], ["1m"], ["a", "b"], [], None, []]


def test_trigrams_are_cut_by_many_tasks(spark, monkeypatch):
    """However few files the texts come in, a task cuts about CUT characters."""
    monkeypatch.setattr(textindex, "CUT", 2000)
    texts, grams = spark.range(0, 1000, 1, 1).select("id", F.concat(F.lit("text "), F.col("id") + 1000).alias("text")), textindex.trigrams
    place = F.spark_partition_id().cast("string")
    monkeypatch.setattr(textindex, "trigrams", lambda text: F.array(place))  # the task, in place of what it cuts
    index = TextIndex.build(texts, scratch(spark, "index"))
    counts = [r["n"] for r in index.counts().collect()]
    assert sum(counts) == 1000 and len(counts) > 3 and max(counts) < 500
    monkeypatch.setattr(textindex, "trigrams", grams)
    index = TextIndex.build(texts, scratch(spark, "index"))
    assert {r.id for r in index.find("XT 17").collect()} == set(range(700, 800)) and index.find("t 1005").count() == 1
