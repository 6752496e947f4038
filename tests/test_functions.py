"""Examples of the column functions: text in, value out."""

import pytest
from meadowlark.functions import classify, dates, geo, rules, tags, text
from pyspark.sql import functions as F


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [r.v for r in df.select("k", f(F.col("x")).alias("v")).orderBy("k").collect()]


def test_venue_names(spark):
    cases = {
        "ELAND LODGE EQUESTRIAN CENTRE LTD": "Eland Lodge", "Kings Sedgemoor EC": "Kings Sedgemoor", "Vale View E C": "Vale View", "Onley Grounds ECC": "Onley Grounds", "Arena UK (2) - SPONSORED BY X": "Arena Uk",
        "Lodge Farm TN12 7ET": "Lodge Farm", "CF71 7RQ": "Tbc", "Aston-le-Walls (Festival)": "Aston-Le-Walls", "o'brien yard": "O'Brien Yard", "Rectory Farm (gl7)": "Rectory Farm (GL7)", "": "Tbc", "Online training": "Online",
        "Ardenrun Showground, Tandridge Lane, Lingfield": "Ardenrun Showground", "Higher Farm, Cheshire": "Higher Farm, Cheshire", "https://x.example": "Tbc", "Berkshire College Of Agriculture Limited": "Berkshire College Of Agriculture", "Chard - Vwh": "Chard", "Equestrian Centre": "Equestrian Centre", "x": "Tbc",
    }
    assert values(spark, text.normalise_venue_name, cases) == list(cases.values())


def test_postcodes(spark):
    cases = {"b946jd": "B94 6JD", "SW1A 1AA.": "SW1A 1AA", " m1  1ae ": "M1 1AE", "nowhere": None, "": None, None: None}
    assert values(spark, text.normalise_postcode, cases) == list(cases.values())
    assert values(spark, text.extract_postcode, ["At GL7 7JW, near B1 1AA", "none"]) == ["GL7 7JW", None]


def test_disciplines(spark):
    cases = {"show_jumping": "Show Jumping", "BD": "Dressage", "Showing, Other": "Showing", "yoga / Hunter Trial": "Hunter Trial", "": None, None: None, "eventers challenge": "Eventers Challenge"}
    assert values(spark, text.normalise_discipline, cases) == list(cases.values())
    names = {"Arena Eventing at Hickstead": "Arena Eventing", "Dressage Training": "Dressage", "Quiz": None, "One Day Event": "Eventing"}
    assert values(spark, classify.discipline_of, names) == list(names.values())


def test_event_types(spark):
    cases = {
        "Staffordshire Show Jumping": "competition", "Arena Hire": "venue_hire", "Dressage Clinics": "training", "Combined Training": "competition", "Arena Eventing Training": "competition", "Rallies": "training",
        "Efficiency Tests": "training", "Stabling": "venue_hire", "Dressage Test": "competition", "B+ test day": "training",
    }
    assert values(spark, classify.event_type, cases) == list(cases.values())


def test_watchable_hidden_continental(spark):
    watch = {"CSI4* Tour": True, "CHIO Aachen": True, "Anchiote Show": False, "County Show": True, "Grassroots league": False}
    assert values(spark, lambda x: classify.spectator(x, F.lit("competition")), watch) == list(watch.values())
    hidden = {"Summer Camp - DEPOSIT": True, "Final instalment": True, "1st payment": True, "Payment Plan Available": False, "£20 Deposit Secures Your Place": False, "6 payments": True, "The Next Instalment - Series": False}
    assert values(spark, classify.is_booking_payment, hidden) == list(hidden.values())
    kinds = {"CSI 3*/1*/YH": "competition", "CSI4* Grand Prix": "show", "Global Champions": "show", "Dressage clinic 3*": "training", "National": "competition"}
    assert values(spark, classify.continental_type, kinds) == list(kinds.values())


@pytest.mark.parametrize(
    ("raw", "start", "end"),
    [("28 - 29 Mar 26", "2026-03-28", "2026-03-29"), ("30 October - 1 November 2026", "2026-10-30", "2026-11-01"), ("30 Dec - 2 Jan 2027", "2026-12-30", "2027-01-02"), ("4th & 5th May 2026", "2026-05-04", "2026-05-05"), ("7 June 2026", "2026-06-07", None), ("soon", None, None), ("31 Feb 2026", None, None)],
)
def test_ranges(spark, raw, start, end):
    a, b = (F.col("x").alias("a"), F.col("x").alias("b"))
    a, b = dates.date_range(F.col("x"))
    r = spark.createDataFrame([(raw,)], "x string").select(a.cast("string").alias("a"), b.cast("string").alias("b")).first()
    assert (r.a, r.b) == (start, end)


def test_scans_of_titles():
    scan = tags.scan_disciplines
    assert scan("DR, Combined Training and SJ Qualifiers", [], None, None, None) == ["discipline:combined-training", "discipline:show-jumping", "discipline:dressage"]
    assert scan("Arena Eventing", [], None, None, None) == ["discipline:arena-eventing"]
    assert scan("Show Jumping - Dallas Polo Club", [], None, "Dallas Polo Club", None) == ["discipline:show-jumping"]
    assert scan("EC Qualifiers @ Greenlands", [], None, None, "nsea") == ["discipline:eventers-challenge"]
    assert scan("NSEA @ Bury Farm EC", [], "Dressage", None, None) == ["discipline:dressage"]
    assert scan("Lambs BD Sale", [], None, None, None) == [] and scan("Triathlon", ["Class 1 xc"], None, None, None) == ["discipline:cross-country"]


def test_rule_tags(spark):
    def of(f):
        return lambda x: F.array_join(f(classify.normalised(x)), ";")

    assert values(spark, lambda x: tags.level_tag(classify.normalised(x)), ["Advanced booking", "Advanced class", "Novices", "Area Championships"]) == [None, "level:advanced", "level:novice", "level:championship"]
    assert values(spark, of(tags.age_tags), ["Senior Citizens", "Seniors & U21", "Adults"]) == ["", "age:senior;age:junior", "age:adult"]
    assert values(spark, of(tags.series_tags), ["Sunshine Tour Qualifier", "Sunshine Tour", "CSI Sunshine Tour qualifier", "Cricklands at South View", "BS Club show"]) == ["series:sunshine-tour-uk", "", "", "", "series:bs-club"]
    assert values(spark, lambda x: tags.scope_tag(classify.normalised(x)), ["National Trust ride", "International show", "National Finals"]) == [None, "scope:international", "scope:national"]
    assert values(spark, lambda x: F.array_join(tags.class_tags(F.split(x, ";")), " "), ["Pony Newcomers 1.30m", "Senior Foxhunter;90cm", "Children on Horses 1.10m", "1.65m Open"]) == [
        "class:pony-newcomers audience:pony height:100", "class:foxhunter audience:senior height:120 height:90", "class:children-on-horses audience:junior height:110", "height:140",
    ]
    none = F.array().cast("array<string>")
    assert values(spark, lambda x: tags.final_tag(classify.normalised(x), none).isNotNull(), ["National Championship Finals", "National Championship Qualifier", "International Championships", "NSEA EC Champs"]) == [True, False, False, True]
    assert values(spark, tags.display_name, ["discipline:show-jumping", "affiliation:endurance-gb", "plain"]) == ["Show Jumping", "Endurance GB", "plain"]


def test_tags_hold_the_vocabulary(spark):
    df = spark.createDataFrame([("County Show CSI3* juniors", "Qualifier", None, "show", "bsps", ["Discovery"], None)], "n string, d string, p string, k string, s string, c array<string>, v string")
    got = df.select(tags.extract_tags(*[F.col(c) for c in ("n", "d", "p", "k", "s", "c", "v")]).alias("t")).first().t
    known = {f"{n}:{v}" for n, vs in rules.VOCABULARY.items() for v in vs}
    assert set(got) <= known and sum(t.startswith("type:") for t in got) == 1 and "tier:elite" in got and "affiliation:bsps" in got


def test_distance(spark):
    cases = [(51.5074, -0.1278, 53.4808, -2.2426), (51.5, -0.1, 51.5, -0.1), (51.5074, -0.1278, 52.4862, -1.8904)]
    df = spark.createDataFrame(cases, "a double, b double, c double, d double")
    got = [r.m for r in df.select(geo.haversine_miles(*[F.col(c) for c in "abcd"]).alias("m")).collect()]
    assert 160 < got[0] < 170 and got[1] < 0.01 and 95 < got[2] < 110


def test_ledger_of_rules(spark):
    """What must match and what must not, value by value."""
    hidden = {
        "Balance due - Camp": True, "Camp deposit": True, "Booking Deposit": True, "Show (deposit)": True, "Deposits": True, "3rd Payment": True, "final  installment": True, "PAYT": True, "Deposit Secures": False, "No payments taken": False,
        "Semi final payment holiday": True, "Depositary show": False, "Summer - depository": False, "Installments welcome": False,
    }
    assert values(spark, classify.is_booking_payment, hidden) == list(hidden.values())
    kinds = {
        "CDIO Aachen": "show", "CSI 2 *": "competition", "CSI 5 * Paris": "show", "Nation Cup final": "show", "Nations  Cup": "show", "J / P tour": "competition", "Jonge Paard dag": "competition", "Junioren Cup 4*": "competition",
        "U25 Championship": "competition", "European Championship": "show", "Talents 3*": "competition", "YH Final 3*": "competition", "YHX 3*": "show", "Global Champions Tour": "show", "CSI": "competition", "1* and 5*": "competition",
    }
    assert values(spark, classify.continental_type, kinds) == list(kinds.values())
    watch = {"Village Show": True, "Ploughing  match": True, "7 * test": True, "CCI2": False, "CCI Blenheim": True, "Csio": True, "Counties show": False, "World Cup": True, None: False}
    assert values(spark, lambda x: classify.spectator(x, F.lit(None).cast("string")), watch) == list(watch.values())
    tiers = {"Chio day": "tier:elite", "Tour 4 *": "tier:elite", "County Fair": "tier:county-show", "HOYS qualifier": "tier:national", "Unaff show": "tier:unaffiliated", "Show": None}
    none = F.array().cast("array<string>")
    assert values(spark, lambda x: tags.tier_tag(classify.normalised(x), none), tiers) == list(tiers.values())


def test_places_in_titles(spark):
    cases = {"Hickstead - Derby": "Hickstead", "Bury Farm : Show : two": "Bury Farm", "Onley | Show (1)": "Onley", "Hartpury British Dressage": "Hartpury", "Arena UK Sat 4 May": "Arena UK", "Vale View 12th Mar": "Vale View", "Min - x": "Tbc", "Saturday": "Tbc", "Solihull Riding Club": "Tbc"}
    assert values(spark, text.venue_of_title, cases) == list(cases.values())
    junk = {"Booking Status: open": True, "book now!": True, "12 Mill Lane": True, "Lane End": False, "4 Acre Farm": False, None: False}
    assert values(spark, text.is_junk_venue, junk) == list(junk.values())
    stems = {"ASTON (2)": "Aston-le-Walls", "Barbury International 2026": "Barbury", "Grassroots Championship": "There", "Burnham Market - by X": "Burnham Market", "Tweseldown & Regional BE90 Championship": "There", "Rockingham incorporating Y": "Rockingham", "": "There"}
    assert values(spark, lambda x: text.venue_stem(x, {"Aston": "Aston-le-Walls"}, F.lit("There")), stems) == list(stems.values())


@pytest.mark.parametrize(
    ("raw", "start", "end"),
    [("4th - 5th May & 8th - 9th May 2026", "2026-05-04", "2026-05-09"), ("30 Dec & 2 Jan 2027", "2026-12-30", "2027-01-02"), ("1st May, 2026", "2026-05-01", None), ("From 3 June 2026 to 5 June 2026 at 10", "2026-06-03", "2026-06-05"), ("5 and 6 July 26", "2026-07-05", "2026-07-06"), ("24 June", None, None), (None, None, None)],
)
def test_more_ranges(spark, raw, start, end):
    a, b = dates.date_range(F.col("x"))
    r = spark.createDataFrame([(raw,)], "x string").select(a.cast("string").alias("a"), b.cast("string").alias("b")).first()
    assert (r.a, r.b) == (start, end)


def test_dates_in_slugs(spark):
    cases = {"/e/show-4th-march": "2027-03-04", "https://x/22nd-october-finals": "2026-10-22", "/e/march-4th": None, "/e/31st-feb": None, "/a-20260304": "2026-03-04"}
    assert values(spark, lambda x: dates.date_in_url(x, F.lit("2026-06-01").cast("date")).cast("string"), cases) == list(cases.values())


def test_class_tags_bear_nulls_and_odd_heights(spark):
    df = spark.createDataFrame([(None,), ([],), ([None, "British Novices 90cm", "Pony Foxhunter", "1.05 m", "30cm", "0cm"],)], "c array<string>")
    got = [r.k for r in df.select(tags.class_tags(F.col("c")).alias("k")).collect()]
    assert got == [[], [], ["height:90", "class:pony-foxhunter", "audience:pony", "height:110", "height:100", "height:80"]]
    known = spark.range(1).select(tags.valid(F.array(F.lit("level:novice"), F.lit("x:y"), F.lit(None).cast("string"))).alias("v"))
    assert known.first().v == ["level:novice"]
