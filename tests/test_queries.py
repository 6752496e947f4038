"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import json
import math
import os
from datetime import date, datetime
from decimal import Decimal
from html.parser import HTMLParser

import duckdb
import pytest
from meadowlark.functions import rules
from meadowlark.plans import ORACLE_SQL, QUERIES
from meadowlark.plans.demo import BASE_TABLES, Tables

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return f"{v:.8g}"
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.skipif(not glob.glob(f"{SF}/orders.parquet*"), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        assert columns == sorted(want.columns)
        place = [want.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[k]) for k in place) for r in want.fetchall()), key=str)
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "name", "venue_name", "distance"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not glob.glob(f"{SF}/orders.parquet*"), reason="needs the driver's tables")
def test_pages_are_made_after_their_shuffle(spark):
    from meadowlark.plans import table_queries as Q

    pages = Q.paged(Tables(spark, SF), Q.table_of(Q.html_row(["name"])))
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("collect_list") < plan.index("Exchange")


@pytest.mark.skipif(not glob.glob(f"{SF}/orders.parquet*"), reason="needs the driver's tables")
@pytest.mark.parametrize(("name", "reader"), [("S7_venue_seeds", "venue_seeds"), ("S8_rule_json", "rule_rows")])
def test_bounded_payloads(spark, monkeypatch, name, reader):
    """The number of payloads grows with the rows, not the payloads."""
    from meadowlark.plans import table_queries

    seen, read = [], getattr(table_queries.feeds, reader)
    monkeypatch.setattr(table_queries, "BUCKET", 1, raising=False)
    monkeypatch.setattr(table_queries.feeds, reader, lambda payload: seen.append(payload) or read(payload))
    rows = QUERIES[name](spark, SF).count()
    sizes = [sum(len(v) if isinstance(v, list) else 1 for v in json.loads(r.body).values()) for r in seen[0].collect()]
    assert max(sizes) == 1 and sum(sizes) * (2 if name[1] == "7" else 1) == rows


@pytest.mark.skipif(not glob.glob(f"{SF}/orders.parquet*"), reason="needs the driver's tables")
def test_links_of_few_events_only(spark):
    """A17 counts first and collects the events of venues that show links."""
    plan = QUERIES["A17_venue_page"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def plain_disciplines(text):
    """Disciplines of a text by looking at every place for every alias, longest first; a place that lies within one
    that is taken doesn't count."""
    found, taken = set(), []
    aliases = sorted({(a, d) for d, words in rules.DISCIPLINES.items() for a in (d.lower(), *words) if a not in rules.TITLE_DENY}, key=lambda x: -len(x[0]))
    inside = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
    for alias, discipline in aliases:
        for at in range(len(text)):
            if not text.startswith(alias, at) or inside(at - 1):
                continue
            ends = [at + len(alias)]
            if alias.isalpha() and len(alias) >= 4 and text[ends[0] : ends[0] + 1] == "s":
                ends.insert(0, ends[0] + 1)
            end = next((e for e in ends if not inside(e)), None)
            if end is not None and not any(a <= at and end <= b for a, b in taken):
                taken.append((at, end))
                found.add(discipline)
    return found


@pytest.mark.skipif(not glob.glob(f"{SF}/orders.parquet*"), reason="needs the driver's tables")
def test_disciplines_against_plain_version(spark):
    """T7 over all events."""
    t = Tables(spark, SF)
    got = {r.id: set(filter(None, r.tags.split(";"))) for r in QUERIES["T7_multi_discipline"](spark, SF).collect()}
    events = t.event.select("id", "name", "discipline", "classes").collect()
    assert len(got) == len(events) > 1000
    for e in events:
        try:
            classes = json.loads(e.classes or "[]")
        except ValueError:
            classes = []
        found = plain_disciplines(" | ".join([e.name.lower().replace("&", " and "), *(c.lower() for c in classes)]))
        found |= {e.discipline} & set(rules.DISCIPLINES)
        words = [w.strip(".,:;()").lower() for w in e.name.split()]
        if "nsea" in words and "EC" in [w.strip(".,:;()") for w in e.name.split("@")[0].split()]:
            found.add("Eventers Challenge")
        assert got[e.id] == {"discipline:" + d.lower().replace(" ", "-") for d in found}, e


class Reader(HTMLParser):
    """The texts of a page with the names of the elements that are open around each, without a tree: an end tag ends
    the last open element of its name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.apart, self.number = [], [], True, 0

    def handle_starttag(self, tag, attrs):
        self.apart = True
        if tag not in ("img", "link", "meta", "br", "hr", "input"):
            self.number += 1
            self.open.append((tag, dict(attrs).get("role"), self.number))

    def handle_endtag(self, tag):
        self.apart = True
        at = [k for k, x in enumerate(self.open) if x[0] == tag]
        if at:
            del self.open[at[-1] :]

    def handle_comment(self, data):
        self.apart = True

    def handle_data(self, data):
        if self.apart:
            self.found.append((list(self.open), data))
        else:
            self.found[-1] = self.found[-1][0], self.found[-1][1] + data
        self.apart = False


SKIPPED = {"script", "style", "nav", "header", "footer", "form", "noscript", "svg", "select", "option"}


def plain_page(html):
    reader = Reader()
    reader.feed(html)
    reader.close()
    kept = [(own, x) for own, x in reader.found if not SKIPPED & {o[0] for o in own}]
    elements = sorted({o for own, _ in kept for o in own}, key=lambda o: o[2])
    within = lambda e, sign: sign.join(x for own, x in kept if e in own)
    lines = lambda x: "\n".join(y for y in (" ".join(z.replace("\t", " ").split(" ")).strip() for z in x.splitlines()) if y)
    blanks = lambda x: "\n".join(" ".join(y.split()) if y.isascii() else y for y in lines(x).splitlines())
    tables = [" ".join(within(e, " | ").split()) for e in elements if e[0] == "table"]
    listed = "\n\n".join(x for x in tables if len(x) > 50)
    if len(listed) > 200:
        return blanks(listed)
    for test in (lambda e: e[0] == "main", lambda e: e[0] == "article", lambda e: e[1] == "main"):
        own = [e for e in elements if test(e)]
        if own:
            if len(within(own[0], "\n")) > 200:
                return blanks(within(own[0], "\n"))
            break
    return blanks("\n".join(x for _, x in kept))


@pytest.mark.skipif(not glob.glob(f"{SF}/pages.parquet*"), reason="needs the driver's tables")
def test_clean_pages_against_plain_version(spark):
    """S5 over all pages."""
    got = {r.page_id: r.text for r in QUERIES["S5_clean_html"](spark, SF).collect()}
    pages = Tables(spark, SF).pages.select("page_id", "html").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id] == plain_page(p.html)[:6000]
