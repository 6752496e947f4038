"""Pages as trees: nested and broken tables, spans, and texts for reading."""

import random
from urllib.parse import urljoin

import pytest
from meadowlark.sources import feeds, markup
from pyspark.sql import functions as F


def texts(html, **kinds):
    return [[[c.words({"table"}) for c in line] for line in markup.grid(t, **kinds)] for t in markup.tree(html).elements("table")]


def test_nested_tables_keep_their_rows():
    html = "<table><tr><td>a<table><tr><td>x</td></tr><tr><td>y</td></tr></table>b</td><td>c</td></tr><tr><td>d</td><td>e</td></tr></table>"
    assert texts(html) == [[["a b", "c"], ["d", "e"]], [["x"], ["y"]]]


@pytest.mark.parametrize("html", ["<table><tr><td>a<td>b<tr><td>c<td>d", "<table><tbody><tr><td>a<b><td>b</b></tr></p><tr><td>c</div><td>d</table>", "<TABLE><TR><TD>a</TD><td>b</td><tr><td>c</td><td>d</td></tr></table></table>"])
def test_cells_that_nothing_ends(html):
    assert texts(html) == [[["a", "b"], ["c", "d"]]]


def test_spans():
    html = "<table><tr><td rowspan=2>1 May</td><td>a</td></tr><tr><td>b</td></tr><tr><td colspan=2>wide</td></tr><tr><td rowspan=99>x</td><td rowspan='no'>y</td></tr></table>"
    assert texts(html) == [[["1 May", "a"], ["1 May", "b"], ["wide", "wide"], ["x", "y"]]]
    assert texts(html, across=False)[0][2] == ["wide"]
    corner = "<table><tr><td>a</td><td rowspan=2 colspan=2>b</td></tr><tr><td>c</td></tr><tr><td>d</td></tr></table>"
    assert texts(corner) == [[["a", "b", "b"], ["c", "b", "b"], ["d"]]]


def test_words_and_references():
    page = markup.tree("<p>caf&eacute; &amp; <b>b</b>ar<br>x<p>y<script>no()</script><!-- no --><li>one<li>two")
    assert page.words({"script"}) == "café & bar x y one two"
    assert markup.tree(None).words() == markup.tree("").words() == "" and markup.tree("<" * 50 + "&#x;&bogus;").words()
    deep = markup.tree("<div>" * 20_000 + "x" + "</div>" * 20_000)
    assert deep.words() == "x"


def test_tables_in_one_pass(monkeypatch):
    """Rows are read without a tree, and are those that the tree gives, whatever the markup."""
    marks = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<TD rowspan=2>", "<td rowspan=99 colspan=2>", "<tbody>", "</tbody>", "<a href='/e/1'>", "<a href='../y?z'>", "<a>", "</a>", "<br>", "<p>", "</p>", "<li>", "<div/>", "<div>", "</div>"]
    marks += ["<script>", "</script>", "</scriptx", "<style>x<td></style>", "<!-- c -->", "<!--", "<?x?>", "x", " y ", "&amp;", "&lt;b&gt;", "a & b", "<b>", "<", "'", '"', "<a title=\"x>y\" href=q>", "<a title='", "<td/>", "<tr/>", "<select>", "<option>", "<a href='/a/./b'>", "<a href='//h/p'>", "<a href=''>"]
    pick, pages = random.Random(7), []
    for k in range(2000):
        html, base = "<table><tr><td>" * (k % 3) + "".join(pick.choices(marks, k=pick.randint(1, 60))), pick.choice([None, "", "https://feed.example/list?page=1", "x/y", "http://[x", "HTTP://a/b"])
        rows = [line for t in markup.tree(html).elements("table") for line in markup.grid(t, ("td",), across=False)]
        links = [next((a.attrs["href"] for cell in line for a in cell.elements("a") if "href" in a.attrs), None) for line in rows]
        pages.append((html, base, [([c.words({"table"}) for c in line], None if x is None else joined(base, x)) for line, x in zip(rows, links, strict=True)]))

    monkeypatch.setattr(markup, "tree", None)
    assert [list(markup._rows(html, base)) for html, base, _ in pages] == [rows for _, _, rows in pages]


def joined(base, link):
    try:
        return urljoin(base or "", link.strip())
    except ValueError:
        return link


def test_table_rows_of_null_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "", None), (3, "<table><tr></tr><tr><td><td>b</table><table></table>", None), (4, "<table><tr><td><a href='/x'>é</a></table>", "http://a.b/c")], "k long, body string, url string").coalesce(1)
    got = pages.select("k", markup.table_rows(F.col("body"), F.col("url")).alias("r")).orderBy("k").collect()
    assert [None if r.r is None else [(x.cells, x.link) for x in r.r] for r in got] == [None, [], [([], None), (["", "b"], None)], [(["é"], "http://a.b/x")]]


def test_rows_of_eight_cells(spark):
    rows = [
        ("go", "<a href='/e/1'>Spring Show</a>", "01/05/2026", "02/05/2026", "Dressage", "Bury Farm (B946JD)", "Kent", "3"), ("go", "<a href='e/2'>Vale Riding Club Camp</a>", "03/05/2026", "03/05/2026", "", "UK Location", "", ""),
        ("go", "Hill PC - Rally", "04/05/2026", "soon", "", "n/a", "", ""), ("go", "Yard - Clinic", "04/05/2026", "", "", "", "", ""), ("go", "Alone", "04/05/2026", "", "", "", "", ""), ("go", "", "04/05/2026", "", "", "", "", ""), ("go", "No day", "x", "", "", "", "", ""),
    ]
    html = "<table><tr><th>head</th></tr>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>"
    got = feeds.FEEDS["html_table"](spark.createDataFrame([(1, "https://feed.example/list/x", html), (2, None, None)], "source_id long, url string, body string")).collect()
    assert [(r.name, str(r.date_start), r.date_end and str(r.date_end), r.venue_name, r.venue_postcode, r.discipline, r.url) for r in got] == [
        ("Spring Show", "2026-05-01", "2026-05-02", "Bury Farm", "B94 6JD", "Dressage", "https://feed.example/e/1"),
        ("Vale Riding Club Camp", "2026-05-03", None, "Vale Riding Club", None, None, "https://feed.example/list/e/2"),
        ("Hill PC - Rally", "2026-05-04", None, "Hill PC", None, None, None), ("Yard - Clinic", "2026-05-04", None, "Yard", None, None, None), ("Alone", "2026-05-04", None, "Alone", None, None, None),
    ]


def test_data_rows(spark):
    body = """{"data": [{"id": 1, "full_show_name": " A &amp; B ", "venue_name": "", "start": "2026-05-01", "end": "2026-05-01", "class_range": "P1 + + N2"}, {"id": 2, "full_show_name": "x", "start": "2026-05-01", "status": "Cancelled"},
      {"id": 3, "full_show_name": "x", "start": "2026-05-01", "event_status_id": 5}, {"id": 4, "full_show_name": "", "start": "2026-05-01"}, {"id": 5, "full_show_name": "x", "start": "?"}]}"""
    got = feeds.FEEDS["data_api"](spark.createDataFrame([(1, body), (2, "no json"), (3, None)], "source_id long, body string")).collect()
    assert [(r.batch_seq, r.name, r.date_end, r.venue_name, r.classes) for r in got] == [(1, "A & B", None, "TBC", ["P1", "N2"])]


def cleaned(spark, html):
    return spark.createDataFrame([(html,)], "x string").select(markup.clean_html(F.col("x")).alias("t")).first().t


def test_pages_for_reading(spark):
    words = "word " * 60
    assert cleaned(spark, f"<nav>menu</nav><main>{words}</main><table><tr><td>short</td></tr></table>") == words.strip()
    assert cleaned(spark, f"<p>before</p><div role=main>caf&eacute; {words}<select><option>no</option></select></div>") == ("café " + words).strip()
    assert cleaned(spark, f"<article>{words}</article><main>short</main><aside>stays</aside>") == f"{words.strip()}\nshort\nstays"
    cells = "".join(f"<tr><td>cell {k}</td><td>{words}</td></tr>" for k in range(2))
    assert cleaned(spark, f"<p>no</p><table>{cells}</table>") == " ".join(f"| cell {k} | {words.strip()} |" for k in range(2)).replace("| |", "|").strip("| ").replace("  ", " ")
    assert cleaned(spark, "<form>a<table><tr><td>" + words + "</td></tr></table></form>b") == "b"
    assert cleaned(spark, None) is None and cleaned(spark, "") == "" and len(cleaned(spark, "<p>" + "x " * 9000)) == 6000


def test_payload_files(spark, tmp_path):
    import json

    meetings = [{"id": k, "name": f"M{k}", "start_on": "2026-01-02", "venue_country": "GBR"} for k in range(3)]
    lines = [json.dumps({"source_id": 1, "url": None, "body": json.dumps(meetings)}), "no json", json.dumps({"source_id": 2, "body": None})]
    (tmp_path / "a.json").write_text("\n".join(lines))
    assert sorted(r.name for r in feeds.read(spark, "meetings_api", str(tmp_path)).collect()) == ["M0", "M1", "M2"]
    with pytest.raises(KeyError):
        feeds.read(spark, "nothing", str(tmp_path))


def test_calendar_files(spark, tmp_path):
    from meadowlark.sources.calendars import FORMAT, write_calendars

    df = spark.createDataFrame([(1, "a/b", "2026-03-02", "X"), (2, "a/b", "2026-03-01", "Y"), (3, "ü", "2026-03-01", "Z"), (4, None, "2026-03-01", "N")], "id long, venue_id string, day string, name string")
    df = df.withColumns({"date_start": F.col("day").cast("date"), "date_end": F.lit(None).cast("date"), "venue_name": F.col("venue_id"), "discipline": F.lit(None).cast("string"), "url": F.lit(None).cast("string")})
    write_calendars(df, str(tmp_path))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["%C3%BC.ics", "a%2Fb.ics"]
    text = (tmp_path / "a%2Fb.ics").read_bytes().decode()
    assert text.startswith("BEGIN:VCALENDAR\r\n") and text.endswith("END:VEVENT\r\nEND:VCALENDAR\r\n") and text.index("SUMMARY:Y") < text.index("SUMMARY:X") and text.count("BEGIN:VEVENT") == 2

    @F.udf("string")
    def broken(text):
        if "SUMMARY:Z" in text:
            raise ValueError("no")
        return text

    other = tmp_path / "other"
    rows = spark.createDataFrame([("k1", "SUMMARY:A"), ("k2", "SUMMARY:Z")], "key string, text string").repartition(2, "key")
    with pytest.raises(Exception, match="no"):
        rows.select("key", broken("text").alias("text")).write.format(FORMAT).mode("append").option("path", str(other)).save()
    assert list(other.glob("*.ics")) == []
    again = spark.createDataFrame([("k1", "A"), ("k2", "B"), ("k1", "C")], "key string, text string").coalesce(1)
    with pytest.raises(Exception, match="stand together"):
        again.write.format(FORMAT).mode("append").option("path", str(other)).save()
    assert list(other.glob("*.ics")) == []
