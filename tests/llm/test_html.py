import glob
import re
from html import unescape

from meadowlark.llm import html as H
from meadowlark.llm.common import table

HEAD = "<html><head><title>t</title><script>var a='<p>';</script></head><body><nav><ul><li><a href=/x>Menu</a></ul></nav>"
FOOT = "<div class='cookie-notice'>We use cookies</div><section id=comments><p>A reader's comment that is rather long, longer than the text itself, and so on and on.</p></section><footer>Foot</footer></body></html>"


def page(body):
    return HEAD + body + FOOT


def test_blocks_references_and_boilerplate():
    p = H.Page(page("<article><h1>A&amp;B &lt;x&gt;</h1><p>One  two<b>three</b>\n four<p>Five<br>six &copy;<aside>no</aside><form>no</form><div class='ad'>no</div></article>"))
    assert p.extract(["html>body>article"]) == "A&B <x> One twothree four Five six ©"


def test_fallback_and_empty():
    assert H.Page("").extract([]) == ""
    assert H.Page("just text").extract(["html>body>article"]) in ("", "just text")
    assert H.Page(page("<div class='post-77'><p>Main text of the page, long enough.</p></div>")).extract(["html>body>article"]) == "Main text of the page, long enough."


def test_generalised_paths():
    a, b = (H.Page(page(f"<div class='post-{k}'><p>Text of the page here.</p></div>")) for k in (7, 81))
    assert max(a.votes(), key=lambda x: x[1])[0] == max(b.votes(), key=lambda x: x[1])[0] == "html>body>div.post-#"


def test_hostile_markup():
    assert H.Page("<div>" * 30_000 + "deep").extract([]) == "deep"
    assert H.Page("<p title=\"unclosed <p>x").extract([]) is not None
    assert H.Page("<script>never closed <p>x</p>").extract([]) == ""
    assert H.Page("<p a=\"x>y\" b='>' c=d'>It isn't lost</p><p title=\"never closed>x").extract([]).startswith("It isn't lost")
    H.Page("</div></p></x><li><li><td>" * 1000 + "<!-- open").extract([])


def test_long_attributes():
    """However long a value is, its signs don't end the tag, and no name in it counts."""
    for quote in "\"'":
        value = "a > LEAKED class=ad hidden " * 40_000
        text = H.Page(page(f"<article><p title={quote}{value}{quote}>Main text of the page</p></article>")).extract(["html>body>article"])
        assert len(value) > 1_000_000 and text == "Main text of the page"
    H.Page("<a b=\"" * 100_000)
    H.Page("<a b='>" * 100_000 + "\"")
    assert H.Page("<div>text <!-- a > b <b>").extract([]) == H.Page("<div>text <script>a > b").extract([]) == H.Page("<div>text <!-- a").extract([]) == "text"
    assert H.Page("<div>text <b").extract([]) == "text <b"


def test_lead_and_body():
    lead, body = "The lead says it all in one line.", "And the body tells it at length. " * 20
    html = page(f"<article><section class=lead><p>{lead}</p></section><section class=body><p>{body}</p></section></article>")
    votes = dict(H.Page(html).votes())
    assert max(votes, key=votes.get) == "html>body>article"
    assert H.Page(html).extract(["html>body>article"]) == H.Page(html).extract([]) == f"{lead} {body}".strip()
    parts = page(f"<div class=wrap><div class=lead><p>{lead * 3}</p></div><div class=body><p>{body}</p></div></div>")
    assert H.Page(parts).extract([]) == f"{lead * 3} {body}".strip()


def test_names_only_lower_scores():
    """Prose under a name that says more than furniture stays; links and short bits under it go; so does furniture."""
    first, work, price = "The study was long in the making.", "Related work has been done by many groups before.", "The share price rose by a tenth on that day."
    parts = [f"<p>{first}</p>", f"<div class=related-work><p>{work}</p></div>", f"<div class=share-price>{price}</div>"]
    furniture = ["<div class='social-share'>Share on X</div>", "<div class='ad-slot'>Buy our fine boots today at half the price</div>", "<ul class='related-posts'><li><a href=x>Another post that is long enough to read</a></ul>", "<div class='share-tools'><a>Post it</a></div>"]
    assert H.Page(page("<article>" + "".join(parts + furniture) + "</article>")).extract([]) == f"{first} {work} {price}"
    inside = page(f"<div class='with-sidebar'><h1>Title</h1><p>{first}</p><p>{work}</p><p>{price}</p><div class=sidebar>Side</div></div>")
    assert H.Page(inside).extract([]) == f"Title {first} {work} {price}"


def test_host_decides_on_names(spark):
    """One page's links under a name don't take the host's prose away, nor the other way round."""
    prose = page("<article><p>Text of this page here.</p><div class='related-work'><p>Prose about other work that people did.</p></div></article>")
    links = page("<article><p>Text of this page here.</p><div class='related-work'><a href=x>Link</a></div></article>")
    df = spark.createDataFrame([(k, "https://a.example/", prose) for k in range(5)] + [(9, "https://a.example/", links)], "page_id long, url string, html string")
    by = {r.page_id: r.text for r in H.extract_main_text(df).collect()}
    assert by[9] == "Text of this page here. Link" and by[0].endswith("people did.")


def test_hosts_vote(spark):
    good = page("<div class=main><p>Long text about horses and riders, with many words in it.</p></div><div class=box><p>Short box.</p></div>")
    odd = page("<div class=main><p>Hi.</p></div><div class=box><p>On this page the box is far longer than the text in the main part, yet the host has decided.</p></div>")
    rows = [(k, f"https://a.example/{k}", good) for k in range(8)] + [(9, "https://A.example/9", odd), (10, None, None), (11, None, odd), (9, "https://A.example/9", odd)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = H.extract_main_text(df)
    assert got.columns == ["page_id", "url", "html", "text"] and got.count() == len(rows)
    by = {r.page_id: r.text for r in got.collect()}
    assert by[9] == "Hi." and by[10] == "" and by[11].startswith("On this page") and by[3].startswith("Long text")
    assert H.extract_main_text(df.limit(0)).count() == 0
    assert H.extract_main_text(df.withColumn("text", df.page_id)).where("text = 'Hi.'").count() == 2
    clash = df.selectExpr("*", "'own' AS host", "'own' AS found", "'own' AS __host", "'own' AS __paths", "'own' AS `a.b`", "'own' AS paths")
    got = H.extract_main_text(clash)
    assert got.columns == [*clash.columns, "text"] and got.where("text = 'Hi.' AND host = 'own' AND found = 'own' AND `a.b` = 'own'").count() == 2


def test_whole_table_against_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    if not glob.glob(f"{sf}/pages.parquet*"):
        return
    for r in H.extract_main_text(table(spark, sf, "pages")).collect():
        body = re.sub(r"</?(?:h1|p|br|ul|li)>", " ", re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1])
        assert r.text == " ".join(unescape(re.sub("</?b>", "", body)).split())


STORY = "The riders came down the hill in the early morning and crossed the river. " * 3


def pages(spark, bodies):
    return spark.createDataFrame([(k, f"https://a.example/{k}", page(b)) for k, b in enumerate(bodies)], "page_id long, url string, html string")


def texts(spark, bodies):
    return {r.page_id: r.text for r in H.extract_main_text(pages(spark, bodies)).collect()}


def test_article_beside_a_teaser_at_the_hosts_path(spark):
    got = texts(spark, [f"<div class=story><p>{STORY}</p></div>"] * 9 + [f"<div class=story><p>Read it all here, dear reader.</p></div><div class=longread><p>{STORY * 9}</p></div>"])
    assert got[0] == STORY.strip() and got[9] == "Read it all here, dear reader. " + " ".join((STORY * 9).split())


def test_page_within_a_form():
    p = H.Page(page(f"<form id=aspnet><div><h1>Title</h1><p>{STORY}</p><p>{STORY}</p><label>Name</label><input><select><option>One</select><button>Go</button></div></form>"))
    assert p.extract([]) == f"Title {STORY}{STORY}".strip()
    small = H.Page(page(f"<div class=main><p>{STORY}</p><form><p>Sign up for news</p><label>Your name here please</label></form></div>"))
    assert small.extract([]) == STORY.strip()


def test_furniture_that_nothing_ends():
    for tag in ("nav", "aside"):
        assert H.Page(f"<body><{tag}><a href=x>Menu</a><article><p>{STORY}</p></article></body>").extract([]) == STORY.strip()
    assert H.Page("<nav>" * 20_000 + "<aside>" * 20_000 + f"<article><p>{STORY}</p>").extract([]) == STORY.strip()
    closed = f"<body><article><p>{STORY}</p></article><aside><section><p>{STORY} no</p></section></aside></body>"
    assert H.Page(closed).extract([]) == STORY.strip()


def test_article_of_links():
    link = "<p><a href=x>A whole paragraph that is a link to somewhere else</a></p>"
    assert H.Page(page(f"<article>{link * 3}</article>")).extract([]) == " ".join(["A whole paragraph that is a link to somewhere else"] * 3)
    assert H.Page("<body><div><p><a href=x>One link</a></p></div></body>").extract([]) == "One link"


def test_remarks_by_structure(spark):
    remark = "<div class=user-post><span class=who>Ann</span><time>today</time><p>What a fine ride that must have been for all.</p></div>"
    body = f"<div class=main><p>{STORY}</p></div><div class=discussion>{remark * 4}</div>"
    assert set(texts(spark, [body] * 3).values()) == {STORY.strip()}
    inside = page(f"<article><p>{STORY}</p><div class=discussion>{remark * 2}</div></article>")
    assert H.Page(inside).extract([]) == STORY.strip()
    thread = page(f"<div class=thread>{remark * 6}</div>")  # nothing but posts: they are the text
    assert H.Page(thread).extract([]).count("What a fine ride") == 6


def test_many_paths_and_names(spark):
    """A body in four paths of like weight stays whole, and a name counts however many others there are."""
    parts = "".join(f"<div class=part{c}><p>{STORY}</p></div>" for c in "abcd")
    got = texts(spark, [f"<div class=w><div class=x>{parts}</div></div>"] * 4)
    assert set(got.values()) == {(STORY * 4).strip()}
    rare = "".join(f"<div class='ad-{'x' * k}'>Buy</div>" for k in range(1, 200))
    got = texts(spark, [f"<div class=main><p>{STORY}</p>{rare}</div>"] * 2)
    assert set(got.values()) == {STORY.strip()}


def test_whole_table_without_articles(spark):
    """The same pages with the article in a plain element: nothing but its place tells it."""
    sf = "/root/testdata/sf0.01"
    if not glob.glob(f"{sf}/pages.parquet*"):
        return
    df = table(spark, sf, "pages").selectExpr("page_id", "url", "replace(replace(html, '<article>', '<div class=\"story\">'), '</article>', '</div>') AS html")
    rows = H.extract_main_text(df).collect()
    right = 0
    for r in rows:
        body = re.sub(r"</?(?:h1|p|br|ul|li)>", " ", re.search(r'<div class="story">(.*?)</div>', r.html, re.DOTALL)[1])
        right += r.text == " ".join(unescape(re.sub("</?b>", "", body)).split())
    assert right == len(rows)
