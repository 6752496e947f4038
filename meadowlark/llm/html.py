"""Main text of web pages by consensus host paths (operator 3).

Each page scores its containers; the generalised tag-class paths of the containers get votes, summed per host in
Spark; pages are then extracted again with their host's winning paths. A page that has none of them falls back to its
own best container. Names that sound like furniture (ads, sharing, related links) only lower a score: whether such an
element goes is voted on per host too, by what it holds.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_anew, named, stored

TOKEN = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)
    |(script|style|noscript|textarea|title|iframe|xmp)\b[^>]*>(?:.*?</\1[^>]*>|.*)
    |(/?)([a-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?=[^"'])))*+(?=>)|[^>]*)>
    |[!?][^>]*>)""",
    re.IGNORECASE | re.DOTALL | re.VERBOSE,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
TELLING = re.compile("class|id|role|hidden|style", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text belongs to the container around them.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dd dt figcaption address".split())
#: What an opening tag closes, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
P_ENDS, P_WITHIN = {"p"}, {"table", "td", "th", "div", "li", "section", "article", "main", "body", "button", "object"}
BOILER_TAGS = frozenset("nav footer aside button select label legend option optgroup datalist output dialog menu svg template object canvas head".split())
#: Where furniture that is never closed ends.
SECTIONS = frozenset("article main section h1 header footer".split())
#: What a reader's remark has besides its text: a time, or an element with one of these words in its name.
REMARK_WORDS = frozenset("author user username nickname avatar date time timestamp posted ago".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary dialog alertdialog alert search menu menubar form".split())
#: Words of class names and ids that furniture often has, those of readers' comments, and those that say nothing.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices newsletter subscribe nav navbar navigation menu breadcrumb breadcrumbs sidebar widget related recommended share sharing social footer popup modal overlay signup login pagination pager skip toolbar masthead topbar".split()
)
COMMENT_WORDS = frozenset("comment comments disqus respond reply replies".split())
NEUTRAL_WORDS = frozenset(
    "a area article bar block body bottom box btn button buttons center col column container content form group has header id inner item items js left links list main off on outer page pane panel post posts right row section site slot text the title top unit with wrap wrapper zone".split()
)
SAFE_TAGS = frozenset({"html", "body", "article", "main"})
DEPTH = 6
#: How an element's name speaks: of nothing, of furniture among other things, of furniture alone, of comments; and what
#: the text in it counts for a score.
PLAIN, MIXED, FURNITURE, COMMENTS, REMARK = range(5)
WEIGHT = (1.0, 0.5, 0.1, 0.0, 0.1)
#: Words of linked text from which it counts, and how much.
LINKED_WORDS, LINKED = 8, 0.25
#: Words of a block that reads like prose, and blocks that furniture by name must hold to pass for a page's body.
PROSE_WORDS, BODY_BLOCKS = 5, 3
#: Paths of a host that win: with this share of the best one's votes, and of all votes of the host (so there are 50 at
#: most); names that a host tells of: with this share of its votes on names (so there are 1,000 at most). Pages decide
#: about others themselves.
SHARE, SUPPORT, TOLD = 0.5, 0.02, 0.001
#: A page whose own best container has so many characters, of which the winning paths hold less than this share, is read
#: at both.
OWN_SIZE, OWN_SHARE = 500, 0.1


def words_of(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if w]


def speaks(names: str) -> int:
    words = set(words_of(names))
    if words & COMMENT_WORDS:
        return COMMENTS
    if not words & BOILER_WORDS:
        return PLAIN
    return MIXED if any(not w.isdigit() for w in words - BOILER_WORDS - NEUTRAL_WORDS) else FURNITURE


def judged(tag: str, attrs: str) -> tuple[str, bool, int]:
    """(generalised label, is no content by tag or role, how its name speaks) of an element. Digits of class names
    count as one sign."""
    if not TELLING.search(attrs):
        return tag, tag in BOILER_TAGS, FURNITURE if tag == "form" else PLAIN
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        found.setdefault(m[1].lower(), unescape((m[2] or "").strip("\"'")))
    classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in found.get("class", "").split()})
    label = ".".join([tag, *classes])
    hard = tag in BOILER_TAGS or found.get("role", "").lower() in BOILER_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
    name = PLAIN if tag in SAFE_TAGS else max(map(speaks, [*found.get("class", "").split(), found.get("id", "")]))
    if name and speaks(found.get("id", "")):
        label += "#" + re.sub(r"\d+", "#", found["id"].lower())
    # a form is judged by what it holds: some pages stand in one
    return label, hard, max(name, FURNITURE) if tag == "form" and name != COMMENTS else name


remembered = lru_cache(maxsize=10_000)(judged)


def traits(tag: str, attrs: str) -> tuple[str, bool, int]:
    return remembered(tag, attrs) if len(attrs) < 300 else judged(tag, attrs)


def unclosed(m: re.Match) -> bool:
    """A comment, or an element of raw text, that goes on to the end."""
    if m[1]:
        return not re.search(rf"</{m[1]}[^>]*>\Z", m[0], re.IGNORECASE)
    return m[0].startswith("<!--") and not m[0].endswith("-->")


class Page:
    """Elements of a page in order (parent, tag, path, no content, nearest element named like furniture), and runs of
    text: (element, text), or (element, None) where a block begins or ends."""

    def __init__(self, html: str):
        self.parent, self.tag, self.path, self.boiler, self.soft = [-1], ["#"], [""], [False], [0]
        self.ended: set[int] = set()  # furniture that a tag of its own ends
        self.name: dict[int, int] = {}
        self.holds: set[int] = set()
        self.runs: list[tuple[int, str | None]] = []
        self.open: dict[str, int] = {}
        stack, at, runs = [0], 0, self.runs
        below: dict[tuple[str, str], str] = {}
        last, m = html.rfind(">") + 1, None
        for m in TOKEN.finditer(html, 0, last):  # behind the last > nothing can be a tag
            start, end = m.span()
            if start > at:
                runs.append((stack[-1], html[at:start]))
            at = end
            tag = m[3]
            if not tag:
                continue
            tag = tag.lower()
            block = tag not in INLINE
            if m[2]:
                if self.open.get(tag):
                    k = next(k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == tag)
                    if self.boiler[stack[k]]:
                        self.ended.add(stack[k])
                    self.close(stack, k)
                if block:
                    runs.append((stack[-1], None))
                continue
            if block:
                runs.append((stack[-1], None))
                if self.open.get("p"):
                    self.imply(stack, P_ENDS, P_WITHIN)
                if tag in CLOSES:
                    self.imply(stack, *CLOSES[tag])
            if tag in VOID:
                continue
            label, boiler, name = traits(tag, m[4])
            top = stack[-1]
            if tag == "header":
                boiler = boiler or not (self.open.get("article") or self.open.get("main"))
            above = self.path[top]
            if (above, label) not in below:
                below[above, label] = ">".join([*above.split(">")[1 - DEPTH :], label]) if above else label
            self.parent.append(top)
            self.tag.append(tag)
            self.path.append(below[above, label])
            self.boiler.append(boiler)  # its own; what stands above it counts in finish()
            node = len(self.parent) - 1
            if name:
                self.name[node] = name
            stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1
        if not (m and at == last and unclosed(m)) and (rest := html[at:].partition("<!--")[0]):
            runs.append((stack[-1], rest))
        self.finish()

    def finish(self) -> None:
        """What follows from the whole tree: where furniture ends, what are readers' remarks, which element named like
        furniture is nearest, and which of them hold the page's heading or body."""
        parent, tag, n = self.parent, self.tag, len(self.parent)
        own = list(self.boiler)
        section = [n] * n  # the first section within
        for k in range(n - 1, 0, -1):
            section[parent[k]] = min(section[parent[k]], k if tag[k] in SECTIONS else section[k])
        # furniture that nothing ends stops at the first section in it
        stops = {k: section[k] for k in range(1, n) if own[k] and tag[k] in ("nav", "aside", "footer", "header", "menu") and k not in self.ended}
        by = [0] * n  # the nearest furniture around, by tag or role, that goes on here
        for k in range(1, n):
            by[k] = k if own[k] else by[parent[k]]
            while by[k] and by[k] != k and stops.get(by[k], n) <= k:
                by[k] = by[parent[by[k]]]
            self.boiler[k] = by[k] != 0
        self.remarks()
        self.soft = [0] * n
        for k in range(1, n):
            self.soft[k] = k if k in self.name else self.soft[parent[k]]
        for k in range(1, n):
            if tag[k] in ("h1", "article", "main") and not self.boiler[k]:
                up = self.soft[parent[k]]
                while up and up not in self.holds:
                    self.holds.add(up)
                    up = self.soft[parent[up]]

    def remarks(self) -> None:
        """Siblings of one path, two at least, that all hold text with a time or a name of who wrote it, and no heading:
        readers' remarks, whatever their names are."""
        told, heading, filled = set(), set(), set()
        for k in range(len(self.parent) - 1, 0, -1):
            label = self.path[k].rpartition(">")[2]
            signed = self.tag[k] == "time" or ("." in label and not REMARK_WORDS.isdisjoint(words_of(label)))
            if signed or k in told:
                told.update((k, self.parent[k]))
            if self.tag[k] in ("h1", "h2", "h3", "article", "main") or k in heading:
                heading.update((k, self.parent[k]))
            if self.tag[k] in LEAF or k in filled:
                filled.update((k, self.parent[k]))
        groups: dict[tuple[int, str], list[int]] = {}
        for k in range(1, len(self.parent)):
            if self.tag[k] not in INLINE and not self.boiler[k]:
                groups.setdefault((self.parent[k], self.path[k]), []).append(k)
        for same in groups.values():
            if len(same) > 1 and all(k in told and k in filled and k not in heading and self.tag[k] not in ("td", "th", "tr") for k in same):
                for k in same:
                    self.name.setdefault(k, REMARK)

    def close(self, stack: list[int], k: int) -> None:
        for node in stack[k:]:
            self.open[self.tag[node]] -= 1
        del stack[k:]

    def imply(self, stack: list[int], closed: set[str], within: set[str]) -> None:
        """Closes what the opening of a block-level tag closes: a paragraph, or the item before it."""
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t in closed:
                return self.close(stack, k)
            if t in within:
                return None
        return None

    def holder(self, node: int) -> int:
        """The container of a run of text: neither inline nor a paragraph."""
        while self.tag[node] in INLINE and node > 0:
            node = self.parent[node]
        return self.parent[node] if self.tag[node] in LEAF else node

    def linked(self, node: int) -> bool:
        while self.tag[node] in INLINE and self.tag[node] != "a" and node > 0:
            node = self.parent[node]
        return self.tag[node] == "a"

    def blocks(self):
        """(element of its first run, characters, is prose) of each block that has text and may be content."""
        node, size, links, words = 0, 0, 0, 0
        for at, text in [*self.runs, (0, None)]:
            if text is None:
                if size:
                    yield node, size, words >= PROSE_WORDS and 2 * links < size
                size = links = words = 0
            elif not self.boiler[at] and (n := len(text.strip())):
                node = node if size else at
                size, words = size + n, words + len(text.split())
                links += n if self.linked(at) else 0

    def furniture_votes(self) -> dict[str, int]:
        """For each path of elements named like furniture, characters that speak for keeping it less those against.
        A name that says other things too is judged by its prose; a name of furniture alone stays if the element
        holds the page's heading or body, or most of its prose; one of comments only if it holds the heading or body;
        a remark if it has more prose than all that is no furniture."""
        if not self.name:
            return {}
        prose, other, count, outside = {}, {}, {}, 0
        for node, size, reads in self.blocks():
            k = self.soft[node]
            if not k:
                outside += size * reads
            elif reads:
                prose[k], count[k] = prose.get(k, 0) + size, count.get(k, 0) + 1
            else:
                other[k] = other.get(k, 0) + size
        votes: dict[str, int] = {}
        for k, name in self.name.items():
            p, o = prose.get(k, 0), other.get(k, 0)
            if k in self.holds or (name == FURNITURE and count.get(k, 0) >= BODY_BLOCKS and p > outside) or (name == REMARK and p > outside):
                vote = p + o + 1
            else:
                vote = p - o if name == MIXED else -(p + o)
            votes[self.path[k]] = votes.get(self.path[k], 0) + vote
        return votes

    def scores(self) -> dict[int, float]:
        """Credit of each container: the text of its paragraphs counts twice, that of its children's once; long linked
        texts count less, short ones only where there is nothing else; text under names of furniture counts less."""
        return self.credit(False) or self.credit(True)

    def credit(self, links: bool) -> dict[int, float]:
        weight = [1.0]
        for k in range(1, len(self.parent)):
            weight.append(weight[self.parent[k]] * WEIGHT[self.name.get(k, 0)])
        credit: dict[int, float] = {}
        for node, text in self.runs:
            if text is None or self.boiler[node] or not weight[node]:
                continue
            size = len(text.strip()) * weight[node]
            if not links and size and self.linked(node):
                size *= LINKED if len(text.split()) >= LINKED_WORDS else 0
            if not size:
                continue
            k = self.holder(node)
            for share in (2, 1):
                if k >= 0:
                    credit[k] = credit.get(k, 0) + share * size * (1.25 if self.tag[k] in ("article", "main") else 1)
                    k = self.parent[k]
        return credit

    def best(self, credit: dict[int, float]) -> int:
        """The best container, or the one around it: its article, or while its siblings hold prose of some size too."""
        best = k = max(credit, key=lambda k: (credit[k], -k))
        while k > 0:
            if self.tag[k] == "article":
                return k
            k = self.parent[k]
        prose = [0] * len(self.parent)
        for node, size, reads in self.blocks():
            if reads and not self.soft[node]:
                prose[node] += size
        for k in range(len(prose) - 1, 0, -1):
            prose[self.parent[k]] += prose[k]
        while (up := self.parent[best]) > 0 and self.tag[up] not in ("html", "body") and 10 * prose[best] <= 9 * prose[up]:
            best = up
        return best

    def votes(self) -> list[tuple[str, int]]:
        """Generalised paths with shares of one million; the best container has those of all within it."""
        credit = self.scores()
        total = sum(credit.values())
        if not total:
            return []
        best = self.best(credit)
        by_path: dict[str, float] = {}
        for k, v in credit.items():
            up = k
            while up > best:
                up = self.parent[up]
            at = self.path[best if up == best else k]
            by_path[at] = by_path.get(at, 0) + v
        return [(p, round(1e6 * v / total)) for p, v in by_path.items()]

    def text_at(self, chosen: set[int], gone: set[str]) -> str:
        """The text within the chosen elements without furniture, blocks in page order."""
        inside, out = [False] * len(self.parent), [False] * len(self.parent)
        for k in range(len(self.parent)):
            inside[k] = k in chosen or (k > 0 and inside[self.parent[k]])
            out[k] = (k > 0 and out[self.parent[k]]) or (k in self.name and self.path[k] in gone)
        blocks, part = [], []
        for node, text in self.runs:
            if text is None:
                if part:
                    blocks += unescape("".join(part)).split()
                    part = []
            elif inside[node] and not out[node] and not self.boiler[node]:
                part.append(text)
        return " ".join([*blocks, *unescape("".join(part)).split()])

    def extract(self, paths: list[str] | None, told: dict[str, bool] | None = None) -> str:
        """Text of all elements at the winning paths. told: what the host says about paths named like furniture (true:
        they stay); the page's own votes decide about others."""
        own, told = self.path, told or {}
        gone = {p for p, v in self.furniture_votes().items() if not told.get(p, v > 0)}
        chosen: set[int] = set()
        around: set[int] = set()
        for path in paths or ():  # best first: what holds a better one is no choice of its own
            new = [k for k in range(len(own)) if own[k] == path and not self.boiler[k] and k not in around]
            chosen.update(new)
            for k in new:
                while k not in around and k >= 0:
                    around.add(k)
                    k = self.parent[k]
        text = self.text_at(chosen, gone) if chosen else ""
        credit = self.scores()
        if not credit:
            return text
        best = own[self.best(credit)]
        alone = {k for k in range(len(own)) if own[k] == best and not self.boiler[k]}
        if not text:
            return self.text_at(alone, gone)
        # a teaser at the host's paths, and the article elsewhere
        if len(other := self.text_at(alone, gone)) >= OWN_SIZE and len(text) < OWN_SHARE * len(other):
            return self.text_at(chosen | alone, gone)
        return text


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def page_votes(html: Column) -> Column:
    """Votes of each page: for paths of containers, and for or against paths named like furniture."""
    kind = pa.list_(pa.struct([("furniture", pa.bool_()), ("path", pa.string()), ("votes", pa.int64())]))

    def cast(html: str) -> list[dict]:
        page = Page(html)
        sides = ((False, page.votes()), (True, page.furniture_votes().items()))
        return [{"furniture": side, "path": p, "votes": v} for side, found in sides for p, v in found]

    @F.arrow_udf("array<struct<furniture:boolean,path:string,votes:long>>")
    def votes(pages: pa.Array) -> pa.Array:
        return pa.array([cast(x or "") for x in pages.to_pylist()], kind)

    return votes(html)


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths, told: the winning paths of each host, best first (ties: by path), and which of its names of
    furniture stay or go. Votes are whole numbers, so that sums don't depend on their order; they are summed before
    the shuffle, so a host of any size is cheap. What wins is told by shares of the host's votes, so that a host with
    very many paths has few winners, and no task ranks its paths: the sums of a host are joined to its paths."""
    cast = pages.select(host_of(F.col("url")).alias("host"), F.explode(page_votes(F.col("html"))).alias("v"))
    summed = stored(cast.groupBy("host", "v.furniture", "v.path").agg(F.sum("v.votes").alias("votes")))
    totals = summed.groupBy("host", "furniture").agg(F.max("votes").alias("most"), F.sum(F.abs("votes")).alias("all"))
    told = join_anew(summed, totals, ["host", "furniture"])
    wins = (F.col("votes") >= F.col("most") * SHARE) & (F.col("votes") >= F.col("all") * SUPPORT)
    kept = told.where(F.when(F.col("furniture"), F.abs("votes") >= F.col("all") * TOLD).otherwise(wins))
    one = F.struct((-F.col("votes")).alias("rank"), "path")
    best = kept.groupBy("host").agg(F.array_sort(F.collect_list(F.when(~F.col("furniture"), one))).alias("p"), F.array_sort(F.collect_list(F.when(F.col("furniture"), one))).alias("f"))
    names = F.transform("f", lambda x: F.struct(x["path"].alias("path"), (x["rank"] < 0).alias("stays")))
    return best.select("host", F.transform("p", lambda x: x["path"]).alias("paths"), names.alias("told"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """pages (url, html and any other columns) with `text`, the main text of the whole html.

    Null or empty html: empty text. Null url: the pages without a host vote together. White space of a block becomes
    one space, blocks are joined by one space; character references are decoded. A clashing column text is replaced.
    The paths of hosts are written once; Spark broadcasts them if they are small and else joins by host, splitting
    the partitions of large hosts (adaptive skew join).
    """
    host, found = fresh(pages, "host", "found")
    paths = stored(host_paths(pages)).select(F.col("host").alias(host), F.struct("paths", "told").alias(found))
    joined = pages.withColumn(host, host_of(F.col("url"))).join(paths, host, "left")

    @F.arrow_udf("string")
    def text(html: pa.Array, hosts: pa.Array) -> pa.Array:
        out = []
        for x, f in zip(html.to_pylist(), hosts.to_pylist(), strict=True):
            f = f or {"paths": None, "told": None}
            out.append(Page(x or "").extract(f["paths"], {t["path"]: t["stays"] for t in f["told"] or ()}))
        return pa.array(out, pa.string())

    columns = [named(c) for c in pages.columns if c.lower() != "text"]
    return joined.select(*columns, text(F.col("html"), F.col(found)).alias("text"))
