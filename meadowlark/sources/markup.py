"""HTML read into trees of elements, in Arrow batches: tables as grids, texts of parts of a page."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements between whose texts a reader sees white space.
BLOCK = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "option", "p", "pre", "section", "select", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: What a start tag ends, if it is open within the same table.
ENDED_BY = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "tbody", "thead", "tfoot"}}
ENDED_BY |= {"thead": ENDED_BY["tbody"], "tfoot": ENDED_BY["tbody"], "li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "p": {"p"}}
#: Elements that an end tag, or a start tag that ends others, doesn't reach beyond.
SCOPE = {"table", "#page"}
LISTS = {"ul", "ol", "select", "dl", "div", "section", "article"}


class Element:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    def walk(self, left_out: frozenset[str] | set[str] = frozenset()) -> Iterator[Element | str]:
        """What the element holds, in page order; elements of the given names with all that they hold are left out."""
        todo = list(reversed(self.children))
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in left_out:
                yield node
                todo.extend(reversed(node.children))

    def elements(self, *tags: str) -> list[Element]:
        return [x for x in self.walk() if not isinstance(x, str) and x.tag in tags]

    def words(self, left_out: frozenset[str] | set[str] = frozenset()) -> str:
        """The text as a reader sees it: white space where a block begins or ends, one space at a time."""
        if len(self.children) == 1 and isinstance(self.children[0], str):
            return " ".join(self.children[0].split())
        out: list[str] = []
        todo: list[Element | str] = list(reversed(self.children))
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                if node.tag in BLOCK:
                    out.append(" ")
                    todo.append(" ")
                todo.extend(() if node.tag in left_out else reversed(node.children))
        return " ".join("".join(out).split())


#: Comments, declarations and the like; end tags; start tags with their attributes, in which ">" may stand within quotes.
TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose text isn't markup.
RAW = {"script", "style"}
#: Short tags without attributes that pages had so far, as they are written: read once, as most tags of pages are such.
TAGS: dict[str, tuple[str, bool, dict[str, str], bool]] = {}
LONGEST_TAG, MOST_TAGS = 40, 10_000


def _tag(found: re.Match) -> tuple[str, bool, dict[str, str], bool]:
    """Of a token: its name in lower case (empty if it is no tag), whether it is an end tag, its attributes (the first of
    equal ones; unescaped), and whether it ends with a slash."""
    rest = found[3] or ""
    own = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(ATTRIBUTE.finditer(rest)))} if "=" in rest and not found[1] else {}
    read = (found[2] or "").lower(), bool(found[1]), own, rest.endswith("/")
    if found[2] and not own and len(found[0]) <= LONGEST_TAG and len(TAGS) < MOST_TAGS:
        TAGS[found[0]] = read
    return read


class _Builder:
    def __init__(self) -> None:
        self.page = self.at = Element("#page", {}, None)
        self.joins = False  # whether text goes on with the text before it

    def feed(self, html: str) -> None:
        at, tokens = 0, TOKEN.finditer(html)
        while (found := next(tokens, None)) is not None:
            start, end = found.span()
            if start > at:
                self.text(html[at:start])
            at = end
            tag, ends, attrs, closed = TAGS.get(found[0]) or _tag(found)
            if not tag:
                self.joins = False
            elif ends:
                self.end(tag)
            else:
                self.start(tag, attrs)
                if closed and tag not in VOID:
                    self.end(tag)
                elif tag in RAW:
                    stop = re.compile(rf"</{tag}\b", re.I).search(html, at)
                    if (stop.start() if stop else len(html)) > at:
                        self.at.children.append(html[at : stop.start() if stop else len(html)])
                    at = stop.start() if stop else len(html)
                    tokens = TOKEN.finditer(html, at)
        if at < len(html):
            self.text(html[at:])

    def close_until(self, tags: set[str], stops: set[str]) -> bool:
        """Ends the outermost open element of the given names that isn't beyond a stop."""
        found, node = None, self.at
        while node is not None and node.tag not in stops:
            if node.tag in tags:
                found = node
            node = node.parent
        if found is not None:
            self.at = found.parent
        return found is not None

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        self.joins = False
        if tag in ENDED_BY:
            self.close_until(ENDED_BY[tag], SCOPE if tag in ("td", "th", "tr", "tbody", "thead", "tfoot") else SCOPE | LISTS | {"td", "th"})
        own = Element(tag, attrs, self.at)
        self.at.children.append(own)
        if tag not in VOID:
            self.at = own

    def end(self, tag: str) -> None:
        self.joins = False
        node = self.at
        while node is not None and node.tag != tag:
            if node.tag in SCOPE and tag != "table":
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def text(self, data: str) -> None:
        data = unescape(data) if "&" in data else data
        own = self.at.children
        if self.joins and own and isinstance(own[-1], str):
            own[-1] += data
        else:
            own.append(data)
        self.joins = True


def tree(html: str | None) -> Element:
    """The page as a tree. Whatever the markup, there is one: end tags without a start are ignored, open elements end
    with the page, cells and rows end where the next one starts, and tables keep what stands within them."""
    builder = _Builder()
    builder.feed(html or "")
    return builder.page


def own_rows(table: Element) -> list[Element]:
    """The rows of a table, without those of tables within it."""
    return [x for x in table.walk({"table"}) if not isinstance(x, str) and x.tag == "tr"]


def cells(row: Element, tags: tuple[str, ...]) -> list[Element]:
    return [x for x in row.walk({"table", "tr"}) if not isinstance(x, str) and x.tag in tags]


def _span(cell: Element, name: str, most: int) -> int:
    found = re.match(r"\s*\+?(\d{1,6})", cell.attrs.get(name, ""))
    return max(1, min(int(found[1]), most)) if found else 1


def grid(table: Element, tags: tuple[str, ...] = ("td", "th"), across: bool = True) -> list[list[Element]]:
    """The cells of each row of a table, a cell again in each row and column that it spans (spans of columns only if
    `across`; no span reaches beyond the table's last row, and none has more than a thousand columns)."""
    return spanned([cells(row, tags) for row in own_rows(table)], across)


def spanned[C: (Element, Cell)](rows: list[list[C]], across: bool = True) -> list[list[C]]:
    """Rows of cells as `grid` gives them, of those that stand in each row."""
    out: list[list[C]] = []
    held: dict[int, tuple[int, C]] = {}  # column: rows left, cell
    for k, row in enumerate(rows):
        line: list[C] = []

        def fill(line: list[C] = line) -> None:
            while len(line) in held:
                left, cell = held.pop(len(line))
                if left > 1:
                    held[len(line)] = left - 1, cell
                line.append(cell)

        now: dict[int, tuple[int, C]] = {}
        for cell in row:
            fill()
            down = _span(cell, "rowspan", len(rows) - k)
            for _ in range(_span(cell, "colspan", 1000) if across else 1):
                if down > 1:
                    now[len(line)] = down - 1, cell
                line.append(cell)
        fill()
        held |= now
        out.append(line)
    return out


def each(value: Column, kind: str, f: Callable, *others: Column) -> Column:
    """f of each text (and of other columns' values), null for a null text, in Arrow batches."""

    @F.arrow_udf(kind)
    def run(first: pa.Array, *more: pa.Array) -> pa.Array:
        columns = [first.to_pylist(), *(x.to_pylist() for x in more)]
        return pa.array([None if row[0] is None else f(*row) for row in zip(*columns, strict=True)], pa_type)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    pa_type = to_arrow_type(_parse_datatype_string(kind))
    return run(value, *others)


class Cell:
    """A cell read without a tree: its attributes, its texts and where its first link goes."""

    __slots__ = ("attrs", "link", "texts")

    def __init__(self, attrs: dict[str, str]):
        self.attrs = attrs
        self.texts: list[str] = []
        self.link: str | None = None

    def words(self) -> str:
        return " ".join("".join(self.texts).split())


#: What ends the search for elements that a start tag ends.
STOPS = {tag: SCOPE if tag in ("td", "th", "tr", "tbody", "thead", "tfoot") else SCOPE | LISTS | {"td", "th"} for tag in ENDED_BY}


def tables(html: str) -> Iterator[list[list[Cell]]]:
    """The rows (of td) of all tables of a page, in page order of the tables, read in one pass. Elements begin and end as
    in `tree`, but no tree is made: a row is the nearest table's, a cell the nearest row's, a text the nearest cell's
    unless a table stands between them, and a link is in all cells around it."""
    out: list[list[list[Cell]]] = []
    spans = False
    opened = ["#page"]
    rows, row, cell = None, None, None  # of the nearest table
    around: list[tuple] = []  # the same of the tables around it
    at, tokens, slashed = 0, TOKEN.finditer(html), ""
    while True:
        if slashed:  # ends as it starts
            tag, ends, slashed = slashed, True, ""
        else:
            found = next(tokens, None)
            if found is None:
                break
            start, end = found.span()
            if cell is not None and start > at:
                text = html[at:start]
                cell.texts.append(unescape(text) if "&" in text else text)
            at = end
            tag, ends, attrs, closed = TAGS.get(found[0]) or _tag(found)
            if not tag:
                continue
        k = left = len(opened)
        if ends:
            k -= 1
            while k and opened[k] != tag:
                if tag != "table" and opened[k] in SCOPE:
                    k = 0
                else:
                    k -= 1
            left = k or left
        elif tag in ENDED_BY:
            ended, stops = ENDED_BY[tag], STOPS[tag]
            k -= 1
            while opened[k] not in stops:
                if opened[k] in ended:
                    left = k
                k -= 1
        while len(opened) > left:
            name = opened.pop()
            if name in BLOCK:
                if name == "td":
                    cell = None
                elif name == "tr":
                    row = cell = None
                elif name == "table":
                    rows, row, cell = around.pop()
                if cell is not None:
                    cell.texts.append(" ")
        if ends:
            continue
        if tag == "td":
            if row is not None:
                cell = Cell(attrs)
                row.append(cell)
                spans = spans or "rowspan" in attrs
        elif tag == "tr":
            row = []
            if rows is not None:
                rows.append(row)
        elif tag == "a":
            if "href" in attrs:
                for own in (cell, *(x[2] for x in reversed(around))) if around else ():
                    if own is not None:
                        if own.link is not None:
                            break  # so those around it have one
                        own.link = attrs["href"]
        elif tag in BLOCK:
            if cell is not None:
                cell.texts.append(" ")
            if tag == "table":
                around.append((rows, row, cell))
                rows, row, cell = [], None, None
                out.append(rows)
        if tag not in VOID:
            opened.append(tag)
            if closed:
                slashed = tag
            elif tag in RAW:
                stop = re.compile(rf"</{tag}\b", re.I).search(html, at)
                until = stop.start() if stop else len(html)
                if cell is not None:
                    cell.texts.append(html[at:until])
                at = until
                tokens = TOKEN.finditer(html, at)
    if cell is not None and at < len(html):
        cell.texts.append(unescape(html[at:]))
    return (spanned(x, across=False) for x in out) if spans else iter(out)


def _rows(html: str, base: str | None) -> Iterator[tuple[list[str], str | None]]:
    """Texts of cells and the link of each row of a page's tables."""
    for rows in tables(html):
        for line in rows:
            link = None
            for cell in line:
                if cell.link is not None:
                    link = _joined(base, cell.link)
                    break
            yield [cell.words() for cell in line], link


#: Addresses and links whose join is the address's beginning and the link: no dots as folders, nothing to be resolved.
SITE, ABSOLUTE = re.compile(r"https?://[A-Za-z0-9.-]+(?=[/?#]|$)"), re.compile(r"/(?:[A-Za-z0-9_-][A-Za-z0-9_./-]*)?")


def _joined(base: str | None, link: str) -> str:
    link = link.strip()
    if base and ABSOLUTE.fullmatch(link) and "/." not in link and (site := SITE.match(base)):
        return site[0] + link
    try:
        return urljoin(base or "", link)
    except ValueError:
        return link


def table_rows(body: Column, url: Column) -> Column:
    """Rows of all tables of a page, in page order of their tables: the texts of their cells (td), where a cell that
    spans rows is in each of them, and the first link of a row, complete by the page's own address."""
    texts = pa.list_(pa.field("element", pa.string()))
    row = pa.struct([("cells", texts), ("link", pa.string())])

    @F.arrow_udf("array<struct<cells:array<string>,link:string>>")
    def run(bodies: pa.Array, urls: pa.Array) -> pa.Array:
        pages: list[int | None] = []  # where the rows of each page begin; null for a null page
        begins, words, links = [0], [], []
        for html, base in zip(bodies.to_pylist(), urls.to_pylist(), strict=True):
            pages.append(None if html is None else len(links))
            for line, link in () if html is None else _rows(html, base):
                words += line
                begins.append(len(words))
                links.append(link)
        cells = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(words, pa.string()), type=texts)
        rows = pa.StructArray.from_arrays([cells, pa.array(links, pa.string())], fields=list(row))
        return pa.ListArray.from_arrays(pa.array([*pages, len(links)], pa.int32()), rows, type=pa.list_(pa.field("element", row)))

    return run(body, url)


#: Elements that reading leaves out, and characters that a table or all tables, or the main part, must have.
LEFT_OUT = {"script", "style", "nav", "footer", "header", "noscript", "svg", "img", "link", "meta", "select", "option", "form"}
LEAST_TABLE, LEAST = 50, 200


def _lines(text: str) -> str:
    return "\n".join(filter(None, (re.sub("[ \t]+", " ", x).strip() for x in text.splitlines())))


def _cleaned(html: str) -> str:
    page = tree(html)

    def texts(part: Element, sign: str) -> str:
        return sign.join(x for x in part.walk(LEFT_OUT) if isinstance(x, str))

    parts = [x for x in page.walk(LEFT_OUT) if not isinstance(x, str)]
    tables = [" ".join(texts(x, " | ").split()) for x in parts if x.tag == "table"]
    listed = "\n\n".join(x for x in tables if len(x) > LEAST_TABLE)
    if len(listed) > LEAST:
        return _lines(listed)
    for test in (lambda x: x.tag == "main", lambda x: x.tag == "article", lambda x: x.attrs.get("role") == "main"):
        found = next((x for x in parts if test(x)), None)
        if found is not None:
            text = texts(found, "\n")
            if len(text) > LEAST:
                return _lines(text)
            break
    return _lines(texts(page, "\n"))


def clean_html(html: Column, most: int = 6000) -> Column:
    """The text of a page for reading, character references decoded; null stays null. Elements that aren't read go
    (LEFT_OUT). Tables come first (over 50 characters each, over 200 in all; their texts joined by " | "; a table within
    another is in both); else the first main, else article, else element of role main, with over 200 characters; else
    the page. Blank lines and repeated blanks go. `most` characters are kept, which is what the reader of these texts
    takes."""
    return F.substring(each(html, "string", _cleaned), 1, most)
