"""Credit pages and award pages, read in Arrow batches over a small tree that an element stack builds.

A page's function sees one page; Spark deals pages out, and dates, roles, levels and units are column functions on what comes
back. Plain markup is cut by one pattern; pages with anything else in them go through the standard parser. Award pages with nothing
but rows of the usual layout need no tree. A closing tag closes what is open above its own; one without an opening tag is ignored, as are scripts and styles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crategraph.functions import catalog, parse
from crategraph.shared import whole_text_batches
from crategraph.sources.pages import level_of_image, units_of_level

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style"))


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict, parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def like(self, tag: str, word: str) -> bool:
        """Whether it is such an element with the word somewhere in its class."""
        return self.tag == tag and word in (self.attrs.get("class") or "")

    def of_class(self, tag: str, name: str) -> bool:
        return self.tag == tag and name in (self.attrs.get("class") or "").split()

    def walk(self) -> Iterator[Element]:
        """Elements below, in the page's order."""
        todo = self.children[::-1]
        while todo:
            x = todo.pop()
            if x.__class__ is Element:
                yield x
                if x.children:
                    todo += x.children[::-1]

    def first(self, fits: Callable[[Element], bool]) -> Element | None:
        return next((x for x in self.walk() if fits(x)), None)

    def strings(self, skip: Callable[[Element], bool] = lambda x: False, line: str | None = None) -> Iterator[str]:
        """Texts below, without those in skipped elements; ``line`` for each br."""
        todo = [iter(self.children)]
        while todo:
            x = next(todo[-1], None)
            if x is None:
                todo.pop()
            elif isinstance(x, str):
                yield x
            elif x.tag == "br" and line is not None:
                yield line
            elif x.tag not in SILENT and not skip(x):
                todo.append(iter(x.children))

    def text(self, between: str = "", skip: Callable[[Element], bool] = lambda x: False) -> str:
        """Its texts without blanks around each, joined."""
        if len(self.children) == 1 and isinstance(self.children[0], str):
            return self.children[0].strip()
        return between.join(s for s in map(str.strip, self.strings(skip)) if s)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        x = Element(tag, dict(attrs), self.stack[-1])
        self.stack[-1].children.append(x)
        if tag not in VOID:
            self.stack.append(x)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(Element(tag, dict(attrs), self.stack[-1]))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


#: A tag with quoted attributes or a text, neither with references; elements whose content is no markup are left to the parser.
_ATTRIBUTE = r'([a-z][a-z-]*)="([^"<>&\0]*)"'
_OPAQUE = "script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext"
PLAIN = re.compile(r'<(?:/([a-z][a-z0-9]*)|(?!(?:' + _OPAQUE + r')[ >])([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"<>&\0]*")*))>|([^<&\0]+)')
WHOLE = re.compile("(?:" + re.sub(r"(?<!\[)\((?!\?)", "(?:", PLAIN.pattern) + ")*+")
ATTRIBUTES = re.compile(_ATTRIBUTE)


@lru_cache(4_096)
def _attributes(text: str) -> dict:
    return dict(ATTRIBUTES.findall(text))


def tree(html: str | None) -> Element:
    html = html or ""
    return _plain_tree(html) if WHOLE.fullmatch(html) else _parsed_tree(html)


def _plain_tree(html: str) -> Element:
    top = root = Element("", {}, None)
    for end, tag, attrs, text in PLAIN.findall(html):
        if text:
            top.children.append(text)
        elif tag:
            x = Element(tag, _attributes(attrs) if attrs else {}, top)
            top.children.append(x)
            if tag not in VOID:
                top = x
        else:
            x = top
            while x is not root and x.tag != end:
                x = x.parent
            if x is not root:
                top = x.parent
    return root


def _parsed_tree(html: str) -> Element:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def _read(pages: DataFrame, id_col: str, html_col: str, read: Callable[[str], Iterator[tuple]], kind: str) -> DataFrame:
    """(page_id, then ``kind``): the rows that ``read`` makes of each page. A null page is read as an empty one."""
    whole_text_batches(pages.sparkSession)
    narrow = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    empty = pages.sparkSession.createDataFrame([], kind)
    out = pa.schema([_arrow(f) for f in empty.schema])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES):
                part = batch.slice(start, PAGES)
                at, made = [], []
                for k, html in enumerate(part.column("html").to_pylist()):
                    found = list(read(html))
                    made += found
                    at += [k] * len(found)
                columns = list(zip(*made)) if made else [()] * len(out)
                ids = part.column("page_id").take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns, out))], names=["page_id", *out.names])

    return narrow.mapInArrow(rows, f"page_id {narrow.schema['page_id'].dataType.simpleString()}, {kind}")


#: Pages whose rows are held at once.
PAGES = 256


def _arrow(field) -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.field(field.name, to_arrow_type(field.dataType))


#: Class words, labels that are no credits, and the separators of names, in the order they are tried.
CREDIT, CREDIT_LABEL, CREDIT_NAMES = "Credit__Container", "Credit__Label", "Credit__Contributor"
OLD_CREDIT, OLD_LABEL = "SongInfo__Credit", "SongInfo__Label"
NO_CREDITS = ("album", "released on", "release date", "genre", "tags")
NAME_SEPARATORS = (" & ", ", ", " and ", " + ", " / ")
ALBUM_ZONES = ("HeaderArtistAndTracklist", "AlbumTracklist")
ABOUT = ("SongDescription__Content", "RichText__Container")
ADVERTS = ("InreadAd", "SidebarAd", "RightSidebar", "LyricsHeader", "Ad__Container")


def names_in(box: Element) -> list[str]:
    """Names of a credit: linked ones, then those of the box's own text."""
    found = [x.text() for x in box.walk() if x.tag == "a"]
    for own in (s.strip() for s in box.children if isinstance(s, str)):
        separator = next((s for s in NAME_SEPARATORS if s in own), None)
        if own not in found:
            found += [own] if separator is None else [x.strip() for x in own.split(separator)]
    return [x for x in dict.fromkeys(found) if len(x) > 1]


def credits_in(page: Element) -> list[tuple[str, str]]:
    """(label, name) of a page's credits, in the present layout or else the older one."""

    def listed(boxes: str, labels: str, names: Callable[[Element, Element], Element | None]) -> list[tuple[str, str]]:
        out = []
        for box in [x for x in page.walk() if x.like("div", boxes)]:
            label = box.first(lambda x: x.like("div", labels))
            who = label and names(box, label)
            if who and label.text().lower() not in NO_CREDITS:
                out += [(label.text(), n) for n in names_in(who)]
        return out

    def beside(_, label: Element) -> Element | None:
        at = label.parent.children
        return next((x for x in at[at.index(label) + 1 :] if isinstance(x, Element) and x.tag == "div"), None)

    return listed(CREDIT, CREDIT_LABEL, lambda box, _: box.first(lambda x: x.like("div", CREDIT_NAMES))) or listed(OLD_CREDIT, OLD_LABEL, beside)


def lyrics_in(page: Element) -> str:
    """Text of the lyrics containers, parted by an empty line; breaks end lines, headers and adverts are left out."""
    boxes = [x for x in page.walk() if x.tag == "div" and x.attrs.get("data-lyrics-container") == "true"] or [x for x in page.walk() if x.like("div", "Lyrics__Container")]
    skip = lambda x: x.attrs.get("data-exclude-from-selection") == "true" or x.tag == "div" and any(w in (x.attrs.get("class") or "") for w in ADVERTS)
    texts = ["".join(x.strings(skip, "\n")) for x in boxes]
    lines = "\n\n".join(t.strip("\n") for t in texts if t.strip()).split("\n")
    text = "\n".join("" if x.startswith("You might also like") else x for x in lines)
    ends = re.search(r"\n?\d*Embed\s*$", text)
    text = text[: ends.start()] if ends else text
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def album_in(page: Element) -> str | None:
    """Name in the first album link of the header, of the track list, or anywhere; without its year."""
    link = lambda x: x.tag == "a" and "/albums/" in (x.attrs.get("href") or "")
    zones = [[z for z in page.walk() if z.like("div", word)] for word in ALBUM_ZONES]
    for zone in [*zones, [page]]:
        found = next((x for z in zone for x in [z.first(link)] if x), None)
        name = re.sub(r"\s*\(\d{4}\)\s*$", "", found.text(" ")).strip() if found else ""
        if 0 < len(name) < 150:
            return name
    return None


def about_in(page: Element) -> str | None:
    """The page's prose about the song, of more than 50 characters."""
    for word in ABOUT:
        box = page.first(lambda x, w=word: x.like("div", w))
        text = box.text(" ", lambda x: x.like("div", "embedly")) if box else ""
        if len(text) > 50:
            return " ".join(text.split())
    return None


def page_parts(html: str) -> Iterator[tuple]:
    """(kind, pos, label, value) of a page's credits, lyrics, album and prose."""
    page = tree(html)
    for k, (label, name) in enumerate(credits_in(page)):
        yield "credit", k, label, name
    for kind, value in (("lyrics", lyrics_in(page)), ("album", album_in(page)), ("about", about_in(page))):
        if value:
            yield kind, 0, None, value


def song_page_parts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, kind, pos, role, detail, value): credits with their canonical role, each once, and lyrics, album and about of
    each page. A null page gives nothing."""
    found = _read(pages, id_col, html_col, page_parts, "kind string, pos int, label string, value string")
    credit = F.col("kind") == "credit"
    df = found.withColumns({"role": F.when(credit, catalog.role_name(F.col("label"))), "detail": F.when(credit, catalog.role_detail(F.col("label")))})
    return df.groupBy("page_id", "kind", "role", "detail", "value").agg(F.min("pos").alias("pos"))


#: An award row as it is usually laid out with the detail table behind it, or what may stand between such rows, or all that is left.
_TEXT, _VALUE, _GAP = r"([^<&\0]*+)", r'([^"<>&\0]*+)', r"\s*+"
_CELL = r'<td(?: class="[^"<>&\0]*+")?+>'
STEP = re.compile(_GAP.join((r'<tr class="content_recent_table">', f"{_CELL}{_TEXT}</td>", f"{_CELL}{_TEXT}(?:<b>{_TEXT}</b>)?+</td>", "</tr>")))
_STEPS = "((?:" + _GAP + re.sub(r"\((?!\?)", "(?:", STEP.pattern) + ")*+)"
USUAL = re.compile(
    _GAP.join((
        r'<tr class="table_award_row" id="(default_[^"<>&\0]*+)">', f'<td><img class="award" src="{_VALUE}"></td>', f'<td class="artists_cell">{_TEXT}</td>', *[f'<td class="others_cell">{_TEXT}</td>'] * 3,
        f'<td class="format_cell">{_TEXT}(?:<a>{_TEXT}</a>)?+</td>', "</tr>(?:", "<tr>", "<td>", f'<table id="{_VALUE}">{_STEPS}', "</table>", "</td>", "</tr>)?+",
    ))
    + r'|</?table>|\s++|((?s:.+))'
)


def _usual_rows(html: str) -> tuple | None:
    """What ``_any_rows`` gives, of a page with nothing but usual rows; None of any other."""
    rows, details = [], {}
    for rid, picture, artist, title, day, publisher, form, more, name, steps, left in USUAL.findall(html):
        if left:
            return None
        if rid:
            rows.append((rid, picture, artist.strip(), title.strip(), day.strip(), publisher.strip(), form.strip() + more.strip()))
            details[name] = steps
    return rows, details, lambda steps: [(first.strip(), second.strip() + bold.strip()) for first, second, bold in STEP.findall(steps)]


def _any_rows(html: str) -> tuple:
    """(id, picture, artist, title, day, publisher, form) of each award row, details by their ids, and what gives the cells of a
    detail's rows."""
    details, found = {}, []
    for x in tree(html).walk():
        if (x.attrs.get("id") or "").endswith("_detail"):
            details[x.attrs.get("id")] = x
        if x.tag == "tr" and x.of_class("tr", "table_award_row"):
            found.append(x)
    rows = []
    for row in found:
        cells: dict[str, list[Element]] = {"artists_cell": [], "others_cell": [], "format_cell": []}
        picture = None
        for x in row.walk():
            if x.tag == "td":
                for name in dict.fromkeys((x.attrs.get("class") or "").split()):
                    if name in cells:
                        cells[name].append(x)
            elif picture is None and x.of_class("img", "award"):
                picture = x
        artist, form = (cells[name][0].text() if cells[name] else "" for name in ("artists_cell", "format_cell"))
        title, day, publisher, *_ = [*(x.text() for x in cells["others_cell"]), "", "", ""]
        rows.append((row.attrs.get("id") or "", picture.attrs.get("src") if picture else None, artist, title, day, publisher, form))
    return rows, details, lambda detail: [[x.text() for x in row.walk() if x.tag == "td"] for row in detail.walk() if row.of_class("tr", "content_recent_table")]


def award_rows_in(html: str) -> Iterator[tuple]:
    """(pos, artist, title, day, publisher, form, picture, history) of a page's award rows, each with the entries (level, day,
    released) of its detail table."""
    rows, details, cells = _usual_rows(html) or _any_rows(html)
    pos = 0
    for rid, picture, artist, title, day, publisher, form in rows:
        if artist and title:
            rid = rid.replace("default_", "")
            detail = details.get(f"recent_{rid}_detail") if rid else None
            yield pos, artist, title, day, publisher, form.replace("MORE DETAILS", "").strip(), picture, entries_of(cells(detail), day) if detail else []
            pos += 1


def entries_of(rows: list[Sequence[str]], day: str) -> list[tuple[str, str, str]]:
    """(level, day, released) of the cells of a detail table's rows: 'level | day' in one cell, else the level in the second and
    the award's own day; a row without a level gives none."""
    out = []
    for cells in rows:
        both = [c for c in cells if "|" in c]
        if not both and len(cells) < 2:
            continue
        level, _, on = both[0].partition("|") if both else (cells[1], "", day)
        if level := level.strip():
            out.append((level, on.strip(), cells[0]))
    return out


def award_steps_in(html: str) -> Iterator[tuple]:
    """(pos, artist, title, day, picture, step, level, day, released) for each entry of a page's award rows; the last four are None
    for a row without entries."""
    for pos, artist, title, day, _, _, picture, entries in award_rows_in(html):
        for step, entry in enumerate(entries) if entries else [(None, (None, None, None))]:
            yield pos, artist, title, day, picture, step, *entry


def award_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, pos, artist, title, day, publisher, form, level, units, history) of award pages; history is an array of
    struct<level, day, released, units> in the page's order. Days are ISO where they can be read."""
    kind = "pos int, artist string, title string, day string, publisher string, form string, picture string, history array<struct<level:string,day:string,released:string>>"
    found = _read(pages, id_col, html_col, award_rows_in, kind)
    level = F.coalesce(level_of_image(F.col("picture")), F.lit(""))
    entry = lambda x: F.struct(x["level"].alias("level"), parse.iso_date(x["day"]).alias("day"), parse.iso_date(x["released"]).alias("released"), units_of_level(x["level"]).alias("units"))
    return found.select("page_id", "pos", "artist", "title", parse.iso_date(F.col("day")).alias("day"), "publisher", "form", level.alias("level"), units_of_level(level).alias("units"), F.transform("history", entry).alias("history"))


def award_history(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each entry of each award row's history, and one with nulls for a row without any."""
    kind = "pos int, artist string, title string, day string, picture string, step int, step_level string, step_day string, released string"
    found = _read(pages, id_col, html_col, award_steps_in, kind).withColumn("level", F.coalesce(level_of_image(F.col("picture")), F.lit("")))
    of_step = lambda c: F.when(F.col("step").isNotNull(), parse.iso_date(F.col(c))).alias(c)
    return found.select("page_id", "pos", "artist", "title", parse.iso_date(F.col("day")).alias("day"), "level", units_of_level(F.col("level")).alias("units"), "step", "step_level", of_step("step_day"), of_step("released"), units_of_level(F.col("step_level")).alias("step_units"))
