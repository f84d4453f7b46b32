"""Rows out of web pages. Spark deals the pages out; a small parser from the standard library walks each one's tags."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crategraph.functions import parse


class _Walk(HTMLParser):
    """A page's events as a flat list: ('open', tag, attributes), ('close', tag), ('text', data)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("open", tag, dict(attrs)))

    def handle_startendtag(self, tag, attrs):
        self.events.append(("open", tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.events.append(("close", tag))

    def handle_data(self, data):
        self.events.append(("text", data))


def events(html: str | None) -> list[tuple]:
    walk = _Walk()
    walk.feed(html or "")
    walk.close()
    return walk.events


def parsed(pages: DataFrame, id_col: str, html_col: str, row: Callable[[str | None], list[dict]], schema: str) -> DataFrame:
    """(id, pos, ...) for each row that ``row`` finds in a page."""
    fields = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[i, k, *(r.get(f) for f in fields)] for i, h in zip(batch["id"], batch["html"]) for k, r in enumerate(row(h))]
            yield pd.DataFrame(rows, columns=["id", "pos", *fields])

    narrow = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"))
    return narrow.mapInPandas(run, f"id long, pos long, {schema}")


def table_cells(html: str | None, css: str | None = None) -> list[list[tuple[str, str | None]]]:
    """Rows of a page's tables (of one class, if given): each cell's text and its first link."""
    rows, cell, inside = [], None, css is None
    for e in events(html):
        if e[0] == "open" and e[1] == "table":
            inside = css is None or css in (e[2].get("class") or "").split()
        elif e == ("close", "table"):
            inside = css is None
        elif inside and e[:2] == ("open", "tr"):
            rows.append([])
        elif inside and e[0] == "open" and e[1] in ("td", "th") and rows:
            cell = ["", None]
            rows[-1].append(cell)
        elif e[0] == "close" and e[1] in ("td", "th"):
            cell = None
        elif cell is not None and e[0] == "text":
            cell[0] += e[1]
        elif cell is not None and e[0] == "open" and e[1] == "a" and cell[1] is None:
            cell[1] = e[2].get("href")
    return [[(c[0].strip(), c[1]) for c in r] for r in rows if r]


def stream_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, pos, title, streams, daily, external_id, is_feature) of stream tables of class addpos: a leading * marks a
    feature, a row without link is skipped, an empty daily count is 0."""

    def rows(html: str | None) -> list[dict]:
        out = []
        for cells in table_cells(html, "addpos"):
            link = re.search(r"/track/([A-Za-z0-9]+)", cells[0][1] or "") if cells else None
            if link:
                text = cells[0][0]
                out.append({"title": text.lstrip("*").strip(), "streams": cells[1][0] if len(cells) > 1 else "", "daily": cells[2][0] if len(cells) > 2 else "", "external_id": link[1], "is_feature": text.startswith("*")})
        return out

    df = parsed(pages, id_col, html_col, rows, "title string, streams string, daily string, external_id string, is_feature boolean")
    return df.withColumns({"streams": parse.digits(F.col("streams")), "daily": F.coalesce(parse.digits(F.col("daily")), F.lit(0))})


def certification_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Seven fields of each block of class certification; one without artist, title, level or date is dropped."""
    names = ("artist", "title", "publisher", "category", "level", "release_date", "date")

    def rows(html: str | None) -> list[dict]:
        out, field = [], None
        for e in events(html):
            css = (e[2].get("class") or "").split() if e[0] == "open" else []
            if "certification" in css:
                out.append({})
            elif out and e[0] == "open":
                field = next((n for n in names if n in css), field if e[1] in ("b", "i", "em", "strong", "a", "span") else None)
            elif e[0] == "close" and e[1] in ("div", "p", "td", "li"):
                field = None
            elif out and field and e[0] == "text":
                out[-1][field] = (out[-1].get(field, "") + e[1]).strip()
        return [r for r in out if all(r.get(n) for n in ("artist", "title", "level", "date"))]

    return parsed(pages, id_col, html_col, rows, ", ".join(f"{n} string" for n in names))


def level_of_image(src: Column) -> Column:
    """Level of an award picture such as 3_big.png: its number is 0 for gold, 1 for platinum, 10 for diamond, else how many
    times platinum; null without one."""
    n = F.regexp_extract(src, r"(\d+)_big", 1).try_cast("int")
    return F.when(n == 0, "Gold").when(n == 1, "Platinum").when(n == 10, "Diamond").when(n.isNotNull(), F.concat(n, F.lit("x Platinum")))


def units_of_level(level: Column) -> Column:
    """Units a US level stands for: half a million gold, a million for each platinum, ten for diamond."""
    times = F.regexp_extract(level, r"^(\d+)\s*x", 1).try_cast("int")
    low = F.lower(level)
    return F.when(low.contains("diamond"), 10_000_000).when(low.contains("platinum"), F.coalesce(times, F.lit(1)) * 1_000_000).when(low.contains("gold"), 500_000)


def split_names(text: Column) -> Column:
    """Names of a credit line: parts between &, commas, plus signs, slashes and 'and'."""
    return F.filter(F.transform(F.split(text, r"\s*(?:&|,|\+|/|\band\b)\s*"), lambda x: F.trim(x)), lambda x: x != "")


def page_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """title, heading, paragraphs and links of each page; scripts and styles don't count."""

    def rows(html: str | None) -> list[dict]:
        out = {"title": None, "heading": None, "paragraphs": 0, "links": 0}
        where = None
        for e in events(html):
            if e[0] == "open":
                out["paragraphs"] += e[1] == "p"
                out["links"] += e[1] == "a"
                where = e[1] if e[1] in ("title", "h1", "script", "style") else where
            elif e[0] == "close" and e[1] == where:
                where = None
            elif e[0] == "text" and where in ("title", "h1"):
                name = "title" if where == "title" else "heading"
                out[name] = (out[name] or "") + e[1]
        return [out]

    return parsed(pages, id_col, html_col, rows, "title string, heading string, paragraphs long, links long").drop("pos")


def numbers_occur(values: Column, page: Column) -> Column:
    """Whether every number of an extraction occurs in the page it was taken from."""
    digits = F.regexp_replace(page, r"\D", "")
    return F.forall(F.regexp_extract_all(values, F.lit(r"\d[\d., ]*"), F.lit(0)), lambda n: F.contains(digits, F.regexp_replace(n, r"\D", "")))
