"""Rules and icons from wiki pages with tables of tags.

One reader turns a page into rows of cells, whatever the table; a cell is a list of marks in the order of the page: text,
code, line break, link, picture. What a cell says is then read off its marks by a small grammar.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import slug
from ..operators.rules import Rule


class Mark(NamedTuple):
    sort: str  # text, code, br, link, img
    value: str
    more: str = ""  # a picture's list of larger ones


@dataclass
class Row:
    table: int  # number of the table on the page
    classes: frozenset[str]
    cells: list[list[Mark]] = field(default_factory=list)
    head: bool = False

    def text(self, i: int) -> str:
        return "".join(m.value for m in self.cells[i] if m.sort in ("text", "code")).strip() if i < len(self.cells) else ""


class _Reader(HTMLParser):
    """Rows of all tables of a page. Tables may stand in cells of others; ends of cells and rows may be left out."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[Row] = []
        self.seen = 0
        #: For each open table: its number, its classes, the open row, the open cell.
        self.open: list[list] = []
        self.code: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "table":
            self.open.append([self.seen, frozenset(a.get("class", "").split()), None, None])
            self.seen += 1
        if not self.open:
            return
        at = self.open[-1]
        if tag == "tr":
            at[2], at[3] = Row(at[0], at[1]), None
            self.rows.append(at[2])
        elif tag in ("td", "th") and at[2] is not None:
            at[3] = []
            at[2].head |= tag == "th"
            if tag == "td":
                at[2].cells.append(at[3])
        elif tag == "code":
            self.code = []
        elif tag == "br":
            self.put(Mark("br", ""))
        elif tag == "img":
            self.put(Mark("img", a.get("src", ""), a.get("srcset", "")))
        elif tag == "a" and "mw-file-description" in a.get("class", "").split():
            self.put(Mark("link", a.get("href", "")))

    def handle_endtag(self, tag: str) -> None:
        if tag == "code" and self.code is not None:
            text, self.code = "".join(self.code), None
            self.put(Mark("code", text))
        elif tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th") and self.open:
            self.open[-1][3] = None

    def handle_data(self, data: str) -> None:
        if self.code is not None:
            self.code.append(data)
        else:
            self.put(Mark("text", data))

    def put(self, mark: Mark) -> None:
        for at in self.open:  # what stands in an inner table belongs to the cells around it too
            if at[3] is not None:
                at[3].append(mark)


def rows(html: str) -> list[Row]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.rows


# cell := combination (divider combination)*; divider := line break | text with a slash; combination := tag+
def tag_combinations(cell: list[Mark]) -> list[list[str]]:
    """Alternatives (divided by '/' or a line break) of tags that must hold together."""
    signs = []
    for m in cell:
        tag = re.sub(r"\s*\n\s*", "", m.value).strip()
        if m.sort == "code" and "=" in tag:
            signs.append(tag)
        elif m.sort == "br" or m.sort == "text" and "/" in m.value:
            signs.append(None)
    out: list[list[str]] = [[]]
    for s in signs:
        if s is None:
            out.append([])
        else:
            out[-1].append(s)
    return [c for c in out if c]


_FILE = re.compile(r"(?:\d+px-)?(?:File:)?(?P<stem>.*?)(?P<sizes>(?:[-_.\s]\d+(?:px)?)*)(?:\.(?:svg|png|gif))*", re.I | re.S)


def icon_name(raw: str) -> tuple[str, str | None]:
    """Stem and size of the file that an icon's address names."""
    m = _FILE.fullmatch(raw.partition("?")[0].rpartition("/")[2])
    sizes = re.findall(r"\d+", m["sizes"]) if m else []
    return (m["stem"] if m else raw), (sizes[-1] if sizes else None)


def _address(cell: list[Mark]) -> str:
    """The file behind the cell's picture: its own page, or the picture itself."""
    return next((m.value for sort in ("link", "img") for m in cell if m.sort == sort and m.value), "")


def _named(cell: list[Mark]) -> str:
    stem, size = icon_name(_address(cell))
    return f"{stem}-{size}" if stem and size else stem


def categories(html: str) -> list[dict]:
    """(icon, description, combinations) of the rows with three cells or more of the first table of tags."""
    tables = [r for r in rows(html) if "wikitable" in r.classes]
    if not tables:
        raise ValueError("no table of tags")
    entries = [(r, tag_combinations(r.cells[2])) for r in tables if r.table == tables[0].table and len(r.cells) > 2]
    return [{"icon": _named(r.cells[0]), "description": r.text(1), "combinations": c} for r, c in entries if c]


def place_types(html: str) -> list[dict]:
    """One entry for each value of the key place, at its first occurrence."""
    listed = [r for r in rows(html) if {"wikitable", "taginfo-taglist"} <= r.classes]
    if not listed:
        raise ValueError("no table of places")
    out: dict[str, dict] = {}
    for value, about in ((r.text(1), r.text(3)) for r in listed if not r.head and r.text(0) == "place" and r.text(1)):
        out.setdefault(value, {"icon": value, "description": about or value, "combinations": [[f"place={value}"]]})
    return list(out.values())


def rules(entries: list[dict]) -> list[Rule]:
    """Ordered rules of entries; '*' as a value asks only for the key."""
    condition = lambda t: tuple(p.strip() for p in t.split("=", 1))
    return [(tuple(map(condition, combo)), slug(e["icon"] or e["description"])) for e in entries for combo in e["combinations"]]


def largest(picture: Mark) -> str:
    """The address of the largest picture on offer ('address 2x, address 300w')."""
    offers = [(float(m[2] or 1), m[1]) for m in re.finditer(r"([^\s,]\S*)(?:\s+([\d.]+)[xw])?\s*(?:,|$)", picture.more)]
    return max(offers, key=lambda o: o[0])[1] if offers else picture.value


def vector_address(shown: str, base: str, file: str) -> str | None:
    """The vector image that a rendered picture was made from, or the page that leads to the named file; None without one."""
    if not shown:
        return None
    url = urlparse(urljoin(base, shown))
    path = re.sub(r"/thumb(/.*\.svg)/[^/]*$", r"\1", url.path).removesuffix(".png")
    if path.endswith(".svg"):
        return url._replace(path=path, query="", fragment="").geturl()
    name = file.partition("?")[0].rpartition("/")[2].removeprefix("File:")
    return urljoin(base, f"/wiki/Special:FilePath/{name}") if name.endswith(".svg") else None


def _file_name(address: str, url: str) -> str:
    stem, size = icon_name(address)
    name = slug(f"{stem}-{size}" if size else stem) or slug(urlparse(url).path.rpartition("/")[2].removesuffix(".svg") or "icon")
    tidied = re.sub(r"_(\d+)px$", r"_\1", re.sub(r"_svg(?=_|$)", "", name)).rstrip("_")
    return f"{tidied or name}.svg"


def icons(html: str, base: str) -> dict[str, str]:
    """{file name: address} of the icons in the first cell of table rows; the first occurrence of a name counts."""
    out: dict[str, str] = {}
    for row in rows(html):
        picture = next((m for m in (row.cells[0] if row.cells else ()) if m.sort == "img"), None)
        if picture is not None:
            address = _address(row.cells[0])
            url = vector_address(largest(picture), base, address)
            if url:
                out.setdefault(_file_name(address, url), url)
    return out


def _over_pages(pages: DataFrame, read: Callable[[str], list[tuple]], columns: list[str], types: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(page, *r) for page, html in zip(b["page_id"], b["html"], strict=True) for r in read(html or "")]
            yield pd.DataFrame(found, columns=["page_id", *columns])

    return pages.select("page_id", "html").mapInPandas(run, types)


def icon_table(pages: DataFrame, base: str) -> DataFrame:
    """(page_id, file, url) of pages (page_id, html); pages without icons give nothing."""
    return _over_pages(pages, lambda html: list(icons(html, base).items()), ["file", "url"], "page_id long, file string, url string")


def page_rules(html: str) -> list[Rule]:
    """The rules of a page with a table of tags or, failing that, of places."""
    for read in (categories, place_types):
        try:
            return rules(read(html))
        except ValueError:
            continue
    return []


def rule_table(pages: DataFrame) -> DataFrame:
    """(page_id, rule_no, conditions array<struct<key,value>>, category) of pages with a table of tags; others give nothing."""
    read = lambda html: [(i, [{"key": k, "value": v} for k, v in conditions], name) for i, (conditions, name) in enumerate(page_rules(html))]
    return _over_pages(pages, read, ["rule_no", "conditions", "category"], "page_id long, rule_no int, conditions array<struct<key:string,value:string>>, category string")
