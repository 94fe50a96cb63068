"""Page parsing: links, cards, label/value tables, embedded state. Regular expressions where they do; a small
tree reader, run by Spark over Arrow batches, where nesting matters."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Links(HTMLParser):
    """(href, text) of anchors, and the title; text inside scripts and styles doesn't count."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[list[str]] = []
        self.open: list[str] = []
        self.title = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in VOID:
            self.open.append(tag)
        if tag == "a":
            self.links.append([dict(attrs).get("href") or "", ""])

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] in ("script", "style"):
            return
        if "title" in self.open:
            self.title += data
        if "a" in self.open and self.links:
            self.links[-1][1] += data


class _Cells(HTMLParser):
    """(label, value) of two-cell table rows and of dt/dd pairs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("tr", "dt"):
            self.rows.append([])
        if tag in ("td", "th", "dt", "dd") and self.rows:
            self.rows[-1].append("")
            self.cell = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "dt", "dd"):
            self.cell = False

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.rows[-1][-1] += data


def page_links(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, position, href, text of every link of every page, read as a tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch[id_col], batch[html]):
                parser = _Links()
                parser.feed(text or "")
                rows += [(key, i, href, " ".join(label.split())) for i, (href, label) in enumerate(parser.links)]
            yield pd.DataFrame(rows, columns=[id_col, "position", "href", "text"])

    return pages.select(id_col, html).mapInPandas(run, f"{id_col} long, position int, href string, text string")


def label_values(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, label, value, n: rows of detail tables; a label that repeats is numbered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch[id_col], batch[html]):
                parser = _Cells()
                parser.feed(text or "")
                seen: dict[str, int] = {}
                for cells in parser.rows:
                    if len(cells) == 2 and cells[0].strip():
                        label = " ".join(cells[0].split())
                        seen[label] = seen.get(label, 0) + 1
                        rows.append((key, label, " ".join(cells[1].split()), seen[label]))
            yield pd.DataFrame(rows, columns=[id_col, "label", "value", "n"])

    return pages.select(id_col, html).mapInPandas(run, f"{id_col} long, label string, value string, n int")


def embedded_json(text: Column, marker: str) -> Column:
    """The JSON value that follows a marker in a page's script (nothing is evaluated), as text; NULL if there is none."""

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def one(page: str | None) -> str | None:
            at = (page or "").find(marker)
            while at >= 0:
                start = next((i for i in range(at + len(marker), len(page)) if page[i] in "{["), -1)
                if start < 0:
                    return None
                try:
                    return page[start : decoder.raw_decode(page, start)[1]]
                except ValueError:
                    at = page.find(marker, at + 1)
            return None

        return pages.map(one)

    return of(text)


def product_cards(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """Cards by expressions: title and advantages of each block of class product-card; first of equal titles wins; a page without cards gives none."""
    blocks = F.filter(F.split(html, r'(?i)<(?:div|article)[^>]*class="[^"]*product-card[^"]*"[^>]*>'), lambda b: b != "")
    cards = pages.select(id_col, F.posexplode(F.slice(blocks, 2, F.size(blocks))).alias("pos", "card"))
    title = F.trim(F.regexp_replace(F.regexp_extract("card", r"(?is)<h\d[^>]*>(.*?)</h\d>", 1), r"<[^>]*>", ""))
    values = F.transform(F.regexp_extract_all("card", F.lit(r'(?is)class="[^"]*advantage[^"]*"[^>]*>(.*?)</'), F.lit(1)), lambda v: F.trim(F.regexp_replace(v, r"<[^>]*>", " ")))
    found = cards.select(id_col, "pos", title.alias("title"), values.alias("advantages")).where("title <> ''")
    first = found.groupBy(id_col, "title").agg(F.min_by(F.struct("pos", "advantages"), "pos").alias("c"))
    return first.select(id_col, "title", "c.pos", "c.advantages")


def key_rates(pages: DataFrame, html: str = "html") -> DataFrame:
    """(day, rate) rows of a published table of dd.mm.yyyy and nn,nn cells."""
    pattern = r"<td>(\d{2}\.\d{2}\.\d{4})</td>\s*<td>(\d{1,2},\d{2})</td>"
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("d"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("r"))
    rows = pages.select(F.explode(pairs).alias("p"))
    return rows.select(F.to_date("p.d", "dd.MM.yyyy").alias("day"), F.regexp_replace("p.r", ",", ".").cast("double").alias("rate"))
