"""Web pages: links, images and visible text; embedded JSON."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements that are not shown, and those that end a line.
HIDDEN = frozenset({"script", "style", "noscript"})
BLOCKS = frozenset({"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "section", "article", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6"})


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[str] = []
        self.images: list[str] = []
        self.pieces: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in BLOCKS:
            self.pieces.append("\n")
        if tag == "a" and given.get("href"):
            self.links.append(given["href"])
        if tag == "img" and (given.get("src") or given.get("data-src")):
            self.images.append(given.get("src") or given["data-src"])

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.pieces.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.pieces.append(data)

    def text(self) -> str:
        lines = (" ".join(x.split()) for x in "".join(self.pieces).split("\n"))
        return "\n".join(x for x in lines if x)


def read_page(html: str | None) -> tuple[list[str], list[str], str]:
    """Links, images and visible text of a page; markup that breaks off is read as far as it goes."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.links, reader.images, reader.text()


def parse_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, links, images, text."""

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            read = [read_page(h) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "links": [r[0] for r in read], "images": [r[1] for r in read], "text": [r[2] for r in read]})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    return rows.mapInPandas(over, "page_id long, links array<string>, images array<string>, text string")


def decode_page(raw: bytes) -> str:
    """UTF-8, or the Western code page if that has fewer characters that cannot be read."""
    return min((raw.decode(c, "replace") for c in ("utf-8", "cp1252")), key=lambda t: t.count("�"))


def embedded_json(html: Column, element_id: str = "__NEXT_DATA__") -> Column:
    """The JSON text of a script element; null without it."""
    return F.nullif(F.regexp_extract(html, rf'(?s)<script[^>]*id="{element_id}"[^>]*>(.*?)</script>', 1), F.lit(""))


def property_data(html: Column) -> Column:
    """The listing in a page's embedded JSON, as a variant."""
    return F.try_variant_get(F.try_parse_json(embedded_json(html)), "$.props.pageProps.data", "variant")


def unescaped_source(html: Column) -> Column:
    """Page source whose JSON is escaped inside strings, with quotes and slashes as they were."""
    return F.replace(F.replace(html, F.lit('\\"'), F.lit('"')), F.lit("\\/"), F.lit("/"))


def first_match(text: Column, patterns: list[str], group: int = 1) -> Column:
    """The group of the first pattern that matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


def greatest_number(text: Column, pattern: str, group: int = 1) -> Column:
    """The greatest of all numbers that a pattern finds, read by its digits."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.array_max(F.transform(found, lambda x: F.regexp_replace(x, "[^0-9]", "").try_cast("bigint")))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without query, fragment and slashes at the end."""
    bare = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    host = F.regexp_extract(bare, r"(?i)^[a-z]+://[^/]*", 0)
    return F.concat(F.lower(host), F.regexp_replace(F.regexp_replace(bare, r"(?i)^[a-z]+://[^/]*", ""), "/+$", ""))
