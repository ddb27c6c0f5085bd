"""Page sources: bytes to text, HTML parsing, robots and sitemap readers."""

from __future__ import annotations

import gzip
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SKIPPED = {"script", "style", "noscript"}
# Link schemes that are never followed.
NO_LINK = ("javascript:", "mailto:", "tel:", "data:")
MAX_HTML, MAX_XML, MAX_ROBOTS = 2_000_000, 2_000_000, 512 * 1024
PARSED = "doc_id bigint, title string, text string, links array<string>, images array<struct<url:string,alt:string>>, lang string"


class _Page(HTMLParser):
    """Collects what a page says: a handler for each tag that matters, everything else is passed over."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.open = base, Counter()
        self.title, self.parts, self.links, self.images, self.lang = [], [], [], [], ""
        self.on = {"html": self._html, "meta": self._meta, "a": self._link, "img": self._image}

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED or tag == "title":
            self.open[tag] += 1
        elif tag in self.on:
            said: dict[str, str] = {}
            for name, value in attrs:  # of a repeated attribute the first counts
                said.setdefault(name, (value or "").strip())
            self.on[tag](said)

    def handle_endtag(self, tag):
        if self.open[tag]:
            self.open[tag] -= 1

    def handle_data(self, data):
        words = data.strip()
        if words and not any(self.open[t] for t in SKIPPED):
            self.parts.append(words)
            if self.open["title"]:
                self.title.append(words)

    def _html(self, said):
        self.lang = said.get("lang") or said.get("xml:lang") or self.lang

    def _meta(self, said):
        if said.get("http-equiv", "").lower() == "content-language" or said.get("name", "").lower() in ("language", "lang"):
            self.lang = said.get("content", "").partition(",")[0].strip() or self.lang

    def _absolute(self, address: str) -> str | None:
        try:
            return urljoin(self.base, address)
        except ValueError:  # one bad address costs itself only
            return None

    def _link(self, said):
        target = said.get("href", "")
        if target and not target.startswith(NO_LINK) and (found := self._absolute(target)) is not None:
            self.links.append(found)

    def _image(self, said):
        source = said.get("src") or said.get("data-src") or ""
        if source and not source.startswith("data:") and (found := self._absolute(source)) is not None:
            self.images.append((found, said.get("alt", "")))


def parse_page(html: str | None, base: str | None) -> tuple:
    """(title, text, links, images, lang); the title's text is part of the text, malformed markup is read as far as it goes."""
    page = _Page(base or "")
    try:
        page.feed(html or "")
        page.close()
    except (ValueError, AssertionError):
        pass
    return " ".join(page.title), " ".join(page.parts), page.links, page.images, page.lang


def parse_html(pages: DataFrame, html: str = "raw_html", url: str = "url") -> DataFrame:
    """Parsed pages, one row each, in Arrow batches; pages without HTML or above the size limit are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [parse_page(h, u) for h, u in zip(b.html, b.url)]
            out = pd.DataFrame(rows, columns=["title", "text", "links", "images", "lang"])
            out["images"] = [[{"url": u, "alt": a} for u, a in x] for x in out["images"]]
            yield pd.concat([b.doc_id.reset_index(drop=True), out], axis=1)

    some = pages.filter(F.col(html).isNotNull() & (F.octet_length(html) <= MAX_HTML)).select("doc_id", F.col(html).alias("html"), F.col(url).alias("url"))
    return some.mapInPandas(run, PARSED)


def html_title(html: Column) -> Column:
    """The title by regular expression: for well-formed pages without entities, wholly in the JVM."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_language(html: Column) -> Column:
    return F.regexp_extract(html, r"(?i)<html[^>]*\blang=\"([^\"]*)\"", 1)


@F.pandas_udf(StringType())
def decode(raw: pd.Series) -> pd.Series:
    """Bytes to text: gunzipped where they begin like gzip, UTF-8 with bad bytes dropped."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        if b[:2] == b"\x1f\x8b":
            try:
                b = gzip.decompress(b)
            except (OSError, EOFError):
                return ""
        return b.decode("utf-8", "ignore")

    return raw.map(one)


ROBOTS = "host string, ord int, pattern string, allow boolean, delay double, sitemap string"


def robots_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """(host, ord, pattern, allow, delay, sitemap) of robots files (host, body): rules of groups that name the agent or ``*``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for host, body in zip(b.host, b.body):
                applies, open_group, delay, order = False, False, None, 0
                for line in (body or "").splitlines():
                    key, _, value = line.partition("#")[0].partition(":")
                    key, value = key.strip().lower(), value.strip()
                    if key == "user-agent":
                        applies = (applies and open_group) or value.lower() in ("*", agent.lower())
                        open_group = True
                        continue
                    open_group = False if key in ("allow", "disallow", "crawl-delay") else open_group
                    if key == "sitemap" and value:
                        rows.append((host, None, None, None, None, value))
                    elif applies and key in ("allow", "disallow"):
                        rows.append((host, order, value, key == "allow", None, None))
                        order += 1
                    elif applies and key == "crawl-delay":
                        try:
                            delay = float(value)
                        except ValueError:
                            continue
                if delay is not None:
                    rows.append((host, None, None, None, delay, None))
            yield pd.DataFrame(rows, columns=["host", "ord", "pattern", "allow", "delay", "sitemap"]).astype({"ord": "Int32", "delay": "float64"})

    return files.filter(F.octet_length("body") <= MAX_ROBOTS).select("host", "body").mapInPandas(run, ROBOTS)


def sitemap_urls(files: DataFrame) -> DataFrame:
    """(host, url) of sitemap bodies: ``<loc>`` elements, or lines with an address where the body is no XML."""
    body = F.col("body")
    locs = F.regexp_extract_all(body, F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)"), F.lit(1))
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.contains("://"))
    found = F.when(body.contains("<"), locs).otherwise(lines)
    return files.filter(F.octet_length("body") <= MAX_XML).select("host", F.explode(F.array_distinct(found)).alias("url"))


def html_pages(fetched: DataFrame) -> DataFrame:
    """(page_id, url, html) of fetched bodies (page_id, url, content_type, body): pages by type or without one, cut at the size limit."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    some = fetched.filter(F.col("body").isNotNull() & ((kind == "") | kind.contains("text/html") | kind.contains("application/xhtml")))
    return some.select("page_id", "url", decode(F.substring("body", F.lit(1), F.lit(MAX_HTML))).alias("html"))
